"""The corpus queries, each an operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import alignment, anagrams, exactdedup, html, linededup, lm, media, mixing, pieces, sharding, simhash, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.by_fingerprint(docs).select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, pieces.Vocabulary.load()).drop("text")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return topk.top_k(rows, F.col("vec_id") % 100 == 0, 10)


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_all(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    held_out = (toxicity.fold(F.col("doc_id")) == 0).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted", "nearest", "nearest_cosine")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents").select("doc_id", "text"), 16)


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return linededup.dedup_lines(docs)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.poisson_mix(docs, seed=17)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.align(docs, keep_text=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.deduplicate(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = anagrams.slipped_words(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return anagrams.variants(words)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_simhash": op2_simhash,
    "op3_pieces": op3_pieces,
    "op4_topk": op4_topk,
    "op5_lm": op5_lm,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_linededup": op8_linededup,
    "op9_media": op9_media,
    "op10_mixing": op10_mixing,
    "op11_alignment": op11_alignment,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_spelling": op13_spelling,
}

def _crc_steps() -> str:
    """What four bits do to a CRC-32, for each value of them, as a SQL list."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return str(table)


ORACLE_SQL: dict[str, str] = {
    "op12_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
    """,
    "op13_spelling": f"""
        WITH RECURSIVE r AS (
            SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL
        ), x AS (
            SELECT run, times, hex(doc_id || ':' || run) AS d FROM r WHERE length(run) >= 7
        ), b AS (
            -- The low four bits of each byte come before the high ones.
            SELECT run, times, list_transform(range(1, length(d) + 1), lambda i: strpos('0123456789ABCDEF', d[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1) AS bits FROM x
        ), h AS (
            SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(bits, lambda v: v::BIGINT)),
                lambda c, v: xor(c >> 4, ({_crc_steps()}::BIGINT[])[(xor(c, v) & 15) + 1]))) AS h FROM b
        ), w AS (
            SELECT CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, times FROM h
        ), v AS (
            SELECT word, CAST(sum(times) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
        ), d AS (
            SELECT word, n, i, word[1 : i] || word[i + 2 :] AS less FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)
        ), p AS (
            SELECT DISTINCT a.word AS a, b.word AS b, b.n AS m FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
            UNION SELECT DISTINCT v.word, d.word, d.n FROM v JOIN d ON d.less = v.word
            UNION SELECT DISTINCT d.word, v.word, v.n FROM v JOIN d ON d.less = v.word
        ), k AS (
            SELECT a, b, m, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY m DESC, b) AS rn FROM p
        ), f AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN b END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
            FROM v LEFT JOIN k ON a = word AND rn = 1
        ), s AS (
            SELECT word AS start, word AS at, form AS next FROM f
            UNION ALL SELECT s.start, f.word, f.form FROM s JOIN f ON f.word = s.next
        )
        SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM f JOIN s ON s.start = f.word AND s.next IS NULL
    """,
    "op4_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s
        )
        SELECT query_id, CAST(rn AS INTEGER) AS "rank", vec_id, score FROM r WHERE rn <= 10
    """,
    "op10_mixing": """
        WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        r AS (SELECT source, (SELECT sum(n) FROM s) / (SELECT count(*) FROM s) / n AS rate FROM s),
        cdf AS (
            SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS c
            FROM r, LATERAL (SELECT unnest(range(0, CAST(ceil(rate + 14 * sqrt(rate) + 31) AS BIGINT))) AS k)
        ),
        d AS (
            SELECT doc_id, source, text,
                   CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
            FROM documents
        ),
        n AS (
            SELECT doc_id, d.source, text, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND c <= u) AS n_copies
            FROM d
        ),
        x AS (SELECT doc_id, source, text, n_copies, unnest(range(0, n_copies)) AS copy_no FROM n WHERE n_copies > 0)
        SELECT doc_id, source, text, CAST(n_copies AS INTEGER) AS n_copies, CAST(copy_no AS INTEGER) AS copy_no,
               CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy_no), 1, 13) AS BIGINT) AS shuffle_key
        FROM x
    """,
}
