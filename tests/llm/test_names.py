"""Every operator keeps columns whose names are those of its own columns, and their values."""

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import html, lm, linededup, media, mixing, pieces, sharding, simhash, topk, toxicity

NAMES = """rate cdf u w n of_source rate_source w_source salt salt_ deal shuffle_keys keep_id keep_mark again_id again_mark mark place_ place key row fp component
    component_id toxicity example_id toxic c0 c1 k0 d t at from to cuts deleted new_text c_text c_doc_id head host p_host t_host t_texts t_container known links
    batch record virtual_slot copies size shard slot content m s word times cold row_ lang source_ h page_no texts container""".split()


@pytest.fixture(scope="module")
def docs(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{line}\nown words of {i % 7}", "a" if i % 3 else None, i) for i in range(40)] + [(None, None, None, -1), (3, f"{line}\nown words of 3", None, 99)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, tag int")
    return frame.select("*", *[F.concat(F.lit(f"{name}:"), F.col("tag")).alias(name) for name in NAMES], F.lit(1).alias("a.b"))


def survive(before, after, gone=()):
    kept = [c for c in before.columns if c.lower() not in gone]
    assert [c for c in after.columns if c in kept] == kept
    for r in after.collect():
        assert all(r[name] == f"{name}:{r.tag}" for name in NAMES if name in kept)
        assert r["a.b"] == 1


def test_mixing(docs):
    survive(docs, mixing.poisson_mix(docs))


def test_mixing_by_join(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    survive(docs, mixing.poisson_mix(docs))


def test_keep_one(docs):
    survive(docs, simhash.keep_one(docs))


def test_line_dedup(docs):
    out = linededup.dedup_lines(docs)
    survive(docs, out)
    assert out.count() == docs.count()


def test_pieces(docs):
    survive(docs, pieces.encode(docs, pieces.Vocabulary.load()))


def test_toxicity(docs, spark):
    labels = spark.createDataFrame([(i, int(i % 7 == 1)) for i in range(40)], "doc_id long, toxic int")
    survive(docs, toxicity.score(docs, toxicity.fit(docs, labels)))


def test_html(docs):
    pages = docs.withColumn("page_id", F.col("doc_id")).withColumn("url", F.concat(F.lit("http://x.example/"), F.coalesce("doc_id", F.lit(0)))).withColumn(
        "html", F.concat(F.lit("<nav>menu</nav><article><p>"), F.col("text"), F.lit("</p></article>"))
    )
    survive(pages, html.extract(pages), {"text", "n_chars", "html"})


def test_those_that_return_their_own_columns(docs, spark):
    assert sharding.assign(docs).count() == docs.count() and media.store_texts(docs).count() == docs.count()
    assert lm.score_all(docs).count() == docs.count() and simhash.by_fingerprint(docs).count() == docs.count()
    vectors = spark.createDataFrame([(i, [i, 1]) for i in range(20)], "vec_id long, v array<long>").withColumns({n: F.lit(1) for n in ("rank", "score", "query_id", "query_key", "block", "term")})
    assert topk.top_k(vectors, F.col("vec_id") % 10 == 0, 3).count() == 6
