import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenfold.llm import alignment
from lumenfold.llm.queries import op11_alignment


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(alignment.BYTE_VOCABULARY)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_VOCABULARY)


def byte_of():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(rows, models):
    """One text and one token after the other, by the libraries' own encoders."""
    a, b = models
    table, found = byte_of(), []
    for key, text in rows:
        text = text or ""
        want = (" " + text).encode() if text else b""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            ids_a, ids_b = [], []
        ends_a, ends_b, at = {}, {}, 0
        for i, t in zip(ids_a, bytes_a):
            at += len(t)
            ends_a[at] = i
        at = 0
        for i, t in zip(ids_b, bytes_b):
            at += len(t)
            ends_b[at] = i
        groups, links, left, right = [], [], [], []
        for end in sorted(set(ends_a) | set(ends_b)):
            left += [str(ends_a[end])] if end in ends_a else []
            right += [str(ends_b[end])] if end in ends_b else []
            if end in ends_a and end in ends_b:
                groups.append(",".join(left) + "|" + ",".join(right))
                links.append((ends_a[end], ends_b[end]))
                left, right = [], []
        found.append((key, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    counts = Counter(p for f in found for p in f[4])
    best = {}
    for (_, i), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    return counts, sorted(
        ((k, na, nb, g, len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), d) for k, na, nb, g, ls, d in found), key=repr
    )


def told(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


ROWS = [
    (1, "The quick brown fox, the quick  brown fox\n\tthe end."), (2, None), (3, ""), (4, " "), (5, "<|endoftext|> and <s> </s> <unk> <0x41>"), (6, "a▁b"),
    (7, "naïve Straße 東京 \U0001f600 ́​"), (8, "ﬁ ½ Ⅷ"), (None, "The quick brown fox"), (1, "The quick brown fox, the quick  brown fox\n\tthe end."),
    (9, "word " * 60_000), (10, "-" * 50_000), (11, " " * 250_000), (12, "\r\n\r\n x"), (13, "\x00\x01"),
] + [(20 + i, "the same words again and again") for i in range(50)]


@pytest.mark.parametrize("parts", [1, 4])
def test_as_brute_force(spark, models, parts):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("links", F.lit("l")).withColumn("n_A", F.lit(1)).withColumn("own_text", F.lit("o")).repartition(parts)
    got = alignment.align(docs)
    assert told(got) == brute(ROWS, models)[1]
    assert {"text", "own_text"} <= set(got.columns) and "links" not in got.columns


def test_counts_and_shards(spark, models):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    links = alignment.linked(docs, keep_text=False)
    manifest = alignment.count_shards(links, shard_pairs=7)
    shards = sorted(tuple(r) for r in manifest.select("first", "last", "pairs").collect())
    assert len(shards) > 5 and all(a[1] < b[0] for a, b in zip(shards, shards[1:])) and all(s[2] <= 7 for s in shards)
    counts, rows = brute(ROWS, models)
    pairs = alignment.pair_table(manifest).collect()
    assert {(r.id_a, r.id_b): r.n for r in pairs} == counts and len(pairs) == len(counts)
    top = {b: max(n for (_, i), n in counts.items() if i == b) for _, b in counts}
    assert all(r.is_best == (r.n == top[r.id_b]) for r in pairs)
    assert told(alignment.with_counts(links, manifest)) == rows


def test_empty_table(spark):
    assert told(alignment.align(spark.createDataFrame([], "doc_id long, text string"))) == []
    assert told(alignment.align(spark.createDataFrame([(1, None)], "doc_id long, text string"))) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_folding():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 50, 300) for _ in range(5)]
    k, n = alignment.folded(parts, [np.ones(300, np.int64)] * 5)
    want = Counter(np.concatenate(parts).tolist())
    assert dict(zip(k.tolist(), n.tolist())) == want and list(k) == sorted(want)


def test_partial_counts_go_on_when_there_are_many(spark, models, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)
    links = alignment.linked(docs, keep_text=False)
    monkeypatch.setattr(alignment, "FOLD", 4)
    got = Counter()
    for r in alignment.partial_counts(links).collect():
        got[(r.pair >> 32, r.pair & 0xFFFFFFFF)] += r.n
    assert got == brute(ROWS, models)[0]


def test_query(spark, models):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert told(op11_alignment(spark, sf)) == brute(rows, models)[1]
