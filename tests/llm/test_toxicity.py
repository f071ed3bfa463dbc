import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import toxicity as T
from lumenfold.llm.queries import op6_toxicity


def independent(texts, toxic, all_texts, weighting):
    """Cosines of every text with every example, from raw texts and dictionaries alone."""
    words = [Counter(re.findall(r"[^\W_]+", (t or "").lower())) for t in texts]
    known = [w for w, y in zip(words, toxic, strict=True) if y is not None]
    labels = [y for y in toxic if y is not None]
    terms = set().union(*known)
    df = Counter(w for t in all_texts for w in set(re.findall(r"[^\W_]+", (t or "").lower())))

    def factor(t):
        plain = math.log((len(all_texts) + 1) / (df[t] + 1)) + 1
        if weighting == "plain":
            return plain
        has, y = [t in w for w in known], [bool(x) for x in labels]
        n11 = sum(a and b for a, b in zip(has, y, strict=True))
        n1, m1, n = sum(has), sum(y), len(y)
        variance = n1 * (n - n1) * m1 * (n - m1)
        return plain * (0.002 + (abs(n * n11 - n1 * m1) / math.sqrt(variance) if variance else 0))

    of = {t: factor(t) for t in terms}

    def unit(c):
        v = {t: (1 + math.log(n)) * of[t] for t, n in c.items() if t in of}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    units = [unit(c) for c in words]
    return [[sum(x * b.get(t, 0) for t, x in a.items()) for b, y in zip(units, toxic, strict=True) if y is not None] for a in units]


@pytest.mark.parametrize("weighting", ["plain", "label"])
def test_neighbours_from_raw_texts(spark, weighting):
    docs, labels = corpus(spark, 120)
    docs = docs.unionByName(spark.createDataFrame([(900, "w1 w2 unseen words"), (901, ""), (902, None), (903, "w3 " * 3000 + "Idiot")], docs.schema))
    m = T.fit(docs, labels, weighting=weighting)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    toxic = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    known = [r.doc_id for r in rows if r.doc_id in toxic]
    want = independent([r.text for r in rows], [toxic.get(r.doc_id) for r in rows], [r.text for r in rows], weighting)
    for r, cosines in zip(rows, want, strict=True):
        examples, cosine, places = m.neighbours(m.vector(r.text), m.index.common([m.vector(r.text)])[0])
        of = dict(zip(known, cosines, strict=True))
        kth = sorted(cosines)[-15]
        assert {m.ids[i] for i in examples} == {i for i, c in of.items() if c >= kth - 1e-9}
        assert cosine == pytest.approx([of[m.ids[i]] for i in examples], abs=1e-9) and places.sum() == pytest.approx(15)


def test_blocks_are_left_out_and_the_result_is_exact():
    rng = np.random.default_rng(1)
    rows = [(np.unique(rng.integers(8 * (j // 40), 8 * (j // 40) + 12, 6)), None) for j in range(800)]
    rows = [(t, (w := rng.uniform(0.1, 1, len(t))) / np.linalg.norm(w)) for t, _ in rows]
    dense = np.zeros((800, 200))
    for j, (t, w) in enumerate(rows):
        dense[j, t] = w
    index = T.Index(200, rows)
    blocks = []
    for j in range(0, 800, 7):
        examples, cosine, read = index.nearest(rows[j], index.common([rows[j]])[0], 15)
        every = dense @ dense[j]
        kth = np.sort(every)[-15]
        assert set(examples) == set(np.flatnonzero(every >= kth - 1e-9)) and cosine == pytest.approx(every[examples])
        blocks.append(read)
    assert max(blocks) < index.n_blocks


def test_ties_share_places():
    ones = [(np.array([0]), np.array([5.0]))] * 40
    m = T.Model({"a": 0}, np.ones(1), tuple(map(np.concatenate, zip(*[(*v, np.ones(1, np.int64)) for v in ones]))), np.array([True] * 10 + [False] * 30), np.arange(40), 0.25, (1.0, 1.0), 15)
    query = T.unit(np.array([0]), np.array([1.0]), np.ones(1))
    assert m.vote(query, m.index.common([query])[0])[0] == pytest.approx(0.25, abs=0.02)


def corpus(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        words = [f"w{i * k % 97}" for k in range(1, 40)] + (["Moron!", "scumbag", "idiot"] if toxic else [])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(spark):
    docs, labels = corpus(spark)
    m = T.fit(docs, labels)
    rows = T.score(docs, m).collect()
    assert all(r.predicted == (r.doc_id % 8 == 0) for r in rows) and all(0 <= r.score <= 1 and len(r.nearest) == 3 for r in rows)


def test_labels_of_the_held_out_fold_have_no_part(spark):
    docs, labels = corpus(spark)
    turned = labels.withColumn("toxic", F.when(T.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in T.score(docs, T.fit(docs, labels)).collect()}
    assert a == {r.doc_id: r.score for r in T.score(docs, T.fit(docs, turned)).collect()}


def test_edges(spark):
    docs, labels = corpus(spark, 100)
    odd = spark.createDataFrame([(1000, None, 1), (1001, "", 2), (None, "idiot", 3), (1002, "x " * 50_000, 4), (1002, "x " * 50_000, 4)], "doc_id long, text string, score int")
    m = T.fit(docs, labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, 1, None), (99999, 1, 1), (0, 1, 0)], labels.schema)))
    out = T.score(odd, m)
    rows = out.collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and out.columns.count("score") == 1
    assert len({r.score for r in rows if r.doc_id == 1002}) == 1
    none = T.fit(docs, labels.limit(0))
    assert {r.score for r in T.score(docs, none).collect()} == {0.0}
    assert T.score(odd.limit(0), m).count() == 0
    only = T.fit(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in T.score(docs, only).collect()} == {0}
    assert T.score(docs, T.fit(docs.limit(0), labels)).count() == 100


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op6_toxicity(spark, sf).collect() if r.doc_id in labels and r.held_out]
    right = sum(r.predicted == labels[r.doc_id] for r in rows)
    assert right / len(rows) > 0.98 and len(rows) > 700 and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)


def test_curve_is_fitted_without_an_index_in_the_driver(spark):
    model = T.fit(*corpus(spark, 120))
    assert "index" not in model.__dict__ and "examples" not in model.__dict__
    curve = model.curve
    model.fit_curve()
    assert np.allclose(curve, model.curve)
