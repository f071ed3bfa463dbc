"""Nearest centroids by pivots and blocks, against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import nearest


def tables(spark, x, c, ids=None):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(3)
    named = zip(ids if ids is not None else range(len(c)), c, strict=True)
    return rows, spark.createDataFrame([(int(i), v.tolist()) for i, v in named], "cluster_id long, centroid array<double>")


def brute(x, c, below, ids=None):
    ids = list(range(len(c))) if ids is None else list(ids)

    def unit(v):
        v = np.nan_to_num(v, nan=0.0, posinf=0.0, neginf=0.0)
        return v / (np.linalg.norm(v) or 1.0)

    c, found = [unit(v) for v in c], {}
    for i, v in enumerate(x):
        d, k = min((round(float(np.sqrt(max(0.0, 2 - 2 * (unit(v) * w).sum()))), 7), k) for k, w in zip(ids, c, strict=True))
        if d < below:
            found[i] = (k, d)
    return found


def result(df):
    rows = df.collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: (r.cluster_id, round(r.distance, 7)) for r in rows}


def small(monkeypatch, pivots=7, rows=16, width=6):
    monkeypatch.setattr(nearest, "PIVOTS", pivots)
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 8 * width * rows)
    monkeypatch.setattr(nearest, "CHUNKS", 2)


@pytest.mark.parametrize("below", [0.35, 1.2, 2.5])
def test_against_brute_force(spark, monkeypatch, below):
    rng = np.random.default_rng(int(below * 100))
    c = rng.normal(size=(300, 6))
    x = np.concatenate([c[rng.integers(300, size=150)] + rng.normal(scale=0.1, size=(150, 6)), rng.normal(size=(100, 6)), np.repeat(c[:1] + 0.01, 120, axis=0)])
    x[3, 2], x[4, 1], x[5] = np.nan, np.inf, 0.0
    small(monkeypatch)
    ids = rng.permutation(300) * 3 + 5
    assert result(nearest.search(*tables(spark, x, c, ids), below)) == brute(x, c, below, ids)


def test_ties_and_equal_centroids(spark, monkeypatch):
    c = np.concatenate([np.tile([1.0, 0, 0, 0, 0, 0], (90, 1)), np.tile([0, 2.0, 0, 0, 0, 0], (3, 1)), [[-1.0, 0, 0, 0, 0, 0]]])
    x = np.array([[3.0, 0, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0], [0, 0, 1, 0, 0, 0], [-2, 0, 0, 0, 0, 0]])
    ids = np.arange(94)[::-1]
    small(monkeypatch, 2, 4)
    assert result(nearest.search(*tables(spark, x, c, ids), 3.0)) == brute(x, c, 3.0, ids)


def test_few_blocks_are_met(spark, monkeypatch):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(24, 6))
    c = np.repeat(middles, 40, axis=0) + rng.normal(scale=0.02, size=(960, 6))
    x = np.repeat(middles, 30, axis=0) + rng.normal(scale=0.02, size=(720, 6))
    small(monkeypatch, 60, 40)
    met, answers = [], nearest._answers

    def counted(chunks, blocks, with_vectors):
        pairs = chunks.join(blocks, "block").agg(F.sum(F.col("n") * F.size("clusters"))).first()[0]
        met.append(pairs or 0)
        return answers(chunks, blocks, with_vectors)

    monkeypatch.setattr(nearest, "_answers", counted)
    assert result(nearest.search(*tables(spark, x, c), 0.35)) == brute(x, c, 0.35)
    # All pairs are 691 200.
    assert sum(met) < 691_200 / 8


def test_empty(spark):
    rows, clusters = tables(spark, np.ones((2, 3)), np.ones((2, 3)))
    assert nearest.search(rows.limit(0), clusters, 1.0).count() == 0
    empty = nearest.search(rows, clusters.limit(0), 1.0)
    assert empty.count() == 0 and empty.dtypes == [("id", "bigint"), ("cluster_id", "bigint"), ("distance", "double")]
