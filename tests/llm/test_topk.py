import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import topk
from lumenfold.llm.queries import ORACLE_SQL, op4_topk
from tests.compare import connect, same


def brute(rows, k):
    out = []
    for q, v in rows:
        if q is None or v is None or q % 2:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i is not None and w is not None and i != q)
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_exact_with_ties_and_shards(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-3, 4) for _ in range(6)]) for i in range(120)] + [(500 + i, [1, 1, 1, 1, 1, 1]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.top_k(frame, F.col("vec_id") % 2 == 0, 10, shard_rows=25)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, 10)


def test_shard_prunes_but_stays_exact():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 32)).round(2) * 1024 // 1
    x[:, 4:] *= 0.01
    x = x.astype(np.int64)
    shard = topk.Shard(np.arange(4000), x)
    for q in range(0, 4000, 400):
        ids, scores = shard.top(x[q], q, 10)
        full = x @ x[q]
        want = sorted((-int(full[i]), i) for i in range(4000) if i != q)[:10]
        assert list(zip((-scores).tolist(), ids.tolist())) == want


def test_big_numbers(spark):
    rows = [(0, [1 << 29, 3]), (1, [1 << 29, 2]), (2, [-(1 << 29), 1])]
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.top_k(frame, F.col("vec_id") == 0, 2)
    assert [(r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [(1, (1 << 58) + 6), (2, 3 - (1 << 58))]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (2, [0.5]), (4, []), (6, None), (8, [nan, 1.0]), (10, [inf, 1.0]), (12, [None, 1.0]), (None, [1.0, 1.0]), (2, [0.25])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    q = frame.select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    got = sorted(tuple(r) for r in topk.top_k(q, F.col("vec_id") == 0, 10).select("rank", "vec_id", "score").collect())
    assert got == [(1, 2, 512 * 512), (2, 2, 512 * 256), (3, 4, 0)]
    assert topk.top_k(q.limit(0), F.col("vec_id") == 0, 10).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    same(op4_topk(spark, sf), connect(sf), ORACLE_SQL["op4_topk"])
