import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import duplicates
from lumenfold.schema import conform


def photos(spark, rows):
    """(id, name, bits) as files."""
    data = [(i, f"/d{i}/{name}.jpg", f"{bits:016x}") for i, name, bits in rows]
    frame = spark.createDataFrame(data, "id long, path string, phash string").withColumn("kind", F.lit("image")).withColumn("missing", F.lit(0)).withColumn("too_small", F.lit(0))
    return conform(frame, "files")


def brute(rows, near):
    least = {}
    for i, name, bits in rows:
        least[name, bits] = min(i, least.get((name, bits), i))
    values = [(i, name, bits) for (name, bits), i in least.items()]
    pairs = set()
    for n, (i, name, bits) in enumerate(values):
        for j, other, more in values[:n]:
            d = (bits ^ more).bit_count()
            if name == other and d <= near:
                pairs.add((min(i, j), max(i, j), d))
    group = {i: i for i, _, _ in rows}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in [p[:2] for p in pairs] + [(least[name, bits], i) for i, name, bits in rows]:
        a, b = sorted((top(a), top(b)))
        group[b] = a
    members = {i: top(i) for i, _, _ in rows}
    sizes = {}
    for g in members.values():
        sizes[g] = sizes.get(g, 0) + 1
    return pairs, {(i, g) for i, g in members.items() if sizes[g] > 1}


def some(rng, n, names):
    """Chains of near hashes, copies, and hashes apart, in any order of ids."""
    seeds = [rng.getrandbits(64) for _ in range(12)]
    ids, rows = rng.sample(range(1, 10 * n), n), []
    for i in ids:
        bits = rng.choice(seeds)
        for _ in range(rng.choice((0, 3, 9, 14, 40))):
            bits ^= 1 << rng.randrange(64)
        rows.append((i, rng.choice(names), bits))
    return rows + [(100_000 + k, r[1], r[2]) for k, r in enumerate(rows[:20])]


@pytest.mark.parametrize("heavy, block", [(10**9, 1), (1, 10**6), (1, 13), (120, 40)])
def test_pairs_and_groups(spark, heavy, block):
    rows = some(random.Random(heavy + block), 260, ["img_1", "img_1", "img_1", "img_2", "x"])
    pairs, groups = brute(rows, 12)
    files = photos(spark, rows)
    got = [tuple(r) for r in duplicates.near_pairs(files, heavy=heavy, block=block).select("a", "b", "distance").collect()]
    assert set(got) == pairs and len(got) == len(pairs)
    assert {tuple(r) for r in duplicates.near_groups(files, heavy=heavy, block=block).select("id", "group_id").collect()} == groups


@pytest.mark.parametrize("same", [True, False])
def test_links_of_many_near_hashes_are_few(same):
    """Every pair of 3 000 hashes is near: 4.5 million pairs, and a chain of links."""
    rng = np.random.default_rng(0)
    x = np.array([sum(1 << int(b) for b in rng.choice(20, 5, replace=False)) for _ in range(3000)])
    ids = np.arange(1, 3001)
    left, right = (slice(None), slice(None)) if same else (slice(0, 1500), slice(1500, 3000))
    found = [f for f in duplicates.near_in_blocks(same, x[left], ids[left], x[right], ids[right], 12, True)]
    links = sum(map(len, found))
    assert links == 2999


def test_random_hashes_of_one_name_take_time_by_arrays():
    """Two blocks of 20 000 hashes, 400 million pairs, in seconds."""
    rng = np.random.default_rng(1)
    x, y = (rng.integers(-(2**63), 2**63, 20_000) for _ in range(2))
    began = time.perf_counter()
    found = sum(len(f) for f in duplicates.near_in_blocks(False, x, np.arange(20_000), y, np.arange(20_000, 40_000), 12, False))
    assert found < 200 and time.perf_counter() - began < 30


@pytest.mark.parametrize("query", [duplicates.near_pairs, duplicates.near_groups])
def test_no_side_is_held_whole_by_the_driver(spark, query, tmp_path, monkeypatch):
    """Files of few bytes are taken for small tables, whatever their rows become."""
    plans, kept = [], duplicates.connected_components
    monkeypatch.setattr(duplicates, "connected_components", lambda edges, *names: plans.append(edges) or kept(edges, *names))
    photos(spark, some(random.Random(5), 200, ["img_1", "img_2"])).write.parquet(str(tmp_path / "files"))
    found = query(spark.read.parquet(str(tmp_path / "files")))
    plan = (plans or [found])[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
