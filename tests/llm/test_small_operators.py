import collections
import math
import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import mixing, sharding
from lumenfold.llm.queries import ORACLE_SQL, op7_sharding, op10_mixing
from tests.compare import connect, same


def test_growth_moves_only_to_the_new_shard():
    now = sharding.initial_map(1)
    for n in range(2, 40):
        new = now.grow()
        assert all(b in (a, n - 1) for a, b in zip(now.shards, new.shards, strict=True)) and new.version == now.version + 1
        sizes = collections.Counter(new.shards)
        assert len(sizes) == n and max(sizes.values()) - min(sizes.values()) <= 2
        now = new


def test_rebalance():
    now = sharding.initial_map(8)
    load = {s: (s * 7919) % 1000 + 5000 * (s % 97 == 0) for s in range(sharding.N_SLOTS)}
    new = now.rebalance(load)
    by = collections.Counter()
    for s, shard in enumerate(new.shards):
        by[shard] += load[s]
    mean = sum(by.values()) / 8
    assert max(by.values()) <= mean * 1.021 and len(new.moved) < 400 and now.rebalance({}).moved == ()


def test_sharding_query(spark, sf):
    rows = op7_sharding(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    places = collections.defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "key" and r.grown_shard in (r.shard, 16)
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(16))


def test_only_the_id_decides(spark):
    a = spark.createDataFrame([(i, "x" * i) for i in range(300)], "doc_id long, text string")
    b = spark.createDataFrame([(i, None) for i in range(0, 900, 3)], "doc_id long, text string")
    one = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign(a).collect()}
    two = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign(b).collect()}
    assert all(one[i] == two[i] for i in one if i in two)


def test_sharding_edges(spark):
    rows = spark.createDataFrame([(None, None, 1), (None, None, 1), (7, "é", 2)], "doc_id long, text string, shard int")
    out = sharding.assign(rows).collect()
    assert sorted((r.size, r.text_crc32) for r in out) == [(1, 0), (1, 0), (3, zlib.crc32("é".encode()))]
    assert sharding.assign(rows.limit(0)).count() == 0


def test_stored_maps(spark):
    name = f"t{uuid.uuid4().hex}"
    assert sharding.load_map(spark, name) is None and sharding.versions(spark, name) == []
    three = sharding.stored_map(spark, 3, 64, name)
    assert three == sharding.initial_map(3, 64) and sharding.load_map(spark, name) == three
    for _ in range(2):  # a job that is run again
        sharding.save_map(spark, name, three)
        assert sharding.stored_map(spark, 3, 64, name) == three
    five = sharding.stored_map(spark, 5, 64, name)
    assert sharding.versions(spark, name) == [3, 5] and five == sharding.load_map(spark, name) == sharding.initial_map(5, 64)
    even = five.rebalance({s: 1000 if s < 8 else 1 for s in range(64)})
    sharding.save_map(spark, name, even)
    assert even.moved and sharding.load_map(spark, name) == even and sharding.load_map(spark, name, 3) == three
    with pytest.raises(ValueError, match="another map"):
        sharding.save_map(spark, name, sharding.SlotMap(3, (0,) * 64))
    assert spark.read.parquet(sharding._folder(spark, name)).groupBy("map_version").count().count() == 3


@pytest.mark.parametrize("run", [sharding.RUN, 50, 7, 1])
def test_repeated_rows_have_places_of_their_own(spark, monkeypatch, run):
    monkeypatch.setattr(sharding, "RUN", run)
    rows = spark.createDataFrame([(None, "x")] * 50 + [(1, "y")] * 30 + [(1, "z")] * 20 + [(i, "w") for i in range(100)], "doc_id long, text string")
    places = collections.defaultdict(list)
    for r in sharding.assign(rows, 2).collect():
        places[r.shard].append(r.slot)
    assert sum(map(len, places.values())) == 200 and all(sorted(p) == list(range(len(p))) for p in places.values())


def test_mixing_query(spark):
    sf = "/root/testdata/sf0.01"
    same(op10_mixing(spark, sf), connect(sf), ORACLE_SQL["op10_mixing"])


def test_poisson(spark):
    rows = spark.createDataFrame([(r, i / 97) for r in (0.05, 3.0, 900.0) for i in range(97)] + [(r, 1 - 2**-40) for r in (0.05, 3.0, 900.0)], "r double, u double")
    for r in rows.select("r", "u", mixing.poisson_inverse(F.col("r"), F.col("u")).alias("k")).collect():
        below = [math.exp(-r.r + k * math.log(r.r) - math.lgamma(k + 1)) for k in range(r.k + 1)]
        assert math.fsum(below) > r.u - 1e-6 and math.fsum(below[:-1]) <= r.u + 1e-6 and r.k < r.r + 9 * r.r**0.5 + 20


def test_weights(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "big" if i % 10 else "small", "t") for i in range(6000)], "doc_id long, source string, text string")
    n = collections.Counter(r.source for r in mixing.poisson_mix(docs, {"big": 1.0, "small": 3.0, "none": 2.0}, 20_000).collect())
    assert abs(n["big"] - 5000) < 300 and abs(n["small"] - 15_000) < 500
    whole = sorted(mixing.poisson_mix(docs, {"big": 1.0, "small": 3.0, "none": 2.0}, 20_000).collect())
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(mixing.poisson_mix(docs, {"big": 1.0, "small": 3.0, "none": 2.0}, 20_000).collect()) == whole
    assert mixing.poisson_mix(docs, {"big": 0.0}).count() == 0


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else "s", None) for i in range(500)] + [(None, None, "x"), (1, None, None), (1, None, None)], "doc_id long, source string, text string")
    docs = docs.withColumn("n", F.lit(1)).withColumn("u", F.lit(2)).withColumn("rate", F.lit(3))
    out = mixing.poisson_mix(docs)
    n = collections.Counter(r.source for r in out.collect())
    assert n[None] > 150 and n["s"] > 150 and mixing.poisson_mix(docs.limit(0)).count() == 0
    assert out.select("shuffle_key").distinct().count() > 100 and {(r.n, r.u, r.rate) for r in out.collect()} == {(1, 2, 3)}
