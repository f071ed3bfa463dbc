import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import exactdedup
from lumenfold.llm.queries import ORACLE_SQL, op12_exact_dedup
from tests.compare import connect, same

ROWS = [
    (5, "a  b"), (3, "a\tb"), (9, "a b"), (4, " a b"), (4, "other"), (4, "other"), (7, None), (6, ""), (1, " "), (8, "\n\r\x0b\x0c"), (None, "a b"), (None, "lone"),
    (12, "a b"), (13, "x" * 200_000), (11, "x" * 200_000 + " "), (10, "x" * 200_000), (20, "é"), (21, "é"),
]


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", text or ""), []).append(i)
    out = []
    for norm, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is None, i or 0))
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, order[0], len(ids), n == 0, digest) for n, i in enumerate(order)]
    return sorted(out, key=repr)


def told(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def table(spark, tmp_path, rows, name="t", parts=3):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("d")).withColumn("file", F.lit(1)).withColumn("_metadata", F.lit("m")).withColumn("n", F.lit(None).cast("int"))
    path = f"{tmp_path}/{name}.parquet"
    frame.repartition(parts).write.parquet(path)
    return path


def test_as_brute_force(spark, tmp_path):
    assert told(exactdedup.deduplicate(spark, table(spark, tmp_path, ROWS))) == brute(ROWS)


@pytest.mark.parametrize("digest_bytes", [0, 1])
def test_digests_that_clash_are_told_apart_by_bytes(spark, tmp_path, digest_bytes):
    rows = ROWS + [(100 + i, f"text {i % 40}") for i in range(120)]
    assert told(exactdedup.deduplicate(spark, table(spark, tmp_path, rows), digest_bytes=digest_bytes)) == brute(rows)


@pytest.mark.parametrize("bounds", [{"heavy": 1, "heavy_from": 2}, {"heavy": 0, "broadcast_bytes": 0}])
def test_bounds_change_no_result(spark, tmp_path, bounds):
    path, state = table(spark, tmp_path, ROWS), f"{tmp_path}/state"
    exactdedup.ingest(spark, path, state)
    assert told(exactdedup.decisions(spark, path, state, **bounds)) == brute(ROWS)


def test_later_files_meet_what_came_before(spark, tmp_path):
    state = f"{tmp_path}/state"
    path = table(spark, tmp_path, ROWS[:9])
    assert told(exactdedup.deduplicate(spark, path, state)) == brute(ROWS[:9])
    spark.createDataFrame(ROWS[9:], "doc_id long, text string").write.mode("append").parquet(path)
    assert told(exactdedup.deduplicate(spark, path, state)) == brute(ROWS)
    # Nothing new: nothing is taken in, and the answer stays.
    assert told(exactdedup.deduplicate(spark, path, state)) == brute(ROWS)


def test_a_batch_that_broke_off_is_done_again(spark, tmp_path):
    path, state = table(spark, tmp_path, ROWS), f"{tmp_path}/state"
    exactdedup.ingest(spark, path, state)
    # As if the driver was lost after the last batch's work and before its commit was noted.
    (spark._jvm.java.io.File(f"{state}/groups-log/commits/0")).delete()
    (spark._jvm.java.io.File(f"{state}/groups-log/commits/.0.crc")).delete()
    assert told(exactdedup.deduplicate(spark, path, state)) == brute(ROWS)


def test_one_large_group_and_empty_tables(spark, tmp_path):
    rows = [(i, "same  text" if i % 3 else "same text") for i in range(3000)] + [(5000, "lone")]
    path = table(spark, tmp_path, rows, parts=8)
    assert told(exactdedup.deduplicate(spark, path)) == brute(rows)
    assert told(exactdedup.deduplicate(spark, table(spark, tmp_path, [], "empty", 1))) == []


def test_survivors_keep_all_columns(spark, tmp_path):
    path = table(spark, tmp_path, ROWS[:6])
    docs = spark.read.parquet(path).drop("_metadata")
    plain = f"{tmp_path}/plain.parquet"
    docs.write.parquet(plain)
    left = exactdedup.survivors(spark, plain, exactdedup.deduplicate(spark, plain))
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(3, "a\tb"), (4, " a b"), (4, "other")]


def test_no_python_in_plan(spark, tmp_path):
    plan = exactdedup.deduplicate(spark, table(spark, tmp_path, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    same(op12_exact_dedup(spark, sf), connect(sf), ORACLE_SQL["op12_exact_dedup"])
