"""Files in hand as state of a stream, against a plain reading of the log; over restarts, and a kill in the middle."""

import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lumenfold.sources import checkpoint_log
from lumenfold.streaming import inflight


def plain(logs, most=inflight.MOST_TRIES):
    """Open files of each run: {(run, file): (line, tries)}."""
    out = {}
    for run, lines in logs.items():
        for number, line in enumerate(lines):
            _, event, file_id, *_ = line.split()
            if event == "done":
                out.pop((run, int(file_id)), None)
            elif event == "start":
                out[run, int(file_id)] = (number, out.get((run, int(file_id)), (0, 0))[1] + 1)
    return out


def random_log(seed, n=120, files=9):
    rng = random.Random(seed)
    return [f"{1000 + i}.5 {rng.choice(['start', 'start', 'done', 'stage'])} {rng.randrange(files)} /x y" for i in range(n)]


def put(folder, run, piece, lines):
    (folder / f".{run}.{piece}").write_text("\n".join(lines))
    os.rename(folder / f".{run}.{piece}", folder / f"{run}.{piece}.log")


def found(spark, out):
    return {(r.run, r.file_id): (r.line_no, r.tries) for r in inflight.in_hand(spark.read.parquet(out)).collect()}


def test_against_plain_reading_over_restarts(spark, tmp_path):
    logs = {f"run{i}": random_log(i) for i in range(3)}
    src, out, cp = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    for piece in range(3):
        for run, lines in logs.items():
            put(src, run, piece, lines[40 * piece : 40 * piece + 40])
        inflight.follow(inflight.log_lines(spark, str(src), 2), out, cp, patience=1e9)
        got = {key: ((line >> 33) * 40 + (line & (1 << 33) - 1), tries) for key, (line, tries) in found(spark, out).items()}
        assert got == plain({run: lines[: 40 * piece + 40] for run, lines in logs.items()})
    # The same as the reading of a whole log.
    last = {r.run: r.file_id for r in inflight.last_in_flight(spark.read.parquet(out)).collect()}
    for run, lines in logs.items():
        rows = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
        assert checkpoint_log.last_in_flight(checkpoint_log.parse(rows)).first().file_id == last[run]
    given = {r.id for r in inflight.tombstones(spark.read.parquet(out)).collect()}
    assert given == {f for (_, f), (_, tries) in plain(logs).items() if tries >= inflight.MOST_TRIES}


def test_a_kill_in_the_middle(spark, tmp_path):
    src, out, cp = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    lines = random_log(7)
    for piece in range(4):
        put(src, "r", piece, lines[30 * piece : 30 * piece + 30])

    def struck(batch, number):
        batch.write.mode("append").parquet(out)
        if number == 1:
            raise RuntimeError("killed")

    def run(then):
        q = inflight.changes(inflight.log_lines(spark, str(src), 1), patience=1e9).writeStream.option("checkpointLocation", cp)
        q.foreachBatch(then).trigger(availableNow=True).start().awaitTermination()

    for key, value in inflight.ROCKS.items():
        spark.conf.set(key, value)
    try:
        with pytest.raises(Exception, match="killed"):
            run(struck)
        run(lambda batch, number: batch.write.mode("append").parquet(out))
    finally:
        for key in inflight.ROCKS:
            spark.conf.unset(key)
    got = {key: ((line >> 33) * 30 + (line & (1 << 33) - 1), tries) for key, (line, tries) in found(spark, out).items()}
    assert got == plain({"r": lines})


def test_stalled_and_odd_lines(spark, tmp_path):
    src, out, cp = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    put(src, "r", 0, ["1000 start 1 /a", "nonsense", "", "1001 start 2 /b", "1002 done 2", "1003 start x /c", "1004 mem 9"])
    inflight.follow(inflight.log_lines(spark, str(src)), out, cp, patience=60, late="1 second")
    put(src, "r", 1, ["2000 start 3 /c"])
    inflight.follow(inflight.log_lines(spark, str(src)), out, cp, patience=60, late="1 second")
    put(src, "r", 2, ["2001 start 4 /d"])
    inflight.follow(inflight.log_lines(spark, str(src)), out, cp, patience=60, late="1 second")
    now = {r.file_id: r.status for r in inflight.known(spark.read.parquet(out)).collect()}
    assert now == {1: "stalled", 2: "done", 3: "open", 4: "open"}
    assert inflight.last_in_flight(spark.read.parquet(out)).first().file_id == 4
    assert spark.read.parquet(out).where(F.col("status") == "stalled").count() == 1


class Fake:
    """State and timers of one key, which count their messages."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], []

    def get(self):
        self.calls.append("get")
        return self.value

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def listTimers(self):
        self.calls.append("list")
        return iter(list(self.timers))

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.timers.remove(at)

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return 0

    def getExpiryTimeInMs(self):
        return self.now


def test_few_messages_a_key_and_timers_of_earlier_starts_do_nothing():
    fake, p = Fake(), inflight.InFlight(most=3, patience=10)
    p.handle = p.state = fake
    line = lambda n, ts, event: Row(line_no=n, ts=ts, event=event)
    told = list(p.handleInputRows(("r", 1), iter([line(1, 5.0, "start")]), fake))
    assert [r.status for r in told] == ["open"] and fake.calls == ["get", "update", "register"]
    fake.calls.clear()
    assert [r.tries for r in p.handleInputRows(("r", 1), iter([line(2, 9.0, "start")]), fake)] == [2]
    assert fake.calls == ["get", "update", "register"]
    fake.now = 15_000  # of the first start, which the second has overtaken
    assert list(p.handleExpiredTimer(("r", 1), fake, fake)) == []
    fake.now = 19_000
    assert [(r.status, r.line_no) for r in p.handleExpiredTimer(("r", 1), fake, fake)] == [("stalled", 2)]
    assert list(p.handleExpiredTimer(("r", 1), fake, fake)) == []
    assert [r.status for r in p.handleInputRows(("r", 1), iter([line(3, 11.0, "done")]), fake)] == ["done"]
