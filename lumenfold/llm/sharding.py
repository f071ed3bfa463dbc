"""Sharding by fixed virtual slots.

A record's key is hashed into one of ``n_slots`` virtual slots, for ever. Which shard
holds a slot is written in a small versioned map, a table in the folder that all executors share; growing or
rebalancing edits the map and so moves whole slots, never single records. Bytes are added up by slot. A version
that is stored is never written again, so a job that is run again finds the map that it made.

Defined results: a null key hashes like any other value; a null text has no bytes and
size 1; rows that are equal in every column get places next to each other, in any order;
very long texts count by their bytes alone; an empty table gives an empty result with the same columns; other columns are left out, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.session import shared_dir

#: Thousands of slots: a shard has hundreds, so that moving one is a small step.
N_SLOTS = 4096
#: Equal rows whose places one row of a task makes; more are dealt out to other tasks first.
RUN = 65_536


@dataclass(frozen=True)
class SlotMap:
    """One version of the slot-to-shard map. ``shards[s]`` is the shard of slot ``s``."""

    version: int
    shards: tuple[int, ...]
    moved: tuple[int, ...] = field(default=())

    @property
    def n_shards(self) -> int:
        return max(self.shards) + 1

    def grow(self) -> SlotMap:
        """The next version, with one more shard that takes slots and gives none.

        The largest shard gives its highest slot until the new one has its share. Only
        the number of shards decides, so two clusters agree without talking.
        """
        new, shards, moved = self.n_shards, list(self.shards), []
        held: list[list[int]] = [[] for _ in range(new)]
        for slot, shard in enumerate(shards):
            held[shard].append(slot)
        for _ in range(len(shards) // (new + 1)):
            giver = max(range(new), key=lambda i: (len(held[i]), -i))
            slot = held[giver].pop()
            shards[slot] = new
            moved.append(slot)
        return SlotMap(self.version + 1, tuple(shards), tuple(sorted(moved)))

    def rebalance(self, slot_bytes: dict[int, int], tolerance: float = 0.02) -> SlotMap:
        """The next version, with bytes a shard near equal and few slots moved.

        While the fullest shard is over the mean by more than ``tolerance``, its slot
        that best closes the gap goes to the emptiest shard.
        """
        shards, moved = list(self.shards), set()
        load = [0] * self.n_shards
        held: list[list[int]] = [[] for _ in range(self.n_shards)]
        for slot, shard in enumerate(shards):
            load[shard] += slot_bytes.get(slot, 0)
            held[shard].append(slot)
        mean = sum(load) / max(1, len(load))
        for _ in range(len(shards)):
            full, empty = load.index(max(load)), load.index(min(load))
            gap = (load[full] - load[empty]) / 2
            if load[full] <= mean * (1 + tolerance) or gap <= 0:
                break
            fits = [s for s in held[full] if 0 < slot_bytes.get(s, 0) < 2 * gap]
            if not fits:
                break
            slot = min(fits, key=lambda s: (abs(slot_bytes[s] - gap), s))
            held[full].remove(slot)
            held[empty].append(slot)
            load[full] -= slot_bytes[slot]
            load[empty] += slot_bytes[slot]
            shards[slot] = empty
            moved.add(slot)
        return SlotMap(self.version + 1, tuple(shards), tuple(sorted(moved)))


def initial_map(n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """Version ``n_shards`` of the map: one shard, grown until there are ``n_shards``."""
    current = SlotMap(1, (0,) * n_slots)
    while current.n_shards < n_shards:
        current = current.grow()
    return current


def slot_of(key: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def record_size(text: Column) -> Column:
    """UTF-8 bytes and one for the record's end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def slot_bytes(records: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Rows and bytes of each slot: at most ``n_slots`` rows, summed before the shuffle."""
    return (
        records.groupBy("virtual_slot")
        .agg(F.count(F.lit(1)).alias("slot_rows"), F.sum("size").alias("slot_bytes"))
    )


def _folder(spark: SparkSession, name: str, version: int | None = None) -> str:
    path = f"{shared_dir(spark)}/slot-maps/{name}"
    return path if version is None else f"{path}/map_version={version}"


def _list(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def versions(spark: SparkSession, name: str) -> list[int]:
    """Versions of a map that are stored whole, in their order."""
    found = [int(n.partition("=")[2]) for n in _list(spark, _folder(spark, name)) if n.startswith("map_version=")]
    return sorted(v for v in found if "_SUCCESS" in _list(spark, _folder(spark, name, v)))


def save_map(spark: SparkSession, name: str, slot_map: SlotMap) -> None:
    """Store a version of a map; earlier ones stay. A version that is there already has to be the same."""
    if slot_map.version in versions(spark, name):
        if load_map(spark, name, slot_map.version).shards != slot_map.shards:
            raise ValueError(f"version {slot_map.version} of {name} is another map")
        return
    moved = set(slot_map.moved)
    rows = [(slot, shard, slot in moved) for slot, shard in enumerate(slot_map.shards)]
    # What a job left that was broken off has no mark of success, and is written over.
    spark.createDataFrame(rows, "virtual_slot int, shard int, moved boolean").coalesce(1).write.mode("overwrite").parquet(_folder(spark, name, slot_map.version))


def load_map(spark: SparkSession, name: str, version: int | None = None) -> SlotMap | None:
    """A version of a stored map, the last one if none is named; None if there is none."""
    stored = versions(spark, name)
    version = version if version is not None else (stored[-1] if stored else None)
    if version not in stored:
        return None
    rows = sorted(spark.read.parquet(_folder(spark, name, version)).collect())  # a row a slot
    return SlotMap(version, tuple(r.shard for r in rows), tuple(r.virtual_slot for r in rows if r.moved))


def stored_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS, name: str | None = None) -> SlotMap:
    """The map of ``n_shards`` shards: as stored, else grown from the last stored one with fewer, step by step, and each step stored."""
    name = name or f"by-key-{n_slots}"
    fewer = [v for v in versions(spark, name) if v <= n_shards]
    current = load_map(spark, name, fewer[-1]) if fewer else SlotMap(1, (0,) * n_slots)
    while current.n_shards < n_shards:
        current = current.grow()
    save_map(spark, name, current)
    return load_map(spark, name, current.version)


def map_table(spark: SparkSession, slot_map: SlotMap, totals: dict[int, tuple[int, int]]) -> DataFrame:
    """The map as a table of one row a slot, with rows, bytes and the slot's first place."""
    place = [0] * (slot_map.n_shards)
    rows = []
    for slot, shard in enumerate(slot_map.shards):
        n, size = totals.get(slot, (0, 0))
        rows.append((slot, shard, slot_map.version, n, size, place[shard]))
        place[shard] += n
    return spark.createDataFrame(
        rows, "virtual_slot int, shard int, map_version int, slot_rows long, slot_bytes long, first_place long"
    )


def assign(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS) -> DataFrame:
    """Every row of ``docs`` with its slot, shard, gapless place in the shard and grown shard.

    A row's place in its shard is its slot's first place plus its place in the slot, so
    no window is wider than a slot, and what is shuffled has no texts.
    """
    spark = docs.sparkSession
    records = docs.select(
        "doc_id",
        record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        slot_of(F.col("doc_id"), n_slots).alias("virtual_slot"),
    )
    # At most n_slots rows, whatever the input's size.
    totals = {r.virtual_slot: (r.slot_rows, r.slot_bytes) for r in slot_bytes(records, n_slots).collect()}
    now, grown = stored_map(spark, n_shards, n_slots), stored_map(spark, n_shards + 1, n_slots)
    table = map_table(spark, now, totals).join(
        F.broadcast(map_table(spark, grown, totals).select("virtual_slot", F.col("shard").alias("grown_shard"))),
        "virtual_slot",
    )
    # A slot with many rows of one id, or of none, is counted by groups of equal rows first: no window holds more than a slot's groups.
    equal = ["virtual_slot", "doc_id", "text_crc32", "size"]
    groups = records.groupBy(*equal).agg(F.count(F.lit(1)).alias("copies"))
    before = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("place", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    few, many = placed.where(F.col("copies") <= RUN), placed.where(F.col("copies") > RUN)
    # A group of very many equal rows is cut into runs of places, which other tasks make: no array is longer than a run.
    starts = many.withColumn("run", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(RUN)))).repartition(*equal, "run")
    runs = starts.select(*equal, F.least(F.col("copies") - F.col("run"), F.lit(RUN)).alias("copies"), (F.col("place") + F.col("run")).alias("place"))
    return (
        few.unionByName(runs)
        .withColumn("place", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("copies") - 1)))
        .join(F.broadcast(table), "virtual_slot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("first_place") + F.col("place")).alias("slot"),
            "grown_shard",
            "virtual_slot",
            "map_version",
            "slot_bytes",
        )
    )
