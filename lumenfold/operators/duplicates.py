"""Duplicates by bytes, by look, and nearly; which copy to keep; live photos."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold import predicates as P
from lumenfold.functions import bits as B
from lumenfold.functions import paths
from lumenfold.operators.components import connected_components
from lumenfold.session import batches_of, checkpointed, stored

NEAR = 12
SIBLINGS = 8
#: Different hashes of one name from which they are compared in blocks.
HEAVY_NAME = 2048
#: Hashes of a block.
BLOCK = 1 << 16
KEEP_RULES = ("shortest-path", "longest-path", "oldest", "newest")
STILLS = (".heic", ".heif", ".jpg", ".jpeg", ".png")


def _live(files: DataFrame) -> DataFrame:
    """Files that are still to decide on: what is a duplicate already has its keeper, and is no keeper itself."""
    return files.where("missing = 0 and too_small = 0 and dup_of is null")


def groups(files: DataFrame, by: str = "content_hash") -> DataFrame:
    """Keys with two live files or more that are no duplicates yet. By look, photos only."""
    rows = _live(files).where(F.coalesce(F.col(by), F.lit("")) != "")
    rows = rows.where(P.is_image()) if by == "phash" else rows
    found = rows.groupBy(F.col(by).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.sum("size").alias("bytes"))
    return found.where("n > 1")


def summary(files: DataFrame, by: str = "content_hash") -> DataFrame:
    found = groups(files, by)
    return found.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("extra"))


def keepers(files: DataFrame, meta: DataFrame, by: str = "content_hash", rule: str = "shortest-path") -> DataFrame:
    """Every member of a group and the file that its group keeps: ``id``, ``keeper``.

    The keeper is a least value of a group, found before the shuffle in part: a group of any size does no harm.
    """
    rows = _live(files).where(F.coalesce(F.col(by), F.lit("")) != "")
    rows = (rows.where(P.is_image()) if by == "phash" else rows).join(meta.select("file_id", "lat", "taken_at"), F.col("id") == F.col("file_id"), "left")
    found = rows.groupBy(by).agg(_least(rule).alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.select("id", by).join(found, by).select("id", "keeper")


def _least(rule: str) -> Column:
    if rule not in KEEP_RULES:
        raise ValueError(f"no such rule: {rule}")
    tier = F.when(F.col("lat").isNotNull(), 0).when(F.coalesce("taken_at", F.lit("")) != "", 1).otherwise(2)
    if rule == "shortest-path":
        return F.min(F.struct(tier, F.length("path"), "path", "id"))["id"]
    if rule == "oldest":
        return F.min(F.struct(tier, "mtime", "id"))["id"]
    if rule == "newest":
        return F.min(F.struct(tier, -F.col("mtime"), "id"))["id"]
    return F.max(F.struct(-tier, F.length("path"), "path", -F.col("id"), "id"))["id"]


def _hashed(files: DataFrame) -> DataFrame:
    rows = _live(files).where(P.is_image() & (F.coalesce("phash", F.lit("")) != ""))
    return rows.select("id", F.lower(paths.basename(F.col("path"))).alias("name"), B.bits_of(F.col("phash")).alias("bits"))


def _by_name(values: DataFrame, near: int) -> DataFrame:
    """Pairs of names with few hashes, joined by name. Bands of the hash would send each row near + 1 times and still leave 0.4 of the pairs to compare."""
    a = values.select("name", F.col("id").alias("a"), F.col("bits").alias("a_bits"))
    b = values.select("name", F.col("id").alias("b"), F.col("bits").alias("b_bits"))
    distance = B.hamming(F.col("a_bits"), F.col("b_bits"))
    # Tables of repeated values take a fraction of their rows' size as files, and are taken for small: without the hint the driver holds one side whole.
    found = a.join(b.hint("merge"), "name").where((F.col("a") < F.col("b")) & (distance <= near))
    return found.select("a", "b", distance.alias("distance"))


def _by_blocks(values: DataFrame, sizes: DataFrame, near: int, block: int, links_only: bool) -> DataFrame:
    """Pairs of names with many hashes. Joined by name they would be all pairs as rows; blocks of hashes are compared in
    arrays instead, and rows are what is near. A row of two blocks goes to each task, so rows sent grow with a name's blocks and not with its pairs.

    With ``links_only`` as many pairs of two blocks as join what all their pairs join, fewer than their hashes.
    """
    parts = F.ceil(F.col("n") / block).cast("int")
    dealt = values.join(sizes, "name").select("name", "bits", "id", parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int"))
    packed = stored(dealt.groupBy("name", "part", "parts").agg(F.collect_list(F.struct("bits", "id")).alias("h")))  # a block's
    left = packed.select("name", F.explode(F.sequence("part", F.col("parts") - 1)).alias("other"), (F.col("part")).alias("mine"), F.col("h").alias("x"))
    right = packed.select("name", F.col("part").alias("other"), F.col("h").alias("y"))
    met = left.join(right, ["name", "other"]).select((F.col("mine") == F.col("other")).alias("same"), F.col("x.bits").alias("x"), F.col("x.id").alias("xi"), F.col("y.bits").alias("y"), F.col("y.id").alias("yi"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for same, x, xi, y, yi in pdf.itertuples(index=False):
                yield from near_in_blocks(same, np.asarray(x), np.asarray(xi), np.asarray(y), np.asarray(yi), near, links_only)

    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with batches_of(values.sparkSession, 2):
        return stored(met.repartition(parts).mapInPandas(compare, "a long, b long, distance int"))


def near_in_blocks(same: bool, x: np.ndarray, xi: np.ndarray, y: np.ndarray, yi: np.ndarray, near: int, links_only: bool) -> Iterator[pd.DataFrame]:
    """Pairs of a hash of ``x`` and one of ``y`` within ``near`` bits, with ids a < b; of one block (``same``) each pair once."""
    x, y = x.astype(np.int64).view(np.uint64), y.astype(np.int64).view(np.uint64)
    n = len(x)
    # Who is joined to whom so far; of one block both sides are the same hashes.
    root = np.arange(n if same else n + len(y))
    a, b, d, held = [], [], [], 0
    for i in range(n):
        start = i + 1 if same else 0
        bits = np.bitwise_count(x[i] ^ y[start:])
        hits = np.flatnonzero(bits <= near)
        if links_only and len(hits):
            at = hits + start if same else hits + n
            _, first = np.unique(root[at], return_index=True)
            first = first[root[at[first]] != root[i]]
            if len(first):
                others = root[at[first]]
                root[np.isin(root, others)] = root[i]
            hits = hits[first]
        if len(hits):
            a.append(np.full(len(hits), xi[i]))
            b.append(yi[hits + start])
            d.append(bits[hits])
            held += len(hits)
        if held > 1 << 16 or held and i == n - 1:
            p, q = np.concatenate(a), np.concatenate(b)
            yield pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q), "distance": np.concatenate(d).astype(np.int32)})
            a, b, d, held = [], [], [], 0


def near_pairs(files: DataFrame, near: int = NEAR, heavy: int = HEAVY_NAME, block: int = BLOCK, links_only: bool = False) -> DataFrame:
    """``a``, ``b``, ``distance``: files of one name whose hashes differ in ``near`` bits at most; of equal hashes the smallest id stands for all.

    Names with ``heavy`` different hashes or more are compared in blocks, the others one with one. With ``links_only`` the pairs of heavy names
    are enough to join what is near by chains, no more.
    """
    values = _hashed(files).groupBy("name", "bits").agg(F.min("id").alias("id"))
    sizes = checkpointed(values.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= heavy))
    if sizes.isEmpty():
        return _by_name(values, near)
    few = _by_name(values.join(sizes, "name", "left_anti"), near)
    return few.unionByName(_by_blocks(values, sizes, near, block, links_only))


def near_groups(files: DataFrame, near: int = NEAR, heavy: int = HEAVY_NAME, block: int = BLOCK) -> DataFrame:
    """``id`` and ``group_id``, the smallest id that chains of near pairs reach; files with none are left out."""
    rows = _hashed(files)
    same = rows.groupBy("name", "bits").agg(F.min("id").alias("first"))
    stars = rows.join(same.hint("merge"), ["name", "bits"]).where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    edges = near_pairs(files, near, heavy, block, links_only=True).select("a", "b").unionByName(stars)
    return connected_components(edges, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("group_id"))


def siblings(files: DataFrame, row_id: int, near: int = SIBLINGS) -> DataFrame:
    """Files that look like one, the most alike first."""
    one = files.where(F.col("id") == row_id).select(B.bits_of(F.col("phash")).alias("bits"))
    rows = files.where((F.col("id") != row_id) & (F.coalesce("phash", F.lit("")) != "")).join(F.broadcast(one))  # one row
    rows = rows.withColumn("distance", B.hamming(B.bits_of(F.col("phash")), F.col("bits"))).where(F.col("distance") <= near)
    return rows.select("id", "distance").orderBy("distance", "id")


def live_pairs(files: DataFrame) -> DataFrame:
    """Videos and the still of the same folder and stem that they belong to: ``video_id``, ``still_id``.

    Equal spelling goes before equal letters, then the lowest id.
    """
    live = files.where("missing = 0")
    place = F.lower(F.concat(paths.directory(F.col("path")), F.lit("/"), paths.stem(F.col("path"))))
    exact = F.concat(paths.directory(F.col("path")), F.lit("/"), paths.stem(F.col("path")))
    videos = live.where(P.is_live_video_path()).select(F.col("id").alias("video_id"), place.alias("place"), exact.alias("v_exact"))
    stills = live.where(paths.extension(F.col("path")).isin(list(STILLS))).select(F.col("id").alias("still"), place.alias("place"), exact.alias("s_exact"))
    best = F.min(F.struct((F.col("v_exact") != F.col("s_exact")).alias("other"), "still"))["still"].alias("still_id")
    return videos.join(stills, "place").groupBy("video_id").agg(best)


def live_reverse(pairs: DataFrame) -> DataFrame:
    """Each still's video, the lowest id."""
    return pairs.groupBy("still_id").agg(F.min("video_id").alias("live_video_id"))


def mark_live(files: DataFrame) -> DataFrame:
    """``files`` with both links set anew."""
    pairs = live_pairs(files)
    back = live_reverse(pairs).withColumnRenamed("still_id", "s")
    rows = files.drop("live_photo_of", "live_video_id").join(pairs, F.col("id") == F.col("video_id"), "left")
    return rows.join(back, F.col("id") == F.col("s"), "left").drop("s", "video_id").withColumnRenamed("still_id", "live_photo_of").select(*files.columns)


def mark_duplicates(files: DataFrame, meta: DataFrame, by: str = "content_hash", rule: str = "shortest-path") -> DataFrame:
    """``files`` with ``dup_of`` of every member but the keeper; other rows keep theirs.

    What became a duplicate in an earlier run keeps its keeper, which may be a duplicate of a later one by now: chains lead to the keeper of today, and end there.
    """
    found = keepers(files, meta, by, rule).where("id <> keeper").withColumnRenamed("id", "k_id")
    rows = files.join(found, F.col("id") == F.col("k_id"), "left")
    return rows.withColumn("dup_of", F.coalesce("keeper", "dup_of")).select(*files.columns)
