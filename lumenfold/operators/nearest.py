"""Nearest centroids, exactly, where the centroids are too many to be sent to every task.

Some centroids are pivots. Every other one stands with its nearest pivot, and those of a pivot are cut into blocks in order of
their distance r from it. By the triangle inequality a vector at distance d from the pivot is no nearer to any of a block than
d - (the block's largest r) and (its least r) - d. A vector meets the block of the least such bound first; what it finds there is a bound of its
own, and it meets only those other blocks that may still win. Vectors travel in chunks, a matrix a row, and a block that many chunks ask for is copied, so
that a hot block is many tasks' work.

Defined results: equal centroids count as the one of the lowest id, and of equal distances the lowest id wins; vectors of no length are as
far as the square root of two from every centroid; an empty table of either kind gives an empty result; a repeated id gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import vectors as V
from lumenfold.operators.density import in_order
from lumenfold.session import batches_of, checkpointed, discard, stored

#: Pivots, and bytes of them at most; they go to every task.
PIVOTS = 256
PIVOT_BYTES = 16 << 20
#: Bytes of a block's centroids, and of a chunk's vectors.
BLOCK_BYTES = 2 << 20
#: Chunks that meet one copy of a block.
CHUNKS = 32
#: Distances that a task holds at a time.
DISTANCES = 1 << 20
#: Bytes of vectors that a task gathers before it gives unfinished chunks.
GATHERED = 64 << 20
#: Above what rounding makes of the distance of two unit vectors that is taken from their product.
SLACK = 1e-6

_CHUNK = "block int, n int, ids binary, x binary"
_FOUND = "id long, cluster_id long, distance double"


def units(embeddings: pd.Series) -> np.ndarray:
    """Rows of unit length; what is not finite counts as 0."""
    x = np.nan_to_num(np.stack(embeddings).astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def closest(x: np.ndarray, ids: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``x``: the id of the nearest row of ``matrix`` and its distance; ties go to the lowest id.

    A product of matrices sums in an order that depends on their shapes. Whatever is as near as rounding can tell is summed again, row by row,
    so that the same two vectors are equally far apart in any block.
    """
    best, least = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, DISTANCES // max(1, len(ids)))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        dots = part @ matrix.T
        row, col = np.nonzero(dots >= dots.max(axis=1, keepdims=True) - 1e-12)
        again = np.concatenate([(part[row[k : k + 8192]] * matrix[col[k : k + 8192]]).sum(axis=1) for k in range(0, len(row), 8192)])
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * again))
        order = np.lexsort((ids[col], d, row))
        first = order[np.searchsorted(row[order], np.arange(len(part)))]
        best[at : at + step], least[at : at + step] = ids[col[first]], d[first]
    return best, least


def _chunks(routed: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int, whole: int) -> Iterator[pd.DataFrame]:
    """Rows of _CHUNK, of ``whole`` vectors at most, from (ids, vectors, blocks) in any order."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    counts: dict[int, int] = {}

    def given(blocks: list[int]) -> pd.DataFrame:
        rows = []
        for b in blocks:
            ids, x = (np.concatenate(p) for p in zip(*held.pop(b), strict=True))
            counts.pop(b)
            rows += [(b, len(ids[k : k + whole]), ids[k : k + whole].tobytes(), x[k : k + whole].tobytes()) for k in range(0, len(ids), whole)]
        return pd.DataFrame(rows, columns=["block", "n", "ids", "x"])

    for ids, x, blocks in (r for r in routed if len(r[0])):
        order = np.argsort(blocks, kind="stable")
        names, starts = np.unique(blocks[order], return_index=True)
        for name, rows in zip(names.tolist(), np.split(order, starts[1:]), strict=True):
            held.setdefault(name, []).append((ids[rows], x[rows]))
            counts[name] = counts.get(name, 0) + len(rows)
        full = [b for b, n in counts.items() if n >= whole]
        if 8 * width * sum(counts.values()) > GATHERED:
            full = list(counts)
        if full:
            yield given(full)
    if counts:
        yield given(list(counts))


def _answers(chunks: DataFrame, blocks: DataFrame, with_vectors: bool) -> DataFrame:
    """Each vector's nearest centroid in the block that its chunk asks for, and with it the vector and the block if asked for."""
    wanted = chunks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CHUNKS).cast("int").alias("copies"))
    dealt = blocks.join(wanted, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    asked = chunks.join(wanted, "block").withColumn("part", F.pmod(F.xxhash64("ids"), F.col("copies")).cast("int")).drop("copies")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                ids = np.frombuffer(r.ids, np.int64)
                x = np.frombuffer(r.x, np.float64).reshape(len(ids), -1)
                best, least = closest(x, np.asarray(r.clusters, np.int64), np.stack(r.centroids))
                out = pd.DataFrame({"id": ids, "cluster_id": best, "distance": least})
                yield out.assign(block=r.block, v=list(x)) if with_vectors else out

    joined = asked.join(dealt.select("block", "part", "clusters", "centroids"), ["block", "part"])
    return joined.mapInPandas(run, _FOUND + (", block int, v array<double>" if with_vectors else ""))


def search(vectors: DataFrame, clusters: DataFrame, below: float) -> DataFrame:
    """``id``, ``cluster_id``, ``distance`` of the nearest centroid, where that is nearer than ``below``.

    ``vectors``: id, embedding; ``clusters``: cluster_id, centroid, none of them without length.
    """
    spark = vectors.sparkSession
    unit_rows = clusters.select("cluster_id", V.unit(F.col("centroid")).alias("c"))
    rows = stored(unit_rows.groupBy("c").agg(F.min("cluster_id").alias("cluster_id")))
    size = rows.agg(F.max(F.size("c")).alias("width"), F.min("cluster_id").alias("lowest")).first()
    if size.width is None:
        discard(rows)
        return vectors.where("false").select("id", F.lit(0).cast("long").alias("cluster_id"), F.lit(0.0).alias("distance"))
    width, block_rows = size.width, max(1, BLOCK_BYTES // (8 * size.width))
    n_pivots = max(1, min(PIVOTS, PIVOT_BYTES // (8 * width)))
    chosen = rows.orderBy(F.xxhash64("cluster_id"), "cluster_id").limit(n_pivots).collect()
    pivots = spark.sparkContext.broadcast(np.array([r.c for r in chosen], np.float64))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = distances(np.stack(pdf["c"]), pivots.value)
                yield pdf.assign(pivot=d.argmin(axis=1).astype(np.int32), r=d.min(axis=1))

    with batches_of(spark, max(16, min(4096, BLOCK_BYTES // (8 * width)))):
        near = rows.mapInPandas(placed, "c array<double>, cluster_id long, pivot int, r double")
        ordered = in_order(near.withColumn("key", F.struct("pivot", "r", "cluster_id")), "key")
    cut = ordered.withColumn("run", F.floor(F.col("place") / block_rows))
    grouped = cut.groupBy("pivot", "run").agg(  # block_rows at most in each
        F.min("r").alias("lo"), F.max("r").alias("hi"), F.sort_array(F.collect_list(F.struct("cluster_id", "c"))).alias("members")
    )
    # A pivot's runs follow each other, so a run has one block for each pivot in it.
    kept = stored(grouped.select(
        "pivot", "run", "lo", "hi", F.transform("members", lambda m: m["cluster_id"]).alias("clusters"), F.transform("members", lambda m: m["c"]).alias("centroids")
    ))
    # A row of four numbers for a block of BLOCK_BYTES.
    table = kept.select("pivot", "run", "lo", "hi").orderBy("pivot", "run").toPandas()
    names = spark.createDataFrame([(int(p), int(r), k) for k, (p, r) in enumerate(zip(table["pivot"], table["run"], strict=True))], "pivot int, run long, block int")
    blocks = kept.join(F.broadcast(names), ["pivot", "run"]).select("block", "clusters", "centroids")
    known = spark.sparkContext.broadcast((table["pivot"].to_numpy(), table["lo"].to_numpy(), table["hi"].to_numpy()))

    def bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances from the pivots, and what each block is at least away."""
        pivot, lo, hi = known.value
        d = distances(x, pivots.value)
        return d, np.maximum(np.maximum(d[:, pivot] - hi, lo - d[:, pivot]), 0.0)

    step = max(1, DISTANCES // (len(table) + len(chosen)))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def routed() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for pdf in (whole.iloc[at : at + step] for whole in batches for at in range(0, len(whole), step)):
                x = units(pdf["embedding"])
                d, least = bounds(x)
                # Of blocks that may hold the vector itself, that of the nearest pivot.
                block = (least + 1e-3 * d[:, known.value[0]]).argmin(axis=1)
                # A pivot is a centroid, so none beyond the nearest pivot can win.
                may = (least.min(axis=1) <= np.minimum(d.min(axis=1), below) + SLACK) & x.any(axis=1)
                yield pdf["id"].to_numpy(np.int64)[may], x[may], block[may]

        yield from _chunks(routed(), width, block_rows)

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def routed() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for pdf in (whole.iloc[at : at + step] for whole in batches for at in range(0, len(whole), step)):
                x = np.stack(pdf["v"])
                d, least = bounds(x)
                may = least <= np.minimum(np.minimum(pdf["distance"].to_numpy(), d.min(axis=1)), below)[:, None] + SLACK
                may[np.arange(len(x)), pdf["block"]] = False
                row, block = np.nonzero(may)
                for k in range(0, len(row), block_rows):
                    at = slice(k, k + block_rows)
                    yield pdf["id"].to_numpy(np.int64)[row[at]], x[row[at]], block[at]

        yield from _chunks(routed(), width, block_rows)

    with batches_of(spark, 1024):
        asked = stored(vectors.select("id", "embedding").where("id IS NOT NULL AND embedding IS NOT NULL").mapInPandas(first, _CHUNK))
    with batches_of(spark, 8):
        answered = stored(_answers(asked, blocks, True))
    with batches_of(spark, 1024):
        again = stored(answered.mapInPandas(rest, _CHUNK))
    with batches_of(spark, 8):
        found = answered.select("id", "cluster_id", "distance").unionByName(_answers(again, blocks, False))
        best = found.groupBy("id").agg(F.min(F.struct("distance", "cluster_id")).alias("b")).where(F.col("b.distance") < below)
        result = checkpointed(best.select("id", "b.cluster_id", "b.distance"))
    for table_of in (rows, kept, asked, answered, again):
        discard(table_of)
    if below <= np.sqrt(2.0):
        return result
    return result.unionByName(_lengthless(vectors, size.lowest))


def _lengthless(vectors: DataFrame, lowest: int) -> DataFrame:
    """Vectors of no length, with the lowest id."""
    zero: Column = V.norm(V.doubles(F.col("embedding"))) == 0
    return vectors.where(zero).select("id", F.lit(lowest).cast("long").alias("cluster_id"), F.lit(float(np.sqrt(2.0))).alias("distance")).distinct()
