"""Clusters of face vectors: centroids, the nearest of them, and new clusters by density."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import vectors as V
from lumenfold.operators import density, nearest
from lumenfold.session import checkpointed

MERGE_BELOW = 0.35
MIN_CLUSTER = 3
#: Bytes of centroids, as doubles, that are sent to every task at most; among more, each vector meets the blocks that can win.
MOST_CENTROID_BYTES = 64 << 20


def centroids(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """Each cluster's mean of unit vectors, of unit length, and its size.

    ``vectors``: id, embedding; ``members``: id, cluster_id. Sums run over positions, so no vector list is in memory.
    """
    rows = vectors.join(members, "id").select("cluster_id", F.posexplode(V.unit(F.col("embedding"))).alias("i", "x"))
    sums = rows.groupBy("cluster_id", "i").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    made = sums.groupBy("cluster_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"), F.max("n").alias("face_count")
    )
    return made.select("cluster_id", V.unit(F.col("mean")).alias("centroid"), "face_count")


def usable(clusters: DataFrame) -> DataFrame:
    """Centroids that are no zero vector once what is not finite counts as 0."""
    return clusters.where(V.norm(V.doubles(F.col("centroid"))) > 0)


def assign(vectors: DataFrame, clusters: DataFrame, below: float = MERGE_BELOW) -> DataFrame:
    """``id``, ``cluster_id``, ``distance`` of the nearest centroid that is nearer than ``below``; equal ones go to the lowest id.

    Centroids are few beside faces: up to MOST_CENTROID_BYTES they go to every task as one matrix. Among more, pivots
    and the triangle inequality tell which can be the nearest (:mod:`nearest`).
    """
    rows = usable(clusters).select("cluster_id", V.unit(F.col("centroid")).alias("c"))
    n_bytes = 8 * (rows.agg(F.sum(F.size("c").cast("long") + 1)).first()[0] or 0)
    if n_bytes <= MOST_CENTROID_BYTES:
        known = rows.orderBy("cluster_id").toPandas()
        matrix = np.stack(known["c"]).astype(np.float64) if len(known) else np.zeros((0, 0))
        shared = vectors.sparkSession.sparkContext.broadcast((known["cluster_id"].to_numpy(np.int64), matrix))

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            for pdf in (b for b in batches if len(b) and len(ids)):
                best, least = nearest.closest(nearest.units(pdf["embedding"]), ids, matrix)
                keep = least < below
                yield pd.DataFrame({"id": pdf["id"][keep], "cluster_id": best[keep], "distance": least[keep]})

        return vectors.select("id", "embedding").mapInPandas(near, "id long, cluster_id long, distance double")
    return nearest.search(vectors, usable(clusters), below)


def density_clusters(x: np.ndarray, min_size: int = MIN_CLUSTER) -> np.ndarray:
    """Labels of a few vectors in memory, as they are, by the steps of :mod:`density`; -1 for noise."""
    labels = np.full(len(x), -1, np.int64)
    if len(x) < max(2, min_size):
        return labels
    points = pd.DataFrame({"p": range(len(x)), "copies": 1, "v": list(x)})
    nodes = pd.DataFrame({"node": points["p"], "points": 1, "mass": 0.0, "inner": 0.0, "branched": False})
    found = density.merged(nodes, density.small_tree(points, min_size), min_size)["label"]
    names = {label: k for k, label in enumerate(sorted(found.dropna().unique()))}
    return np.array([-1 if pd.isna(f) else names[f] for f in found], np.int64)


def discover(vectors: DataFrame, min_size: int = MIN_CLUSTER) -> DataFrame:
    """``id`` and ``label`` of vectors in new clusters, by density; noise is left out."""
    return density.clusters(vectors, min_size)


def incremental(vectors: DataFrame, clusters: DataFrame, min_size: int = MIN_CLUSTER, below: float = MERGE_BELOW) -> DataFrame:
    """``id``, ``cluster_id`` for unclustered vectors: the nearest centroid, else a new cluster.

    A new cluster near a centroid joins it; others get ids above the largest, in order of their labels.
    Centroids are those from before the run.
    """
    near = checkpointed(assign(vectors, clusters, below).select("id", "cluster_id"))
    found = checkpointed(discover(vectors.join(near, "id", "left_anti"), min_size))
    fresh = checkpointed(centroids(vectors, found.select("id", F.col("label").alias("cluster_id"))))
    asked = fresh.select(F.col("cluster_id").alias("id"), F.col("centroid").alias("embedding"))
    merged = checkpointed(assign(asked, clusters, below).select(F.col("id").alias("label"), "cluster_id"))
    top = clusters.agg(F.max("cluster_id")).first()[0] or 0
    others = fresh.select(F.col("cluster_id").alias("label")).join(merged, "label", "left_anti")
    numbered = density.in_order(others, "label").select("label", (F.col("place") + top + 1).cast("long").alias("cluster_id"))
    return near.unionByName(found.join(merged.unionByName(numbered), "label").select("id", "cluster_id"))


def full(vectors: DataFrame, min_size: int = MIN_CLUSTER) -> DataFrame:
    """All vectors anew: ``id``, ``cluster_id`` from 1."""
    return discover(vectors, min_size).select("id", (F.col("label") + 1).alias("cluster_id"))


def orphans(vectors: DataFrame, parents: DataFrame, parent_id: str = "id") -> DataFrame:
    """Vectors whose file or face is gone."""
    return vectors.join(parents.select(F.col(parent_id).alias("id")), "id", "left_anti").select("id")
