"""Connected components of an edge list, by alternating large and small stars.

Each round links every node to the smallest id that it knows of, in two joins on the
node. Nothing is collected but a truth value a round; the rounds grow with the logarithm
of the longest path and end when all edges are stars. Each round's edges are checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import checkpointed, release


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one edge and is no other's ``v``: then ``v`` is the least node of its component, as each edge leads to a lesser one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("hub")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("hub"))
    )
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("hub").alias("hub"))
    return not nodes.agg(F.max((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("hub") > 0)))).first()[0]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable), a row for each node with an edge.

    Repeated edges do no harm; loops and edges with a null end are left out; no edges give no rows.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    now = checkpointed(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if _stars(now):
            break
        mirrored = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: each larger neighbour of u goes to the least of u and its neighbours.
        # Least ids are kept first, so that the join can have the rows of one hub split.
        large = (
            mirrored.join(checkpointed(_least(mirrored)), "u")
            .where("v >= u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u > v")
            .distinct()
        )
        large = checkpointed(large)
        # Small star: each smaller neighbour of u, and u, go to the least of them.
        least = checkpointed(_least(large))
        now = checkpointed(
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u > v")
            .distinct()
        )
        del mirrored, large, least
        # The rounds' jobs are many and small, and what the driver keeps of them would pile up.
        release(spark)
    else:
        if not _stars(now):
            raise RuntimeError("components did not settle")
    # All edges now lead to the least node of a star; that node is its own component.
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    hubs = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return members.unionByName(hubs).distinct()
