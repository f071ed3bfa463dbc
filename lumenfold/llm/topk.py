"""Exact top-k by inner product with MaxScore.

Terms are a vector's positions, a document's impact on a term is the product of query and
document component, taken from its least value in the shard so that it isn't negative. In
each shard the terms stand by their greatest impact. Those whose bounds together can't lift
a document over the k-th best score so far are non-essential: they aren't traversed, only
probed, one after the other, for documents that are still competitive. Each shard gives
its k best for each query; the best of these are the answer.

Shards are cut by a hash of the id, SHARD_ROWS rows each, and queries come to them in
blocks of QUERY_ROWS, so that a task's memory has a bound whatever the table's size.

Defined results: vectors that are null or hold null or non-finite components, and rows
with a null vec_id, take no part; shorter vectors count as if filled up with 0; an
empty vector scores 0; repeated ids are rows of their own, and a query isn't matched
with any row that has its id; an empty table gives an empty result. Products must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 4096
QUERY_ROWS = 2048
SCALE = 1024
#: Documents that are scored in full first, to have a k-th best score.
WARM_UP = 64


def quantised(embedding: Column) -> Column:
    """floor(1024 * x) of every component, as longs; null if any component is null or not finite."""
    good = ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(embedding.isNotNull() & good, F.transform(embedding, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long")))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Shard:
    """Documents of one shard, ordered so that ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], vectors[order]
        self.low, self.high = self.x.min(axis=0), self.x.max(axis=0)
        self.lists = np.ascontiguousarray(self.x.T)
        # Products and sums below 2**53 are exact in doubles, which are faster to multiply.
        self.largest = max(1, abs(int(self.x.max(initial=0))), abs(int(self.x.min(initial=0))))
        self.doubles = self.lists.astype(np.float64)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, by score and then id."""
        n = len(self.ids)
        exact = self.largest * max(1, int(np.abs(query).max(initial=0))) * max(1, len(query)) < 1 << 53
        lists = self.doubles if exact else self.lists
        q = query.astype(lists.dtype)
        least = np.minimum(query * self.low, query * self.high)
        bound = np.maximum(query * self.low, query * self.high) - least
        others = self.ids != own
        first = np.flatnonzero(others)[:WARM_UP]
        if len(first) < k:
            theta = None
        else:
            theta = int(np.partition((q @ lists[:, first]).astype(np.int64), len(first) - k)[len(first) - k])
        base = int(least.sum())
        order = np.argsort(bound, kind="stable")
        lifted = base + np.cumsum(bound[order])
        # Terms that together cannot reach the k-th best score. A tie may still win by its id.
        cut = 0 if theta is None else int(np.searchsorted(lifted, theta, side="left"))
        essential, rest = order[cut:], order[:cut][::-1]
        live = np.flatnonzero(others)
        score = (q[essential] @ lists[essential])[live] if len(essential) else np.zeros(len(live), lists.dtype)
        score = score + least[rest].sum()  # the least that the others can bring
        slack = int(bound[rest].sum())
        step = max(1, len(rest) // 4)
        for at in range(0, len(rest), step):
            if theta is not None:
                keep = score + slack >= theta
                live, score = live[keep], score[keep]
            terms = rest[at : at + step]
            score = score + q[terms] @ lists[np.ix_(terms, live)] - least[terms].sum()
            slack -= int(bound[terms].sum())
        score = score.astype(np.int64)
        if len(live) > k:
            kth = np.partition(score, len(score) - k)[len(score) - k]
            keep = score >= kth
            live, score = live[keep], score[keep]
        best = np.lexsort((self.ids[live], -score))[:k]
        return self.ids[live[best]], score[best]


def _search(k: int):
    columns = ["query_key", "query_id", "vec_id", "score"]

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
        width = max(rows["v"].map(len).max(), queries["v"].map(len).max())
        shard = Shard(rows["vec_id"].to_numpy(np.int64), _matrix(rows["v"], width))
        out = []
        for key, own, query in zip(queries["query_key"], queries["vec_id"], _matrix(queries["v"], width), strict=True):
            ids, scores = shard.top(query, own, k)
            out.append(np.stack([np.full(len(ids), key), np.full(len(ids), own), ids, scores], axis=1))
        return pd.DataFrame(np.concatenate(out), columns=columns)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` best other rows for every row that ``is_query`` marks: query_id, rank, vec_id, score.

    ``vectors``: vec_id long and v, an array of longs.
    """
    rows = vectors.where("vec_id is not null and v is not null")
    n, m = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // QUERY_ROWS))
    place = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")
    split = rows.select(
        "vec_id", "v", place.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    )
    queries = (
        rows.where(is_query)
        .distinct()
        .withColumn("query_key", F.xxhash64("vec_id", "v"))
        .withColumn("block", F.pmod(F.col("query_key"), F.lit(blocks)).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )
    found = (
        queries.groupBy("shard", "block")
        .cogroup(split.groupBy("shard", "block"))
        .applyInPandas(_search(k), "query_key long, query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_key", "query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
