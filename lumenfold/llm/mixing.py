"""Mixing sources to target weights by Poisson replication.

A source that should have weight w in a mix of T documents, and has n of them, repeats
each of its documents at the rate r = w * T / n. How often a document comes is Poisson
with mean r, drawn by inverting the distribution at a uniform number that is a hash of
the seed and the document: no state, the same on every run and after a lost executor.

Rates go to every task while their table is below BROADCAST_BYTES; beyond, they are joined by
source and one of SALTS parts of the documents, so that a source with a third of all rows is split. Both give the same rows.

Defined results: a null source is a source of its own; a weight for a source that has
no rows, or a weight of 0, gives no rows; sources without a given weight are left out; a null doc_id
draws as the empty string does, a null text stays null; very long texts are only moved; rows with equal doc_id draw
equal counts; an empty table gives an empty one. All columns are kept, whatever their names, but those named as the three added ones, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.columns import others, quoted, unused
from lumenfold.session import checkpointed

#: Up to so many bytes of sources' names and rates are sent to every task.
BROADCAST_BYTES = 16 << 20
SALTS = 64
ADDED = ("n_copies", "copy_no", "shuffle_key")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from MD5 of the seed and the parts."""
    return hashed(seed, *parts) / F.lit(float(2**52))


def hashed(seed: int, *parts: Column) -> Column:
    """52 bits of MD5, as long."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def poisson_inverse(rate: Column, u: Column) -> Column:
    """How many k have P(X <= k) <= u: X's value at u. Steps until what is left is far below 2**-52; in logs, so that no rate underflows."""
    steps = F.sequence(F.lit(1), F.ceil(rate + 14 * F.sqrt(rate) + 30).cast("int"))
    state = F.named_struct(F.lit("lp"), -rate, F.lit("c"), F.exp(-rate), F.lit("n"), F.when(F.exp(-rate) <= u, 1).otherwise(0))

    def step(a: Column, k: Column) -> Column:
        lp = a["lp"] + F.log(rate) - F.log(k)
        c = a["c"] + F.exp(lp)
        # Where rounding keeps the sum below u, the far end has no part.
        on = (c <= u) & ((k <= rate) | (lp > -38.0))
        return F.named_struct(F.lit("lp"), lp, F.lit("c"), c, F.lit("n"), a["n"] + F.when(on, 1).otherwise(0))

    return F.aggregate(steps, state, step, lambda a: a["n"])


def rates(docs: DataFrame, weights: dict[str, float] | None, total: int | None) -> DataFrame:
    """source and rate. Without weights every source gets the same share; without a total the mix is as large as the input."""
    sizes = checkpointed(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    if weights is not None:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "w_source string, w double")
        sizes = sizes.join(table, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    else:
        sizes = sizes.withColumn("w", F.lit(1.0))
    all_w, all_n = sizes.agg(F.sum("w"), F.sum("n")).first()
    size = F.lit(int(total) if total is not None else all_n or 0)
    return sizes.withColumn("rate", F.col("w") / F.lit(all_w or 1.0) * size / F.col("n")).where("rate > 0").select("source", "rate")


def poisson_mix(
    docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = 17
) -> DataFrame:
    """``docs``, each row as often as it is drawn, in an order shuffled over all partitions.

    Added columns: ``n_copies``, ``copy_no`` from 0, and ``shuffle_key``, by which rows are dealt and sorted.
    """
    kept = others(docs.columns, *ADDED)
    of, rate, salt, deal = unused([*docs.columns, *ADDED], "of_source", "rate", "salt", "deal")
    table = rates(docs.select("source"), weights, total).select(F.col("source").alias(of), F.col("rate").alias(rate))
    rows = docs.select(*[F.col(quoted(c)) for c in kept])
    same = F.col("source").eqNullSafe(F.col(of))
    n_bytes = table.agg(F.sum(F.coalesce(F.octet_length(of), F.lit(0)) + 64)).first()[0] or 0
    if n_bytes <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(table), same)
    else:
        parts = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn(f"{salt}_", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = salted.join(parts, same & (F.col(f"{salt}_") == F.col(salt)))
    drawn = joined.withColumn("n_copies", poisson_inverse(F.col(rate), uniform(seed, F.col("doc_id"))).cast("int")).where("n_copies > 0")
    # Rows of one id, or of none, have one key; their other columns deal them out.
    plain = [F.col(quoted(c)) for c, kind in rows.dtypes if not any(x in kind for x in ("map<", "variant", "interval"))]
    mixed = (
        drawn.select(*[F.col(quoted(c)) for c in kept], "n_copies", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy_no"))
        .withColumn("shuffle_key", hashed(seed, F.col("doc_id"), F.col("copy_no")))
        .withColumn(deal, F.xxhash64("copy_no", *plain))
    )
    return mixed.repartition(F.col("shuffle_key"), F.col(deal)).sortWithinPartitions("shuffle_key", deal).drop(deal)
