"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits are eight bytes. Two that differ in d bits or fewer differ in d
bytes at most, so they share 8 - d positional bytes at least: that is the guaranteed
minimum count. The index must bring every such pair together, yet a list for one byte
alone would hold a 256th of everything. So its lists are those of four positions at a
time, from a covering design: for any two positions one of the six sets avoids both, and
so a pair that shares six bytes is together in one list at least. For every pair in a list
the shared positional bytes are tallied, those below the minimum go, the rest are
verified bit by bit.

A list of more than LIST_CAP fingerprints (near copies of one text by the thousand) isn't
paired: each of its members is entered under itself and under each fingerprint that
differs in one of the 32 bits not fixed by the list. Two fingerprints are within two bits
just if they meet under one of these, and whoever meets there is within two bits; so a
star from the least of each such group keeps every component. That is exact, and linear
in the list's length.

keep_one and near_duplicates have another rule: texts are linked if the sets of their
five-word shingles have a Jaccard similarity of 0.8 or more. Fingerprints of these sets go
through the index above first, and its pairs are compared shingle by shingle. Alike sets may
differ in more bits than it reaches: they share one
of their first shingles by any common order (prefix filtering); here shingles of many
texts come last. Pairs of one list, of long lists those that the first pass left in different components, go by
their sizes and places, the rest are compared too; no pair that is alike is missed but for clashes of 64-bit hashes.

Defined results: a text that is null or has no words has fingerprint 0, linked like any
other; fewer than three words are one shingle; repeated rows share their fingerprint; a
null doc_id takes part and is the smallest of its component only if no other is there;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.batches import bounded_batches
from lumenfold.llm.columns import quoted, unused
from lumenfold.operators.components import connected_components
from lumenfold.session import checkpointed, discard, release, stored

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
MIN_SHARED_BYTES = 8 - MAX_BITS
#: Sets of four byte positions; any two positions are avoided by one of them.
LISTS = ((0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 4, 5), (2, 3, 6, 7), (0, 1, 6, 7), (2, 3, 4, 5))
LIST_CAP = 48
#: The shingles of keep_one, which links texts whose sets have a Jaccard similarity of 0.8 or more.
NEAR_WORDS = 5
#: Shingles that have a rank of their own; which ones have is a matter of speed alone.
MOST_COMMON = 1 << 18
#: Shingles that are hashed and counted at a time, so that long texts need little memory.
BLOCK = 1 << 16
#: Parts that a text's copies are dealt over.
SALTS = 32
#: Bytes of names of texts that are sent to every task at most; more are joined.
BROADCAST_BYTES = 32 << 20


def shingle_hashes(text: str | None, words_a_shingle: int) -> Iterator[np.ndarray]:
    """The hashes of the text's shingles in their order, a block at a time."""
    # bytes.lower changes A-Z alone; bytes.split cuts at the bytes 20 and 09 to 0D.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    n = max(1, len(words) - words_a_shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words_a_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        spans = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: str | None, words_a_shingle: int = SHINGLE_WORDS) -> int:
    """The text's SimHash, as a signed 64-bit number."""
    return _fingerprint(shingle_hashes(text, words_a_shingle))


def _fingerprint(blocks: Iterable[np.ndarray]) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _mask(positions: tuple[int, ...]) -> int:
    value = sum(0xFF << 8 * p for p in positions)
    return value - (1 << 64) if value >> 63 else value


def shared_bytes(a: Column, b: Column) -> Column:
    """The count of byte positions at which two fingerprints agree."""
    x = a.bitwiseXOR(b)
    return sum((F.when(x.bitwiseAND(F.lit(_mask((p,)))) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))


def links(fingerprints: DataFrame, list_cap: int = LIST_CAP) -> DataFrame:
    """``a``, ``b``: pairs of distinct fingerprints within two bits that connect all such pairs' components.

    ``fingerprints`` has one column ``fp`` of distinct longs. Of lists up to ``list_cap``
    every pair within two bits is here.
    """
    lists = F.array(*[
        F.struct(F.lit(i).alias("list"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("bytes")) for i, s in enumerate(LISTS)
    ])
    postings = fingerprints.select("fp", F.explode(lists).alias("p")).select("fp", "p.list", "p.bytes")
    sizes = checkpointed(postings.groupBy("list", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    light = (
        postings.join(sizes.where(F.col("n") <= list_cap), ["list", "bytes"])
        .groupBy("list", "bytes")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # at most list_cap
        .select(F.expr("""explode(flatten(transform(fps, (x, i) ->
            transform(slice(fps, i + 2, size(fps)), y -> struct(x as a, y as b)))))""").alias("p"))
        .select("p.a", "p.b")
        .where(shared_bytes(F.col("a"), F.col("b")) >= MIN_SHARED_BYTES)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    )
    free = F.array(*[
        F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << 8 * p + k)) for p in range(8) if p not in s for k in range(8)]) for s in LISTS
    ])
    heavy = (
        postings.join(sizes.where(F.col("n") > list_cap), ["list", "bytes"])
        .select("fp", "list", F.explode(F.element_at(free, F.col("list") + 1)).alias("bit"))
        .select("fp", "list", F.col("fp").bitwiseXOR(F.col("bit")).alias("near"))
        .groupBy("list", "near")
        .agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps"))  # at most 33
        .where(F.size("fps") > 1)
        .select("a", F.explode("fps").alias("b"))
        .where("a <> b")
    )
    return light.unionByName(heavy).distinct()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def by_fingerprint(docs: DataFrame, list_cap: int = LIST_CAP) -> DataFrame:
    """``docs`` with ``fp``, ``component`` (a fingerprint that names the group) and ``component_id``, the smallest doc_id that links of two bits reach. Texts are left out."""
    bounded_batches(docs.sparkSession)
    rows = checkpointed(docs.select(*[F.col(quoted(c)) for c in _others(docs)], fingerprint_udf(F.col("text")).alias("fp")))
    return _grouped(rows, links(rows.select("fp").distinct(), list_cap))


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("text", "fp", "component", "component_id")]


def _grouped(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rows`` with the component of their ``fp`` under ``pairs``, and its smallest doc_id."""
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(pairs, "a", "b")
    labelled = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    named = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = labelled.join(named, "component").select("fp", "component", "component_id")
    return rows.join(classes, "fp")


def shingle_set(text: str | None, words_a_shingle: int = NEAR_WORDS) -> np.ndarray:
    """The distinct hashes of the text's shingles, in their order as signed numbers."""
    blocks = list(shingle_hashes(text, words_a_shingle))
    return np.unique(np.concatenate(blocks).view(np.int64)) if blocks else np.zeros(0, np.int64)


def set_fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of the set, each shingle once."""
    return _fingerprint(shingles[at : at + BLOCK] for at in range(0, len(shingles), BLOCK))


def fingerprint_pairs(sets: DataFrame, list_cap: int = LIST_CAP) -> DataFrame:
    """``a``, ``b``: pairs of sets that the index of fingerprints brings together.

    ``sets``: ``fp``, a name, and ``print``. Sets of one fingerprint form a star, and of each two linked fingerprints the least sets are a pair.
    """
    least = checkpointed(sets.groupBy("print").agg(F.min("fp").alias("least")))
    of_a, of_b = (least.select(F.col("print").alias(x), F.col("least").alias(f"of_{x}")) for x in "ab")
    near = links(least.select(F.col("print").alias("fp")), list_cap).join(of_a, "a").join(of_b, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    equal = sets.join(least, "print").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return equal.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def set_id(shingles: np.ndarray) -> int:
    """A number that names the set; 0 if it is empty."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63) if len(shingles) else 0


def prefix(shingles: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first of the set's shingles by rank, then hash; two sets that are alike share one of these at least.

    ``common`` are the sorted low halves of shingles in many sets and ``ranks`` their ranks
    from 1; all others have rank 0. Sets that are 0.8 alike share 0.8 of each, so the last
    0.8 of one, less one shingle, can't hold all that they share.
    """
    n = len(shingles)
    take = n - (4 * n + 4) // 5 + 1 if n else 0
    if len(common) and n:
        low = shingles.astype(np.int32)
        at = np.minimum(np.searchsorted(common, low), len(common) - 1)
        rank = np.where(common[at] == low, ranks[at], 0)
        shingles = shingles[np.lexsort((shingles, rank))]
    return shingles[:take]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is 0.8 or more."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Low halves of the shingles that most sets hold, sorted, and their ranks by count; MOST_COMMON at most."""

    @F.pandas_udf("array<int>")
    def halves(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t).astype(np.int32) for t in texts])

    counts = docs.select(F.explode(halves("text")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    counts = checkpointed(counts.where(F.col("n") > LIST_CAP).withColumn("level", F.floor(F.log2("n")).cast("int")))
    least, total = 99, 0
    for r in sorted(counts.groupBy("level").count().collect(), reverse=True):
        total += r["count"]
        if total > MOST_COMMON:
            break
        least = r.level
    found = counts.where(F.col("level") >= least).select("s", "n").toPandas().sort_values(["n", "s"])
    low = found["s"].to_numpy(np.int32)
    by_value = np.argsort(low)
    return low[by_value], by_value + 1


def _in_order(x: str, y: str) -> list[Column]:
    turned = F.col(f"{x}.fp") > F.col(f"{y}.fp")
    return [F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x), F.when(turned, F.col(x)).otherwise(F.col(y)).alias(y)]


def set_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``fp`` (a name of the text's shingle set) in place of the text, and ``a``, ``b``: pairs of alike sets that connect all such pairs' components."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = spark.sparkContext.broadcast(_common(docs.select("text")))
    release(spark)

    @F.pandas_udf("fp long, n int, prefix array<long>, print long")
    def marks(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_set(t) for t in texts]
            yield pd.DataFrame({
                "fp": [set_id(s) for s in sets], "n": [len(s) for s in sets], "prefix": [prefix(s, *known.value) for s in sets],
                "print": [set_fingerprint(s) for s in sets],
            })

    @F.pandas_udf("fp long, shingles array<long>")
    def whole(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t) for t in texts]
        return pd.DataFrame({"fp": [set_id(s) for s in sets], "shingles": sets})

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alike(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    text_hash = F.xxhash64("text").alias("t")
    rows = stored(docs.select(*[F.col(quoted(c)).alias(f"c_{c}") for c in _others(docs)], text_hash, marks(F.col("text")).alias("m")).select("*", "m.*").drop("m"))
    named = fingerprint_pairs(checkpointed(rows.where("n > 0").select("fp", "print").distinct()))
    release(spark)
    sets = rows.where("n > 0").select("fp", "n", "prefix").dropDuplicates(["fp"])
    # Dealt out as rows, which are a fraction of the bytes of an aggregate's unfinished lists.
    postings = sets.select("fp", "n", F.posexplode("prefix").alias("at", "s")).repartition("s")
    lists = postings.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("n", "fp", "at"))).alias("l"))
    lists = stored(lists.where(F.size("l") > 1))
    del sets, postings
    release(spark)

    def only_alike(pairs: DataFrame) -> DataFrame:
        # Sets are made again, of those texts alone that a pair names.
        pairs = stored(pairs.select("a", "b"))
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        named = rows.where("n > 0").groupBy("fp").agg(F.min("t").alias("t")).join(nodes, "fp", "left_semi").select("t")
        named = checkpointed(named.distinct())
        if 16 * named.count() <= BROADCAST_BYTES:
            # No text moves that no pair names, and of a text's copies each task gives one.
            texts = docs.select("text", text_hash).join(F.broadcast(named), "t", "left_semi")
        else:
            # Copies of one text are dealt over SALTS parts, and each part gives one before they meet.
            parts = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            salted = docs.select("text", text_hash, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
            texts = salted.join(parts, ["t", "salt"], "left_semi")
        texts = texts.groupBy("t").agg(F.first("text").alias("text"))
        held = stored(texts.select(whole(F.col("text")).alias("w")).select("w.*"))
        del texts, named
        release(spark)
        of_a, of_b = (held.select(F.col("fp").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
        found = checkpointed(pairs.select("a", "b").join(of_a, "a").join(of_b, "b").where(verified("of_a", "of_b")).select("a", "b"))
        del of_a, of_b
        discard(held)
        discard(pairs)
        release(spark)
        return found

    near_size = "5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)"
    # Sets that follow each other by size in a long list are compared first: most near copies are one component then.
    long = lists.where(F.size("l") > LIST_CAP)
    chain = (
        long.select(F.expr("explode(zip_with(slice(l, 1, size(l) - 1), slice(l, 2, size(l)), (x, y) -> struct(x, y)))").alias("p"))
        .select("p.x", "p.y")
        .where(near_size)
        .select(*_in_order("x", "y"))
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    first = only_alike(named.unionByName(chain).distinct())
    del named, chain
    # Of the long lists' pairs only those of different components are left to compare; none is left out.
    component = checkpointed(connected_components(first, "a", "b").withColumnRenamed("node", "fp"))
    short = (
        lists.where(F.size("l") <= LIST_CAP)
        .select(F.expr("explode(flatten(transform(l, (x, i) -> transform(slice(l, i + 2, size(l)), y -> struct(x, y)))))").alias("p"))
        .select("p.x", "p.y")
        .where(near_size)
    )
    parts = (
        long.select("s", F.explode("l").alias("x"))
        .withColumn("fp", F.col("x.fp"))
        .join(component, "fp", "left")
        .groupBy("s", F.coalesce("component", "fp").alias("c"))
        .agg(F.collect_list("x").alias("xs"))
    )
    parts = checkpointed(parts)
    across = (
        parts.join(parts.select("s", F.col("c").alias("d"), F.col("xs").alias("ys")), "s")
        .where("c < d")
        .select(F.explode("xs").alias("x"), "ys")
        .select("x", F.explode("ys").alias("y"))
        .where(near_size)
    )
    # What a pair shares is what its lists tell, and at most all that stands after its last list in the shorter rest.
    pairs = (
        short.unionByName(across)
        .select(*_in_order("x", "y"))
        .groupBy(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
        .agg(
            F.count(F.lit(1)).alias("c"), F.max("x.at").alias("i"), F.max("y.at").alias("j"), F.first("x.n").alias("n"), F.first("y.n").alias("m"),
        )
        .where("9 * (c + least(n - i, m - j) - 1) >= 4 * (n + m)")
    )
    found = first.unionByName(only_alike(pairs))
    discard(lists)
    release(spark)
    return rows.select(*[F.col(quoted(f"c_{c}")).alias(c) for c in _others(docs)], "fp"), found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fp``, ``component`` (the ``fp`` that names the group) and ``component_id``, the smallest doc_id that links of similar shingle sets reach. Texts are left out."""
    return _grouped(*set_links(docs))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that with the smallest doc_id, and of equal ids the smallest hash of its text.

    A null doc_id comes last. Of rows with the kept doc_id and text one stays, that with the least other columns. All columns are kept, whatever their names.
    """
    marked, key, keep_id, keep_mark, row = unused(docs.columns, "mark", "key", "keep_id", "keep_mark", "row")
    columns = [F.col(quoted(c)) for c in docs.columns]
    mark = F.xxhash64("text")
    rows = near_duplicates(docs.select("doc_id", "text", mark.alias("mark")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("k")
    keepers = checkpointed(rows.groupBy("component").agg(first).select(F.col("k.doc_id").alias(keep_id), F.col("k.mark").alias(keep_mark)))
    kept = docs.select("*", mark.alias(marked)).join(keepers, F.col("doc_id").eqNullSafe(F.col(keep_id)) & (F.col(marked) == F.col(keep_mark)), "left_semi")
    again = checkpointed(rows.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(keep_id), F.col("mark").alias(keep_mark)))
    if again.isEmpty():
        return kept.select(*columns)
    repeated = F.col("doc_id").eqNullSafe(F.col(keep_id)) & (F.col(marked) == F.col(keep_mark))
    # The least row of each, found before the shuffle in part: a row with any number of repeats does no harm.
    ordered = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rest = [F.first(quoted(c)).alias(f"{key}{i}") for i, c in enumerate(docs.columns) if c not in ordered]
    least = F.min(F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(ordered)])).alias(row)
    once = kept.join(again, repeated, "left_semi").groupBy("doc_id", marked).agg(least, *rest)
    place = {c: F.col(f"{row}.c{i}") for i, c in enumerate(ordered)}
    once = once.select(*[place.get(c, F.col(f"{key}{i}")).alias(c) for i, c in enumerate(docs.columns)])
    return kept.join(again, repeated, "left_anti").select(*columns).unionByName(once)
