"""Line deduplication: a suffix array over line ids by prefix doubling, and its intervals of common prefixes.

A document is a sequence of line ids. All suffixes are ranked by their first 1, 2, 4, ... lines: a line's rank is its id, and
a suffix's rank by 2 * m lines is the place of the pair of ranks by m lines, its own and that of the suffix m lines on, in the
order of all such pairs. Pairs are sorted by range over all tasks (:func:`ranked`), so the ranks are the suffix array's order; suffixes
with a rank of their own are in no interval, and leave.

A run of lines is repeated if it has ``min_words`` words or more and stands elsewhere too. The suffixes that have a run in
common are an interval of the array, whose longest common prefix is the run or more; its first and last power of two of lines
name it. The intervals wanted are those of the shortest such runs that begin, or end, at each line: they cover all others.
Occurrences that follow on one another in a document, as do their first occurrences, are put together (:func:`maximal_runs`): runs that
can't be made longer on either side. The first occurrence, by doc_id and then by line, stays; the lines of later ones go.

Lines are cut at \\n and compared exactly; lines without a word are skipped in the
sequences, and go only with a deleted run that has them inside.

Defined results: a null text stays null and an empty one empty; a text that is all
repeated becomes empty and its row stays; rows with equal doc_id and text are one document
and get the same new text; a null doc_id stands before others; where an occurrence overlaps
the first one in a document, only the lines beyond the first one go; an empty table
gives an empty one. All columns are kept, and n_chars, if there, is the new text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.batches import bounded_batches
from lumenfold.llm.columns import quoted
from lumenfold.session import checkpointed, discard, stored

#: "Over 50 words": a run of 50 words or more is a passage.
MIN_WORDS = 50
KEY = ["d", "t"]
NO_ID = -(1 << 63)
_CHECK_SEED = 7


def _keys(docs: DataFrame) -> list[Column]:
    """Which document a row belongs to: its id and text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("t")]


def sequence(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """Number, id and words of each line that has a word."""
    at, ids, words = [], [], []
    for i, line in enumerate((text or "").split("\n")):
        if n := len(line.split()):
            at.append(i)
            ids.append(xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63))
            words.append(n)
    return at, ids, words


def spans(words: list[int], min_words: int) -> tuple[list[int], list[int]]:
    """For each line, how many lines from it on, and up to it, have ``min_words`` words at least; 0 if all have fewer."""
    total = np.concatenate(([0], np.cumsum(words)))
    lines = np.arange(len(words))
    ends = np.searchsorted(total, total[:-1] + min_words, side="left")
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    return np.where(ends <= len(words), ends - lines, 0).tolist(), np.where(starts >= 0, lines - starts + 1, 0).tolist()


def stretches(numbers: list[int], words: list[int], min_words: int) -> Iterator[tuple[int, int]]:
    """Begin and end of consecutive numbers with ``min_words`` words at least."""
    begin = 0
    for i in range(1, len(numbers) + 1):
        if i == len(numbers) or numbers[i] != numbers[i - 1] + 1:
            if sum(words[begin:i]) >= min_words:
                yield begin, i
            begin = i


_SEQUENCE = "ns array<int>, ids array<long>, words array<int>"


def line_table(docs: DataFrame) -> DataFrame:
    """One row a document: its key and the arrays of its sequence."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(_SEQUENCE)
    def cut(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sequence(t) for t in texts], columns=["ns", "ids", "words"])

    return docs.select(*_keys(docs), cut(F.col("text")).alias("s")).select(*KEY, "s.*").dropDuplicates(KEY)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``d``, ``t`` and ``cuts``: places in the document's sequence, from and to, whose lines repeat earlier ones."""
    table = stored(line_table(docs))
    lines = table.select(*KEY, F.posexplode(F.arrays_zip("ids", "words")).alias("n", "l")).select(
        *KEY, "n", F.col("l.ids").alias("id"), F.col("l.words").alias("words")
    )
    # Kept, as all tables of counts below, so that the join has rows of one id split when there are many.
    twice = checkpointed(lines.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id"))
    # Depth 1: lines that stand elsewhere, in stretches long enough.
    kept = (
        lines.join(twice, "id", "left_semi")
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_list(F.struct("n", "id", "words"))).alias("l"))
    )
    level = "n int, name long, ahead int, back int, ahead_check long, back_check long"

    @F.pandas_udf(f"array<struct<{', '.join(x.replace(' ', ':') for x in level.split(', '))}>>")
    def first(ns: pd.Series, ids: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([_first(list(a), list(b), list(c), min_words) for a, b, c in zip(ns, ids, words, strict=True)])

    base = checkpointed(
        kept.select(*KEY, F.explode(first(F.col("l.n"), F.col("l.id"), F.col("l.words"))).alias("r")).select(*KEY, "r.*")
    )
    levels, now, k = [base.select(*KEY, F.lit(0).alias("k"), "n", "name")], base.select(*KEY, "n", "name"), 0
    longest = base.agg(F.max(F.greatest("ahead", "back"))).first()[0] or 0
    while 2 << k <= longest:
        later = Window.partitionBy(*KEY).orderBy("n").rangeBetween(1 << k, 1 << k)
        pairs = now.withColumn("half", F.first("name").over(later)).where("half is not null")
        classes = ranked(pairs.groupBy("name", "half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), ["name", "half"])
        now, k = checkpointed(pairs.join(classes, ["name", "half"]).select(*KEY, "n", F.col("rank").alias("name"))), k + 1
        if now.isEmpty():
            break
        levels.append(now.select(*KEY, F.lit(k).alias("k"), "n", "name"))
    names = levels[0]
    for other in levels[1:]:
        names = names.unionByName(other)
    runs = (
        base.where("ahead > 0")
        .select(*KEY, F.col("n").alias("start"), F.col("ahead").alias("len"), F.col("ahead_check").alias("check"))
        .unionByName(
            base.where("back > 0").select(
                *KEY, (F.col("n") - F.col("back") + 1).alias("start"), F.col("back").alias("len"), F.col("back_check").alias("check")
            )
        )
        .distinct()
        .withColumn("k", F.floor(F.log2(F.col("len").cast("double")) + 1e-9).cast("int"))
    )
    left = names.withColumnRenamed("n", "start").withColumnRenamed("name", "left")
    right = names.withColumnRenamed("n", "second").withColumnRenamed("name", "right")
    named = (
        runs.join(left, [*KEY, "k", "start"])
        .withColumn("second", F.expr("cast(start + len - shiftleft(1, k) as int)"))
        .join(right, [*KEY, "k", "second"])
        .select("len", "left", "right", "check", *KEY, "start")
    )
    named = checkpointed(named)
    interval = ["len", "left", "right", "check"]
    heads = checkpointed(
        named.groupBy(*interval)
        .agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*KEY, "start")).alias("head"))
        .where("c > 1")
        .drop("c")
    )
    hits = named.join(heads, interval).where(F.struct(*KEY, "start") > F.col("head"))
    runs = checkpointed(maximal_runs(hits))
    discard(table)
    return runs.groupBy(*KEY).agg(F.collect_set(F.struct("from", "to")).alias("cuts"))  # of one document


def maximal_runs(hits: DataFrame) -> DataFrame:
    """``d``, ``t``, ``from``, ``to``, and ``of_d``, ``of_t``, ``of_from``: lines that repeat earlier ones, and where those begin.

    ``hits``: occurrences (``d``, ``t``, ``start``, ``len``) and their runs' first ones (``head``). In one document the lines
    of the first occurrence have no part in the later one.
    """
    same = (F.col("d") == F.col("head.d")) & (F.col("t") == F.col("head.t"))
    begin = F.when(same, F.greatest("start", F.col("head.start") + F.col("len"))).otherwise(F.col("start"))
    rows = hits.select(
        *KEY, F.col("head.d").alias("of_d"), F.col("head.t").alias("of_t"), (F.col("start") - F.col("head.start")).alias("on"),
        begin.alias("from"), (F.col("start") + F.col("len")).alias("to"),
    ).where(F.col("from") < F.col("to"))
    line = [*KEY, "of_d", "of_t", "on"]
    earlier = Window.partitionBy(*line).orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*line).orderBy("from", "to").rowsBetween(Window.unboundedPreceding, 0)
    apart = F.when(F.col("from") > F.max("to").over(earlier), 1).otherwise(0)
    found = rows.withColumn("apart", apart).withColumn("run", F.sum("apart").over(upto))
    found = found.groupBy(*line, "run").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    return found.select(*KEY, "from", "to", "of_d", "of_t", (F.col("from") - F.col("on")).alias("of_from"))


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows``, all different, with ``rank``: their place in the order of ``by`` over all tasks, from 0."""
    low = (1 << 33) - 1
    placed = checkpointed(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33).cast("int")
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a task
    starts = np.concatenate(([0], np.cumsum([n for _, n in sizes], dtype=np.int64)))
    table = rows.sparkSession.createDataFrame([(p, int(at)) for (p, _), at in zip(sizes, starts[:-1], strict=True)], "part int, before long")
    return placed.withColumn("part", part).join(F.broadcast(table), "part").withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit(low))).drop("part", "before", "place")


def _first(ns: list[int], ids: list[int], words: list[int], min_words: int) -> list[tuple]:
    out = []
    for a, b in stretches(ns, words, min_words):
        ahead, back = spans(words[a:b], min_words)
        raw = np.array(ids[a:b], np.int64).tobytes()

        def check(begin: int, n: int) -> int:
            return xxhash.xxh64_intdigest(raw[8 * begin : 8 * (begin + n)], _CHECK_SEED) - (1 << 63) if n else 0

        for i in range(b - a):
            out.append((ns[a + i], ids[a + i], ahead[i], back[i], check(i, ahead[i]), check(i - back[i] + 1, back[i])))
    return out


def without(text: str | None, cuts: list | None) -> tuple[str | None, list[int]]:
    """``text`` without the lines of ``cuts``, and the numbers of these lines."""
    if text is None or cuts is None or not len(cuts):
        return text, []
    lines = text.split("\n")
    at = [i for i, line in enumerate(lines) if line.split()]
    gone: set[int] = set()
    for cut in cuts:
        gone.update(range(at[cut["from"]], at[cut["to"] - 1] + 1))
    return "\n".join(line for i, line in enumerate(lines) if i not in gone), sorted(gone)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs of lines deleted, and ``removed_lines``, their numbers from 0."""
    cuts = repeated_runs(docs.select("doc_id", "text"), min_words)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("new_text string, removed_lines array<int>")
    def delete(texts: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([without(t, c) for t, c in zip(texts, cuts, strict=True)], columns=["new_text", "removed_lines"])

    others = [c for c in docs.columns if c not in ("text", "removed_lines", "n_chars")]
    key = _keys(docs)
    joined = docs.select(*[F.col(quoted(c)).alias(f"c_{c}") for c in docs.columns if c != "removed_lines"], *key).join(cuts, KEY, "left")
    joined = joined.withColumn("deleted", F.when(F.col("cuts").isNotNull(), delete("c_text", "cuts")))
    changed = F.col("deleted").isNotNull()
    new = {
        "text": F.when(changed, F.col("deleted.new_text")).otherwise(F.col("c_text")),
        "removed_lines": F.coalesce("deleted.removed_lines", F.array().cast("array<int>")),
    }
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("deleted.new_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("c_n_chars"))
    order = [c for c in docs.columns if c != "removed_lines"] + ["removed_lines"]
    return joined.select(*[new[c].alias(c) if c in new else F.col(quoted(f"c_{c}")).alias(c) for c in order if c in new or c in others])
