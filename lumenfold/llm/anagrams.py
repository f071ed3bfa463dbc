"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' fifth powers, whatever their order. Words that differ by one letter more have keys that
differ by that letter's value; words that differ by one letter in place of another, by the difference of two values. So each word is entered under its key
and under its key less the value of each letter it has: a word and one with a letter more meet at the first's key, and an exchange meets where both
have lost their own letter. Fifth powers of letters have no two equal sums of two, so the letters lost are those of the difference.

The key forgets the order of letters, which makes anagrams of any number meet. So a word is entered twice, with its first half and
with its second half beside the key: one difference leaves one of them as it is. What meets is then verified in order, by edit distance.
A pair that agrees in the first half isn't taken from the second, so each pair is found once and no DISTINCT is needed.

Occurrences are counted in part before the shuffle; only words that occur often enough are entered, with at most twice as many entries as the alphabet has
letters, so a word's neighbours, and the entries that meet, are bounded by its letters and not by the corpus.

Defined results: a null text has no words, a null id is written as an empty string; of neighbours with equal counts the first in code-point order is the
form; repeated rows count each; very long words are words (their keys go round at 2**62, which keeps differences); an empty table gives an empty one; other columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.session import checkpointed, discard, stored

LETTERS = "A-Za-zÀ-ÿ"
SLIP_EVERY = 31
MIN_LENGTH = 7
MIN_COUNT = 2
#: A word's form is so many times as frequent.
TIMES = 10
POWER = 5
_ROUND = (1 << 62) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slipped_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = SLIP_EVERY, min_length: int = MIN_LENGTH) -> DataFrame:
    """``word`` of each run of letters with ``min_length`` letters or more after one in ``every`` has lost a letter, as a hash of id and run says."""
    # Shorter runs can't give a word; a longer one is matched whole from its first letter.
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return rows.select(F.when(F.col("h") % every == 0, slipped).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= min_length)


def value(letter: Column) -> Column:
    return F.pow(F.ascii(letter).cast("double"), F.lit(float(POWER))).cast("long")


def entries(words: DataFrame) -> DataFrame:
    """``meets``, ``side``, ``lost`` (empty for the word's own key), ``word``, ``n``: where words that are near can meet."""
    letters = F.split("word", "")
    key = F.aggregate(letters, F.lit(0).cast("long"), lambda a, c: (a + value(c)).bitwiseAND(F.lit(_ROUND)))
    keyed = words.select("word", "n", key.alias("key"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct(letters))).alias("lost"))
    less = F.when(F.col("lost") == "", F.col("key")).otherwise((F.col("key") - value(F.col("lost")) + F.lit(_ROUND + 1)).bitwiseAND(F.lit(_ROUND)))
    # Of both words of a pair these are the same: the shorter's length, or one less than that of two alike.
    length = F.char_length("word") - F.when(F.col("lost") == "", 0).otherwise(1)
    half = F.floor(length / 2).cast("int")
    first, second = F.substring("word", F.lit(1), half), F.substring("word", F.char_length("word") - length + half + 1, length)
    sides = F.array(F.struct(F.lit(0).alias("side"), first.alias("part")), F.struct(F.lit(1).alias("side"), second.alias("part")))
    both = keyed.select("word", "n", "lost", less.alias("less"), length.alias("length"), first.alias("first"), F.explode(sides).alias("s"))
    meets = F.xxhash64("less", "length", "s.side", "s.part")
    return both.select(meets.alias("meets"), F.col("s.side").alias("side"), "lost", "word", "n", "first")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a``, ``b``, ``n_a``, ``n_b``: words that differ by one letter more, less or in place of another, each pair once (a before b)."""
    rows = entries(words)
    left = rows.select("meets", F.col("side").alias("side_a"), F.col("lost").alias("lost_a"), F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("first").alias("first_a"))
    right = rows.select("meets", F.col("side").alias("side_b"), F.col("lost").alias("lost_b"), F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("first").alias("first_b"))
    once = (F.col("side_a") == 0) | (F.col("first_a") != F.col("first_b"))
    near = (F.col("a") < F.col("b")) & (F.col("lost_a") != F.col("lost_b")) & (F.col("side_a") == F.col("side_b")) & once & (F.levenshtein("a", "b", 1) == 1)
    return left.join(right, "meets").where(near).select("a", "b", "n_a", "n_b")


def forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` of all ``words``."""
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("w"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("w"), F.col("a").alias("other"), F.col("n_a").alias("m"))
    )
    best = both.groupBy("w").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    rows = words.join(best, F.col("word") == F.col("w"), "left")
    is_form = -F.col("best.less") >= times * F.col("n")
    return rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
    )


def roots(steps: DataFrame) -> DataFrame:
    """``w`` and ``last``: where the words of ``steps`` (word, form) lead. Ways double each round, and counts grow tenfold each step: a few rounds."""
    now = checkpointed(steps.select(F.col("word").alias("w"), F.col("form").alias("last")))
    while True:
        ahead = now.select(F.col("w").alias("at"), F.col("last").alias("on"))
        then = checkpointed(now.join(ahead, F.col("last") == F.col("at"), "left").select("w", F.coalesce("on", "last").alias("last"), F.col("on").isNotNull().alias("moved")))
        now = then.select("w", "last")
        if then.where("moved").isEmpty():
            return now


def variants(occurrences: DataFrame, min_count: int = MIN_COUNT, times: int = TIMES) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of each ``word`` that occurs ``min_count`` times or more."""
    counted = occurrences.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    words = stored(counted)
    found = stored(forms(words, times))
    ends = roots(found.where("form is not null"))
    discard(words)
    rows = found.join(ends, F.col("word") == F.col("w"), "left")
    return rows.select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")
