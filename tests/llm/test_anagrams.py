import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import anagrams
from lumenfold.llm.queries import ORACLE_SQL, op13_spelling
from tests.compare import connect, same


def occurrences(rows):
    out = []
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                out.append(run)
    return out


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, min_count=2):
    n = {w: c for w, c in Counter(words).items() if c >= min_count}
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and is_near(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o.encode()), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=repr)


def told(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_pairs_of_few_letters(spark, seed):
    """Few letters make many anagrams, so the order has to be verified."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé") for _ in range(rng.choice((1, 2, 6, 7, 8)))) for _ in range(400)] * 2
    words += [w for w in set(words) for _ in range(rng.choice((0, 0, 0, 30)))] + ["x" * 3000, "x" * 3001] * 2
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    assert told(anagrams.variants(frame)) == brute(words)


def test_chains_lead_to_their_end(spark):
    words = ["abcdefg"] * 2 + ["abcdefx"] * 20 + ["abcdeyx"] * 200 + ["abcdeyxz"] * 2000 + ["abcdefh"] * 2
    got = told(anagrams.variants(spark.createDataFrame([(w,) for w in words], "word string")))
    assert got == brute(words)
    assert {r[2] for r in got if r[0] == "abcdefg"} == {"abcdeyxz"}


def test_anagrams_of_one_word_do_not_multiply(spark):
    """2 000 orders of the same letters: none is near another but by chance, and halves keep them apart."""
    rng = random.Random(5)
    words = sorted({"".join(rng.sample("abcdefghijkl", 12)) for _ in range(2000)})
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    rows = anagrams.entries(frame)
    meets = rows.groupBy("meets").count().select(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert meets < 30 * rows.count()
    assert anagrams.near_pairs(frame).count() == sum(is_near(a, b) for a, b in itertools.combinations(words, 2))


ROWS = [
    (1, "Letters LETTERS letters, lettres; Élèves×élèves abc1defghij abcdefgh_abcdefgh"), (2, None), (3, ""), (None, "letters Letterss letterss"), (4, "x" * 100_000),
    (5, "x" * 100_000), (1, "Letters LETTERS letters, lettres; Élèves×élèves abc1defghij abcdefgh_abcdefgh"),
    (6, "Ābcdefgh bcdefgh \U0001f600bcdefgh"),
] + [(10 + i, "letters written " * 3) for i in range(60)]


def test_texts(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).withColumn("run", F.lit("r"))
    assert sorted(r.word for r in anagrams.slipped_words(frame).collect()) == sorted(occurrences(ROWS))
    assert told(anagrams.variants(anagrams.slipped_words(frame))) == brute(occurrences(ROWS))
    assert told(anagrams.variants(anagrams.slipped_words(frame.limit(0)))) == []


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = same(op13_spelling(spark, sf), connect(sf), ORACLE_SQL["op13_spelling"])
    assert len(got) > 1000
