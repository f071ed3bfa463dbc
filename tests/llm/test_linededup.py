import random

import pytest

from lumenfold.llm import linededup as L
from lumenfold.llm.queries import op8_linededup


def brute(docs, least):
    """Every shortest run of enough words from, or up to, each line; all but the first of equal ones go."""
    seqs, windows, first = [], [], {}
    for d, text in sorted(set(docs), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (text or "").split("\n")
        at = [i for i, x in enumerate(lines) if x.split()]
        seqs.append((d, text, lines, at, set()))
        s = len(seqs) - 1
        n = [len(lines[i].split()) for i in at]
        found = set()
        for a in range(len(at)):
            found |= {(a, b) for b in range(a + 1, len(at) + 1) if sum(n[a:b]) >= least and sum(n[a : b - 1]) < least}
            found |= {(b, a + 1) for b in range(a + 1) if sum(n[b : a + 1]) >= least and sum(n[b + 1 : a + 1]) < least}
        windows += [(s, a, b) for a, b in found]
    key = lambda s, a, b: tuple(seqs[s][2][i] for i in seqs[s][3][a:b])
    for s, a, b in windows:
        k = key(s, a, b)
        first[k] = min(first.get(k, (s, a)), (s, a))
    for s, a, b in windows:
        f = first[key(s, a, b)]
        if f != (s, a):
            begin = max(a, f[1] + b - a) if f[0] == s else a
            if begin < b:
                seqs[s][4].update(range(seqs[s][3][begin], seqs[s][3][b - 1] + 1))
    return {(d, t): t if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone) for d, t, lines, _, gone in seqs}


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(0, 6))) for _ in range(12)]
    docs = []
    for i in range(40):
        lines = [rng.choice(pool) for _ in range(rng.randrange(0, 14))] + [f"own {i}"]
        if docs and rng.random() < 0.4:
            other = rng.choice(docs)[1].split("\n")
            lines[3:3] = other[rng.randrange(len(other)) :]
        docs.append((i, "\n".join(lines)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id,): r.text for r in L.dedup_lines(frame, min_words=7).collect()}
    assert got == {(d,): t for (d, _), t in brute(docs, 7).items()}


def test_spans():
    assert L.spans([3, 1, 2, 5], 4) == ([2, 3, 2, 1], [0, 2, 3, 1])
    assert L.spans([1, 1], 5) == ([0, 0], [0, 0]) and L.spans([9], 5) == ([1], [1])


def test_passage(spark):
    passage = "\n".join(f"line {i} of a passage with some more words in it" for i in range(6))
    rows = [(2, f"before\n{passage}\nafter"), (1, f"x\n\n{passage}"), (3, passage.replace("\n", "\n\n")), (4, "clean text\nx\nx"), (None, None), (5, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "cast(length(text) as bigint) as n_chars", "'k' as cuts")
    out = {r.doc_id: r for r in L.dedup_lines(frame).collect()}
    assert out[1].text == f"x\n\n{passage}" and out[2].text == "before\nafter" and out[2].n_chars == 12 and out[2].removed_lines == list(range(1, 7))
    assert out[3].text == "" and out[4].text == "clean text\nx\nx" and out[None].text is None and out[5].text == ""
    assert L.dedup_lines(frame).columns == ["doc_id", "text", "n_chars", "cuts", "removed_lines"]


def test_repeats_inside_a_document(spark):
    text = "\n".join(["two words"] * 181)
    frame = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert {r.text for r in L.dedup_lines(frame).collect()} == {"\n".join(["two words"] * 25)}


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.dedup_lines(frame).count() == 0
    long = spark.createDataFrame([(1, "w " * 60_000), (2, "w " * 60_000)], "doc_id long, text string")
    assert sorted(len(r.text) for r in L.dedup_lines(long).collect()) == [0, 120_000]


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {(r.doc_id,): r.text for r in op8_linededup(spark, sf).collect()} == {(d,): t for (d, _), t in brute(docs, 50).items()}


def test_ranks_are_the_order(spark):
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(-50, 50), rng.randrange(50)) for _ in range(900)})
    frame = spark.createDataFrame(rng.sample(pairs, len(pairs)), "name long, half long").repartition(7)
    rows = L.ranked(frame, ["name", "half"]).collect()
    assert [(r.name, r.half) for r in sorted(rows, key=lambda r: r["rank"])] == pairs and sorted(r["rank"] for r in rows) == list(range(len(pairs)))
    assert L.ranked(frame.limit(0), ["name", "half"]).count() == 0


def by_longest_matches(docs, least):
    """A line goes if it is in a run of enough words that an earlier document has too, found by extending every pair of equal lines."""
    out, before = {}, []
    for d, text in docs:
        lines = text.split("\n")
        gone = set()
        for other in before:
            for i in range(len(lines)):
                for j in range(len(other)):
                    n = 0
                    while i + n < len(lines) and j + n < len(other) and lines[i + n] == other[j + n]:
                        n += 1
                    if sum(len(x.split()) for x in lines[i : i + n]) >= least:
                        gone |= set(range(i, i + n))
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        before.append(lines)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_longest_matches_go(spark, seed):
    rng = random.Random(seed)
    own = iter(range(10**6))
    passages = [[f"line {k} of passage {p} here" for k in range(rng.randrange(1, 40))] for p in range(6)]
    docs = []
    for i in range(30):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            lines += [f"own line {next(own)}" for _ in range(rng.randrange(3))]
            some = rng.choice(passages)
            begin = rng.randrange(len(some))
            part = some[begin : begin + rng.randrange(1, 41)]
            lines += part if not set(part) & set(lines) else []
        docs.append((i, "\n".join(lines)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.text for r in L.dedup_lines(frame, min_words=30).collect()} == by_longest_matches(docs, 30)


def test_maximal_runs(spark):
    hits = spark.createDataFrame([(5, 1, s, 3, (2, 7, s - 4)) for s in (4, 5, 6, 10)] + [(5, 1, 4, 3, (3, 8, 4)), (6, 1, 2, 3, (6, 1, 1))], "d long, t long, start int, len int, head struct<d: long, t: long, start: int>")
    got = {tuple(r) for r in L.maximal_runs(hits).select("d", "from", "to", "of_d", "of_from").collect()}
    assert got == {(5, 4, 9, 2, 0), (5, 10, 13, 2, 6), (5, 4, 7, 3, 4), (6, 4, 5, 6, 3)}
