import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import simhash
from lumenfold.llm.queries import op2_simhash


def slow(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBcÉé \t\n", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == slow(text)


def test_blocks_of_long_texts(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(text) == whole


def test_lists_cover_all_pairs_of_positions():
    for a in range(8):
        for b in range(8):
            assert any(a not in s and b not in s for s in simhash.LISTS)


def brute(values):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if ((values[i] ^ values[j]) & (1 << 64) - 1).bit_count() <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_components_with_long_and_short_lists(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(30)]
    for base in values[:4]:  # chains and clouds, with lists far over the cap
        x = base
        for _ in range(60):
            x ^= 1 << rng.randrange(64)
            values.append(x)
        values += [base ^ 1 << a ^ 1 << b for a, b in [(rng.randrange(32), rng.randrange(32)) for _ in range(60)] if a != b]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    expect = brute(values)
    groups = {}
    for v, g in zip(values, expect, strict=True):
        groups.setdefault(g, set()).add(v)
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    for cap in (2, 8, 1000):
        found = {}
        for r in simhash.connected_components(simhash.links(frame, cap), "a", "b").collect():
            found.setdefault(r.component, set()).add(r.node)
        assert {frozenset(g) for g in found.values()} == want


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string, lang string")


def test_edges(spark):
    text = "one two three four five six"
    rows = docs(spark, (5, text, "a"), (3, text.upper(), None), (9, None, "a"), (8, "", "a"), (None, " \n", "a"), (3, text.upper(), None), (7, "short", "x"))
    out = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect()}
    assert out == {(5, 3), (3, 3), (9, 8), (8, 8), (None, 8), (7, 7)}
    assert simhash.near_duplicates(rows.limit(0)).count() == 0
    kept = simhash.keep_one(rows)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8] and kept.columns == rows.columns
    clash = rows.withColumnRenamed("lang", "fp")
    assert simhash.keep_one(clash).count() == 3 and simhash.near_duplicates(clash).columns.count("fp") == 1
    assert simhash.keep_one(rows.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op2_simhash(spark, sf).collect()}
    values = [slow(r.text) for r in rows]
    roots = brute(values)
    least = {}
    for r, g in zip(rows, roots, strict=True):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    for r, v, g in zip(rows, values, roots, strict=True):
        assert got[r.doc_id].fingerprint == f"{v:016x}" and got[r.doc_id].component_id == least[g]


def test_keep_one_by_five_words_and_similarity(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(150)]
        for _ in range(9 if base else 40):
            copy = words[:]
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy), "a"))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    far = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
                far += (simhash.fingerprint(rows[i][1]) ^ simhash.fingerprint(rows[j][1])).bit_count() > simhash.MAX_BITS
    assert far
    frame = docs(spark, *rows)
    for cap, n_bytes in ((3, 0), (48, 1 << 20)):
        monkeypatch.setattr(simhash, "LIST_CAP", cap)
        monkeypatch.setattr(simhash, "BROADCAST_BYTES", n_bytes)
        assert {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()} == {i: find(i) for i in range(len(rows))}
        assert sorted(r.doc_id for r in simhash.keep_one(frame).collect()) == sorted({find(i) for i in range(len(rows))})


def test_keep_one_asks_the_index_of_fingerprints(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{rng.randrange(400)}" for _ in range(300)]
    texts = [" ".join(words[:i] + ["x"] + words[i:]) for i in range(5, 300, 30)] + [" ".join(rng.sample(words, 90)) for _ in range(10)]
    sets = [simhash.shingle_set(t) for t in texts]
    prints = [simhash.set_fingerprint(s) for s in sets]
    names = [simhash.set_id(s) for s in sets]
    # The plain reading of a fingerprint: a bit is 1 if it is in over half of the set's shingles.
    for s, p in zip(sets, prints, strict=True):
        assert p & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in s) > len(s))
    frame = spark.createDataFrame([*zip(names, prints, strict=True), (1, prints[0])], "fp long, print long")
    roots = brute([p & (1 << 64) - 1 for p in [*prints, prints[0]]])
    found = {r.node: r.component for r in simhash.connected_components(simhash.fingerprint_pairs(frame), "a", "b").collect()}
    got = [found.get(n, n) for n in [*names, 1]]
    assert {(i, j) for i, x in enumerate(got) for j, y in enumerate(got) if x == y} == {(i, j) for i, x in enumerate(roots) for j, y in enumerate(roots) if x == y}
    calls, whole = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a: calls.append(1) or whole(*a))
    assert simhash.keep_one(docs(spark, *[(i, t, "a") for i, t in enumerate(texts)])).count() == 11 and calls
