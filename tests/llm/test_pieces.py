import random
import time
import tracemalloc

import numpy as np
import pytest

from lumenfold.llm import pieces
from lumenfold.llm.queries import op3_pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def every(part, v):
    """All segmentations."""
    if not part:
        yield 0.0, ()
        return
    for n in range(1, min(len(part), v.longest) + 1):
        i = v.ids.get(part[:n])
        if i is not None:
            first, score = (i,), v.units[i] / pieces.UNIT
        elif n == 1:
            first, score = v.spelled(part[0]), v.unknown / pieces.UNIT
        else:
            continue
        for s, rest in every(part[n:], v):
            yield score + s, first + rest


@pytest.mark.parametrize("part", ["▁hello", "▁▁x", "▁the😀a", "abcab", "▁", "\n", "▁zzz", "▁réeux"])
def test_n_best_is_exact(part, vocabulary):
    want = sorted((s for s, _ in every(part, vocabulary)), reverse=True)
    for n in (1, 2, 7, 500):
        got = pieces.n_best(part, vocabulary, n)
        assert [s for s, _ in got] == pytest.approx(want[:n]) and len({i for _, i in got}) == len(got)


def test_many_is_the_same_as_one(vocabulary):
    rng = random.Random(2)
    words = ["▁" + "".join(rng.choice("theandoéß,.x字😀") for _ in range(rng.randrange(1, 20))) for _ in range(400)]
    e = pieces.Encoder(vocabulary)
    e.learn(sorted(set(words)))
    ids, sizes, scores, losses = e.arrays()
    for w in set(words):
        k = e.index[w]
        two = pieces.n_best(w, vocabulary, 2)
        assert scores[k] == pytest.approx(two[0][0]) and tuple(ids[e.starts[k] : e.starts[k] + sizes[k]]) == two[0][1]
        assert losses[k] == pytest.approx(two[0][0] - two[1][0] if len(two) > 1 else np.inf)


def in_order(part, v):
    """All segmentations by the documented rule: score, fewer pieces, the longer piece at the right end."""
    def ends(ids):
        at, out = 0, []
        for i in ids:
            at += len(v.pieces[i])
            out.append(at)
        return out[-2::-1]

    return sorted(every(part, v), key=lambda x: (-x[0], len(x[1]), ends(x[1])))


@pytest.mark.parametrize("part", ["-" * 14, "ababababab", "▁▁▁▁▁▁", "aaaaaaaaaaaa", "▁====----"])
def test_ties_by_the_rule(part, vocabulary):
    want = in_order(part, vocabulary)
    for n in (1, 2, 4, 40):
        got = pieces.n_best(part, vocabulary, n)
        assert got[0][1] == want[0][1] and len({ids for _, ids in got}) == len(got) and {ids for _, ids in got} <= {ids for _, ids in want}
        assert [(s, len(ids)) for s, ids in got] == [(s, len(ids)) for s, ids in want[:n]]


def test_scores_that_are_not_whole_numbers():
    rng = random.Random(5)
    names = ["<unk>", *"abc", "ab", "bc", "abc", "ca", "aa", "▁a", "▁"]
    for _ in range(20):
        v = pieces.Vocabulary(names, [0.0, *(-rng.choice((0.125, 0.25, 0.375, 1.0625)) for _ in names[1:])], {}, {0})
        part = "".join(rng.choice("abc") for _ in range(12))
        want = in_order(part, v)
        got = pieces.n_best(part, v, 30)
        want.sort(key=lambda x: (-round(x[0], 5), len(x[1])))
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:30]]) and [len(i) for _, i in got] == [len(i) for _, i in want[:30]]


def applied(ids, following):
    row, shift = ids.tolist(), 0
    for one in following["edits"]:
        at = one["at"] + shift
        assert 0 <= at and at + one["n_old"] <= len(row)
        row[at : at + one["n_old"]] = one["ids"]
        shift += len(one["ids"]) - one["n_old"]
    return row


@pytest.mark.parametrize("text", ["the cat", "a b c", "x", "on\nit", "the the the", "-- --", "é x é", "a  b", "ab ab\n\nab", "zq 😀 z", "to be or", "in on"])
@pytest.mark.parametrize("n", [2, 4, 9])
def test_next_best_of_texts(text, n, vocabulary):
    e = pieces.Encoder(vocabulary)
    (ids, score, following), = e.encode([text], n)
    whole = sorted((s for s, _ in every(pieces.BLANK + text.replace(" ", pieces.BLANK), vocabulary)), reverse=True)
    assert score == pytest.approx(whole[0])
    assert [f["score"] for f in following] == pytest.approx(whole[1:n])
    rows = [applied(ids, f) for f in following]
    assert len({tuple(r) for r in [ids.tolist(), *rows]}) == len(rows) + 1 and all(e.decode(np.array(r)) == text for r in rows)
    for f, row in zip(following, rows, strict=True):
        spelled = sum(i in vocabulary.bytes_of for i in row)
        if not spelled:
            assert f["score"] == pytest.approx(sum(vocabulary.units[i] for i in row) / pieces.UNIT)


LETTERS = random.Random(9)
LONG = {
    "hyphens": "-" * 100_000, "equals": "=" * 100_001, "one letter": "a" * 100_000,
    "letters": "".join(LETTERS.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)),
    "base64": "".join(LETTERS.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(100_000)),
    "chinese": "".join(chr(LETTERS.randrange(0x4E00, 0x9FA5)) for _ in range(100_000)),
}


@pytest.mark.parametrize("kind", LONG)
def test_long_parts(kind, vocabulary):
    e = pieces.Encoder(vocabulary)
    began = time.perf_counter()
    (ids, score, following), = e.encode([LONG[kind]])
    assert time.perf_counter() - began < 2  # less than one on an idle core
    assert e.decode(ids) == LONG[kind] and [f["score"] for f in following] == sorted((f["score"] for f in following), reverse=True)
    assert len(following) == (0 if kind == "chinese" else 3) and all(f["score"] <= score for f in following)
    tracemalloc.start()
    pieces.Encoder(vocabulary).encode([LONG[kind][:20_000]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80_000_000


def test_without_a_prefix():
    v = pieces.Vocabulary(["<unk>", "a", "b", "▁a", "▁"], [0.0, -1.0, -1.5, -1.2, -2.0], {}, {0}, prefix=False)
    e = pieces.Encoder(v)
    assert [tuple(r[0]) for r in e.encode(["a a", " a"])] == [(1, 3), (3,)] and e.decode(np.array([3])) == " a" and e.decode(np.array([1, 3])) == "a a"


@pytest.mark.parametrize("text", ["hello  world\n\tx é 😀", "  a", " ", "a ", "\n\n", "x" * 3000, "tab\tand\r\nreturn", "\x00\x7f", "日本語 текст", "a" + " " * 100 + "b"])
def test_round_trip(text, vocabulary):
    e = pieces.Encoder(vocabulary)
    (ids, _, _), = e.encode([text])
    assert e.decode(ids) == text


def test_cache_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "KEEP", 10)
    e = pieces.Encoder(vocabulary)
    texts = [f"word{i} and more{i}" for i in range(50)]
    one = [tuple(e.encode([t])[0][0]) for t in texts]
    assert one == [tuple(r[0]) for r in pieces.Encoder(vocabulary).encode(texts)]


def test_frames(spark, vocabulary):
    rows = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (2, None, None), (None, "", 1), (3, "x ▁y", 2)], "doc_id long, text string, score int")
    odd = pieces.encode(rows.withColumnsRenamed({"score": "Piece_Ids"}).withColumn("a.b", rows["doc_id"]), vocabulary)
    assert [c for c in odd.columns if c not in pieces.NAMES] == ["doc_id", "text", "a.b"] and {r["a.b"] for r in odd.collect()} == {1, 2, 3, None}
    out = pieces.encode(rows, vocabulary)
    got = {(r.doc_id, r.text, r.n_pieces, r.round_trip) for r in out.collect()}
    assert {(2, None, 0, True), (None, "", 0, True)} < got and (3, "x ▁y", 5, False) in {(a, b, 5, d) for a, b, _, d in got}
    assert out.columns.count("score") == 1 and pieces.encode(rows.limit(0), vocabulary).count() == 0
    back = pieces.decode(out.select("doc_id", "piece_ids"), vocabulary)
    assert {r.text for r in back.where("doc_id = 1").collect()} == {"a b"}


def test_without_cuts():
    v = pieces.Vocabulary(["<unk>", "a", "▁a", "a▁a", "▁"], [0.0, -1.0, -1.5, -1.2, -2.0], {}, {0})
    assert not v.cut
    e = pieces.Encoder(v)
    assert e.encode(["a a"])[0][1] == pytest.approx(-3.0) or e.encode(["a a"])[0][1] == pytest.approx(max(s for s, _ in every("▁a▁a", v)))


def test_query(spark, sf):
    rows = op3_pieces(spark, sf).collect()
    assert len(rows) == 200 and all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in rows)
