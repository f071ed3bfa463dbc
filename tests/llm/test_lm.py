import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenfold.llm import lm
from lumenfold.llm.queries import op5_lm


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def test_codes_are_prefix_free_and_short():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 300):
        w = rng.zipf(1.4, n).astype(float)
        starts, lengths, nodes, bits = lm._flat(lm.huffman(w))
        codes = ["".join(map(str, bits[s : s + k])) for s, k in zip(starts, lengths, strict=True)]
        assert len(set(codes)) == n and sum(2.0 ** -len(c) for c in codes) == pytest.approx(1)
        assert not any(a != b and b.startswith(a) for a in codes[:50] for b in codes[:50])
        h = -(w / w.sum() * np.log2(w / w.sum())).sum()
        assert h <= (w * lengths).sum() / w.sum() + 1e-9 <= h + 1 + 1e-9


def fitted(spark, texts):
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    return lm.fit(docs)


def total(row):
    """What a text scores if none of its other words is counted: spelled."""
    return row[5] + sum(row[4])


def test_probabilities_sum_to_one(spark):
    """All first tokens over a tiny alphabet, with what is left for others, are one at most."""
    model, _ = fitted(spark, ["a b", "a a b", "b", ""])
    assert model.ready()["n"] == 2
    end = 10 ** total(model.score([""])[0])
    # Each is a token and then an end; the token alone is what is left without the end's part.
    first = {w: 10 ** total(model.score([w])[0]) for w in ("a", "b", "c", "ab")}
    assert 0 < end < 1 and all(0 < p < 1 for p in first.values()) and sum(first.values()) + end < 1
    assert first["a"] > first["c"]


def test_neighbours_in_a_batch_do_not_matter(spark):
    texts = ["the cat sat on the mat " * 200, "a dog", "", None, "the cat sat " * 5, "zq xv " * 300]
    model, _ = fitted(spark, texts)
    whole = [total(s) for s in model.score(texts)]
    assert whole == pytest.approx([total(model.score([t])[0]) for t in texts], rel=1e-5)
    assert whole[2] == whole[3]


def test_learns_inside_a_document(spark):
    model, _ = fitted(spark, ["some usual words here", "other words there"])
    many = total(model.score(["qwxz " * 400])[0])
    one = total(model.score(["qwxz"])[0])
    assert -many < -one * 400 * 0.5


def test_the_word_before_is_a_context(spark):
    rng = np.random.default_rng(3)
    pairs = [("red", "apple"), ("green", "leaf"), ("blue", "sea"), ("white", "snow")]
    texts = [" ".join(f"{a} {b}" for a, b in (pairs[k] for k in rng.integers(0, 4, 30))) for _ in range(300)]
    model, _ = fitted(spark, texts)
    right = " ".join(f"{a} {b}" for a, b in pairs)
    wrong = " ".join(f"{a} {pairs[(i + 1) % 4][1]}" for i, (a, _) in enumerate(pairs))
    assert total(model.score([right])[0]) > total(model.score([wrong])[0]) + 2
    assert (model.contexts != 0).sum() > 10


def test_sums_in_a_tree(spark, monkeypatch):
    docs = spark.createDataFrame([(f"a b c{i % 7} d",) for i in range(60)], "text string").repartition(9)
    whole, _ = lm.fit(docs)
    monkeypatch.setattr(lm, "FAN_IN", 2)
    tree, _ = lm.fit(docs)
    assert (whole.contexts == tree.contexts).all() and all((a == b).all() for a, b in zip(whole.tables, tree.tables, strict=True))


def test_counts_of_rare_words_tell(spark, monkeypatch):
    """Beyond the common words, a word that was seen more often is likelier, and one that was never seen least."""
    monkeypatch.setattr(lm, "HOT", 3)
    train = spark.createDataFrame([("the of and",)] * 50 + [("zebra",)] * 4 + [("quagga",)], "text string")
    model, counts = lm.fit(train)
    docs = spark.createDataFrame([(0, "zebra"), (2, "quagga"), (3, "qzagga")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(docs, model, counts).collect()}
    assert got[0] > got[2] + 0.3 and got[2] > got[3] + 0.3


def test_base_and_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    counts = Counter()
    for r in docs:
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            counts.update(tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in op5_lm(spark, sf).collect()}
    assert len(rows) == len(docs)
    for r in docs:
        got, words = rows[r.doc_id], tokens(r.text)
        assert got.n_tokens == len(words) and got.n_known == sum(counts[w] > 0 for w in words) and got.train_tokens == n
        assert got.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
        assert got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and got.score < 0 and math.isfinite(got.score)


def test_cold_words_by_join(spark, sf, monkeypatch):
    whole = {r.doc_id: r for r in op5_lm(spark, sf).collect()}
    monkeypatch.setattr(lm, "HOT", 50)
    for r in op5_lm(spark, sf).collect():
        assert r.n_known == whole[r.doc_id].n_known and r.base_score == pytest.approx(whole[r.doc_id].base_score)


def test_better_than_counts_on_held_out(spark):
    rows = [r for r in op5_lm(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_edges(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "Word", 5), (4, "x " * 5000, 5), (4, "x " * 5000, 5)], "doc_id long, text string, score int")
    out = {(r.doc_id, r.n_tokens): r for r in lm.score_all(rows).collect()}
    assert set(out) == {(1, 1), (2, 1), (None, 2), (4, 5001)} and all(math.isfinite(r.score) for r in out.values())
    assert lm.score_all(rows.limit(0)).count() == 0
    held = spark.createDataFrame([(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in lm.score_all(held).collect())


def test_contexts_do_not_follow_the_size_of_the_corpus():
    words, counts = [b"w%d" % i for i in range(100)], np.arange(200, 100, -1)
    small, large = (lm.Model(words, counts * k, 5 * k, 0, 0, int(counts.sum() + 5) * k, 101, np.ones(lm.SYMBOLS)) for k in (1, 10_000))
    assert small.contexts.shape == large.contexts.shape and small.deep.shape == large.deep.shape


def test_contexts_against_a_plain_count(spark, monkeypatch):
    monkeypatch.setattr(lm, "ROW_BITS", 2)
    monkeypatch.setattr(lm, "CONTEXT_NODES", 6)
    monkeypatch.setattr(lm, "HOT", 12)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 40)) for _ in range(30)] + ["", None]
    model, _ = fitted(spark, texts)
    names = list(model.words)
    r = model.ready()
    codes, first, length, n, heavy = r["codes"].kept(), r["first"].kept(), r["length"].kept(), r["n"], r["size"] - 6
    want, deep = np.zeros((4, 6, 2)), np.zeros((1 << lm.DEEP_BITS, 2))
    for text in texts:
        last = n
        for token in tokens(text):
            i = n if token is None else names.index(token) if token in names else n + 1
            for code in codes[first[i] : first[i] + length[i]].tolist():
                node, bit = code >> 1, code & 1
                if node >= heavy:
                    want[last % 4, node - heavy, bit] += 1
                else:
                    deep[lm._slot(model._begin(np.array([last])), np.array([node], np.int32), lm.DEEP_BITS)[0], bit] += 1
            last = i if i < n else last
    assert 6 < n <= 12 and heavy > 0 and deep.any()
    for got, counts, hashed in ((model.contexts, want, False), (model.deep, deep, True)):
        assert (got == lm._packed(counts[..., 0].ravel(), counts[..., 1].ravel(), hashed)).all()


def test_words_are_looked_up_many_at_a_time():
    known = [b"a", b"a\x00", b"\x00a", b"eightbyt", b"ninebytes", b"sixteen bytes...".replace(b" ", b"_"), b"seventeen_bytes_x", "größe".encode(), b"b" * 40, b"\x1c"]
    texts = ["A a\x00 b\x00", None, "", "  \t", "eightbyt EIGHTBYTE ninebytes\nninebyteS2\x0bsixteen_bytes... \x1c x", "seventeen_bytes_x größe GRÖSSE" + " " + "b" * 40 + "\r" + "b" * 41, "\x00a"]
    tokens = lm._Tokens(texts)
    words = [lm.words_of(t) for t in texts]
    assert tokens.words(np.arange(len(tokens.starts))) == sum(words, [])
    assert tokens.sizes.tolist() == [len(w) + 1 for w in words]
    place = {w: i for i, w in enumerate(known)}
    assert lm._Places(known).find(tokens).tolist() == [place.get(w, -1) for w in sum(words, [])]
    assert lm._Places([]).find(tokens).tolist() == [-1] * sum(map(len, words))
    many = [b"%d" % i for i in range(50_000)]
    assert lm._Places(many).find(lm._Tokens([" ".join(map(str, range(60_000)))])).tolist() == [*range(50_000), *[-1] * 10_000]


def test_windows_keep_the_rows_of_their_texts(spark):
    texts = ["a b c " * k for k in (1, 300, 2, 0, 40, 7)] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    model, counts = lm.fit(docs.select("text"))
    got = {r.doc_id: (r.n_tokens, r.score) for r in lm.score(docs, model, counts).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (len(t.split()) + 1, pytest.approx(got[i % 6][1]))
    assert len({round(s, 6) for _, s in got.values()}) == 6
