"""Language-model scoring by online logistic mixing of hashed-context bit predictors.

A text is a sequence of tokens, its lower-cased words and one end. Each token becomes bits of a prefix-free code: the
commonest words (HOT at most), the end and an escape have Huffman codes of their own. After an escape comes one of the other
words, by a mixture of two: a word that the training documents have, by its count there, and any word
at all, spelled in Huffman-coded bytes up to a terminator. Counts of all words are kept in a table that grows with the corpus and
are joined to a text's words. So every sequence of tokens has one probability, and these sum to 1 at most.

Each bit is predicted in several contexts, hashed to slots but for the heaviest nodes, which have rows of slots:
- two static ones with counts from all training documents: for common words the code's
  node, and the node after the common word before it; for spelling the node after the last 2 and 4 bytes of
  the word, with each distinct word counted once, as a new word is more like other rare words than like the commonest;
- one that learns inside the document: the node in the document so far.
Predictions are mixed in the logistic domain by a vector of weights that a gate chooses from
what kind of bit it is and how well its contexts are known. A last stage adds a
correction that depends on the mixed value. Weights, corrections and the document's own
counts start alike for every document and are refined after each block of BLOCK bits from
its errors, so a document's score depends on the training counts and its text alone.

Documents are scored side by side, block by block, in arrays.

Defined results: a null or empty text is one end; rows score alike if their texts are equal;
a null doc_id is in the fold of the empty string; very long texts are scored whole, in memory that grows with one text; without training
documents all counts are 0 and the model is the starting code; an empty table gives an empty one; other
columns than doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.batches import bounded_batches
from lumenfold.session import discard, stored

#: So many words have codes of their own; the rest is spelled. A bound of what is broadcast.
HOT = 1 << 18
SLOT_BITS = 22
ORDERS = (2, 4)
BLOCK = 512
LOCAL_SLOTS = 1024
RANGE = 1 << 16
WORDS_A_TASK = 2_000_000
#: A Counter is given out when it has so many words.
FLUSH = 400_000
TEXT_BYTES = 1 << 19
#: Texts are put in order of their length in windows of so many characters, so that those scored side by side end together.
WINDOW = 1 << 22
TERM, SYMBOLS = 256, 257
#: Eight gates for common words, by how often the context was seen; four for hashed slots seen often, and four for spelling.
GATES = 16
#: Levels of hashed slots from here on have gates of their own.
OFTEN = 3
INPUTS = 3
#: Starting weights of the two static predictors and of the document's own: for common words by how often the context was seen, and for spelling.
START_HOT = ((0.95, 0.6, 0.5, 0.4, 0.3, 0.25, 0.15, 0.1), (0.0, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95), (0.25,) * 8)
#: A hashed slot that was seen often is most likely shared by several contexts, and isn't trusted until it proves right.
START_DEEP = (0.95, 0.0, 0.25)
START_SPELLED = (0.25, 0.75, 0.15)
RATE = 1.5
CORRECTION_RATE = 0.1
CORRECTIONS = 24
#: The common word before is the context of what follows, whatever the corpus's size. Words go by their places' last bits to so many rows (the commonest
#: don't share theirs), which have a slot for each of so many of the code's heaviest nodes, those of a token's first bits;
#: nodes beyond these are hashed to slots, also of a fixed number.
ROW_BITS, CONTEXT_NODES = 14, 1024
#: Of a context's place: its row's begin has so many bits, what the row doesn't tell of it is above.
BEGIN_BITS = 25
DEEP_BITS = 23
#: Training tokens that a task counts in contexts, at least: its table is as large as the whole one.
TOKENS_A_TASK = 16_000_000
#: Parts of a sum that one task adds up.
FAN_IN = 32


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def words_of(text: str | None) -> list[bytes]:
    """Words between the bytes 20 and 09 to 0D, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent and side of every node of the code's tree; leaves come first, in the order of ``weights``, the root last."""
    n = len(weights)
    parent, side = np.zeros(max(1, 2 * n - 1), np.int32), np.zeros(max(1, 2 * n - 1), np.uint8)
    # Two queues, both in order: leaves by weight, and sums as they are made.
    leaves = np.argsort(weights, kind="stable").tolist()
    w = [float(x) for x in weights] + [0.0] * (n - 1)
    i, j = 0, n
    for node in range(n, 2 * n - 1):
        for bit in (0, 1):
            if i < n and (j >= node or w[leaves[i]] <= w[j]):
                child, i = leaves[i], i + 1
            else:
                child, j = j, j + 1
            parent[child], side[child] = node, bit
            w[node] += w[child]
    return parent, side


def _flat(tree: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Starts, lengths, nodes and bits of the leaves' codes, from the root down, one after the other."""
    parent, side = tree
    n = (len(parent) + 1) // 2
    root = len(parent) - 1
    lengths = np.zeros(n, np.int32)
    at = np.arange(n, dtype=np.int32)
    while (up := at != root).any():
        lengths += up
        at = np.where(up, parent[at], np.int32(root))
    starts = (np.cumsum(lengths) - lengths).astype(np.int32)
    nodes, bits = np.zeros(int(lengths.sum()), np.int32), np.zeros(int(lengths.sum()), np.uint8)
    at, has, back = np.arange(n, dtype=np.int32), np.flatnonzero(lengths), 1
    while len(has):
        place = starts[has] + lengths[has] - back
        nodes[place], bits[place] = parent[at[has]] - n, side[at[has]]
        at[has] = parent[at[has]]
        has, back = has[lengths[has] > back], back + 1
    return starts, lengths, nodes, bits


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after the other."""
    ends = np.cumsum(lengths, dtype=np.int32)
    out = np.repeat((starts - (ends - lengths)).astype(np.int32), lengths)
    out += np.arange(len(out), dtype=np.int32)
    return out


def _spell(words: list[bytes], code: tuple[np.ndarray, ...]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """For words spelled out: bits a word; then for every bit its slots by order, node and bit."""
    starts, lengths, nodes, bits = code
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    raw = np.frombuffer(b"\x00".join(words) + b"\x00", np.uint8).astype(np.int64)
    ends = np.cumsum(sizes)
    symbols = raw.copy()
    symbols[ends - 1] = TERM
    place = _ranges(np.zeros(len(words), np.int64), sizes)
    bits_of = lengths[symbols]
    at = _ranges(starts[symbols], bits_of)
    node = nodes[at].astype(np.uint64)
    slots = []
    context = np.zeros(len(symbols), np.uint64)
    for back in range(1, max(ORDERS) + 1):
        shifted = np.zeros(len(symbols), np.uint64)
        shifted[back:] = symbols[:-back]
        shifted[place < back] = 300  # before the word
        context = context * np.uint64(0x100000001B3) + shifted + np.uint64(1)
        if back in ORDERS:
            mixed = np.repeat(context * np.uint64(0x9E3779B97F4A7C15) + np.uint64(back), bits_of) + node * np.uint64(0xC2B2AE3D27D4EB4F)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            slots.append((mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int32))
    word_bits = np.add.reduceat(bits_of, ends - sizes).astype(np.int32) if len(words) else np.zeros(0, np.int32)
    return word_bits, slots, node.astype(np.int32), bits[at]


def _packed(n0: np.ndarray, n1: np.ndarray, hashed: bool = False) -> np.ndarray:
    """Log-odds in 1/128 over four low bits, the gate: how often the slot was seen, and whether it is ``hashed`` and was seen often."""
    seen = n0 + n1
    odds = np.log((n1 + 0.3) / (n0 + 0.3))
    level = np.clip(np.floor(np.log2(seen + 1)), 0, 7).astype(np.int32)
    if hashed:
        level = np.where(level < OFTEN, level, np.minimum(level + 8 - OFTEN, 11))
    return (np.clip(np.rint(odds * 128), -2000, 2000).astype(np.int32) << 4 | level).astype(np.int16)


def _context(ids: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    """The last common word before each token in its text; ``n`` where there is none. ``sizes``: tokens of the texts."""
    place = np.where(ids < n, np.arange(len(ids)), -1)
    last = np.concatenate(([-1], np.maximum.accumulate(place)[:-1]))
    return np.where(last >= np.repeat(np.cumsum(sizes) - sizes, sizes), ids[last], n)


def _slot(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Where a node's counts in a context are, if it is none of the heaviest."""
    h = context.astype(np.uint32)
    h *= np.uint32(0x9E3779B1)
    h += node.view(np.uint32) * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h >>= np.uint32(32 - bits)
    return h.view(np.int32)


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` (binary) and ``n`` over whole texts, counted in each task before the shuffle."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                counts.update(words_of(text))
                if len(counts) >= FLUSH:
                    yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                    counts.clear()
        if counts:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    return docs.select("text").mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Model:
    """The codes and tables that scoring needs, of a size that the corpus doesn't change."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n_end: int, n_other: int, once: int, total: int, distinct: int, spelling: np.ndarray) -> None:
        """``n_other``: tokens that are no common words; ``once``: words seen once, which tell how often a new one comes."""
        self.total, self.distinct, self.n_end = total, distinct, n_end
        self.words, self.counts = words, counts.astype(np.int64)
        self.weights = np.concatenate((counts, [max(n_end, 1), max(n_other + once, 1)])).astype(np.float64)
        self.tree, self.spelling = huffman(self.weights), huffman(spelling)
        self.tables: list[np.ndarray] = [np.zeros(1 << SLOT_BITS, np.int16) for _ in ORDERS]
        self.row_bits, self.deep_bits = ROW_BITS, DEEP_BITS
        self.rows, self.context_nodes = min(1 << ROW_BITS, len(words) + 2), min(CONTEXT_NODES, len(words) + 1)
        #: By row and node.
        self.contexts = np.zeros(self.rows * self.context_nodes, np.int16)
        self.deep = np.zeros(1 << DEEP_BITS, np.int16)
        #: Of the words behind an escape, the share that is given to those that were counted, and their tokens.
        self.known_share = min(max((n_other - once) / n_other, 0.1), 0.9) if n_other else 0.0
        self.n_other = n_other
        self._ready: dict | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def ready(self) -> dict:
        """What a process makes of the model once: the word index, codes, and the common words' predictions."""
        if self._ready is None:
            n, weights = len(self.words), self.weights
            starts, lengths, nodes, bits = _flat(self.tree)
            size = max(1, int(nodes.max(initial=0)) + 1)
            # A node's odds are those of the words below it.
            one, both = np.full(size, 0.02), np.full(size, 0.04)
            for i in range(0, n + 2, RANGE):
                some = slice(starts[i], starts[i] + int(lengths[i : i + RANGE].sum()))
                each = np.repeat(weights[i : i + RANGE], lengths[i : i + RANGE])
                both += np.bincount(nodes[some], each, size)
                one += np.bincount(nodes[some], each * bits[some], size)
            plain = np.log(one / (both - one)).astype(np.float32)
            # Nodes come by weight, so a code's first bits are at the heaviest; what these tell of a token is its stem.
            heavy = size - self.context_nodes
            heads = np.add.reduceat((nodes >= heavy).astype(np.int32), starts)
            last = starts + heads - 1
            _, one_of, stem = np.unique(nodes[last].astype(np.int64) << 1 | bits[last], return_index=True, return_inverse=True)
            place = (np.arange(size, dtype=np.uint32) * np.uint32(2654435761) >> np.uint32(12)) % np.uint32(LOCAL_SLOTS - 1) + np.uint32(1)
            self._ready = {
                "index": _Places(self.words),
                "base": self.base(np.concatenate((self.counts, [self.n_end]))),
                # Bits of common words: node and bit taken. Behind them is room for a batch's other words, whose
                # bits are nodes of their own; the first of these is filler.
                "codes": _Room(np.concatenate(([size << 1], nodes << 1 | bits)).astype(np.int32)),
                "meta": _Room(place.astype(np.int32)),
                "plain": _Room(plain), "told": _Room(np.concatenate((self.deep, self.contexts))),
                "heavy": heavy, "stem": stem, "stems": (1 + starts[one_of], heads[one_of]), "heads": heads,
                "first": _Room(1 + starts.astype(np.int32)), "length": _Room(lengths.astype(np.int32)),
                "size": size, "n": n, "n_codes": len(nodes), "escape": (1 + int(starts[n + 1]), int(lengths[n + 1])), "spell": _flat(self.spelling),
            }
            # These are two views of one array now.
            self.deep, self.contexts = np.split(self._ready["told"].kept(), [len(self.deep)])
            # What only served to make these is let go.
            self.counts = self.weights = self.tree = self.words = None
        return self._ready

    def no_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Zeros for :meth:`count_contexts`."""
        return np.zeros((self.rows, len(self.ready()["stems"][0])), np.int32), np.zeros(2 << self.deep_bits, np.float32)

    def count_contexts(self, texts: list[str | None], pairs: np.ndarray, deep: np.ndarray) -> None:
        """Add these texts' tokens, common words, ends and escapes, to ``pairs``, by row and stem, and their bits behind the stem to ``deep``."""
        r = self.ready()
        codes, first, length, heads = (*(r[k].kept() for k in ("codes", "first", "length")), r["heads"])
        n, stem = r["n"], r["stem"]
        for some in _some(texts):
            tokens = _Tokens(some)
            found = r["index"].find(tokens)
            ids = tokens.with_ends(np.where(found < 0, n + 1, found), n)
            context, head = _context(ids, n, tokens.sizes), heads.take(ids)
            np.add.at(pairs.ravel(), (context & (1 << self.row_bits) - 1) * pairs.shape[1] + stem.take(ids), np.int32(1))
            behind = length.take(ids) - head
            code = codes.take(_ranges(first.take(ids) + head, behind))
            np.add.at(deep, _slot(np.repeat(self._begin(context), behind), code >> 1, self.deep_bits) * 2 + (code & 1), np.float32(1))

    def _begin(self, context: np.ndarray) -> np.ndarray:
        """Where the nodes of these contexts' rows would begin behind the hashed ones, with the rest of the contexts above."""
        begin = (context & (1 << self.row_bits) - 1) * self.context_nodes + (len(self.deep) - self.ready()["heavy"])
        return (begin | context >> self.row_bits << BEGIN_BITS).astype(np.int32)

    def node_counts(self, pairs: np.ndarray, rows: int = 64) -> Iterator[tuple[int, np.ndarray]]:
        """Zeros and ones of the heaviest nodes, of the tokens that :meth:`count_contexts` told: some rows at a time, with the first slot of these."""
        r = self.ready()
        codes, (first, length), width = r["codes"].kept(), r["stems"], self.context_nodes * 2
        for at in range(0, len(pairs), rows):
            seen = pairs[at : at + rows]
            k, stem = np.nonzero(seen)
            size = length.take(stem)
            place = codes.take(_ranges(first.take(stem), size)) - 2 * r["heavy"] + np.repeat(k * width, size)
            yield at * self.context_nodes, np.bincount(place, np.repeat(seen[k, stem], size), len(seen) * width).astype(np.float32)

    def score(self, texts: list[str | None]) -> list[tuple]:
        """For each text: tokens, known common ones, their base score, the other words, log10 of these as spelled, and the log10 probability of all but these."""
        r = self.ready()
        n = r["n"]
        tokens = _Tokens(texts)
        found = r["index"].find(tokens)
        others = np.flatnonzero(found < 0)
        rest, cold = tokens.words(others), {}
        found[others] = [n + 2 + cold.setdefault(w, len(cold)) for w in rest]
        ids = tokens.with_ends(found, n)
        bounds = np.concatenate(([0], np.cumsum(tokens.sizes)))
        away = np.flatnonzero(ids >= n + 2)
        cuts = np.searchsorted(away, bounds)
        out = []
        for begin, end, i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            some = ids[begin:end]
            out.append((end - begin, end - begin - (j - i) - (not self.n_end), float(r["base"].take(some[some <= n]).sum()), rest[i:j]))
        word_bits, slots, _, bit = _spell(list(cold), r["spell"])
        looked = [t.take(s) for t, s in zip(self.tables, slots, strict=True)]
        level = (looked[-1] & 15).astype(np.int32)
        gate = (12 + np.minimum((level + 1) // 2, 3)).astype(np.int16)
        # A spelling bit's place in the document's own counts has the context of the shortest order.
        own = (slots[0].astype(np.int64) * 2654435761 >> 5) % (LOCAL_SLOTS - 1) + 1
        codes = r["codes"].with_tail((r["size"] + 1 + np.arange(len(bit), dtype=np.int32)) << 1 | bit)
        meta = r["meta"].with_tail(np.concatenate(([0], own)))
        # What a spelling bit's longest order tells stands behind the contexts.
        told = r["told"].with_tail(np.concatenate((np.zeros(1, np.int16), looked[-1] & ~np.int16(15) | gate)))
        plain = r["plain"].with_tail(np.concatenate(([0], (looked[0] >> 4) * np.float32(1 / 128))))
        first = r["first"].with_tail(1 + r["n_codes"] + np.cumsum(word_bits, dtype=np.int32) - word_bits)
        size = r["length"].with_tail(word_bits)
        escape_start, escape_size = r["escape"]
        behind = len(self.deep) + len(self.contexts) - r["size"]
        context = self._begin(_context(ids, n, tokens.sizes))
        # Before each token stands an escape, of no bits for those that need none.
        length = np.stack((np.zeros(len(ids), np.int32), size.take(ids)), axis=1)
        length[away, 0] = escape_size
        begin = np.stack((np.full(len(ids), escape_start, np.int32), first.take(ids)), axis=1)
        before = np.stack((context, context), axis=1)
        before[away, 1] = behind
        length = length.ravel()
        ends = np.cumsum(length)
        at = ends[2 * bounds[1:] - 1]
        sequences = np.split(_ranges(begin.ravel(), length), at[:-1])
        contexts = np.split(np.repeat(before.ravel(), length), at[:-1])
        spelled = [(ends[2 * away[i:j]] - zero, ends[2 * away[i:j] + 1] - zero) for i, j, zero in zip(cuts[:-1], cuts[1:], [0, *at[:-1].tolist()], strict=True)]
        found = _mix(sequences, contexts, codes, meta, plain, told, r["heavy"], self.deep_bits)
        rows = []
        for o, logs, (begin, end) in zip(out, found, spelled, strict=True):
            # Sums from each begin to its end, and from there to the next, of which every other is wanted.
            bounds = np.stack((begin, end), axis=1).ravel()
            each = np.add.reduceat(logs, bounds[: len(bounds) - (len(bounds) > 0 and bounds[-1] == len(logs))], dtype=np.float64)[::2] if len(begin) else np.zeros(0)
            rows.append((*o, (each / math.log(10)).tolist(), float(logs.sum(dtype=np.float64) - each.sum()) / math.log(10)))
        return rows


class _Tokens:
    """The words of some texts, as :func:`words_of` has them, in one array of bytes."""

    def __init__(self, texts: list[str | None]) -> None:
        raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        whole = b"\n".join([*raw, b""])
        #: Bytes behind the last word's, so that two numbers can be read wherever a word begins.
        self.raw = whole + bytes(16)
        space = np.ones(len(whole) + 1, bool)
        np.take(_SPACE, np.frombuffer(whole, np.uint8), out=space[1:])
        edges = np.flatnonzero(space[1:] != space[:-1])
        self.starts = edges[0::2]
        self.lengths = edges[1::2] - self.starts
        #: Tokens of each text, its end too.
        self.sizes = np.diff(np.searchsorted(self.starts, np.cumsum([0, *(len(x) + 1 for x in raw)]))) + 1

    def with_ends(self, ids: np.ndarray, end: int) -> np.ndarray:
        """``ids`` of the words with an end after each text."""
        whole = np.full(len(ids) + len(self.sizes), end, np.int64)
        whole[np.arange(len(ids)) + np.repeat(np.arange(len(self.sizes)), self.sizes - 1)] = ids
        return whole

    def words(self, which: np.ndarray) -> list[bytes]:
        starts = self.starts[which]
        return [self.raw[i:j] for i, j in zip(starts.tolist(), (starts + self.lengths[which]).tolist(), strict=True)]

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """The first and the second eight bytes of each word, 0 where it has none."""
        each = np.ndarray((len(self.raw) - 7,), "<u8", self.raw, strides=(1,))
        a, b = each[self.starts] & _MASKS[np.minimum(self.lengths, 8)], np.zeros(len(self.starts), np.uint64)
        longer = np.flatnonzero(self.lengths > 8)
        b[longer] = each[self.starts[longer] + 8] & _MASKS[np.minimum(self.lengths[longer] - 8, 8)]
        return a, b


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class _Places:
    """Places of words, looked up by many at a time: those up to 16 bytes as two numbers and a length, in buckets of their hashes."""

    BITS = 20

    def __init__(self, words: list[bytes]) -> None:
        tokens = _Tokens([])
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        tokens.raw, tokens.lengths = b"".join(words) + bytes(16), sizes
        tokens.starts = np.cumsum(sizes) - sizes
        self.long = {w: i for i, w in enumerate(words) if len(w) > 16}
        a, b = tokens.numbers()
        bucket = self._bucket(a, b, sizes)
        short = np.flatnonzero(sizes <= 16)
        order = short[np.argsort(bucket[short], kind="stable")]
        self.a, self.b, self.sizes, self.places = a[order], b[order], sizes[order].astype(np.uint8), order.astype(np.int32)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(bucket[short], minlength=1 << self.BITS)))).astype(np.int32)

    def _bucket(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        h = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + sizes.astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, tokens: _Tokens) -> np.ndarray:
        """The place of each word; -1 for those that have none."""
        (a, b), sizes = tokens.numbers(), tokens.lengths
        bucket = self._bucket(a, b, sizes)
        at, end = self.first.take(bucket), self.first.take(bucket + 1)
        found = np.full(len(a), -1, np.int64)
        live = np.flatnonzero((at < end) & (sizes <= 16))
        while len(live):
            here = at[live]
            same = (self.a.take(here) == a[live]) & (self.b.take(here) == b[live]) & (self.sizes.take(here) == sizes[live])
            found[live[same]] = self.places.take(here[same])
            live = live[~same]
            at[live] += 1
            live = live[at[live] < end[live]]
        long = np.flatnonzero(sizes > 16)
        found[long] = [self.long.get(w, -1) for w in tokens.words(long)]
        return found


class _Room:
    """An array that stays, with room behind it for another that changes."""

    def __init__(self, kept: np.ndarray) -> None:
        self.n, self.whole = len(kept), np.concatenate((kept, np.zeros(1 << 16, kept.dtype)))

    def kept(self) -> np.ndarray:
        return self.whole[: self.n]

    def with_tail(self, tail: np.ndarray) -> np.ndarray:
        end = self.n + len(tail)
        if end > len(self.whole):
            self.whole = np.concatenate((self.whole[: self.n], np.zeros(2 * len(tail), self.whole.dtype)))
        self.whole[self.n : end] = tail
        return self.whole[:end]


def _mix(
    sequences: list[np.ndarray], contexts: list[np.ndarray], codes: np.ndarray, meta: np.ndarray, plain: np.ndarray, table: np.ndarray, heavy: int, deep_bits: int,
) -> list[np.ndarray]:
    """The natural logarithm of each bit's probability; ``contexts``: where the nodes of its context would begin in ``table``; those below ``heavy`` are hashed. Entry 0 of the codes is filler and has no part."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    blocks = np.array([max(1, -(-len(sequences[i]) // BLOCK)) for i in order])
    ends = np.cumsum(blocks) * BLOCK
    starts = ends - blocks * BLOCK
    padded, before = np.zeros(int(ends[-1]), np.int32), np.zeros(int(ends[-1]), np.int32)
    for i, at in zip(order, starts, strict=True):
        padded[at : at + len(sequences[i])] = sequences[i]
        before[at : at + len(sequences[i])] = contexts[i]
    logs = np.zeros(int(ends[-1]), np.float32)
    docs = len(order)
    weight = np.empty((INPUTS, docs, GATES), np.float32)
    weight[:, :, :8] = np.reshape(START_HOT, (-1, 1, 8))
    weight[:, :, 8:12], weight[:, :, 12:] = np.reshape(START_DEEP, (-1, 1, 1)), np.reshape(START_SPELLED, (-1, 1, 1))
    correction = np.zeros((docs, CORRECTIONS), np.float32)
    seen, own = np.full((docs * LOCAL_SLOTS, 2), 0.4, np.float32), np.zeros(docs * LOCAL_SLOTS, np.float32)
    one = np.float32(1)
    for step in range(int(blocks[0])):
        live, more = (int(np.searchsorted(-blocks, -b, side="left")) for b in (step, step + 1))
        rows = starts[:live] // BLOCK + step
        j = padded.reshape(-1, BLOCK).take(rows, axis=0)
        row = np.arange(live, dtype=np.int32)[:, None]
        # All places are valid; to take by "clip" saves the check for it.
        code = codes.take(j, mode="clip")
        bit, node = code & 1, code >> 1
        place = node.astype(np.intp)
        here = meta.take(place, mode="clip")
        here += row * LOCAL_SLOTS
        x0 = plain.take(place, mode="clip")
        begin = before.reshape(-1, BLOCK).take(rows, axis=0)
        slot = _slot(begin, node, deep_bits)
        begin &= (1 << BEGIN_BITS) - 1
        begin += node
        # Of nodes below heavy the slot, of all others the place in the context's row, without a branch.
        slot ^= begin
        node -= np.int32(heavy)
        node >>= 31
        slot &= node
        begin ^= slot
        told = table.take(begin, mode="clip")
        which = (told & 15).astype(np.intp)
        which += row * GATES
        x1 = (told >> 4) * np.float32(1 / 128)
        x2 = own.take(here, mode="clip")
        w = weight[:, :live].reshape(INPUTS, -1)
        z = w[0].take(which, mode="clip")
        z *= x0
        for x, of_x in ((x1, w[1]), (x2, w[2])):
            part = of_x.take(which, mode="clip")
            part *= x
            z += part
        np.clip(z, -14, 14, out=z)
        bucket = ((z + 14) * np.float32(CORRECTIONS / 28.001)).astype(np.intp)
        bucket += row * CORRECTIONS
        z += correction[:live].ravel().take(bucket, mode="clip")
        turn = code << 31  # the sign of a float
        z.view(np.int32)[...] ^= turn
        np.exp(z, out=z)
        z += 1
        logs.reshape(-1, BLOCK)[rows] = -np.log(z)
        if more:
            # Only texts that go on learn; their blocks have no filler.
            p = 1 / z[:more]
            p -= 1
            p.view(np.int32)[...] ^= turn[:more]
            error = p.ravel()
            which, bucket = which[:more].ravel(), bucket[:more].ravel()
            scale = RATE / (np.bincount(which, minlength=more * GATES) + 60)
            for k, x in enumerate((x0, x1, x2)):
                weight[k, :more] += (scale * np.bincount(which, error * x[:more].ravel(), more * GATES)).reshape(more, -1)
            counted = np.bincount(bucket, minlength=more * CORRECTIONS) * 0.2 + 10
            correction[:more] += (CORRECTION_RATE * np.bincount(bucket, error, more * CORRECTIONS) / counted).reshape(more, -1)
            here = here[:more]
            here *= 2
            here += bit[:more]
            np.add.at(seen.ravel(), here.ravel(), one)
            counted = seen[: more * LOCAL_SLOTS]
            np.log(counted[:, 1] / counted[:, 0], out=own[: more * LOCAL_SLOTS])
    found: list = [None] * docs
    for i, at in zip(order, starts, strict=True):
        found[i] = logs[at : at + len(sequences[i])]
    return found


def _gathered(batches: Iterator[pd.DataFrame], most: int = 50_000) -> Iterator[list[bytes]]:
    """Words of several batches together."""
    words: list[bytes] = []
    for pdf in batches:
        words += map(bytes, pdf["word"])
        if len(words) >= most:
            yield words
            words = []
    if words:
        yield words


def _level(n: Column) -> Column:
    """Counts in steps: every count below 1024, then 64 to a doubling."""
    return F.when(n < 1024, n).otherwise(1024 + F.floor(64 * F.log2(n / 1024)))


def _parts(counts: np.ndarray, k: int, task: int, begin: int = 0) -> Iterator[pd.DataFrame]:
    """Counts of zeros and ones by slot from ``begin`` on, in ranges of slots."""
    for at in range(0, len(counts) // 2, RANGE):
        part = counts[2 * at : 2 * (at + RANGE)]
        if part.any():
            yield pd.DataFrame({"k": [k], "at": [begin + at], "task": [task], "part": [zlib.compress(part.tobytes(), 1)]})


_PARTS = "k int, at int, task long, part binary"


def _sum(parts: DataFrame, often: tuple[int, ...] = ()) -> Iterator[tuple[int, int, np.ndarray]]:
    """Table, first slot and packed odds of every range of slots, added up in a tree: no task adds more than FAN_IN parts. ``often``: tables of hashed contexts."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = np.zeros(1, np.float32)
        for part in pdf["part"]:
            whole = whole + np.frombuffer(zlib.decompress(part), np.float32)
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "at": pdf["at"].iloc[:1], "task": pdf["task"].iloc[:1] // FAN_IN, "part": [zlib.compress(whole.tobytes(), 1)]})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        hashed = pdf["k"].iloc[0] in often
        whole = np.frombuffer(zlib.decompress(add(pdf)["part"].iloc[0]), np.float32).reshape(-1, 2)
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "at": pdf["at"].iloc[:1], "odds": [zlib.compress(_packed(whole[:, 0], whole[:, 1], hashed).tobytes(), 1)]})

    parts = stored(parts)
    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > FAN_IN:
        fewer = stored(parts.groupBy("k", "at", F.floor(F.col("task") / FAN_IN).alias("group")).applyInPandas(add, _PARTS))
        discard(parts)
        parts, tasks = fewer, -(-tasks // FAN_IN)
    for row in parts.groupBy("k", "at").applyInPandas(pack, "k int, at int, odds binary").collect():  # tables of fixed size
        yield row.k, row.at, np.frombuffer(zlib.decompress(row.odds), np.int16)
    discard(parts)


def _windows(batches: Iterator[pd.Series]) -> Iterator[list[str | None]]:
    """Texts of several batches together, of WINDOW characters or so."""
    texts: list[str | None] = []
    size = 0
    for batch in batches:
        texts += batch.tolist()
        size += sum(len(t or "") for t in batch)
        if size >= WINDOW:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def _some(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Texts in groups of TEXT_BYTES or so."""
    some: list[str | None] = []
    size = 0
    for text in texts:
        some.append(text)
        size += len(text or "")
        if size >= TEXT_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of ``docs`` (all of them training documents), and the counts of all their words.

    The counts stay in the shared folder and grow with the corpus; the model has HOT common words at most and tables of bounded size.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n_end = docs.count()
    counts = stored(count_words(docs))
    n_words, distinct, once = counts.agg(F.sum("n"), F.count(F.lit(1)), F.count_if(F.col("n") == 1)).first()
    n_words = n_words or 0
    # The lowest count that HOT words or fewer reach. No task sees more than its own words.
    least, reached = 0, 0
    for r in counts.groupBy(_level(F.col("n")).alias("level")).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least")).orderBy(F.desc("level")).collect():
        reached += r.c
        if reached > HOT:
            break
        least = r.least
    common = counts.where(F.col("n") >= (least if least else 1 << 62)).toArrow()
    # The commonest first: what texts look up most lies together.
    rows = sorted(zip(common["n"].to_pylist(), common["word"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    words, n_of = [w for _, w in rows], np.array([n for n, _ in rows], np.int64)

    def symbols(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(SYMBOLS)
        for words in _gathered(batches):
            seen[:256] += np.bincount(np.frombuffer(b"".join(words), np.uint8), minlength=256)
            seen[TERM] += len(words)
        yield pd.DataFrame({"symbol": np.arange(SYMBOLS, dtype=np.int32), "n": seen})

    spelling = np.full(SYMBOLS, 0.5)
    for row in counts.select("word").mapInPandas(symbols, "symbol int, n double").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        spelling[row.symbol] += row.n
    n_other = n_words - int(n_of.sum())
    model = Model(words, n_of, n_end, n_other, min(once, n_other), n_words + n_end, distinct + (n_end > 0), spelling)
    code = _flat(model.spelling)

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(ORDERS), 2 << SLOT_BITS), np.float32)
        for words in _gathered(batches):
            _, slots, _, bit = _spell(words, code)
            for k in range(len(ORDERS)):
                np.add.at(sums[k], slots[k].astype(np.int64) * 2 + bit, np.float32(1))
        for k in range(len(ORDERS)):
            yield from _parts(sums[k], k, TaskContext.get().partitionId())

    if distinct:
        tasks = -(-distinct // WORDS_A_TASK)
        for k, at, odds in _sum(counts.select("word").repartition(tasks).mapInPandas(tables, _PARTS)):
            model.tables[k][at : at + len(odds)] = odds
        shared = spark.sparkContext.broadcast(model)

        def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = shared.value
            pairs, deep = model.no_counts()
            for pdf in batches:
                model.count_contexts(pdf["text"], pairs, deep)
            yield from _parts(deep, 1, TaskContext.get().partitionId())
            for begin, counts in model.node_counts(pairs):
                yield from _parts(counts, 0, TaskContext.get().partitionId(), begin)

        # Fewer tasks, without a shuffle, so that there are fewer tables to add up.
        texts = docs.select("text").coalesce(-(-model.total // TOKENS_A_TASK))
        for k, at, odds in _sum(texts.mapInPandas(contexts, _PARTS), (1,)):
            (model.contexts, model.deep)[k][at : at + len(odds)] = odds
        shared.unpersist()
    return model, counts


SCORED = "n_tokens long, hot_known long, hot_base double, cold array<binary>, cold_spelled array<double>, hot_score double"


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``bits_per_byte`` of every text.

    Words outside the common ones meet their counts in a join, so that base and score have them whatever the vocabulary's size.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # HOT words, and tables of bounded size
    names = [x.split()[0] for x in SCORED.split(", ")]

    @F.pandas_udf(SCORED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in _windows(batches):
            rows: list = [None] * len(texts)
            order = sorted(range(len(texts)), key=lambda i: -len(texts[i] or ""))
            at = 0
            for some in _some(texts[i] for i in order):
                for i, row in zip(order[at : at + len(some)], shared.value.score(some), strict=True):
                    rows[i] = row
                at += len(some)
            yield pd.DataFrame(rows, columns=names)

    scored = stored(
        docs.select("doc_id", F.octet_length("text").alias("n_bytes"), run(F.col("text")).alias("s"))
        .select("doc_id", "n_bytes", "s.*")
        .withColumn("row", F.monotonically_increasing_id())
    )
    cold = scored.select("row", F.explode(F.arrays_zip("cold", "cold_spelled")).alias("c")).select(
        "row", F.col("c.cold").alias("word"), F.col("c.cold_spelled").alias("spelled")
    )
    base = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(model.total + 0.5 * (model.distinct + 1)))
    # A word behind an escape: by its count, or spelled.
    counted, spelled = F.col("n") * (model.known_share / max(1, model.n_other)), F.log10(F.lit(1 - model.known_share)) + F.col("spelled")
    # The sum of both, which for a new word is its spelling, however small that is.
    other = F.when(F.col("n") > 0, F.log10(counted + F.pow(F.lit(10.0), spelled))).otherwise(spelled)
    rest = (
        cold.join(counts, "word", "left")
        .groupBy("row")
        .agg(F.count_if(F.col("n") > 0).alias("cold_known"), F.sum(base).alias("cold_base"), F.sum(other).alias("cold_score"))
    )
    score = F.col("hot_score") + F.coalesce("cold_score", F.lit(0.0))
    return scored.join(rest, "row", "left").select(
        "doc_id",
        (fold(F.col("doc_id")) == 1).alias("held_out"),
        "n_tokens",
        (F.col("hot_known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("cold_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        (score * -math.log2(10) / F.greatest(F.coalesce("n_bytes", F.lit(0)), F.lit(1))).alias("bits_per_byte"),
    )


def score_all(docs: DataFrame) -> DataFrame:
    """Learn from the documents whose fold isn't 1, score all."""
    model, counts = fit(docs.where(fold(F.col("doc_id")) != 1).select("text"))
    return score(docs.select("doc_id", "text"), model, counts)
