"""SentencePiece encoding and decoding, with the N best segmentations.

A text's characters, blanks written as U+2581 and (where the model wants it) one put before, span a lattice
of the vocabulary's pieces; a segmentation's score is the sum of its pieces' scores. Viterbi from the left gives,
up to every place, the best score and beside it the least number of pieces that has this score. These are
exact heuristics for an A* search from the right: it takes the best open hypothesis, and each one that comes to
the left end is the next best segmentation. Scores are counted in whole units of 2**-24, so that ties are ties
and no rounding puts one path before another. Of hypotheses that tie in score and pieces the deepest goes first. As the
heuristic is exact, n open hypotheses are enough for the n best, and each goes on to the left end
at once: the search takes n walks over the part at most and holds n hypotheses, which share their right ends.

No piece of the vocabulary has a blank after another character or a line end, so a lattice
falls into parts there, and a text's best segmentations are combinations of its parts'. A
part's Viterbi pass is kept and used again. New parts of ordinary length are passed through
Viterbi many at a time in arrays, from both sides: from both the loss of the best detour is
known, and only parts that the N best segmentations can differ in are searched.

A character that no piece covers has a score below all pieces' and is written in byte pieces. The model's own
normalisation is not applied: texts are encoded as they are, so that decoding gives them back.

Defined results: a null or empty text has no pieces, score 0 and no alternative; a text
that holds U+2581 itself decodes to a blank there (the format can't tell them apart) and
has ``round_trip`` false; equal scores go to fewer pieces, and the best of those has the longer piece at the right end; other ties stand as the search
comes to them, which the part alone decides; of a whole text's next best, equal scores go to fewer changed parts, then to parts further left; very long texts, and very long parts without a blank, take time and memory in
proportion to their length; repeated rows encode alike; an empty table gives an empty one; input columns named as results are
replaced, all others are kept.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.batches import bounded_batches
from lumenfold.llm.columns import others, quoted

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The blank's sign in pieces, as the format has it.
BLANK = "▁"
UNKNOWN_BELOW = 10.0
N_BEST = 4
#: Parts that are kept; of longer ones than WIDTH the pass is made one character after the other.
KEEP = 600_000
#: And so many characters, so that long parts don't fill the memory.
KEEP_CHARS = 16_000_000
#: Alternatives are kept for parts up to this length.
SHORT = 64
#: Units of score, and room for counts of pieces below a unit.
UNIT = 1 << 24
COUNT = 1 << 40
WIDTH = 24
TOGETHER = 4096
_PART = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class Vocabulary:
    """Pieces and scores by id. Byte pieces serve characters without a piece; control pieces aren't matched."""

    def __init__(self, pieces: Sequence[str], scores: Sequence[float], bytes_of: dict[int, int], control: set[int], prefix: bool = True) -> None:
        self.pieces, self.bytes_of, self.control, self.prefix = list(pieces), bytes_of, control, prefix
        self.units = [round(x * UNIT) for x in scores]
        self.byte_ids = {b: i for i, b in bytes_of.items()}
        self.ids = {p: i for i, p in enumerate(pieces) if i not in bytes_of and i not in control}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = min((self.units[i] for i in self.ids.values()), default=0) - round(UNKNOWN_BELOW * UNIT)
        #: Parts can be cut before blanks and around line ends only if no piece spans these places.
        self.cut = all(BLANK not in p.lstrip(BLANK) and ("\n" not in p or p == "\n") for p in self.ids)
        #: Every beginning of a piece: its piece, or -1.
        self.beginnings = {p[:n]: -1 for p in self.ids for n in range(1, len(p))} | self.ids

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Vocabulary:
        """Read a model file that the driver can open."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=Path(path).read_bytes())
        n = m.get_piece_size()
        bytes_of = {i: int(m.id_to_piece(i)[3:5], 16) for i in range(n) if m.is_byte(i)}
        control = {i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)}
        prefix = m.id_to_piece(m.encode("a")[:1])[0].startswith(BLANK)
        return cls([m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)], bytes_of, control, prefix)

    def weight(self, i: int) -> int:
        """A piece's score and, below it, its count: sums of these compare by score, then by fewer pieces."""
        return self.units[i] * COUNT - 1

    def spelled(self, char: str) -> tuple[int, ...]:
        """A character's byte pieces, or the unknown piece 0 where the vocabulary has no byte pieces."""
        raw = char.encode("utf-8", "surrogatepass")
        return tuple(self.byte_ids[b] for b in raw) if all(b in self.byte_ids for b in raw) else (0,)


def viterbi(part: str, v: Vocabulary) -> list[int]:
    """The best weight up to each place."""
    best: list[int | None] = [0] + [None] * len(part)
    get, units = v.beginnings.get, v.units
    for start in range(len(part)):
        here = best[start]
        for end in range(start + 1, min(len(part), start + v.longest) + 1):
            i = get(part[start:end])
            if i is None:
                break
            if i >= 0:
                weight = here + units[i] * COUNT - 1
                if best[end] is None or weight > best[end]:
                    best[end] = weight
        if part[start] not in v.ids:
            weight = here + v.unknown * COUNT - len(v.spelled(part[start]))
            if best[start + 1] is None or weight > best[start + 1]:
                best[start + 1] = weight
    return best


def arcs_to(part: str, end: int, v: Vocabulary) -> list[tuple[int, int, tuple[int, ...]]]:
    """Start, weight and ids of what can end at a place, the longest first."""
    found = []
    for start in range(max(0, end - v.longest), end):
        i = v.ids.get(part[start:end])
        if i is not None:
            found.append((start, v.weight(i), (i,)))
    if not found or found[-1][0] != end - 1:
        ids = v.spelled(part[end - 1])
        found.append((end - 1, v.unknown * COUNT - len(ids), ids))
    return found


def n_best(part: str, v: Vocabulary, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """Up to ``n`` segmentations of ``part``, the best first: scores and ids."""
    best = viterbi(part, v)
    into: dict[int, list[tuple[int, int, tuple[int, ...]]]] = {}
    # What is still possible (turned round), place, number, weight so far, and ids so far with a link to those on their right.
    hypotheses: list[tuple] = [(-best[-1], len(part), 0, 0, None)]
    found, number = [], 0
    while hypotheses and len(found) < n:
        possible, at, _, done, ids = hypotheses.pop(0)
        room = n - len(found) - 1
        while at:
            if at not in into:
                into[at] = arcs_to(part, at, v)
            onward = None
            for start, weight, more in into[at]:
                total = -(done + weight + best[start])
                if onward is None and total == possible:
                    onward = start, done + weight, (more, ids)
                elif room and (len(hypotheses) < room or (total, start) < hypotheses[-1][:2]):
                    number += 1
                    bisect.insort(hypotheses, (total, start, number, done + weight, (more, ids)))
                    del hypotheses[room:]
            at, done, ids = onward
        row: list[int] = []
        while ids is not None:
            row += ids[0]
            ids = ids[1]
        found.append((-(-done // COUNT) / UNIT, tuple(row)))
    return found


def edit(old: Sequence[int], new: Sequence[int]) -> tuple[int, int, tuple[int, ...]]:
    """Where ``new`` differs from ``old``: place, how many of the old ids go, and the ids that come."""
    same = 0
    while same < min(len(old), len(new)) and old[same] == new[same]:
        same += 1
    back = 0
    while back < min(len(old), len(new)) - same and old[-1 - back] == new[-1 - back]:
        back += 1
    return same, len(old) - same - back, tuple(new[same : len(new) - back])


def combinations(losses: list[list[float]], n: int) -> list[tuple[float, int, tuple[int, ...]]]:
    """The ``n`` least sums of one of each list's losses (each in order, from 0): sum, how many aren't the first, and which."""
    kept: list[tuple[float, int, tuple[int, ...]]] = [(0.0, 0, ())]
    for part in losses:
        kept = sorted((lost + x, changes + (j > 0), (*pick, j)) for lost, changes, pick in kept for j, x in enumerate(part))[:n]
    return kept


def _mixed(h: np.ndarray) -> np.ndarray:
    """A hash whose upper and lower bits all depend on all of ``h``'s."""
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


class _Table:
    """Pieces by hash, in two tables of slots, looked up in arrays."""

    BITS = 20

    def __init__(self, v: Vocabulary) -> None:
        size = 1 << self.BITS
        self.hashes = np.zeros((2, size), np.uint64)
        self.found = np.full((2, size), -1, np.int32)
        taken: tuple[set[int], set[int]] = (set(), set())
        self.rest: dict[int, int] = {}
        for piece, i in v.ids.items():
            h = 0
            for c in piece:
                h = (h * _BASE + ord(c) + 1) & _MASK
            m = int(_mixed(np.array([h], np.uint64))[0])
            for k, slot in enumerate((m >> 64 - self.BITS, m >> 20 & size - 1)):
                if slot not in taken[k]:
                    taken[k].add(slot)
                    self.hashes[k, slot], self.found[k, slot] = h, i
                    break
            else:
                self.rest[h] = i

    def __call__(self, h: np.ndarray) -> np.ndarray:
        m = _mixed(h)
        a, b = (m >> np.uint64(64 - self.BITS)).astype(np.int64), (m >> np.uint64(20)).astype(np.int64) & ((1 << self.BITS) - 1)
        out = np.where(self.hashes[0].take(a) == h, self.found[0].take(a), -1)
        # The second table has what found its slot taken: few pieces, so few lookups hit it.
        again = np.flatnonzero(self.hashes[1].take(b) == h)
        out[again] = np.where(out[again] < 0, self.found[1].take(b[again]), out[again])
        for other, i in self.rest.items():
            out[h == np.uint64(other)] = i
        return out


class Encoder:
    """Best segmentations of parts, kept by part; made once in each process."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.table = v, _Table(v)
        self.scores = np.array([*v.units, 0], np.float64)
        self.clear()
        self.kept_alternatives = lru_cache(50_000)(self._alternatives)
        self.text_of = [chr(0xDC00 + v.bytes_of[i]) if i in v.bytes_of else "" if i in v.control else p for i, p in enumerate(v.pieces)]
        self.has_bytes = np.zeros(len(v.pieces) + 1, bool)
        self.has_bytes[list(v.bytes_of)] = True

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.fresh: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        self.ids: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.size: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.score: list[np.ndarray] = [np.zeros(0)]
        self.loss: list[np.ndarray] = [np.zeros(0)]

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.v.cut or not self.v.prefix:
            whole = (BLANK if self.v.prefix else "") + text.replace(" ", BLANK)
            return _PART.findall(whole) if self.v.cut else [whole]
        if "  " in text or text[0] == " " or text[-1] == " " or BLANK in text or "\n" in text:
            return _PART.findall(BLANK + text.replace(" ", BLANK))
        return (BLANK + text.replace(" ", " " + BLANK)).split(" ")

    def learn(self, parts: list[str], n: int = 2) -> None:
        """Enter parts that aren't kept yet."""
        others = [p for p in parts if len(p) > WIDTH]
        short = sorted((p for p in parts if len(p) <= WIDTH), key=len)
        for at in range(0, len(short), TOGETHER):
            some = short[at : at + TOGETHER]
            ids, sizes, score, loss, plain = self._many(some)
            starts = np.cumsum(sizes) - sizes
            keep = np.flatnonzero(plain)
            order = [some[i] for i in keep.tolist()]
            self._enter(order, ids[_ranges(starts[keep], sizes[keep])], sizes[keep], score[keep], loss[keep])
            others += [some[i] for i in np.flatnonzero(~plain).tolist()]
        for p in others:
            few = n_best(p, self.v, max(2, n))
            if len(p) > SHORT:
                self.fresh[p] = few
            row = np.array(few[0][1], np.int32)
            self._enter([p], row, np.array([len(row)]), np.array([few[0][0]]), np.array([few[0][0] - few[1][0] if len(few) > 1 else np.inf]))

    def _alternatives(self, part: str, n: int) -> list[tuple[float, tuple[int, int, tuple[int, ...]]]]:
        """What each of the ``n`` best segmentations loses, and its edit of the best."""
        found = self.fresh.get(part) or n_best(part, self.v, n)
        return [(found[0][0] - score, edit(found[0][1], ids)) for score, ids in found[:n]]

    def alternatives(self, part: str, n: int) -> list[tuple[float, tuple[int, int, tuple[int, ...]]]]:
        return self.kept_alternatives(part, n) if len(part) <= SHORT else self._alternatives(part, n)

    def _enter(self, parts: list[str], ids: np.ndarray, sizes: np.ndarray, score: np.ndarray, loss: np.ndarray) -> None:
        at = len(self.index)
        self.chars += sum(map(len, parts))
        self.index.update(zip(parts, range(at, at + len(parts)), strict=True))
        self.ids.append(ids)
        self.size.append(sizes)
        self.score.append(score)
        self.loss.append(loss)

    def _many(self, parts: list[str]) -> tuple[np.ndarray, ...]:
        """Viterbi from both sides over many short parts: ids, sizes, best scores, the best detours' losses, and which have pieces for all characters."""
        order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
        lengths = np.array([len(parts[i]) for i in order])
        n, width = len(parts), int(lengths[0])
        chars = np.zeros((width, n), np.uint64)
        raw = np.frombuffer("".join(parts[i].ljust(width, "\0") for i in order).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, width)
        chars[:] = raw.T
        longest = min(self.v.longest, width)
        live = [int(np.searchsorted(-lengths, -j, side="right")) for j in range(width + 1)]  # parts of j characters or more
        arcs: dict[tuple[int, int], np.ndarray] = {}
        piece_of = np.zeros((width, width + 1, n), np.int32)
        plain = np.ones(n, bool)
        for start in range(width):
            h = np.zeros(n, np.uint64)
            for end in range(start + 1, min(width, start + longest) + 1):
                m = live[end]
                h = h[:m] * np.uint64(_BASE) + chars[end - 1, :m] + np.uint64(1)
                found = self.table(h)
                score = np.where(found >= 0, self.scores[found], -np.inf)
                if end == start + 1:
                    missing = found < 0
                    plain[:m] &= ~missing
                    score[missing] = self.v.unknown  # parts that have one are searched alone
                if (found >= 0).any() or end == start + 1:
                    arcs[start, end] = score
                    piece_of[start, end, :m] = found
        left = np.full((width + 1, n), -np.inf)
        left[0] = 0
        pieces = np.zeros((width + 1, n), np.int32)
        come = np.zeros((width + 1, n), np.int32)
        for end in range(1, width + 1):
            m = live[end]
            for start in range(max(0, end - longest), end):
                if (start, end) in arcs:
                    value = left[start, :m] + arcs[start, end]
                    count = pieces[start, :m] + 1
                    better = (value > left[end, :m]) | (value == left[end, :m]) & (count < pieces[end, :m]) & np.isfinite(value)
                    left[end, :m][better] = value[better]
                    pieces[end, :m][better] = count[better]
                    come[end, :m][better] = start
        right = np.full((width + 1, n), -np.inf)
        right[lengths, np.arange(n)] = 0
        for start in range(width - 1, -1, -1):
            for end in range(start + 1, min(width, start + longest) + 1):
                if (start, end) in arcs:
                    m = live[end]
                    np.maximum(right[start, :m], arcs[start, end] + right[end, :m], out=right[start, :m])
        best = left[lengths, np.arange(n)]
        # The chosen arcs, from the right end.
        at, path, chosen = lengths.copy(), [], np.zeros((width + 1, n), bool)
        while True:
            on = at > 0
            if not on.any():
                break
            start = np.where(on, come[at, np.arange(n)], 0)
            path.append((start, np.where(on, at, 0)))
            chosen[at[on], np.flatnonzero(on)] = True
            at = start
        second = np.full(n, -np.inf)
        for (start, end), score in arcs.items():
            m = live[end]
            through = left[start, :m] + score + right[end, :m]
            used = chosen[end, :m] & (come[end, :m] == start)
            np.maximum(second[:m], np.where(used, -np.inf, through), out=second[:m])
        picked = np.stack([piece_of[start, end, np.arange(n)] for start, end in path])
        sizes = np.array([(end > 0) for _, end in path], np.int64).sum(axis=0)
        # Back to the order of ``parts``.
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        flat = picked.T[back][:, ::-1]
        has = (np.arange(len(path)) >= len(path) - sizes[back][:, None])
        return flat[has], sizes[back], best[back] / UNIT, (best - second)[back] / UNIT, plain[back]

    def arrays(self) -> tuple[np.ndarray, ...]:
        if len(self.ids) > 1:
            self.ids, self.size = [np.concatenate(self.ids)], [np.concatenate(self.size)]
            self.score, self.loss = [np.concatenate(self.score)], [np.concatenate(self.loss)]
            self.starts = np.cumsum(self.size[0]) - self.size[0]
        return self.ids[0], self.size[0], self.score[0], self.loss[0]

    def encode(self, texts: list[str | None], n: int = N_BEST) -> list[tuple]:
        """For each text its ids, score, and up to ``n`` - 1 next best: scores, and what they change."""
        split = [self.parts(t or "") for t in texts]
        if len(self.index) > KEEP or self.chars > KEEP_CHARS:
            self.clear()
        get = self.index.get
        found = [np.fromiter([get(p, -1) for p in parts], np.int64, len(parts)) for parts in split]
        unknown = [np.flatnonzero(of < 0).tolist() for of in found]
        if any(unknown):
            self.learn(list({parts[i] for parts, new in zip(split, unknown, strict=True) for i in new}), n)
            for of, parts, new in zip(found, split, unknown, strict=True):
                for i in new:
                    of[i] = self.index[parts[i]]
        if not len(self.index):
            self.starts = np.zeros(0, np.int64)
        ids, sizes, scores, losses = self.arrays()
        out = []
        for parts, of in zip(split, found, strict=True):
            length = sizes.take(of)
            row = ids.take(_ranges(self.starts.take(of), length))
            total = float(scores.take(of).sum())
            out.append((row, total, self._next(parts, of, length, losses.take(of), total, n)))
        self.fresh.clear()
        return out

    def _next(self, parts: list[str], of: np.ndarray, length: np.ndarray, loss: np.ndarray, total: float, n: int) -> list[dict]:
        """The next best: combinations of other segmentations of the n - 1 parts that lose least."""
        if n < 2 or not len(of):
            return []
        cheap = np.argsort(loss, kind="stable")[: n - 1]
        cheap = np.sort(cheap[np.isfinite(loss[cheap])])
        places = np.cumsum(length) - length
        choices = [self.alternatives(parts[i], n) for i in cheap.tolist()]
        rows = []
        for lost, changes, pick in combinations([[x for x, _ in part] for part in choices], n):
            if changes:
                edits = [(int(places[i]), c[j][1]) for i, c, j in zip(cheap.tolist(), choices, pick, strict=True) if j]
                rows.append({"score": total - lost, "edits": [{"at": at + same, "n_old": n_old, "ids": list(ids)} for at, (same, n_old, ids) in edits]})
        return rows

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids. Byte pieces in a row are read as UTF-8."""
        joined = "".join([self.text_of[i] for i in ids.tolist()])
        if len(ids) and self.has_bytes[ids].any():
            joined = re.sub("[\udc00-\udcff]+", lambda m: bytes(ord(c) - 0xDC00 for c in m[0]).decode("utf-8", "replace"), joined)
        joined = joined.replace(BLANK, " ")
        return joined[1:] if self.v.prefix and joined.startswith(" ") else joined


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = int(lengths.sum())
    ends = np.cumsum(lengths, dtype=np.int64)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


ENCODED = (
    "piece_ids array<int>, n_pieces int, score double, "
    "next_best array<struct<score:double, edits:array<struct<at:int, n_old:int, ids:array<int>>>>>, round_trip boolean"
)
NAMES = ("piece_ids", "n_pieces", "score", "next_best", "round_trip")
_ENCODERS: dict[int, Encoder] = {}


def encode(docs: DataFrame, vocabulary: Vocabulary, n: int = N_BEST) -> DataFrame:
    """``docs`` with ids, their number, score, the next best segmentations as edits, and whether decoding gives the text back."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)  # as large as the vocabulary's file
    names = others(docs.columns, *NAMES)
    # Numbered on the way through Python, so that no name is in the way.
    kept = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)])
    place = [c.lower() for c in names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if id(shared.value) not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[id(shared.value)] = Encoder(shared.value)
        encoder = _ENCODERS[id(shared.value)]
        for batch in batches:
            texts = batch.column(place).to_pylist()
            found = encoder.encode(texts, n)
            ids = [row for row, _, _ in found]
            columns = [
                _lists(ids),
                pa.array([len(row) for row in ids], pa.int32()),
                pa.array([score for _, score, _ in found], pa.float64()),
                _following([following for _, _, following in found]),
                pa.array([encoder.decode(row) == (text or "") for row, text in zip(ids, texts, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *NAMES])

    return kept.mapInArrow(run, T.StructType(kept.schema.fields + T._parse_datatype_string(ENCODED).fields)).toDF(*names, *NAMES)


def _lists(rows: list) -> pa.ListArray:
    """Rows of numbers as one Arrow array, without a Python object for each number."""
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64))).astype(np.int32)
    values = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def _following(rows: list[list[dict]]) -> pa.ListArray:
    flat = [x for row in rows for x in row]
    edits = [e for x in flat for e in x["edits"]]
    edit = pa.StructArray.from_arrays(
        [pa.array([e["at"] for e in edits], pa.int32()), pa.array([e["n_old"] for e in edits], pa.int32()), _lists([e["ids"] for e in edits])],
        names=["at", "n_old", "ids"],
    )
    of = np.concatenate(([0], np.cumsum([len(x["edits"]) for x in flat], dtype=np.int64))).astype(np.int32)
    one = pa.StructArray.from_arrays([pa.array([x["score"] for x in flat], pa.float64()), pa.ListArray.from_arrays(pa.array(of), edit)], names=["score", "edits"])
    per = np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(per), one)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "piece_ids") -> DataFrame:
    """``encoded`` with ``text`` from its ids; null ids give a null text."""
    spark = encoded.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(shared.value)
        for rows in batches:
            yield pd.Series([None if ids is None else encoder.decode(np.asarray(ids, np.int64)) for ids in rows], dtype=object)

    return encoded.withColumn("text", run(F.col(ids_col)))
