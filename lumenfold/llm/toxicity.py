"""Toxicity by nearest labelled examples, with exact TF-IDF cosine over block-max inverted indexes.

Examples are a bounded sample of labelled rows of the training folds, as many of each
label as there are up to ``per_label``. Terms are all words of the examples' whole texts. A
term's weight in a text is (1 + ln tf) * idf * g: document frequencies are counted over all
documents, and g is a factor of the term that the examples' labels tell (``label_factor``: the
size of the correlation of term and label, which no term has below FLOOR); ``weighting="plain"``
leaves g out. A word that no example has can't match any; it would scale a text's cosines
all alike, and so the cosine is taken in the space of the examples' terms.

The index has a term's postings in blocks of BLOCK examples, each block with its largest weight.
For a text, the bounds of all blocks come first; blocks are then read by their bound, the largest first,
until no bound reaches the k-th best cosine: the neighbours are exact. Equal cosines at the
k-th place share what places are left. Votes weigh by distance and by how the sample thinned each
label; a logistic curve fitted on examples, each without itself, turns the share into a
calibrated score.

A score is made of the text alone: labels of other folds, language, source and doc_id have
no part in it.

Defined results: null and empty texts, and texts without any term, are as near to every example and
score what all examples' votes say; without labelled examples, or with one label only, every score is that label's share;
repeated labels of a document count as toxic if any is; labels that are null or belong to no document are
left out; very long texts count whole, in memory that grows with one text; repeated rows score
alike; an empty table gives an empty one; input columns named as results are replaced, all others are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.batches import bounded_batches
from lumenfold.llm.columns import others, quoted, unused
from lumenfold.session import discard, stored

#: The bound of the sample: so many examples of each label.
PER_LABEL = 2048
NEIGHBOURS = 15
BLOCK = 64
#: So many blocks are read first, to have a k-th best cosine; then eight times as many, and so on.
FIRST_BLOCKS = 8
COMMON = 16
#: Texts whose common terms are multiplied together.
TOGETHER = 64
#: Tasks that vote on the examples.
CURVE_TASKS = 6
#: The least factor of a term.
FLOOR = 0.002
EPSILON = 1e-9
_WORD = re.compile(r"[^\W_]+")


def term_counts(text: str | None) -> Counter:
    """Every word of the text, in lower case, and how often it stands there."""
    return Counter(_WORD.findall((text or "").lower()))


def idf(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.log((n_docs + 1) / (df + 1)) + 1


def label_factor(with_toxic: np.ndarray, with_other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """The correlation of having the term and being toxic, without its sign; FLOOR is added."""
    a, b = with_toxic.astype(np.float64), with_other.astype(np.float64)
    spread = np.sqrt((a + b) * (n_toxic + n_other - a - b) * n_toxic * n_other)
    apart = np.abs(a * (n_other - b) - b * (n_toxic - a))
    return FLOOR + np.divide(apart, spread, out=np.zeros(len(a)), where=spread > 0)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after the other."""
    ends = np.cumsum(lengths, dtype=np.int32)
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(len(out), dtype=np.int32)
    return out


def unit(terms: np.ndarray, counts: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's terms and weights, of length 1 if it has any."""
    weights = (1 + np.log(counts)) * factor[terms]
    norm = math.sqrt(float(weights @ weights))
    return terms, weights / norm if norm else weights


class Index:
    """Postings by term and block: entries (block, largest weight, place of its postings) and postings (example, weight).

    Lists of terms that a COMMON-th of all examples have are kept as whole rows, which are multiplied for many texts at a time; their
    bounds are the products' largest in each block.
    """

    def __init__(self, n_terms: int, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """``rows``: terms and weights of each example, in the examples' order."""
        sizes = np.array([len(t) for t, _ in rows], np.int64)
        terms = np.concatenate([t for t, _ in rows]).astype(np.int32) if rows else np.zeros(0, np.int32)
        weights = np.concatenate([w for _, w in rows]) if rows else np.zeros(0)
        examples = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        order = np.lexsort((examples, terms))
        terms, self.example, self.weight = terms[order], examples[order], weights[order]
        self.n_examples, self.n_blocks = len(rows), max(1, -(-len(rows) // BLOCK))
        often = np.bincount(terms, minlength=n_terms) * COMMON >= max(1, len(rows))
        self.row = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        self.full = np.zeros((int(often.sum()), self.n_blocks * BLOCK))
        whole = often[terms]
        self.full[self.row[terms[whole]], self.example[whole]] = self.weight[whole]
        terms, self.example, self.weight = terms[~whole], self.example[~whole], self.weight[~whole]
        block = self.example // BLOCK
        new = np.ones(len(terms), bool)
        new[1:] = (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        self.at, self.block = at.astype(np.int32), block[at].astype(np.int32)
        self.size = np.diff(np.append(at, len(terms))).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, at) if len(at) else np.zeros(0)
        self.entries = np.bincount(terms[at], minlength=n_terms).astype(np.int32)
        self.first = (np.cumsum(self.entries, dtype=np.int32) - self.entries).astype(np.int32)

    def common(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms bring to the cosine of each query (terms and weights) with each example."""
        asked = np.zeros((len(queries), len(self.full)))
        for i, (terms, weights) in enumerate(queries):
            row = self.row.take(terms)
            asked[i, row[row >= 0]] = weights[row >= 0]
        return asked @ self.full

    def nearest(self, query: tuple[np.ndarray, np.ndarray], common: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """Examples and cosines of the k nearest and of all tied with the last; and how many blocks were read."""
        rare = self.row.take(query[0]) < 0
        terms, weights = query[0][rare], query[1][rare]
        n = self.entries.take(terms)
        entry = _ranges(self.first.take(terms), n)
        asked = np.repeat(weights, n)
        block = self.block.take(entry)
        bound = common.reshape(-1, BLOCK).max(axis=1) + np.bincount(block, asked * self.most.take(entry), self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        cosine = common[: self.n_examples].copy()
        read = np.zeros(self.n_blocks, bool)
        kth, at, width, examples = -1.0, 0, FIRST_BLOCKS, np.zeros(0, np.int64)
        while at < len(order) and bound[order[at]] >= kth - EPSILON:
            some = order[at : at + width]
            some = some[bound[some] >= kth - EPSILON]
            at, width = at + width, width * 8
            now = np.zeros(self.n_blocks, bool)
            now[some] = True
            chosen = np.flatnonzero(now.take(block))
            if len(chosen):
                of = entry.take(chosen)
                size = self.size.take(of)
                place = _ranges(self.at.take(of), size)
                cosine += np.bincount(self.example.take(place), np.repeat(asked.take(chosen), size) * self.weight.take(place), self.n_examples)
            read |= now
            examples = np.flatnonzero(np.repeat(read, BLOCK)[: self.n_examples])
            examples = examples[examples != without]
            if len(examples) >= k:
                values = cosine[examples]
                kth = float(np.partition(values, len(values) - k)[len(values) - k])
        near = examples[cosine[examples] >= kth - EPSILON]
        return near, cosine[near], int(read.sum())


@dataclass
class Model:
    """Examples as unit vectors in an index, and what turns votes into scores."""

    terms: dict[str, int]
    factor: np.ndarray  # idf and label factor of each term
    vectors: tuple[np.ndarray, np.ndarray, np.ndarray]  # terms, counts and number of terms of the examples, one after the other
    toxic: np.ndarray
    ids: np.ndarray
    share: float
    thinned: tuple[float, float]
    k: int = NEIGHBOURS
    curve: tuple[float, float] = (0.0, 1.0)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "examples")}

    @cached_property
    def examples(self) -> list[tuple[np.ndarray, np.ndarray]]:
        terms, counts, sizes = self.vectors
        ends = np.cumsum(sizes)
        return [unit(terms[e - n : e], counts[e - n : e].astype(np.float64), self.factor) for e, n in zip(ends, sizes, strict=True)]

    @cached_property
    def index(self) -> Index:
        """Made once in each process: the vectors are a fraction of its size, and they are what is sent."""
        index = Index(len(self.factor), self.examples)
        del self.examples
        return index

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The text's terms and weights."""
        none = len(self.factor)
        get = self.terms.get
        found = np.array([get(w, none) for w in _WORD.findall((text or "").lower())], np.int32)
        terms, counts = np.unique(found[found < none], return_counts=True)
        return unit(terms, counts, self.factor)

    def neighbours(self, query: tuple[np.ndarray, np.ndarray], common: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Examples, cosines and places held: the k nearest, those tied at the last place sharing what is left."""
        examples, cosine, _ = self.index.nearest(query, common, self.k, without)
        kth = float(np.sort(cosine)[-self.k]) if len(cosine) >= self.k else -1.0
        sure = cosine > kth + EPSILON
        tied = ~sure & (cosine >= kth - EPSILON)
        return examples, cosine, sure + tied * (max(0, self.k - sure.sum()) / max(1, tied.sum()))

    def vote(self, query: tuple[np.ndarray, np.ndarray], common: np.ndarray, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """The share of toxic votes, with the nearest examples and their cosines, the nearest first."""
        examples, cosine, places = self.neighbours(query, common, without)
        toxic = self.toxic[examples]
        weight = places / (1.05 - cosine) * np.where(toxic, self.thinned[1], self.thinned[0])
        share = (float(weight @ toxic) + 0.1 * self.share) / (float(weight.sum()) + 0.1)
        first = np.lexsort((examples, -cosine))[:3]
        return share, examples[first], cosine[first]

    def votes(
        self, queries: list[tuple[np.ndarray, np.ndarray]], left_out: bool = False, begin: int = 0, end: int | None = None,
    ) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """A vote on each query from ``begin`` to ``end``. With ``left_out`` the queries are the examples, each without itself."""
        end = len(queries) if end is None else min(end, len(queries))
        for at in range(begin, end, TOGETHER):
            some = queries[at : min(at + TOGETHER, end)]
            for j, (query, common) in enumerate(zip(some, self.index.common(some), strict=True), at):
                yield self.vote(query, common, j if left_out else -1)

    def left_out(self, begin: int, end: int) -> list[float]:
        """The votes on examples from ``begin`` to ``end``, each without itself."""
        return [share for share, _, _ in self.votes(self.examples, left_out=True, begin=begin, end=end)]

    def fit_curve(self, shares: list[float] | None = None) -> None:
        """A logistic curve from the log-odds of votes, by Newton's method over examples left out in turn; ``shares``: their votes, if known."""
        if self.constant():
            return
        x = _logit(np.array(self.left_out(0, len(self.toxic)) if shares is None else shares))
        y = self.toxic.astype(float)
        w = np.where(self.toxic, self.thinned[1], self.thinned[0])
        a, b = 0.0, 1.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a + b * x)))
            r, v = w * (y - p), w * p * (1 - p) + 1e-9
            # A light pull to the plain share keeps the fit bounded on separable examples.
            g = np.array([r.sum() - a, (r * x).sum() - (b - 1)])
            h = np.array([[v.sum() + 1, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1]])
            step = np.linalg.solve(h, g)
            a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -1, 1))
            if np.abs(step).max() < 1e-8:
                break
        self.curve = (a, max(b, 0.05))

    def constant(self) -> bool:
        return not len(self.toxic) or bool(self.toxic.all()) or not self.toxic.any()

    def score(self, texts: list[str | None]) -> list[tuple[float, list[int], list[float]]]:
        if self.constant():
            return [(self.share, [], [])] * len(texts)
        (a, b), out = self.curve, []
        for share, examples, cosine in self.votes([self.vector(t) for t in texts]):
            out.append((float(1 / (1 + math.exp(-(a + b * float(_logit(np.array(share))))))), self.ids[examples].tolist(), cosine.tolist()))
        return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fold(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def examples_of(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """``example_id``, ``toxic`` and whole ``text`` of the sample, and how many labelled documents of each label there are."""
    known = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .where(fold(F.col("doc_id")) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit("examples"), F.col("doc_id"))
    sample = [
        (r.doc_id, r.toxic)
        for label in (0, 1)
        for r in known.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(per_label).collect()
    ]
    chosen = docs.sparkSession.createDataFrame(sample, "example_id long, toxic int")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("example_id")).select("example_id", "toxic", "text"), totals


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, k: int = NEIGHBOURS, weighting: str = "label") -> Model:
    """A model from labelled rows whose fold isn't 0. What comes to the driver is bounded by the sample's texts."""
    spark = docs.sparkSession
    bounded_batches(spark)
    chosen, totals = examples_of(docs, labels, per_label)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [term_counts(t) for t in pdf["text"]]
            yield pd.DataFrame({
                "example_id": pdf["example_id"], "toxic": pdf["toxic"],
                "terms": [list(c) for c in found], "counts": [list(c.values()) for c in found],
            })

    kept = stored(chosen.mapInPandas(counted, "example_id long, toxic int, terms array<string>, counts array<int>"))
    number: dict[str, int] = {}
    ids, toxic, vectors = [], [], []
    for batch in kept.toArrow().to_batches(max_chunksize=64):
        ids += batch.column("example_id").to_pylist()
        toxic += batch.column("toxic").to_pylist()
        for terms, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            at = np.fromiter((number.setdefault(t, len(number)) for t in terms), np.int32, len(terms))
            vectors.append((at, np.array(counts, np.int32)))
    discard(kept)
    shared = spark.sparkContext.broadcast(number)  # the words of the sample's texts

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get, seen, n = shared.value.get, np.zeros(len(shared.value) + 1, np.int64), 0
        none = len(shared.value)
        for pdf in batches:
            for text in pdf["text"]:
                # Each word once, so that each place is added to once; but for the last, which is set below.
                seen[[get(w, none) for w in set(_WORD.findall((text or "").lower()))]] += 1
                n += 1
        seen[none] = n
        has = np.flatnonzero(seen)
        yield pd.DataFrame({"term": has, "df": seen[has]})

    df = np.zeros(len(number) + 1, np.int64)
    sums = docs.select("text").mapInPandas(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df[sums["term"].to_numpy(np.int64)] = sums["df"].to_numpy(np.int64)
    shared.unpersist()
    is_toxic = np.array([y == 1 for y in toxic], bool)
    factor = idf(int(df[-1]), df[:-1])
    if weighting == "label":
        held = [np.bincount(np.concatenate([v[0] for v, y in zip(vectors, is_toxic, strict=True) if y == label] or [np.zeros(0, np.int64)]), minlength=len(number)) for label in (True, False)]
        factor = factor * label_factor(held[0], held[1], int(is_toxic.sum()), int((~is_toxic).sum()))
    n_all = sum(totals.values())
    n_of = {1: int(is_toxic.sum()), 0: int((~is_toxic).sum())}
    # Examples of like labels and strongest terms stand together, so that blocks' bounds are tight.
    strongest = [int(t[np.argmax((1 + np.log(c)) * factor[t])]) if len(t) else -1 for t, c in vectors]
    order = sorted(range(len(ids)), key=lambda i: (is_toxic[i], strongest[i], ids[i], toxic[i], vectors[i][0].tobytes()))
    terms = np.concatenate([vectors[i][0] for i in order] or [np.zeros(0)]).astype(np.int32)
    counts = np.concatenate([vectors[i][1] for i in order] or [np.zeros(0)]).astype(np.int32)
    model = Model(
        number, factor, (terms, counts, np.array([len(vectors[i][0]) for i in order], np.int64)), is_toxic[order] if order else is_toxic, np.array([ids[i] for i in order], np.int64),
        totals.get(1, 0) / n_all if n_all else 0.0, tuple(totals.get(y, 0) / max(1, n_of[y]) for y in (0, 1)), k,
    )
    if not model.constant():
        model.fit_curve(_left_out(spark, model))
    return model


def _left_out(spark: SparkSession, model: Model) -> list[float]:
    """Each example's vote without itself. Made in tasks: the index is several times the vectors, and the driver needs none."""
    shared = spark.sparkContext.broadcast(model)

    def voted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(at + i, share) for at in pdf["id"].tolist() for i, share in enumerate(shared.value.left_out(at, at + TOGETHER))]
            yield pd.DataFrame(found, columns=["example", "share"])

    groups = spark.range(0, len(model.toxic), TOGETHER, CURVE_TASKS)
    rows = groups.mapInPandas(voted, "example long, share double").collect()  # a number for each example of the bounded sample
    shared.unpersist()
    return [r.share for r in sorted(rows)]


SCORED = "score double, nearest array<long>, nearest_cosine array<double>"
RESULTS = ("score", "predicted", "nearest", "nearest_cosine")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, ``predicted``, and as evidence the nearest examples and their cosines."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # the sample's words and vectors

    @F.pandas_udf(SCORED)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(shared.value.score(texts.tolist()), columns=["score", "nearest", "nearest_cosine"])

    kept = others(docs.columns, *RESULTS)
    (found,) = unused(docs.columns, "toxicity")
    value = F.col(f"{found}.score")
    return docs.select("*", scored(F.col("text")).alias(found)).select(
        *[F.col(quoted(c)) for c in kept],
        value.alias("score"),
        F.when(value >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
        F.col(f"{found}.nearest").alias("nearest"),
        F.col(f"{found}.nearest_cosine").alias("nearest_cosine"),
    )
