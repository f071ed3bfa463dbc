"""Full text: an inverted index, a query language, and bm25.

Terms are lower-cased runs of letters and digits without accents. Queries: words side by
side must all be there; OR, NOT, "a phrase", begin*, and parentheses.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.session import checkpointed

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def _accents() -> tuple[str, str]:
    """Lower-case letters with accents that one character stands for, and their plain letters."""
    pairs = []
    for code in range(0xC0, 0x250):
        c = chr(code).lower()
        plain = unicodedata.normalize("NFD", c)[0]
        if len(c) == 1 and plain != c and plain.isalpha():
            pairs.append((c, plain))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


FROM, TO = _accents()


def plain(text: str) -> str:
    return text.lower().translate(str.maketrans(FROM, TO))


def terms(text: Column) -> Column:
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), FROM, TO)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: t != "")


@dataclass(frozen=True)
class Index:
    """``postings`` (term, file_id, n_terms, tf, positions), ``lengths`` (file_id, n_terms).

    A stored index also has its documents and their mean length, and says by ``holding`` where the terms of a query are.
    """

    postings: DataFrame
    lengths: DataFrame
    totals: tuple[int, float | None] | None = None
    holding: Callable[[Node], Column] | None = None


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's terms with their positions: they are together already, so nothing is sent before it is put together."""
    for batch in batches:
        ids, words = batch.column(0), batch.column(1)
        size = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        if not size.sum():
            continue
        coded = words.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        key = doc * len(coded.dictionary) + code
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        ends = np.append(first, len(key))
        doc, code = doc[order[first]], code[order[first]]
        positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[order], pa.int32()))
        columns = [coded.dictionary.take(pa.array(code)), ids.take(pa.array(doc)), pa.array(size[doc]), pa.array(np.diff(ends)), positions]
        yield pa.RecordBatch.from_arrays(columns, ["term", "file_id", "n_terms", "tf", "positions"])


def build(texts: DataFrame, id_col: str = "file_id") -> Index:
    """Documents without a term are not in the index; ``texts`` has a row a document."""
    words = texts.select(F.col(id_col).cast("long").alias("file_id"), terms(F.col("text")).alias("t")).where(F.size("t") > 0)
    postings = words.mapInArrow(_postings, "term string, file_id long, n_terms long, tf long, positions array<int>")
    return Index(postings, words.select("file_id", F.size("t").cast("bigint").alias("n_terms")))


@dataclass(frozen=True)
class Node:
    """A query's part: kind word, prefix, phrase, and, or, not."""

    kind: str
    value: str = ""
    parts: tuple = ()


class BadQuery(ValueError):
    """What is no query."""


_LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")(\s*\*)?|(\()|(\))|([^\s()"*]+)(\*)?|(\S))')


def parse(query: str) -> Node:
    tokens, at = [], 0
    query = query.strip()
    while at < len(query):
        m = _LEX.match(query, at)
        if m is None or m[7]:
            raise BadQuery(query)
        at = m.end()
        if m[1]:
            words = [w for w in re.split(r"[^\w]+|_", plain(m[1][1:-1])) if w]
            tokens.append(Node("phrase", parts=tuple(words)) if len(words) != 1 else Node("prefix" if m[2] else "word", words[0]))
        elif m[3] or m[4]:
            tokens.append(m[3] or m[4])
        elif m[5] in ("AND", "OR", "NOT") and not m[6]:
            tokens.append(m[5])
        else:
            words = [w for w in re.split(r"[^\w]+|_", plain(m[5])) if w]
            if len(words) != 1 or re.search(r"[^\w]", m[5]):
                raise BadQuery(query)
            tokens.append(Node("prefix" if m[6] else "word", words[0]))
    pos = 0

    def peek():
        return tokens[pos] if pos < len(tokens) else None

    def either() -> Node:
        nonlocal pos
        parts = [both()]
        while peek() == "OR":
            pos += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", parts=tuple(parts))

    def both() -> Node:
        nonlocal pos
        parts = [without()]
        while peek() == "AND" or isinstance(peek(), Node) or peek() == "(":
            pos += peek() == "AND"
            parts.append(without())
        return parts[0] if len(parts) == 1 else Node("and", parts=tuple(parts))

    def without() -> Node:
        nonlocal pos
        left = unit()
        while peek() == "NOT":
            pos += 1
            left = Node("not", parts=(left, unit()))
        return left

    def unit() -> Node:
        nonlocal pos
        token = peek()
        pos += 1
        if token == "(":
            inner = either()
            if peek() != ")":
                raise BadQuery(query)
            pos += 1
            return inner
        if isinstance(token, Node):
            return token
        raise BadQuery(query)

    tree = either()
    if pos != len(tokens):
        raise BadQuery(query)
    return tree


def _leaves(node: Node) -> list[Node]:
    if node.kind in ("word", "prefix", "phrase"):
        return [node]
    parts = node.parts[:1] if node.kind == "not" else node.parts
    return [leaf for p in parts for leaf in _leaves(p)]


def _every_leaf(node: Node) -> list[Node]:
    """The excluded ones too."""
    return [leaf for p in node.parts for leaf in _every_leaf(p)] if node.kind in ("and", "or", "not") else [node]


def _any_word(node: Node) -> Column:
    """Terms that any part of a query reads, the excluded ones too."""
    if node.kind == "word":
        return F.col("term") == node.value
    if node.kind == "prefix":
        return F.col("term").startswith(node.value)
    if node.kind == "phrase":
        return F.col("term").isin(list(node.parts))
    return reduce(lambda a, b: a | b, [_any_word(p) for p in node.parts])


def matching(index: Index, tree: Node) -> DataFrame:
    """Postings of a query's words."""
    rows = index.postings.where(_any_word(tree))
    return rows.where(index.holding(tree)) if index.holding else rows


def _leaf_rows(index: Index, node: Node) -> DataFrame:
    """``file_id`` and ``tf`` of a word, a beginning or a phrase."""
    p = index.postings
    if node.kind == "word":
        return p.where(F.col("term") == node.value).select("file_id", "tf")
    if node.kind == "prefix":
        return p.where(F.col("term").startswith(node.value)).groupBy("file_id").agg(F.sum("tf").alias("tf"))
    if not node.parts:
        return p.where("false").select("file_id", "tf")
    # Each word's positions, moved back by its place in the phrase, must meet.
    starts = [
        p.where(F.col("term") == w).select("file_id", F.expr(f"transform(positions, x -> x - {i})").alias(f"s{i}")) for i, w in enumerate(node.parts)
    ]
    joined = reduce(lambda a, b: a.join(b, "file_id"), starts)
    meet = reduce(F.array_intersect, [F.col(f"s{i}") for i in range(len(starts))])
    return joined.select("file_id", F.size(meet).cast("bigint").alias("tf")).where("tf > 0")


def _ids(index: Index, node: Node) -> DataFrame:
    if node.kind in ("word", "prefix", "phrase"):
        return _leaf_rows(index, node).select("file_id")
    parts = [_ids(index, p) for p in node.parts]
    if node.kind == "and":
        return reduce(lambda a, b: a.join(b, "file_id", "left_semi"), parts)
    if node.kind == "or":
        return reduce(DataFrame.unionByName, parts).distinct()
    return parts[0].join(parts[1], "file_id", "left_anti")


def search(index: Index, query: str) -> DataFrame:
    """``file_id`` and ``rank``, a negative number, the least for the best. What is no query finds nothing."""
    try:
        tree = parse(query)
    except BadQuery:
        return index.lengths.where("false").select("file_id", F.lit(0.0).alias("rank"))
    n, mean = index.totals or index.lengths.agg(F.count(F.lit(1)), F.avg("n_terms")).first()
    # The postings of the query's words alone, made once.
    rows = matching(index, tree)
    found = checkpointed(rows if any(leaf.kind == "phrase" for leaf in _every_leaf(tree)) else rows.drop("positions"))
    index, lengths = Index(found, index.lengths), found.select("file_id", "n_terms").distinct()
    leaves = [_leaf_rows(index, leaf).select("file_id", "tf", F.lit(i).alias("leaf")) for i, leaf in enumerate(dict.fromkeys(_leaves(tree)))]
    rows = reduce(DataFrame.unionByName, leaves)
    # One row for each part of the query.
    idf = F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    weights = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("df")).select("leaf", idf.alias("idf"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_terms") / F.lit(mean or 1.0)))
    scored = rows.join(F.broadcast(weights), "leaf").join(lengths, "file_id").select("file_id", (-F.col("idf") * weight).alias("s"))
    total = scored.groupBy("file_id").agg(F.sum("s").alias("rank"))
    return total.join(_ids(index, tree), "file_id", "left_semi")
