"""Alignment of two tokenizers over a corpus: which tokens end together, and how often each pair does.

Every text is encoded by a byte-level vocabulary (A, blank and text) and by a piece vocabulary (B, which
puts the blank itself). Token bytes are added up to end offsets; offsets where both have an end cut the text into
groups, and the two tokens that end there are a link. Nothing of this leaves the text's row.

A link's pair is one 64-bit key, A's id above B's. Each task counts its keys with ``np.unique``, folding
as it goes; the partial counts are range-partitioned by key, so all counts of a key lie side by side in one sorted partition,
and runs of equal keys are added up. Each partition is written to the shared folder as shards, arrays of keys and of counts, in order. For
the last pass a task maps into memory the shards that its keys fall in and finds counts by ``searchsorted``: pages are read as they are touched and
are shared by all tasks of a machine. The highest count of each B id is one number for an id, so no more than the vocabulary has.

A lost task writes its shards anew under new names; the manifest, a table that Spark commits, names those of tasks that ended well.
The rows of links and the manifest are stored, so no text is encoded twice.

Defined results: a null or empty text, and one whose tokens' bytes don't add up to blank and text, has no tokens: zeros and an empty
string; special tokens' strings are plain text; very long texts take time and memory in proportion; equal counts tie as highest; repeated rows count
each; an empty table gives an empty one; columns named as results are replaced, all others stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.batches import bounded_batches
from lumenfold.llm.columns import others, quoted, unused
from lumenfold.session import discard, shared_dir, stored

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how texts of this kind of vocabulary are split before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are encoded by the library that has no limit on runs of white space; ids are the same.
LONG = 200_000
#: Bytes of texts that are encoded and cut at a time; a longer text stands alone.
CHUNK_BYTES = 1 << 20
#: Keys that a task gathers before it folds them to counts.
FOLD = 1 << 21
#: Pairs of a shard: 64 MB.
SHARD_PAIRS = 1 << 22
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
_LOW = (1 << 32) - 1


class ByteVocabulary:
    """A byte-level vocabulary file with merges."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        model = json.loads(open(path, encoding="utf-8").read())["model"]
        # Bytes that are printed stand for themselves, the others for what follows 255 in order.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        vocab = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError(f"{path}: ids don't follow the order of merges")
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = token
        self._ranks = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=vocab, special_tokens={})
        self._file = Tokenizer.from_file(path)
        self._file.encode_special_tokens = True

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return [self._ranks.encode_ordinary(t) if len(t) < LONG else self._file.encode(t, add_special_tokens=False).ids for t in texts]


class PieceVocabulary:
    """A piece vocabulary file; a blank before the text is its own doing."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [
            bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())
        ]

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return self._model.encode(list(texts), num_threads=1)


@lru_cache(maxsize=4)
def vocabularies(a: str, b: str) -> tuple[ByteVocabulary, PieceVocabulary, Cutter]:
    """Read once a worker, from files that every machine has."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    first, second = ByteVocabulary(a), PieceVocabulary(b)
    return first, second, Cutter(first.bytes, second.bytes)


class Cutter:
    """Cuts encoded texts into groups; all texts of a chunk at a time."""

    def __init__(self, bytes_a: Sequence[bytes], bytes_b: Sequence[bytes]) -> None:
        self.bytes_a, self.bytes_b = bytes_a, bytes_b
        self.size_a, self.size_b = (np.array([len(x) for x in v], np.int64) for v in (bytes_a, bytes_b))
        # A token as it is written: first of a group or not, by A or by B.
        self.written = [sign + b"%d" % i for sign, v in ((b",", bytes_a), (b";", bytes_a), (b",", bytes_b), (b"|", bytes_b)) for i in range(len(v))]

    def cut(self, texts: Sequence[bytes], ids_a: Sequence[list[int]], ids_b: Sequence[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Per text: tokens of A, of B, groups, digest; and the keys of all links, in order of texts."""
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        whole = [b"".join(map(of_a, x)) == t and b"".join(map(of_b, y)) == t for t, x, y in zip(texts, ids_a, ids_b)]
        ids_a, ids_b = [x if w else [] for x, w in zip(ids_a, whole)], [y if w else [] for y, w in zip(ids_b, whole)]
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        if not len(a):
            return n_a, n_b, np.zeros(len(texts), np.int64), [""] * len(texts), np.zeros(0, np.int64)
        # Both vocabularies' bytes of a text add up to the same, so ends of all texts can be counted through.
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[at] == end_a)
        last_b = at[last_a]
        keys = a[last_a] << 32 | b[last_b]
        first_a, first_b = (np.concatenate(([0], last[:-1] + 1)) for last in (last_a, last_b))
        upto_a, upto_b = np.concatenate(([0], np.cumsum(n_a))), np.concatenate(([0], np.cumsum(n_b)))
        groups = np.searchsorted(last_a, upto_a)
        code_a, code_b = a.copy(), b + 2 * len(self.size_a)
        code_a[first_a] += len(self.size_a)
        code_b[first_b] += len(self.size_b)
        # A group's tokens of A, then those of B: each goes behind the other side's tokens up to there.
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(first_b, last_a - first_a + 1)] = code_a
        order[np.arange(len(b)) + np.repeat(last_a + 1, last_b - first_b + 1)] = code_b
        written, digests = self.written, []
        for low, high in zip(upto_a[:-1] + upto_b[:-1], upto_a[1:] + upto_b[1:]):
            joined = b"".join([written[c] for c in order[low:high].tolist()])
            digests.append(hashlib.sha256(joined[1:]).hexdigest() if joined else "")
        return n_a, n_b, np.diff(groups), digests, keys


def chunks(texts: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of CHUNK_BYTES together, or one text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t)
    if len(texts) > start:
        yield start, len(texts)


def linked(docs: DataFrame, a: str = BYTE_VOCABULARY, b: str = PIECE_VOCABULARY, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_a``, ``n_b``, ``n_groups``, ``groups_sha256`` and ``links``, the keys of a text's links in order."""
    bounded_batches(docs.sparkSession)
    results = ("n_a", "n_b", "n_groups", "groups_sha256", "links")
    (own,) = unused([*docs.columns, *results], "own_text")
    kept = [c for c in others(docs.columns, *results) if keep_text or c.lower() != text.lower()]
    rows = docs.select(*[F.col(quoted(c)) for c in kept], F.col(quoted(text)).alias(own))
    fields = [f for f in rows.schema.fields if f.name != own]
    added = [T.StructField(n, T.LongType()) for n in results[:3]] + [T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.ArrayType(T.LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, cutter = vocabularies(a, b)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            raw = [(" " + t).encode() if t else b"" for t in texts]
            for low, high in chunks(raw):
                plain = [t or "" for t in texts[low:high]]
                ids_a = [x if t else [] for t, x in zip(plain, first.encode([" " + t for t in plain]))]
                ids_b = [x if t else [] for t, x in zip(plain, second.encode(plain))]
                n_a, n_b, n_groups, digests, keys = cutter.cut(raw[low:high], ids_a, ids_b)
                offsets = np.concatenate(([0], np.cumsum(n_groups))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))
                columns = [*batch.slice(low, high - low).columns[:-1], pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(digests, pa.string()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *results])

    return rows.mapInArrow(run, T.StructType(fields + added))


def folded(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, and the sums of their counts."""
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys, kind="stable")
    return summed(all_keys[order], all_counts[order])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal keys added up."""
    if not len(keys):
        return keys, counts
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(counts, starts)


def partial_counts(links: DataFrame) -> DataFrame:
    """``pair`` and ``n`` of each task's own links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        bound = FOLD
        for batch in batches:
            k, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            keys.append(k)
            counts.append(n.astype(np.int64))
            held += len(k)
            if held >= bound:
                k, n = folded(keys, counts)
                keys, counts, held = [k], [n], len(k)
                if held > FOLD // 2:  # too many different ones: what is there goes on as it is
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["pair", "n"])
                    keys, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        k, n = folded(keys, counts)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["pair", "n"])

    return links.select("links").mapInArrow(run, "pair long, n long")


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """A folder's file system and path; local ones are those that memory can be mapped from."""
    if urlparse(folder).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(folder).path
    return pafs.FileSystem.from_uri(folder)


def count_shards(links: DataFrame, shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """The manifest of counts: ``shard`` (a file in the shared folder), ``first`` and ``last`` key, ``pairs``, and the highest count of each B id in it.

    Keys of all shards are disjoint ranges. Stored, so that only shards of tasks that ended well are named.
    """
    spark = links.sparkSession
    folder = f"{shared_dir(spark)}/pair-counts-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _store(folder)
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def flush(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            name = f"{root}/{uuid.uuid4().hex}.npy"
            files.create_dir(root, recursive=True)
            with files.open_output_stream(name) as out:
                np.lib.format.write_array_header_1_0(out, {"descr": "<i8", "fortran_order": False, "shape": (2, len(k))})
                out.write(k.tobytes())
                out.write(n.tobytes())
            ids = k & _LOW
            order = np.lexsort((n, ids))
            ends = np.flatnonzero(np.concatenate((ids[order][1:] != ids[order][:-1], [True])))
            highest = [{"id": int(i), "n": int(c)} for i, c in zip(ids[order][ends], n[order][ends])]
            kind = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))
            row = [pa.array([name]), pa.array([int(k[0])]), pa.array([int(k[-1])]), pa.array([len(k)]), pa.array([highest], kind)]
            return pa.RecordBatch.from_arrays(row, names=["shard", "first", "last", "pairs", "highest"])

        for batch in batches:
            k, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            keys.append(k)
            counts.append(n)
            if sum(map(len, keys)) > shard_pairs:
                k, n = summed(np.concatenate(keys), np.concatenate(counts))
                while len(k) > shard_pairs:  # the last key may go on
                    yield flush(k[:shard_pairs], n[:shard_pairs])
                    k, n = k[shard_pairs:], n[shard_pairs:]
                keys, counts = [k], [n]
        k, n = summed(np.concatenate(keys), np.concatenate(counts))
        if len(k):
            yield flush(k, n)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = partial_counts(links).repartitionByRange(parts, "pair").sortWithinPartitions("pair")
    schema = "shard string, first long, last long, pairs long, highest array<struct<id: long, n: long>>"
    return stored(dealt.mapInArrow(write, schema))


def pair_table(manifest: DataFrame) -> DataFrame:
    """The alignment itself: ``id_a``, ``id_b``, ``n``, and whether that is the B id's highest count."""
    folder_of = manifest.sparkSession
    best = manifest.select(F.explode("highest").alias("h")).groupBy(F.col("h.id").alias("id")).agg(F.max("h.n").alias("best"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                k, n = open_shard(name)
                for low in range(0, len(k), 1 << 16):
                    part, c = np.array(k[low : low + (1 << 16)]), np.array(n[low : low + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array(part >> 32), pa.array(part & _LOW), pa.array(c)], names=["id_a", "id_b", "n"])

    parts = int(folder_of.conf.get("spark.sql.shuffle.partitions"))
    rows = manifest.select("shard").repartition(parts, "shard").mapInArrow(read, "id_a long, id_b long, n long")
    # A number for each id of the vocabulary at most.
    return rows.join(F.broadcast(best), F.col("id_b") == F.col("id")).select("id_a", "id_b", "n", (F.col("n") == F.col("best")).alias("is_best"))


def open_shard(name: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a shard, mapped into memory where the store has files of its own."""
    files, path = _store(name)
    if isinstance(files, pafs.LocalFileSystem):
        both = np.load(path, mmap_mode="r")
    else:
        with files.open_input_stream(path) as stream:
            both = np.load(io.BytesIO(stream.read()))
    return both[0], both[1]


class Counts:
    """Looks up counts in shards, which are opened when a key falls in them."""

    def __init__(self, shards: Sequence[tuple[str, int, int]]) -> None:
        self.names = [s[0] for s in shards]
        self.last = np.array([s[2] for s in shards], np.int64)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of keys that are in order; all of them are in some shard."""
        found = np.zeros(len(keys), np.int64)
        shard = np.searchsorted(self.last, keys)
        cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(keys) else np.zeros(0, np.int64)
        for low, high in zip(cuts[:-1], cuts[1:]):
            i = int(shard[low])
            if i not in self.open:
                self.open[i] = open_shard(self.names[i])
            k, n = self.open[i]
            found[low:high] = n[np.searchsorted(k, keys[low:high])]
        return found


def with_counts(links: DataFrame, manifest: DataFrame) -> DataFrame:
    """``links`` rows with ``n_links``, ``n_best`` and ``count_sum`` in place of the links."""
    spark = links.sparkSession
    shards = [tuple(r) for r in manifest.select("shard", "first", "last").orderBy("first").collect()]  # a row for SHARD_PAIRS pairs
    best = manifest.select(F.explode("highest").alias("h")).groupBy("h.id").agg(F.max("h.n").alias("n")).collect()  # a row for an id of B at most
    highest = np.zeros(max((r.id for r in best), default=-1) + 1, np.int64)
    for r in best:
        highest[r.id] = r.n
    sent = spark.sparkContext.broadcast((shards, highest))
    fields = [f for f in links.schema.fields if f.name != "links"]
    added = [T.StructField(n, T.LongType()) for n in ("n_links", "n_best", "count_sum")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, most = sent.value
        counts = Counts(table)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            keys = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            distinct, where = np.unique(keys, return_inverse=True)
            n = counts.of(distinct)
            best = (n == most[distinct & _LOW])[where] if len(keys) else np.zeros(0, bool)
            sums, bests = (np.concatenate(([0], np.cumsum(x.astype(np.int64)))) for x in (n[where] if len(keys) else keys, best))
            columns = [*batch.columns[:-1], *(pa.array(np.diff(x[upto]) if x is not None else np.diff(upto)) for x in (None, bests, sums))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_links", "n_best", "count_sum"])

    return links.select(*[F.col(quoted(f.name)) for f in fields], "links").mapInArrow(run, T.StructType(fields + added))


def drop_shards(manifest: DataFrame) -> None:
    """Delete the files of a manifest that nothing reads any more, and the manifest."""
    row = manifest.select("shard").first()
    if row is not None:
        files, path = _store(os.path.dirname(row.shard))
        files.delete_dir(path)
    discard(manifest)


def align(docs: DataFrame, a: str = BYTE_VOCABULARY, b: str = PIECE_VOCABULARY, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with RESULTS: tokens, groups and links of each text, and how common its links are in all of ``docs``."""
    links = stored(linked(docs, a, b, text, keep_text), "zstd")
    manifest = count_shards(links)
    found = stored(with_counts(links, manifest))
    drop_shards(manifest)
    discard(links)
    return found
