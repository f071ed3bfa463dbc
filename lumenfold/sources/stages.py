"""Stages that make rows of media: a queue, a function over batches, an output table, a flag.

Models come from outside: anything with the right signature. The fakes here are functions of
a file's hash, so that tests need no model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold import predicates as P
from lumenfold.operators.transitions import replace_by_key, set_flag

#: Pictures that a model sees at a time.
BATCH = 8


@dataclass(frozen=True)
class Stage:
    """``needs``: files to do. ``run``: rows of a file (id, path, content_hash) to output rows and an error text."""

    name: str
    table: str
    flag: str
    needs: Callable[[], Column]
    schema: str
    run: Callable[[pd.DataFrame], list[list[tuple]]]
    key: str = "file_id"
    columns: tuple[str, ...] = ("id", "path", "content_hash")


def outputs(stage: Stage, files: DataFrame) -> DataFrame:
    """Rows that the stage makes of its queue, and a row with an ``error`` for each file that it can't do.

    A batch that fails is done again file by file, so that one bad file costs no other.
    """
    names = [stage.key, *[x.split()[0] for x in stage.schema.split(", ")], "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for at in range(0, len(pdf), BATCH):
                some = pdf.iloc[at : at + BATCH]
                try:
                    made = [(r, None) for r in stage.run(some)]
                    if len(made) != len(some):
                        raise ValueError(f"{len(made)} results for {len(some)} files")
                except Exception:
                    made = []
                    for i in range(len(some)):
                        try:
                            (one,) = stage.run(some.iloc[i : i + 1])
                            made.append((one, None))
                        except Exception as failure:
                            made.append(([], str(failure).replace("\n", " ")[:500]))
                for file_id, (found, error) in zip(some["id"], made, strict=True):
                    rows += [(file_id, *r, None) for r in found] or [(file_id, *[None] * (len(names) - 2), error or "")]
            yield pd.DataFrame(rows, columns=names)

    todo = files.where(stage.needs()).select(*stage.columns)
    return todo.mapInPandas(run, f"{stage.key} long, {stage.schema}, error string")


def apply(stage: Stage, files: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New snapshots of files and of the stage's table. Running it again changes nothing.

    The joins hash the ids of what was done and let all other rows pass: these shrink to a fraction in a shuffle, so that sorting them would take
    a task many times what it reads, and a broadcast guessed from the stored file's size many times that.
    """
    from lumenfold.session import stored

    made = stored(outputs(stage, files))
    done = made.select(F.col(stage.key).alias("id"), F.nullif("error", F.lit("")).alias("error")).distinct()
    fields = [x.split()[0] for x in stage.schema.split(", ")]
    rows = made.where("error is null").select(stage.key, *fields)
    flagged = set_flag(files, done.where("error is null").select("id"), stage.flag, hint="shuffle_hash")
    failed = done.where("error is not null").select(F.col("id").alias("e_id"), F.col("error").alias("e_text"))
    joined = flagged.join(failed.hint("shuffle_hash"), F.col("id") == F.col("e_id"), "left")
    joined = joined.withColumn("decode_failed", F.when(F.col("e_id").isNotNull(), 1).otherwise(F.col("decode_failed")))
    joined = joined.withColumn("decode_error", F.coalesce("e_text", "decode_error")).select(*files.columns)
    return joined, replace_by_key(table, rows, stage.key, done.select(F.col("id").alias(stage.key)), hint="shuffle_hash")


def _bytes(content_hash: str) -> bytes:
    """The hash's bytes; of what is no hash in hex, those of its SHA-256."""
    try:
        raw = bytes.fromhex(content_hash)
    except ValueError:
        raw = b""
    return raw if len(raw) >= 32 else hashlib.sha256(content_hash.encode()).digest()


def fake_detector(files: pd.DataFrame) -> list[list[tuple]]:
    """Label, confidence, box: up to three for each file, six of the hash's bytes each."""
    out = []
    for raw in map(_bytes, files["content_hash"]):
        some = [raw[1 + 6 * i : 7 + 6 * i] for i in range(raw[0] % 4)]
        out.append([(f"label{b[0] % 20}", b[1] / 256, b[2] / 256, b[3] / 256, b[4] / 512, b[5] / 512) for b in some])
    return out


def fake_embedder(files: pd.DataFrame) -> list[list[tuple]]:
    """A unit vector along the hash's first 32 bytes."""
    out = []
    for raw in map(_bytes, files["content_hash"]):
        v = (np.frombuffer(raw[:32], np.uint8) - 127.5) / 128
        out.append([((v / np.linalg.norm(v)).astype(np.float32).tolist(),)])
    return out


def fake_reader(files: pd.DataFrame) -> list[list[tuple]]:
    """Text in a picture: its hash's words."""
    return [[(" ".join(h[i : i + 8] for i in range(0, len(h), 8)),)] for h in files["content_hash"]]


def _open(flag: str) -> Callable[[], Column]:
    return lambda: P.work_queue([flag])


DETECT = Stage("detect", "detections", "yolo_done", _open("yolo"), "label string, conf double, x double, y double, w double, h double", fake_detector)
EMBED = Stage("embed", "vec_clip", "clip_done", _open("clip"), "embedding array<float>", fake_embedder, key="id_")
READ = Stage("read", "ocr_text", "ocr_done", P.ocr_queue, "text string", fake_reader)
