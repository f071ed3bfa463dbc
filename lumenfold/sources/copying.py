"""Carrying out a plan of copies, on volumes that all executors mount.

Each file is written beside its target under another name, its bytes are compared by hash,
and one rename puts it in place. A target with the right bytes is left as it is, so a plan can be
run again after any crash, and a task that runs twice does no harm.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

CHUNK = 1 << 16
RESULT = "id long, target string, status string, bytes long"


def sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def copy_one(source: str, target: str) -> tuple[str, int]:
    """Status and size: copied, there (already), or what went wrong."""
    try:
        want = sha256(source)
        if os.path.exists(target):
            return ("there" if sha256(target) == want else "other bytes at target"), os.path.getsize(target)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        part = f"{target}.{uuid.uuid4().hex}.part"
        try:
            shutil.copy2(source, part)
            if sha256(part) != want:
                return "bytes differ after copy", 0
            os.replace(part, target)
        finally:
            if os.path.exists(part):
                os.remove(part)
        return "copied", os.path.getsize(target)
    except OSError as failure:
        return f"failed: {failure.strerror}", 0


def carry_out(plan: DataFrame) -> DataFrame:
    """``plan`` (id, path, target) done: one row a file. Call an action once, or store it: each run copies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, t, *copy_one(s, t)) for i, s, t in zip(pdf["id"], pdf["path"], pdf["target"], strict=True)]
            yield pd.DataFrame(rows, columns=["id", "target", "status", "bytes"])

    return plan.select("id", "path", "target").mapInPandas(run, RESULT)
