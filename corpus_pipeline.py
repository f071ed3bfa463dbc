"""The corpus pipeline: documents are filtered, deduplicated, mixed and encoded.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on; each result
is written as Parquet in the folder that executors share, and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import linededup, mixing, pieces, simhash, toxicity
from lumenfold.session import discard, stored

MIX_SEED = 17


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the model learns from the labels beside ``docs``.

    Null and empty texts score as all examples' votes say, and stay unless most are toxic; repeated rows fare alike; without labels
    all stay; an empty table stays empty; extra columns stay whatever their names.
    """
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of passages.

    A null text stays null; what is all repeated becomes empty, and its row stays; rows of equal doc_id and text are one document; a null doc_id
    comes first; an empty table stays empty; extra columns stay whatever their names.
    """
    return linededup.dedup_lines(docs).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id, a null one last, then the smallest hash of its text.

    Texts without words, null ones too, are one group; of repeated rows one stays; an empty table stays empty; extra columns stay whatever their names.
    """
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources weigh the same, shuffled.

    A null source is a source; rows of equal doc_id are drawn alike; null texts stay null; an empty table stays empty; extra columns stay whatever their names.
    """
    return mixing.poisson_mix(docs, seed=MIX_SEED).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as piece ids, with their next best segmentations.

    Null and empty texts have no pieces; very long parts take time in proportion; repeated rows encode alike; an empty table stays empty; columns
    named as results are replaced, others stay.
    """
    return pieces.encode(docs, pieces.Vocabulary.load())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mixing", mix),
    ("pieces", encode),
]

#: SQL can express neither the fitted scores nor the components of fingerprints.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs
