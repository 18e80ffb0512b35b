"""The corpus pipeline: documents are filtered, deduplicated, mixed and packed.

Each stage works on all rows its predecessor kept; all but the last return the columns of
``documents``. The last returns the packed pieces: doc_id, piece, start, length, ids_crc32,
sequence_id, offset. A document that the mix takes twice is two rows from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from driftline.llm.common import written
from driftline.sources.tables import load_table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones, finds toxic go."""
    return toxicity.keep_mild(docs, toxicity.fit(docs, load_table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class (similarity 0.80 or more) the document with the smallest id stays."""
    return near_dedup.keep_one(docs, percent=80, trees=24)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the mix takes."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL can express neither the trained filter nor the seeded mix and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each is written as Parquet and reread as the next one's documents."""
    docs = load_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
