"""Training-data pipeline over documents: quality, near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import mixing, near_dedup, packing, quality
from seqloom.llm.common import shared_dir, table
from seqloom.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside the importance sample go; all columns of the rest stay.

    Null and empty texts are scored as empty; rows that tie with the last one of the sample stay; repeated rows are judged
    each for itself, with equal results; without labels all rows stay. Further columns, of any name, stay as they are.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that with the smallest id, of equal ids the first row, null ids last.

    Null and empty texts are one class. Further columns, of any name, stay as they are.
    """
    return near_dedup.keep_one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, are cut or go, so that sources come near their targets.

    Documents without words go, null texts among them; a null source is a source. Further columns, of any name, stay.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the packed sequences. A null text is empty, an empty one its end id alone; each row is a document. Further columns are ignored."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_classifier", quality_stage), ("minhash_near_dedup", dedup_stage), ("mix_to_weights", mixing_stage), ("packing", packing_stage)]

#: The models' sums and the order of hashes have no counterpart in SQL; tests/llm/test_pipeline.py holds run() against its stages by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; what lies between two stages is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
