"""Containers: targets coded against references, their scripts in checked blocks, a folder of files for each name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codec, delta


def write_container(targets: DataFrame, path: str, options: codec.Options = codec.Options()) -> None:
    """Codes each target (id, name, header, target, reference, reference_header) and writes its blocks below a folder of its name."""
    scripts = delta.encode_table(targets).select("id", F.encode("script", "utf-8").alias("data"))
    blocks = codec.compress_table(scripts, options).join(targets.select("id", "name"), "id")
    blocks.write.partitionBy("name").mode("errorifexists").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """id, block_no, offset, block, name. Blocks may lie in any order; each says where it belongs."""
    return spark.read.parquet(path)


def read_container(spark: SparkSession, path: str, references: DataFrame) -> DataFrame:
    """id, header, target of all that a container holds. references: id, reference, reference_header. Damaged blocks are errors."""
    scripts = codec.decompress_table(read_blocks(spark, path)).select("id", F.decode("data", "utf-8").alias("script"))
    return delta.decode_table(scripts.join(references, "id"))
