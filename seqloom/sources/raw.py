"""Raw bytes in, arrays out and in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def padded(data: Column, multiple: int) -> Column:
    """Bytes with zeros behind them up to the next multiple of a length."""
    missing = F.pmod(-F.octet_length(data), F.lit(multiple))
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), missing)))


def read_padded(spark: SparkSession, path: str | list[str], multiple: int = 8) -> DataFrame:
    """path, length, data of whole files, data padded with zeros to a multiple of a length. A file has to fit into a task; an empty one has no row."""
    return spark.read.format("binaryFile").load(path).select("path", "length", padded(F.col("content"), multiple).alias("data"))


def write_array(df: DataFrame, path: str, place: str, value: str) -> None:
    """Writes an array, a row for each place, as files in the order of the places."""
    df.select(place, value).repartitionByRange(place).sortWithinPartitions(place).write.mode("errorifexists").parquet(path)


def read_array(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
