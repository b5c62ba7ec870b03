"""FASTA files: records in, sequences and scripts out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def read_fasta(spark: SparkSession, path: str | list[str], marker: str = ">") -> DataFrame:
    """header (without its marker), seq (letters, case kept) of each record; comment lines that begin with ; are skipped.

    Records are split where a line begins with the marker, so one file is read by many tasks and only a single record has
    to fit in one. What stands before the first marker is no record. Files end lines with \\n or \\r\\n.
    """
    rows = spark.read.option("lineSep", f"\n{marker}").text(path).select(F.regexp_replace("value", "\r", "").alias("value"), F.col("_metadata.file_block_start").alias("at"))
    # the first record of a file still has its marker; without one, the file's head is no record
    body = F.when(F.col("value").startswith(marker), F.substring("value", len(marker) + 1, 2**31 - 1)).otherwise(F.col("value"))
    head_only = (F.col("at") == 0) & F.col("value").startswith(";") & ~F.col("value").startswith(marker)
    lines = F.split(body, "\n")
    seq = F.array_join(F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: ~x.startswith(";")), "")
    return rows.where((F.length("value") > 0) & ~head_only).select(F.get(lines, F.lit(0)).alias("header"), T.letters(seq).alias("seq"))


def fasta_text(header: Column, seq: Column, marker: str = ">", width: int = 60) -> Column:
    """One record as text, lines of width letters."""
    return F.concat(F.lit(marker), header, F.lit("\n"), T.wrap(seq, width))


def write_fasta(df: DataFrame, path: str, header: str = "header", seq: str = "seq", marker: str = ">", width: int = 60) -> None:
    """Writes a file for each partition; a null header is empty, a null seq has no lines."""
    df.select(fasta_text(F.coalesce(F.col(header), F.lit("")), F.coalesce(F.col(seq), F.lit("")), marker, width)).write.mode("errorifexists").text(path)


def write_scripts(df: DataFrame, path: str, name: str = "name", script: str = "script") -> None:
    """Writes each script below a folder of its name, lines in order."""
    df.select(F.col(name), F.col(script)).write.partitionBy(name).mode("errorifexists").text(path)


def read_scripts(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """name, script of what write_scripts wrote: a whole file is a script."""
    return spark.read.text(path, wholetext=True).select(name, F.regexp_replace("value", "\n$", "").alias("script"))


def write_distances(df: DataFrame, path: str, taxon: str = "taxon", distances: str = "distances") -> None:
    """Lines of a distance matrix: the taxon in ten characters, then the distances with eight digits."""
    digits = F.array_join(F.transform(F.col(distances), lambda x: F.format_string("%.8f", x)), " ")
    df.select(F.concat(F.rpad(taxon, 10, " "), F.lit(" "), digits)).write.mode("errorifexists").text(path)
