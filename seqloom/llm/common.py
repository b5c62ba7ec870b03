"""What the operators of this subpackage share: tables written in the shared folder, checked broadcasts, row numbers."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: \x20 and \x09 to \x0D. bytes.split() without arguments splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a side table may be broadcast; they are counted first.
BROADCAST_ROWS = 200_000
#: Bytes of its texts and binaries up to which it may be.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session of one machine gets a temporary one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: driver and executors share no folder")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seqloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Paths of the tables that saved() has written and nothing has deleted yet.
_WRITTEN: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_all() -> None:
    """When the driver's Python ends, lazy results can't be read any more: their tables go. A session that is stopped already leaves them."""
    for path, spark in list(_WRITTEN.items()):
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
    _WRITTEN.clear()


def saved(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqloom-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._seqloom_path = path
    return out


def drop_saved(*tables: DataFrame | None) -> None:
    """Deletes tables of saved() that no lazy plan reads any more."""
    for df in tables:
        path = getattr(df, "_seqloom_path", None)
        if path:
            _delete(df.sparkSession, path)
            _WRITTEN.pop(path, None)
            df._seqloom_path = None


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marks df for broadcast if it has at most so many rows and bytes of text and binary, counted first; else a shuffle join is left to Spark. df should be saved()."""
    heavy = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    n, *found = df.limit(rows + 1).agg(F.count(F.lit(1)), *heavy).first()
    return F.broadcast(df) if n <= rows and sum(found) <= size else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def with_row_number(df: DataFrame, name: str) -> DataFrame:
    """A number for each row, the same in each scan of the same files under the same settings: rows may repeat or lack an id."""
    return df.withColumn(name, F.monotonically_increasing_id())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
