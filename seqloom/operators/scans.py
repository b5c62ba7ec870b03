"""Order-dependent operators over a whole table: global row numbers and running aggregates in two levels.

A window without PARTITION BY puts all rows into one task. Here rows are sorted into ranges, each range is scanned for
itself, and one row a range carries its total to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOCAL = (1 << 33) - 1


def ordered(df: DataFrame, *order: Column | str, ranges: int | None = None) -> DataFrame:
    """df sorted by order, with _part (range) and _pos (place in it). Kept, so that later passes see the same ranges."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return out.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(LOCAL))).persist(StorageLevel.MEMORY_AND_DISK)


def carried(kept: DataFrame, agg: Column, over: Column) -> DataFrame:
    """_p, _carry: the aggregate of all ranges before each range; a row a range."""
    parts = kept.groupBy("_part").agg(agg.alias("_v"))
    return parts.select(F.col("_part").alias("_p"), over.over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))


def global_index(df: DataFrame, *order: Column | str, name: str = "idx") -> DataFrame:
    """Adds each row's place, from 0, in the total order."""
    kept = ordered(df, *order)
    base = carried(kept, F.count(F.lit(1)), F.sum("_v"))
    return kept.join(F.broadcast(base), F.col("_part") == F.col("_p")).withColumn(name, F.col("_pos") + F.coalesce("_carry", F.lit(0))).drop("_part", "_pos", "_p", "_carry")


def running(df: DataFrame, order: list[Column | str], value: str, kind: str, name: str, exclusive: bool = False) -> DataFrame:
    """Adds the running sum, max or min of value in the total order; exclusive leaves out the row's own (the first has 0 for sum, null else)."""
    kept = ordered(df, *order)
    f = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
    base = carried(kept, f(value), f("_v"))
    w = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}[kind]
    here = kept.withColumn("_own", f(value).over(w))
    return here.join(F.broadcast(base), F.col("_part") == F.col("_p")).withColumn(name, both(F.col("_own"), F.col("_carry"))).drop("_part", "_pos", "_p", "_carry", "_own")


def segment_places(df: DataFrame, by: list[str], order: list[str], name: str = "place", ties: bool = False) -> DataFrame:
    """Adds each row's place in its segment, from 1, in the order given; ties: equal rows share the first one's place (competition rank).

    One sort by segment and order; a segment spreads over as many ranges as its rows fill, so few large segments don't
    make few tasks. Each segment's first place is one row, joined back.
    """
    indexed = global_index(df, *by, *order, name="_idx")
    first = indexed.groupBy(*by).agg(F.min("_idx").alias("_first")).select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_first") if by else None
    if ties:
        equal = indexed.groupBy(*by, *order).agg(F.min("_idx").alias("_at")).select(*[F.col(c).alias(f"_eq{i}") for i, c in enumerate([*by, *order])], "_at")
        same = [F.col(c).eqNullSafe(F.col(f"_eq{i}")) for i, c in enumerate([*by, *order])]
        indexed = indexed.join(equal, same).drop(*[f"_eq{i}" for i in range(len(by) + len(order))])
    else:
        indexed = indexed.withColumn("_at", F.col("_idx"))
    if first is None:
        return indexed.withColumn(name, F.col("_at") + 1).drop("_idx", "_at")
    out = indexed.join(first, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)])
    return out.withColumn(name, F.col("_at") - F.col("_first") + 1).drop("_idx", "_at", "_first", *[f"_by{i}" for i in range(len(by))])


def folded(df: DataFrame, order: list[Column | str], value: str, op: Callable, name: str, init=None, exclusive: bool = False) -> DataFrame:
    """Adds the running fold of value by any associative op(a, b), in the total order; it need not commute. Nulls are skipped.

    init, if given, stands before the first row, so that an exclusive scan has it there (null without). The ranges' totals,
    one a range, are folded on the driver and sent back; op runs over arrays of Python values.
    """
    kept = ordered(df, *order)
    kind = df.schema[value].dataType.simpleString()

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, part = None, None
        for b in batches:
            for p, v in zip(b["_part"], b[value], strict=True):
                part = int(p)
                if v is not None and v == v:
                    t = v if t is None else op(t, v)
        if part is not None:
            yield pd.DataFrame({"_part": [part], "_v": pd.Series([t], dtype=object)})

    sums = {r["_part"]: r["_v"] for r in kept.select("_part", value).mapInPandas(total, f"_part int, _v {kind}").collect()}
    before, t = {}, init
    for p in sorted(sums):
        before[p] = t
        if sums[p] is not None:
            t = sums[p] if t is None else op(t, sums[p])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, first = None, True
        for b in batches:
            out = []
            for p, v in zip(b["_part"], b[value], strict=True):
                if first:
                    t, first = before[int(p)], False
                if exclusive:
                    out.append(t)
                if v is not None and v == v:
                    t = v if t is None else op(t, v)
                if not exclusive:
                    out.append(t)
            yield pd.DataFrame({"_p": b["_part"], "_q": b["_pos"], name: pd.Series(out, dtype=object)})

    done = kept.select("_part", "_pos", value).mapInPandas(scan, f"_p int, _q long, {name} {kind}")
    return kept.join(done, (F.col("_part") == F.col("_p")) & (F.col("_pos") == F.col("_q"))).drop("_part", "_pos", "_p", "_q")


def run_ids(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "run_no") -> DataFrame:
    """Numbers runs of equal consecutive values, from 1, inside each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    start = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return df.withColumn("_start", start).withColumn(name, F.sum("_start").over(w)).drop("_start")
