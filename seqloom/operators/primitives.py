"""Array and relational primitives as DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def partition_order(df: DataFrame, selected: Column, *order: Column | str) -> DataFrame:
    """Places selected rows first in their order, rejected ones after them in reverse: adds place, from 0. One sort; rows and selected rows are counted in the same pass."""
    from .scans import ordered

    kept = ordered(df.withColumn("_sel", selected.cast("int")), *order)
    parts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("_sel").alias("_s"))
    w, everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    base = parts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"), F.sum("_n").over(everything).alias("_all"))
    own = F.coalesce(F.sum("_sel").over(Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = kept.withColumn("_own", own).join(F.broadcast(base), F.col("_part") == F.col("_p"))
    before = F.col("_before") + F.col("_own")
    place = F.when(F.col("_sel") == 1, before).otherwise(F.col("_all") - 1 - (F.col("_rows") + F.col("_pos") - before))
    return out.withColumn("place", place).drop("_sel", "_part", "_pos", "_p", "_rows", "_before", "_all", "_own")


def buckets(df: DataFrame, bucket: Column) -> DataFrame:
    """bucket, n, begin: rows of each bucket and how many lie in buckets before it."""
    n = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("begin", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))


def histogram_even(df: DataFrame, value: Column, bins: int, lo: float, hi: float) -> DataFrame:
    """bin, n of all bins, empty ones too; values outside [lo, hi) are dropped."""
    b = F.floor((value - lo) / ((hi - lo) / bins)).cast("int")
    got = df.where((value >= lo) & (value < hi)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_range(df: DataFrame, value: Column, levels: list[float]) -> DataFrame:
    """bin, n: counts between neighbouring levels, lower bound included; one expression, no join."""
    b = F.lit(None).cast("int")
    for i in range(len(levels) - 2, -1, -1):
        b = F.when((value >= levels[i]) & (value < levels[i + 1]), i).otherwise(b)
    got = df.select(b.alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(len(levels) - 1).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def arg_first(value: str, idx: list[str], largest: bool) -> Column:
    """struct of the first row's idx and value among those with the least or largest value."""
    key = F.struct((-F.col(value) if largest else F.col(value)).alias("k"), *idx)
    return F.min(key)


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, name: str) -> DataFrame:
    """Each left row with the last right value at or before it in its group: one union and one window, no range join."""
    l = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))  # noqa: E741
    r = right.select(*by, at, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return l.unionByName(r, allowMissingColumns=True).withColumn(name, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


def spmv(matrix: DataFrame, vector: DataFrame, row: str, col: str, val: Column, x: Column) -> DataFrame:
    """y = A x for non-zeros (row, col, val) and a vector (col, x)."""
    return matrix.join(vector, col).groupBy(row).agg(F.sum(val * x).alias("y"))


def range_minima(values: DataFrame, queries: DataFrame, n: int, fan: int = 6) -> DataFrame:
    """q, i, j, place, value: the leftmost minimum of places i to j, both included, of values (idx, value); nulls are passed over.

    A tree of minima, 2^fan children a node: a query takes at most 2 * 2^fan nodes of each level, whatever its length.
    """
    level = values.where("value IS NOT NULL").select(F.col("idx").alias("node"), F.struct("value", F.col("idx").alias("place")).alias("best"))
    todo, found = queries.select("q", F.col("i").alias("lo"), F.col("j").alias("hi")), []
    while True:
        up = lambda c: F.shiftright(c, fan)
        ends_at, begins_at = F.shiftleft(up("lo") + 1, fan) - 1, F.shiftleft(up("hi"), fan)
        inside = up("lo") == up("hi")
        left = F.sequence("lo", F.when(inside, F.col("hi")).otherwise(ends_at))
        right = F.when(~inside, F.sequence(begins_at, F.col("hi"))).otherwise(F.array().cast("array<bigint>"))
        found.append(todo.select("q", F.explode(F.concat(left, right)).alias("node")).join(level, "node").select("q", "best"))
        n = (n - 1 >> fan) + 1
        if n <= 1:
            break
        todo = todo.where(up("lo") + 1 <= up("hi") - 1).select("q", (up("lo") + 1).alias("lo"), (up("hi") - 1).alias("hi"))
        level = level.groupBy(up("node").alias("node")).agg(F.min("best").alias("best"))
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    best = every.groupBy("q").agg(F.min("best").alias("best"))
    return queries.join(best, "q", "left").select("q", "i", "j", F.col("best.place").alias("place"), F.col("best.value").alias("value"))


def search_bounds(keys: DataFrame, needles: DataFrame, x: str) -> DataFrame:
    """Adds lower_bound (keys below x) and upper_bound (keys not above) to every row of needles: one running count over both, no range join."""
    from .scans import running

    counts = keys.groupBy(x).agg(F.count(F.lit(1)).alias("_n"))
    sought = needles.select(x).distinct().join(counts, x, "full").select(x, F.coalesce("_n", F.lit(0)).alias("_n"))
    bounds = running(sought, [x], "_n", "sum", "lower_bound", exclusive=True).select(F.col(x).alias("_x"), "lower_bound", (F.col("lower_bound") + F.col("_n")).alias("upper_bound"))
    return needles.join(bounds, F.col(x) == F.col("_x")).drop("_x")


def expanded(df: DataFrame, n: str, *order: str) -> DataFrame:
    """n rows for each row, numbered k in it and idx over all without gaps; rows with none have no row."""
    from .scans import running

    begun = running(df, list(order), n, "sum", "_begin", exclusive=True).where(F.col(n) > 0)
    return begun.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))).withColumn("idx", (F.col("_begin") + F.col("k")).cast("long")).drop("_begin")


def interval_move(intervals: DataFrame, values: DataFrame, kind: str) -> DataFrame:
    """place, x for each place of intervals (seg, src, dst, n). gather: values from src on, written one after another; scatter: values one after another, written from dst on; move: from src on to dst on. values: idx, x; null beyond them."""
    each = expanded(intervals, "n", "seg")
    src = F.col("idx") if kind == "scatter" else F.col("src") + F.col("k")
    dst = F.col("idx") if kind == "gather" else F.col("dst") + F.col("k")
    return each.select(src.alias("from"), dst.cast("long").alias("place")).join(values, F.col("from") == F.col("idx"), "left").select("place", "x")


def remerge(df: DataFrame, group: str, part: str, order: list[str]) -> DataFrame:
    """Merges the parts of each group in order and deals the rows out again, parts keeping their sizes: adds to_<part> and place in it."""
    from .scans import segment_places

    sizes = df.groupBy(group, part).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.select(F.col(group).alias("_g"), F.col(part).alias(f"to_{part}"), (F.sum("_n").over(w) - F.col("_n")).alias("_begin"), F.sum("_n").over(w).alias("_stop"))
    merged = segment_places(df, [group], order, "_place").withColumn("_place", F.col("_place") - 1)
    here = (F.col(group) == F.col("_g")) & (F.col("_place") >= F.col("_begin")) & (F.col("_place") < F.col("_stop"))
    return merged.join(sizes, here).withColumn("place", F.col("_place") - F.col("_begin")).drop("_g", "_begin", "_stop", "_place")


def histogram_channels(df: DataFrame, channels: dict[str, tuple[Column, list[float]]]) -> DataFrame:
    """channel, bin, n: counts of each channel between its neighbouring levels, lower bound included, empty bins too; all channels in one pass."""

    def bin_of(x: Column, levels: list[float]) -> Column:
        out = F.lit(None).cast("int")
        for i in range(len(levels) - 2, -1, -1):
            out = F.when((x >= levels[i]) & (x < levels[i + 1]), i).otherwise(out)
        return out

    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), bin_of(x, levels).alias("bin")) for c, (x, levels) in channels.items()]))
    got = df.select(each.alias("s")).select("s.channel", "s.bin").where("bin IS NOT NULL").groupBy("channel", "bin").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.createDataFrame([(c, i) for c, (_, levels) in channels.items() for i in range(len(levels) - 1)], "channel string, bin int")
    return every.join(got, ["channel", "bin"], "left").select("channel", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def grid_matrix(spark: SparkSession, width: int) -> DataFrame:
    """row, col, val of the five-point stencil on a square grid: 4 on the diagonal, -1 for each neighbour."""
    i = F.col("id")
    x, y = F.floor(i / width), i % width
    near = [(F.lit(True), i, 4), (x > 0, i - width, -1), (x < width - 1, i + width, -1), (y > 0, i - 1, -1), (y < width - 1, i + 1, -1)]
    cells = F.filter(F.array(*[F.struct(ok.alias("ok"), j.alias("col"), F.lit(v).alias("val")) for ok, j, v in near]), lambda c: c["ok"])
    return spark.range(width * width).select(i.alias("row"), F.explode(cells).alias("c")).select("row", "c.col", "c.val")
