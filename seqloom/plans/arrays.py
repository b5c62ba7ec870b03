"""Queries of array primitives: searches, intervals, merges, segments, histograms, folds, bits, matrices. They join the catalogue when this module is imported."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import primitives as P
from ..operators import scans
from .catalog import LINE, query, t

# range minima, searches


@query("""WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, value FROM events), n AS (SELECT count(*) AS n FROM e),
q AS (SELECT q, (q * 7919) % n AS i, (q * 7919) % n + (q * 104729) % (n - (q * 7919) % n) AS j FROM range(1000) r(q), n)
SELECT q, i, j, arg_min(idx, (value, idx)) FILTER (WHERE value IS NOT NULL) AS place, min(value) AS value FROM q JOIN e ON idx BETWEEN i AND j GROUP BY q, i, j""")
def rmq_any(spark, d):
    """Leftmost minimum of a thousand ranges of any length."""
    e = scans.global_index(t(spark, d, "events").select("event_id", "value"), "event_id").select("idx", "value")
    n = e.count()
    q = spark.range(1000).select(F.col("id").alias("q"), ((F.col("id") * 7919) % n).alias("i"))
    return P.range_minima(e, q.withColumn("j", F.col("i") + (F.col("q") * 104729) % (n - F.col("i"))), n)


@query("""WITH a AS (SELECT floor(c_acctbal / 100) AS x, c_custkey, 0 AS k FROM customer UNION ALL SELECT floor(o_totalprice / 1000), NULL, 1 FROM orders),
b AS (SELECT c_custkey, (sum(k) OVER (ORDER BY x RANGE UNBOUNDED PRECEDING))::BIGINT AS upper_bound, (sum(k) OVER (PARTITION BY x))::BIGINT AS equal FROM a)
SELECT c_custkey, upper_bound - equal AS lower_bound, upper_bound FROM b WHERE c_custkey IS NOT NULL""")
def sorted_search(spark, d):
    keys = t(spark, d, "orders").select(F.floor(F.col("o_totalprice") / 1000).cast("double").alias("x"))
    needles = t(spark, d, "customer").select("c_custkey", F.floor(F.col("c_acctbal") / 100).cast("double").alias("x"))
    return P.search_bounds(keys, needles, "x").select("c_custkey", "lower_bound", "upper_bound")


# intervals and work


def intervals(spark, d) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    return t(spark, d, "nation").select(k.alias("seg"), ((k * 7) % 90).alias("src"), (k * 100).alias("dst"), (k % 5).alias("n"))


INTERVALS = "i AS (SELECT n_nationkey::BIGINT AS seg, (n_nationkey * 7) % 90 AS src, n_nationkey::BIGINT * 100 AS dst, n_nationkey % 5 AS n, sum(n_nationkey % 5) OVER (ORDER BY n_nationkey) - n_nationkey % 5 AS begin FROM nation), v AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, s_acctbal AS x FROM supplier), w AS (SELECT *, unnest(range(n)) AS k FROM i)"


def supplies(spark, d) -> DataFrame:
    return scans.global_index(t(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x")), "s_suppkey").select("idx", "x")


@query(f"WITH {INTERVALS} SELECT (begin + k)::BIGINT AS place, x FROM w LEFT JOIN v ON idx = src + k")
def interval_gather(spark, d):
    return P.interval_move(intervals(spark, d), supplies(spark, d), "gather")


@query(f"WITH {INTERVALS} SELECT dst + k AS place, x FROM w LEFT JOIN v ON idx = begin + k")
def interval_scatter(spark, d):
    return P.interval_move(intervals(spark, d), supplies(spark, d), "scatter")


@query(f"WITH {INTERVALS} SELECT dst + k AS place, x FROM w LEFT JOIN v ON idx = src + k")
def interval_move(spark, d):
    return P.interval_move(intervals(spark, d), supplies(spark, d), "move")


@query("WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1), b AS (SELECT c_custkey, n, sum(n) OVER (ORDER BY c_custkey) - n AS begin FROM c) SELECT (begin + k)::BIGINT AS idx, c_custkey AS seg, k AS rank_in_seg FROM (SELECT *, unnest(range(n)) AS k FROM b)")
def load_balance_items(spark, d):
    """For each item of all segments, empty ones too, its segment and its rank there."""
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = t(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))
    return P.expanded(c, "n", "c_custkey").select("idx", F.col("c_custkey").alias("seg"), F.col("k").alias("rank_in_seg"))


@query("WITH b AS (SELECT o_orderkey, o_orderkey % 3 AS n, sum(o_orderkey % 3) OVER (ORDER BY o_orderkey) - o_orderkey % 3 AS begin FROM orders) SELECT (begin + k)::BIGINT AS idx, o_orderkey, o_orderkey * 10 + k AS work FROM (SELECT *, unnest(range(n)) AS k FROM b)")
def work_create(spark, d):
    """Each order makes none, one or two pieces of work, numbered without gaps."""
    o = t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("n"))
    return P.expanded(o, "n", "o_orderkey").select("idx", "o_orderkey", (F.col("o_orderkey") * 10 + F.col("k")).alias("work"))


# splits, merges, segmented sorts


@query("WITH b AS (SELECT o_orderkey, o_totalprice, least(o_custkey // 100, 15) AS bucket FROM orders) SELECT bucket, o_orderkey, o_totalprice, row_number() OVER (ORDER BY bucket, o_orderkey) - 1 AS place FROM b")
def multisplit_pairs(spark, d):
    """Rows of each bucket together, in the order they came."""
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice", F.least(F.expr("o_custkey div 100"), F.lit(15)).alias("bucket"))
    return scans.global_index(o, "bucket", "o_orderkey", name="place")


@query("""WITH s AS (SELECT o_orderkey, o_totalprice, o_orderkey % 8 AS slice FROM orders), g AS (SELECT *, CASE WHEN slice < 3 THEN 0 WHEN slice < 5 THEN 1 ELSE 2 END AS grp FROM s),
n AS (SELECT grp, slice AS to_slice, sum(count(*)) OVER (PARTITION BY grp ORDER BY slice) - count(*) AS begin, sum(count(*)) OVER (PARTITION BY grp ORDER BY slice) AS stop FROM g GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY o_totalprice, o_orderkey) - 1 AS p FROM g)
SELECT o_orderkey, to_slice, (p - begin)::BIGINT AS place FROM r JOIN n ON r.grp = n.grp AND p >= begin AND p < stop""")
def remerge_ranges(spark, d):
    """Adjacent sorted slices 0-2, 3-4, 5-7 merged; each slice keeps its size."""
    s = t(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 8).alias("slice"))
    return P.remerge(s.withColumn("grp", F.when(F.col("slice") < 3, 0).when(F.col("slice") < 5, 1).otherwise(2)), "grp", "slice", ["o_totalprice", "o_orderkey"]).select("o_orderkey", "to_slice", "place")


@query("SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC) - 1 AS idx FROM orders")
def sort_keys_desc(spark, d):
    return scans.global_index(t(spark, d, "orders").select("o_totalprice", F.monotonically_increasing_id().alias("n")), F.desc("o_totalprice"), "n").drop("n")


@query("SELECT l_orderkey, list(l_extendedprice ORDER BY l_extendedprice DESC, l_linenumber)::VARCHAR AS keys, list(l_linenumber ORDER BY l_extendedprice DESC, l_linenumber)::VARCHAR AS vals FROM lineitem GROUP BY 1")
def seg_sort_pairs_desc(spark, d):
    """Keys and values of each segment in falling order of the keys."""
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("k"), "l_linenumber", "l_extendedprice")))
    s = t(spark, d, "lineitem").groupBy("l_orderkey").agg(pairs.alias("p"))
    text = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.col(f"p.{c}"), lambda x: x.cast("string")), ", "), F.lit("]"))
    return s.select("l_orderkey", text("l_extendedprice").alias("keys"), text("l_linenumber").alias("vals"))


@query("SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS was, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey, l_extendedprice) - 1 AS place FROM lineitem")
def seg_sort_indices(spark, d):
    """For each place in a sorted segment, where its row was."""
    w = Window.partitionBy("l_orderkey")
    ties = ["l_linenumber", "l_partkey", "l_extendedprice"]
    return t(spark, d, "lineitem").select("l_orderkey", (F.row_number().over(w.orderBy(*ties)) - 1).alias("was"), (F.row_number().over(w.orderBy("l_quantity", *ties)) - 1).alias("place"))


# segmented reductions, histograms


@query("""WITH o AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT c_custkey, arg_min(pos, (o_totalprice, pos)) AS min_at, min(o_totalprice) AS min_value, arg_max(pos, (o_totalprice, -pos)) AS max_at, max(o_totalprice) AS max_value FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY 1""")
def seg_arg_min_max(spark, d):
    """Place and value of the first minimum and maximum of each segment; null in empty ones."""
    o = t(spark, d, "orders").select("o_custkey", "o_totalprice", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long").alias("at"))
    best = o.groupBy("o_custkey").agg(F.min(F.struct("o_totalprice", "at")).alias("lo"), F.max(F.struct("o_totalprice", (-F.col("at")).alias("back"))).alias("hi"))
    c = t(spark, d, "customer").select("c_custkey").join(best, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.col("lo.at").alias("min_at"), F.col("lo.o_totalprice").alias("min_value"), (-F.col("hi.back")).alias("max_at"), F.col("hi.o_totalprice").alias("max_value"))


@query("SELECT l_orderkey, round(max(l_extendedprice * (1 - l_discount)), 4) AS hi, round(min(l_extendedprice * (1 + l_tax)), 4) AS lo FROM lineitem GROUP BY 1")
def seg_reduce_transform(spark, d):
    """Reductions of what a function makes of each row."""
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.max(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("hi"), F.round(F.min(F.col("l_extendedprice") * (1 + F.col("l_tax"))), 4).alias("lo"))


CHANNELS = {"discount": ("l_discount * 100", [0.0, 2.5, 5.0, 7.5, 10.5]), "linenumber": ("l_linenumber", [1.0, 3.0, 8.0]), "quantity": ("l_quantity", [0.0, 10.0, 20.0, 45.0]), "tax": ("l_tax * 100", [-0.5, 0.5, 4.5])}
LEVELS = ", ".join(f"('{c}', {i}, {a}, {b})" for c, (_, v) in CHANNELS.items() for i, (a, b) in enumerate(zip(v, v[1:], strict=False)))
SAMPLES = " UNION ALL ".join(f"SELECT '{c}' AS channel, {e} AS x FROM lineitem" for c, (e, _) in CHANNELS.items())


@query(f"SELECT v.channel, bin::INT AS bin, count(x) AS n FROM (VALUES {LEVELS}) v(channel, bin, lo, hi) LEFT JOIN ({SAMPLES}) s ON s.channel = v.channel AND x >= lo AND x < hi GROUP BY 1, 2")
def hist_multi_range(spark, d):
    """Four channels at once, each with its own levels."""
    return P.histogram_channels(t(spark, d, "lineitem"), {c: (F.expr(e), levels) for c, (e, levels) in CHANNELS.items()})


EVEN = {"discount": ("l_discount * 100 + 0.001", 5, 0.0, 10.0), "quantity": ("l_quantity", 4, 0.0, 40.0), "tax": ("l_tax * 100 + 0.001", 3, 0.0, 9.0)}


@query(" UNION ALL ".join(f"SELECT '{c}' AS channel, b::INT AS bin, count(x) AS n FROM range({n}) r(b) LEFT JOIN (SELECT {e} AS x FROM lineitem) ON floor((x - {lo}) / (({hi} - {lo}) / {n})) = b AND x >= {lo} AND x < {hi} GROUP BY 1, 2" for c, (e, n, lo, hi) in EVEN.items()))
def hist_multi_even(spark, d):
    return P.histogram_channels(t(spark, d, "lineitem"), {c: (F.expr(e), [lo + i * (hi - lo) / n for i in range(n + 1)]) for c, (e, n, lo, hi) in EVEN.items()})


@query("SELECT b::INT AS bin, count(l_orderkey) AS n FROM range(5) r(b) LEFT JOIN (SELECT * FROM lineitem WHERE l_orderkey BETWEEN 100 AND 900 AND l_linenumber BETWEEN 2 AND 4) ON floor(l_quantity / 10) = b GROUP BY 1")
def hist_region(spark, d):
    """Even bins of a region of rows and columns."""
    region = t(spark, d, "lineitem").where("l_orderkey BETWEEN 100 AND 900 AND l_linenumber BETWEEN 2 AND 4")
    return P.histogram_even(region, F.col("l_quantity"), 5, 0.0, 50.0)


# folds with an operator of one's own


@query("SELECT xor(bit_xor(o_custkey), 12345) AS x, least(min(o_totalprice), 1000.0) AS lo, greatest(max(o_totalprice), 1000.0) AS hi, bit_or(o_custkey) AS o, bit_and(o_custkey) AS a FROM orders")
def reduce_with_init(spark, d):
    return t(spark, d, "orders").agg(
        F.bit_xor("o_custkey").bitwiseXOR(F.lit(12345)).alias("x"), F.least(F.min("o_totalprice"), F.lit(1000.0)).alias("lo"), F.greatest(F.max("o_totalprice"), F.lit(1000.0)).alias("hi"), F.bit_or("o_custkey").alias("o"), F.bit_and("o_custkey").alias("a")
    )


@query("SELECT event_id, xor(77, coalesce(bit_xor(user_id) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM events")
def scan_exclusive_with_init(spark, d):
    return scans.folded(t(spark, d, "events").select("event_id", "user_id"), ["event_id"], "user_id", lambda a, b: int(a) ^ int(b), "before", init=77, exclusive=True).select("event_id", "before")


@query("SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS latest FROM events")
def scan_latest(spark, d):
    """A fold whose operator doesn't commute: the later value."""
    return scans.folded(t(spark, d, "events").select("event_id", "ts", "value"), ["ts", "event_id"], "value", lambda a, b: b, "latest").select("event_id", "latest")


# ranks, flags, exchanges


@query("SELECT c_custkey, rank() OVER (ORDER BY c_nationkey) AS place FROM customer")
def rank_all(spark, d):
    """Competition rank over the whole table."""
    return scans.segment_places(t(spark, d, "customer").select("c_custkey", "c_nationkey"), [], ["c_nationkey"], ties=True).select("c_custkey", "place")


@query("WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS idx FROM customer) SELECT c_custkey, idx, CASE WHEN lag(c_nationkey) OVER (ORDER BY idx) IS DISTINCT FROM c_nationkey THEN idx ELSE 0 END AS mark, min(idx) OVER (PARTITION BY c_nationkey) AS start FROM r")
def rank_marks(spark, d):
    """A row that begins a run of equal keys is marked with its place; the running maximum of marks is each row's rank."""
    r = scans.global_index(t(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey")
    first = r.groupBy("c_nationkey").agg(F.min("idx").alias("first")).select(F.col("c_nationkey").alias("k"), "first")
    marked = r.join(first, F.col("c_nationkey") == F.col("k")).withColumn("mark", F.when(F.col("idx") == F.col("first"), F.col("idx")).otherwise(F.lit(0)))
    return scans.running(marked, ["idx"], "mark", "max", "start").select("c_custkey", "idx", "mark", "start")


@query("SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) > 1 AS open FROM customer")
def compaction_flags(spark, d):
    """Rows whose rank is shared stay open."""
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return c.join(n, ["c_nationkey", "c_mktsegment"]).select("c_custkey", (F.col("n") > 1).alias("open"))


@query("SELECT o_orderkey, lag(o_orderkey, 1, -1) OVER w AS up, lead(o_orderkey, 1, -1) OVER w AS down, lead(o_orderkey, 2) OVER w AS two_on FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def shuffle_up_down(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey", 1, -1).over(w).alias("up"), F.lead("o_orderkey", 1, -1).over(w).alias("down"), F.lead("o_orderkey", 2).over(w).alias("two_on"))


@query("WITH b AS (SELECT o_orderkey, o_custkey, row_number() OVER w - 1 AS i, ceil(count(*) OVER (PARTITION BY o_custkey) / 8)::BIGINT AS per FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY i % per, i // per) - 1 AS striped FROM b")
def exchange_striped(spark, d):
    """Eight lanes with a run of rows each, then a row of each lane in turn: one place for every row, however many there are."""
    w = Window.partitionBy("o_custkey")
    b = t(spark, d, "orders").select("o_orderkey", "o_custkey", (F.row_number().over(w.orderBy("o_orderkey")) - 1).cast("long").alias("i"), F.ceil(F.count(F.lit(1)).over(w) / 8).alias("per"))
    return b.select("o_orderkey", (F.row_number().over(w.orderBy(F.col("i") % F.col("per"), F.floor(F.col("i") / F.col("per")))) - 1).alias("striped"))


@query("SELECT event_id, value FROM (SELECT event_id, value, event_id % 3 = 0 AS flag FROM events) WHERE flag")
def select_by_flag(spark, d):
    return t(spark, d, "events").select("event_id", "value", (F.col("event_id") % 3 == 0).alias("flag")).where("flag").drop("flag")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'c' ELSE event_type END AS event_type, least(greatest(floor(value / 10), 0), 9)::BIGINT AS bucket, CASE WHEN value = 0 THEN 0 ELSE 1 END AS nonzero FROM events WHERE value IS NOT NULL")
def overwrite_and_buckets(spark, d):
    """A value written where another stands, and clamped range buckets with one for zero."""
    kind = F.when(F.col("event_type") == "click", "c").otherwise(F.col("event_type"))
    return t(spark, d, "events").where("value IS NOT NULL").select("event_id", kind.alias("event_type"), F.least(F.greatest(F.floor(F.col("value") / 10), F.lit(0)), F.lit(9)).alias("bucket"), F.when(F.col("value") == 0, 0).otherwise(1).alias("nonzero"))


# numbers


@query("SELECT o_orderkey, floor(log2(o_orderkey))::BIGINT AS log2, bit_count((o_orderkey & -o_orderkey) - 1)::BIGINT AS lowest, o_orderkey & (o_orderkey - 1) AS cleared FROM orders WHERE o_orderkey > 0")
def bit_tricks(spark, d):
    k = F.col("o_orderkey")
    lowest = F.bit_count(k.bitwiseAND(-k) - 1)
    return t(spark, d, "orders").where("o_orderkey > 0").select("o_orderkey", F.floor(F.log2(k)).alias("log2"), lowest.cast("long").alias("lowest"), k.bitwiseAND(k - 1).alias("cleared"))


@query("SELECT l_orderkey, l_linenumber, round(ln(p / (1 - p)), 9) AS stretch, round(1 / (1 + exp(-(l_quantity - 25) / 8)), 9) AS squash FROM (SELECT *, (l_quantity + 0.5) / 52 AS p FROM lineitem)")
def logistic(spark, d):
    p = (F.col("l_quantity") + 0.5) / 52
    return t(spark, d, "lineitem").select(*LINE, F.round(F.log(p / (1 - p)), 9).alias("stretch"), F.round(1 / (1 + F.exp(-(F.col("l_quantity") - 25) / 8)), 9).alias("squash"))


@query("SELECT i, (i // 2) * 3 + i % 2 + 1 AS whole, CASE WHEN ((i // 2) * 3 + i % 2 + 1) % 3 = 1 THEN 0 ELSE 1 END AS half, CASE WHEN i + 5 <= 999 THEN i + 5 ELSE 0 END AS capped, i - 7 AS less FROM range(1000) r(i)")
def index_remap(spark, d):
    """Places of a sample of two in three to places of the whole; capped sums; differences."""
    i = F.col("id")
    whole = F.floor(i / 2) * 3 + i % 2 + 1
    return spark.range(1000).select(i.alias("i"), whole.alias("whole"), F.when(whole % 3 == 1, 0).otherwise(1).alias("half"), F.when(i + 5 <= 999, i + 5).otherwise(F.lit(0)).alias("capped"), (i - 7).alias("less"))


@query("SELECT i, 3 * i AS strided, 42 AS constant, i * i AS squared, x AS value FROM range(100) r(i) JOIN (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, s_acctbal AS x FROM supplier) ON idx = (3 * i) % 10")
def iterators(spark, d):
    """Counting, strided, constant and transforming sources, and a table read by index."""
    i = spark.range(100).select(F.col("id").alias("i"), (F.col("id") * 3).alias("strided"), F.lit(42).alias("constant"), (F.col("id") * F.col("id")).alias("squared"))
    return i.join(supplies(spark, d), F.col("idx") == F.col("strided") % 10).select("i", "strided", "constant", "squared", F.col("x").alias("value"))


@query("SELECT event_id, abs(value - 50) AS distance, greatest(value, 25.0) AS hi, least(value, 75.0) AS lo, value = 50 AS eq, value <> 50 AS ne, value < 50 AS lt, value <= 50 AS le, value > 50 AS gt, value >= 50 AS ge, user_id + 1 AS plus, user_id - 1 AS minus, user_id * 2 AS times, user_id::VARCHAR AS text, (user_id::VARCHAR || '7')::BIGINT AS parsed FROM events WHERE value IS NOT NULL")
def functors(spark, d):
    v, u = F.col("value"), F.col("user_id")
    return t(spark, d, "events").where("value IS NOT NULL").select(
        "event_id", F.abs(v - 50).alias("distance"), F.greatest(v, F.lit(25.0)).alias("hi"), F.least(v, F.lit(75.0)).alias("lo"), (v == 50).alias("eq"), (v != 50).alias("ne"), (v < 50).alias("lt"), (v <= 50).alias("le"), (v > 50).alias("gt"), (v >= 50).alias("ge"),
        (u + 1).alias("plus"), (u - 1).alias("minus"), (u * 2).alias("times"), u.cast("string").alias("text"), F.concat(u.cast("string"), F.lit("7")).cast("long").alias("parsed"),
    )


# matrices


@query("WITH n AS (SELECT s_suppkey, count(l_orderkey) AS n FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1) SELECT s_suppkey AS row, n, (sum(n) OVER (ORDER BY s_suppkey) - n)::BIGINT AS begin FROM n")
def csr_rows(spark, d):
    """Row offsets of a sparse matrix from its non-zeros; rows without any have none."""
    n = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    rows = t(spark, d, "supplier").select(F.col("s_suppkey").alias("row")).join(n, F.col("row") == F.col("l_suppkey"), "left").select("row", F.coalesce("n", F.lit(0)).alias("n"))
    return scans.running(rows, ["row"], "n", "sum", "begin", exclusive=True)


GRID = 40


@query(f"WITH p AS (SELECT x, y, x * {GRID} + y AS i FROM range({GRID}) a(x), range({GRID}) b(y)), e AS (SELECT p.i, q.i AS j FROM p JOIN p q ON abs(p.x - q.x) + abs(p.y - q.y) <= 1) SELECT i AS row, sum(CASE WHEN i = j THEN 4 ELSE -1 END * (j % 7))::BIGINT AS y FROM e GROUP BY 1")
def grid_spmv(spark, d):
    """A generated matrix, the five-point stencil of a square grid, times a vector."""
    vector = spark.range(GRID * GRID).select(F.col("id").alias("col"), (F.col("id") % 7).alias("x"))
    return P.spmv(P.grid_matrix(spark, GRID), vector, "row", "col", F.col("val"), F.col("x"))
