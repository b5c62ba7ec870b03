"""Catalogue of queries over the driver's tables, each with DuckDB SQL where SQL can express it on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import primitives as P
from ..operators import scans, suffix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE = ["l_orderkey", "l_linenumber"]
ROW = [*LINE, "l_partkey", "l_suppkey", "l_extendedprice"]


# sorts and merges


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS idx FROM lineitem")
def sort_pairs_asc(spark, d):
    return scans.global_index(t(spark, d, "lineitem").select(*LINE, "l_extendedprice"), "l_extendedprice", *LINE)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) - 1 AS idx FROM lineitem")
def sort_pairs_desc(spark, d):
    return scans.global_index(t(spark, d, "lineitem").select(*LINE, "l_extendedprice"), F.desc("l_extendedprice"), *LINE)


@query("SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) - 1 AS idx FROM orders")
def sort_keys(spark, d):
    # equal keys spread over ranges by a number of their own
    return scans.global_index(t(spark, d, "orders").select("o_totalprice", F.monotonically_increasing_id().alias("n")), "o_totalprice", "n").drop("n")


@query("SELECT o_orderkey, (o_orderkey >> 3) & 255 AS bits, row_number() OVER (ORDER BY (o_orderkey >> 3) & 255, o_orderkey) - 1 AS idx FROM orders")
def sort_bit_range(spark, d):
    return scans.global_index(t(spark, d, "orders").select("o_orderkey", F.shiftright("o_orderkey", 3).bitwiseAND(F.lit(255)).alias("bits")), "bits", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS place FROM lineitem")
def seg_sort(spark, d):
    return t(spark, d, "lineitem").select(*LINE, F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_linenumber")).alias("place"))


@query("SELECT side, k, row_number() OVER (ORDER BY k, side, n) - 1 AS idx FROM (SELECT 'a' AS side, o_orderkey AS k, 0 AS n FROM orders UNION ALL SELECT 'b', l_orderkey, l_linenumber FROM lineitem)")
def merge_sorted(spark, d):
    a = t(spark, d, "orders").select(F.lit("a").alias("side"), F.col("o_orderkey").alias("k"), F.lit(0).alias("n"))
    b = t(spark, d, "lineitem").select(F.lit("b").alias("side"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    return scans.global_index(a.unionByName(b), "k", "side", "n").drop("n")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


# partition and selection


@query("WITH b AS (SELECT least(o_custkey // 100, 15) AS bucket, count(*) AS n FROM orders GROUP BY 1) SELECT bucket, n, (sum(n) OVER (ORDER BY bucket) - n)::BIGINT AS begin FROM b")
def bucket_partition(spark, d):
    return P.buckets(t(spark, d, "orders"), F.least(F.expr("o_custkey div 100"), F.lit(15)))


@query("SELECT o_custkey % 8 AS src, o_orderkey % 8 AS dst, count(*) AS n FROM orders GROUP BY 1, 2")
def split_table(spark, d):
    return t(spark, d, "orders").groupBy((F.col("o_custkey") % 8).alias("src"), (F.col("o_orderkey") % 8).alias("dst")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, value FROM events WHERE value > 50")
def select_if(spark, d):
    return t(spark, d, "events").where("value > 50").select("event_id", "value")


@query("SELECT d.doc_id, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1")
def select_flagged(spark, d):
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels").where("quality = 1").select("doc_id", "quality"), "doc_id")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def select_unique(spark, d):
    p = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t(spark, d, "events").withColumn("p", p).where(~F.col("p").eqNullSafe(F.col("event_type"))).select("event_id", "user_id", "event_type")


@query("""WITH e AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS idx, coalesce(value > 50, false) AS sel FROM events)
SELECT event_id, CASE WHEN sel THEN count(*) FILTER (WHERE sel) OVER (ORDER BY idx) - 1 ELSE (SELECT count(*) FROM e) - (count(*) FILTER (WHERE NOT sel) OVER (ORDER BY idx)) END AS place FROM e""")
def partition_if(spark, d):
    return P.partition_order(t(spark, d, "events").select("event_id", "value"), F.coalesce(F.col("value") > 50, F.lit(False)), "event_id").select("event_id", "place")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def bulk_remove(spark, d):
    gone = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t(spark, d, "orders").select("o_orderkey").join(gone, "o_orderkey", "left_anti")


@query("SELECT k, row_number() OVER (ORDER BY pos, side, k) - 1 AS idx FROM (SELECT s_suppkey AS k, s_suppkey * 10 AS pos, 0 AS side FROM supplier UNION ALL SELECT o_orderkey, o_orderkey, 1 FROM orders)")
def bulk_insert(spark, d):
    a = t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") * 10).alias("pos"), F.lit(0).alias("side"))
    b = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("pos"), F.lit(1).alias("side"))
    return scans.global_index(a.unionByName(b), "pos", "side", "k").select("k", "idx")


# aggregates


@query("SELECT count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS s, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem")
def reduce_sum_min_max(spark, d):
    q = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
    return t(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), q.alias("s"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


@query("""SELECT (SELECT l_orderkey FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 1) AS arg_min,
(SELECT l_orderkey FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 1) AS arg_max""")
def reduce_arg(spark, d):
    a = t(spark, d, "lineitem").agg(P.arg_first("l_extendedprice", LINE, False).alias("lo"), P.arg_first("l_extendedprice", LINE, True).alias("hi"))
    return a.select(F.col("lo.l_orderkey").alias("arg_min"), F.col("hi.l_orderkey").alias("arg_max"))


RUNS = """WITH e AS (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN i > 1 AND p IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_no FROM e) """


def event_runs(spark, d):
    e = scans.run_ids(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return e.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))


@query(RUNS + "SELECT user_id, run_no::BIGINT AS run_no, event_type, round(sum(value), 2) AS total FROM r GROUP BY ALL")
def reduce_by_key(spark, d):
    return event_runs(spark, d).groupBy("user_id", F.col("run_no").cast("long").alias("run_no"), "event_type").agg(F.round(F.sum("value"), 2).alias("total"))


@query(RUNS + "SELECT user_id, run_no::BIGINT AS run_no, event_type, count(*) AS n FROM r GROUP BY ALL")
def run_length_encode(spark, d):
    return event_runs(spark, d).groupBy("user_id", F.col("run_no").cast("long").alias("run_no"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(RUNS + "SELECT user_id, event_type, min(i) - 1 AS begin, count(*) AS n FROM r GROUP BY user_id, run_no, event_type HAVING count(*) > 1")
def nontrivial_runs(spark, d):
    return event_runs(spark, d).groupBy("user_id", "run_no", "event_type").agg((F.min("i") - 1).cast("long").alias("begin"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("run_no")


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(max(o_totalprice), -1) AS hi, coalesce(min(o_totalprice), -1) AS lo, coalesce(sum(o_totalprice::DECIMAL(18,2)), 0)::DOUBLE AS s FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def seg_reduce(spark, d):
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    out = t(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hi", F.lit(-1.0)).alias("hi"), F.coalesce("lo", F.lit(-1.0)).alias("lo"), F.coalesce(F.col("s").cast("double"), F.lit(0.0)).alias("s"))


@query("SELECT b::INT AS bin, count(l_orderkey) AS n FROM range(16) r(b) LEFT JOIN lineitem ON floor(l_quantity / 3) = b AND l_quantity >= 0 AND l_quantity < 48 GROUP BY 1")
def hist_even(spark, d):
    return P.histogram_even(t(spark, d, "lineitem"), F.col("l_quantity"), 16, 0.0, 48.0)


@query("SELECT bin::INT AS bin, count(l_orderkey) AS n FROM (VALUES (0, 0, 5), (1, 5, 7), (2, 7, 20), (3, 20, 60)) v(bin, lo, hi) LEFT JOIN lineitem ON l_quantity >= lo AND l_quantity < hi GROUP BY 1")
def hist_range(spark, d):
    return P.histogram_range(t(spark, d, "lineitem"), F.col("l_quantity"), [0, 5, 7, 20, 60])


@query("SELECT channel, bin, count(*) AS n FROM (SELECT 'discount' AS channel, round(l_discount * 100)::INT AS bin FROM lineitem UNION ALL SELECT 'tax', round(l_tax * 100)::INT FROM lineitem) GROUP BY 1, 2")
def hist_multi(spark, d):
    s = t(spark, d, "lineitem").select(F.expr("stack(2, 'discount', l_discount, 'tax', l_tax) AS (channel, x)"))
    return s.groupBy("channel", F.round(F.col("x") * 100).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


CLEAN = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


@query(f"WITH c AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split({CLEAN}, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY 1) SELECT ch, n, (sum(n) OVER (ORDER BY ch) - n)::BIGINT AS begin, sum(n) OVER (ORDER BY ch)::BIGINT AS stop FROM c")
def byte_histogram(spark, d):
    c = T.letter_counts(t(spark, d, "documents"), "text").where("n > 0")
    w = F.sum("n").over(Window.orderBy("ch").rowsBetween(Window.unboundedPreceding, 0))
    return c.select("ch", "n", (w - F.col("n")).alias("begin"), w.alias("stop"))


# scans and windows


@query("SELECT l_orderkey, l_linenumber, (sum(round(l_quantity * 100)) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) - round(l_quantity * 100))::BIGINT AS before FROM lineitem")
def scan_exclusive_sum(spark, d):
    li = t(spark, d, "lineitem").select(*ROW, F.round(F.col("l_quantity") * 100).cast("long").alias("q"))
    return scans.running(li, ROW, "q", "sum", "before", exclusive=True).select(*LINE, "before")


@query("SELECT l_orderkey, l_linenumber, sum(round(l_quantity * 100)) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM lineitem")
def scan_inclusive_sum(spark, d):
    li = t(spark, d, "lineitem").select(*ROW, F.round(F.col("l_quantity") * 100).cast("long").alias("q"))
    return scans.running(li, ROW, "q", "sum", "total").select(*LINE, "total")


@query("SELECT event_id, max(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS hi FROM events")
def scan_max(spark, d):
    return scans.running(t(spark, d, "events").select("event_id", "ts", "value"), ["ts", "event_id"], "value", "max", "hi").select("event_id", "hi")


@query("SELECT event_id, min(value) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo FROM events")
def scan_exclusive_min(spark, d):
    return scans.running(t(spark, d, "events").select("event_id", "ts", "value"), ["ts", "event_id"], "value", "min", "lo", exclusive=True).select("event_id", "lo")


@query("SELECT event_id, lag(event_type) OVER w IS DISTINCT FROM event_type AS head, lead(event_type) OVER w IS DISTINCT FROM event_type AS tail FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def flags_head_tail(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, d, "events").select("event_id", (~F.lag("event_type").over(w).eqNullSafe(F.col("event_type"))).alias("head"), (~F.lead("event_type").over(w).eqNullSafe(F.col("event_type"))).alias("tail"))


@query("WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT a.o_orderkey, b.o_orderkey AS rotated FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.i = (a.i + 3) % a.n")
def shuffle_rotate(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("o_custkey")).alias("n"))
    other = o.select("o_custkey", F.col("i").alias("j"), F.col("o_orderkey").alias("rotated"))
    return o.withColumn("j", ((F.col("i") + 3) % F.col("n")).cast("int")).join(other, ["o_custkey", "j"]).select("o_orderkey", "rotated")


@query("SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS place FROM customer")
def rank_initial(spark, d):
    return scans.segment_places(t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), ["c_mktsegment"], ["c_nationkey"], ties=True).select("c_custkey", "place")


@query("WITH r AS (SELECT c_custkey, c_acctbal, c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS old FROM customer) SELECT c_custkey, old + rank() OVER (PARTITION BY c_mktsegment, old ORDER BY c_acctbal) - 1 AS place FROM r")
def rebucket(spark, d):
    r = scans.segment_places(t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal"), ["c_mktsegment"], ["c_nationkey"], "old", ties=True)
    return scans.segment_places(r, ["c_mktsegment", "old"], ["c_acctbal"], "inner", ties=True).select("c_custkey", (F.col("old") + F.col("inner") - 1).alias("place"))


@query("SELECT user_id, event_id, arg_min(event_id, (value, event_id)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 7 PRECEDING) AS at FROM events WHERE value IS NOT NULL")
def rmq_leftmost(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-7, 0)
    return t(spark, d, "events").where("value IS NOT NULL").select("user_id", "event_id", F.min(F.struct("value", "event_id")).over(w)["event_id"].alias("at"))


@query("SELECT o_orderkey, (i % 8) * 100 + i // 8 AS striped FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)")
def blocked_to_striped(spark, d):
    i = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long")
    return t(spark, d, "orders").withColumn("i", i).select("o_orderkey", ((F.col("i") % 8) * 100 + F.floor(F.col("i") / 8)).alias("striped"))


# joins and lookups


@query("SELECT o_orderkey, l_linenumber, o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def inner_join(spark, d):
    return t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "o_custkey")


@query("SELECT e.event_id, (SELECT max_by(x.value, (x.ts, x.event_id)) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.value IS NOT NULL AND x.ts <= e.ts) AS last_value FROM events e WHERE e.event_type <> 'purchase'")
def as_of_join(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    last = e.where("event_type = 'purchase' AND value IS NOT NULL").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return P.as_of(e.where("event_type <> 'purchase'").drop("value"), last, ["user_id"], "ts", "value", "last_value").select("event_id", "last_value")


@query("SELECT n_nationkey, unnest(range(n_nationkey + 1)) AS i FROM nation")
def interval_expand(spark, d):
    return t(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_nationkey").cast("long"))).alias("i"))


@query("SELECT n_nationkey AS seg, c_custkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) - 1 AS rank_in_seg FROM nation JOIN customer ON c_nationkey = n_nationkey")
def load_balance_search(spark, d):
    j = t(spark, d, "nation").join(t(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").alias("seg"), "c_custkey")
    return scans.segment_places(j, ["seg"], ["c_custkey"]).select("seg", "c_custkey", (F.col("place") - 1).alias("rank_in_seg"))


@query("SELECT a.o_orderkey, coalesce(b.o_custkey, 0) AS ahead FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey + 4")
def gather_h(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.select("o_orderkey").join(o.select((F.col("o_orderkey") - 4).alias("o_orderkey"), F.col("o_custkey").alias("ahead")), "o_orderkey", "left").select("o_orderkey", F.coalesce("ahead", F.lit(0)).alias("ahead"))


@query("SELECT p_partkey AS pos, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS rank FROM part")
def scatter_inverse(spark, d):
    return scans.global_index(t(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", name="rank").select(F.col("p_partkey").alias("pos"), "rank")


@query("SELECT l_orderkey AS row, round(sum(l_quantity * p_retailprice), 2) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def spmv(spark, d):
    a = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), "l_quantity")
    x = t(spark, d, "part").select(F.col("p_partkey").alias("col"), "p_retailprice")
    return P.spmv(a, x, "row", "col", F.col("l_quantity"), F.col("p_retailprice")).select("row", F.round("y", 2).alias("y"))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionAll(t(spark, d, "supplier").select("s_nationkey"))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_rows(spark, d):
    return t(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(t(spark, d, "supplier").select("s_nationkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def except_keys(spark, d):
    return t(spark, d, "orders").select(F.col("o_custkey").alias("k")).subtract(t(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


# sequences


@query(f"SELECT doc_id, {CLEAN} AS seq FROM documents")
def seq_clean(spark, d):
    return t(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("seq"))


@query(f"SELECT doc_id, seq || translate(reverse(regexp_replace(seq, '[^ACGT]', '', 'g')), 'ACGT', 'TGCA') AS seq FROM (SELECT doc_id, {CLEAN} AS seq FROM documents)")
def both_strands(spark, d):
    return t(spark, d, "documents").select("doc_id", T.both_strands(T.clean(F.col("text"))).alias("seq"))


@query(f"SELECT item_id, translate({CLEAN}, 'N', '1') AS seq FROM benchmark")
def mask_n(spark, d):
    return t(spark, d, "benchmark").select("item_id", T.mask(T.clean(F.col("text"))).alias("seq"))


@query("SELECT doc_id, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ') AS flipped FROM documents")
def case_flip(spark, d):
    return t(spark, d, "documents").select("doc_id", T.flip_case(T.letters(F.col("text"))).alias("flipped"))


@query("SELECT doc_id, len(regexp_extract_all(s, '[a-z]+')) AS n_runs, length(regexp_replace(s, '[^a-z]', '', 'g')) AS n_lower FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS s FROM documents)")
def case_runs(spark, d):
    s = t(spark, d, "documents").select("doc_id", T.letters(F.col("text")).alias("s"))
    return s.select("doc_id", F.regexp_count("s", F.lit("[a-z]+")).cast("long").alias("n_runs"), F.length(F.regexp_replace("s", "[^a-z]", "")).cast("long").alias("n_lower"))


@query("SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS restored FROM documents")
def case_apply(spark, d):
    s = t(spark, d, "documents").select("doc_id", T.letters(F.col("text")).alias("s"))
    # lengths of the runs of one case, from which the text is put together again out of its upper-case form
    lengths = F.transform(F.regexp_extract_all("s", F.lit("([a-z]+|[A-Z]+)"), 1), F.length)
    return s.select("doc_id", T.apply_case(F.upper("s"), lengths, F.col("s").rlike("^[a-z]")).alias("restored"))


@query(f"SELECT k, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(length(s) - 4, 1)), lambda i: substring(s, i, 6))) AS k FROM (SELECT {CLEAN} AS s FROM documents) WHERE length(s) >= 6) GROUP BY 1")
def kmer_count(spark, d):
    return T.kmer_counts(t(spark, d, "documents").select(T.clean(F.col("text")).alias("s")), "s", 6)


@query("SELECT doc_id, CASE WHEN source = p THEN '0' ELSE source END AS header FROM (SELECT doc_id, source, lag(source) OVER (PARTITION BY lang ORDER BY doc_id) AS p FROM documents)")
def header_compact(spark, d):
    """A header equal to that of the document before in its language is 0."""
    before = F.lag("source").over(Window.partitionBy("lang").orderBy("doc_id"))
    return t(spark, d, "documents").select("doc_id", "source", before.alias("p")).select("doc_id", F.when(F.col("source") == F.col("p"), "0").otherwise(F.col("source")).alias("header"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(s, '(.{{60}})', '\\1\n', 'g'), '\n$', '') AS wrapped FROM (SELECT doc_id, {CLEAN} AS s FROM documents)")
def fasta_wrap(spark, d):
    return t(spark, d, "documents").select("doc_id", T.wrap(T.clean(F.col("text"))).alias("wrapped"))


@query(f"""WITH b AS (SELECT doc_id, {CLEAN} AS s FROM documents), c AS (SELECT doc_id, len(s) AS n, unnest(string_split(s, '')) AS ch, generate_subscripts(string_split(s, ''), 1) - 1 AS i FROM b WHERE s <> ''),
x AS (SELECT doc_id, (1 + sum(ascii(ch))) % 65521 AS lo, (any_value(n) + sum((n - i) * ascii(ch))) % 65521 AS hi FROM c GROUP BY doc_id)
SELECT b.doc_id, CASE WHEN s IS NULL THEN NULL ELSE coalesce(hi * 65536 + lo, 1) END::BIGINT AS adler FROM b LEFT JOIN x ON b.doc_id = x.doc_id""")
def adler32(spark, d):
    return t(spark, d, "documents").select("doc_id", T.adler32(T.clean(F.col("text"))).alias("adler"))


@query(f"SELECT doc_id, reverse({CLEAN}) AS reversed FROM documents")
def reverse_block(spark, d):
    return t(spark, d, "documents").select("doc_id", F.reverse(T.clean(F.col("text"))).alias("reversed"))


# string index: see strings.py


@query(f"SELECT doc_id, {CLEAN} AS restored FROM documents")
def bwt_round_trip(spark, d):
    def run(batches):
        for b in batches:
            b["restored"] = [suffix.unbwt(*suffix.bwt(s.encode())).decode() for s in b.pop("seq")]
            yield b

    return t(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("seq")).mapInPandas(run, "doc_id long, restored string")


@query(f"SELECT doc_id, {CLEAN} AS restored FROM documents")
def bwt_round_trip_by_squaring(spark, d):
    """The other way back, by squaring the permutation."""

    def run(batches):
        for b in batches:
            b["restored"] = [suffix.unbwt_by_squaring(*suffix.bwt(s.encode())).decode() for s in b.pop("seq")]
            yield b

    return t(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("seq")).mapInPandas(run, "doc_id long, restored string")
