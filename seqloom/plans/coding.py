"""Queries of delta coding, FASTA files and the block codec; they join the catalogue when this module is imported.

Targets are the documents' letters. Each one's reference is the benchmark item that shares most stretches of 22 letters
with it, the smallest item_id of equals; where none shares any, the item whose place is doc_id modulo the number of items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import codec, delta, scans, shared, suffix
from ..sources import fasta
from .catalog import CLEAN, kmer_count, query, t

LETTERS = "regexp_replace(text, '[^A-Za-z]', '', 'g')"
#: Items and letters up to which references and their stretches, 16 bytes for each letter, are broadcast; both are counted first.
BROADCAST_ITEMS, BROADCAST_LETTERS = 100_000, 4 << 20


def pairs(spark, d) -> DataFrame:
    items = scans.global_index(t(spark, d, "benchmark").select("item_id", F.col("text").alias("reference")), "item_id", name="place")
    n, size = items.agg(F.count(F.lit(1)), F.sum(F.length("reference"))).first()
    small = F.broadcast if n <= BROADCAST_ITEMS and (size or 0) <= BROADCAST_LETTERS else lambda x: x
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("target"), F.col("doc_id").cast("string").alias("header"))
    # a document's stretches meet the items' where they are made; only those found are grouped
    stretches = lambda df, key, text: T.stretch_keys(df.select(key, T.clean(F.col(text)).alias("s")), key, "s", delta.MIN_MATCH + 1)
    of_items = small(stretches(items, "place", "reference").withColumnRenamed("id", "place"))
    found = stretches(docs, "id", "target").join(of_items, "k").groupBy("id", "place").agg(F.count(F.lit(1)).alias("n"))
    best = found.groupBy("id").agg(F.max_by("place", F.struct("n", -F.col("place"))).alias("best"))
    chosen = docs.join(best, "id", "left").withColumn("place", F.coalesce("best", F.pmod("id", F.lit(max(n, 1)))))
    return chosen.join(small(items.select("place", "reference", F.col("item_id").cast("string").alias("reference_header"))), "place", "left").drop("place", "best")


@query()
def longest_match(spark, d):
    return delta.match_table(pairs(spark, d)).withColumnRenamed("id", "doc_id")


@query()
def match_cover(spark, d):
    return delta.cover_table(pairs(spark, d)).withColumnRenamed("id", "doc_id")


@query()
def delta_tokens(spark, d):
    return delta.token_table(pairs(spark, d)).withColumnRenamed("id", "doc_id")


@query()
def delta_script(spark, d):
    return delta.encode_table(pairs(spark, d)).select(F.col("id").alias("doc_id"), "script", F.substring("script", 1, 1).alias("mode"))


def coded_and_back(spark, d) -> DataFrame:
    """id, header, target (decoded), was."""
    both = pairs(spark, d)
    kept = delta.encode_table(both).join(both.select("id", "reference", "reference_header"), "id")
    return delta.decode_table(kept).join(both.select("id", T.letters(F.coalesce("target", F.lit(""))).alias("was")), "id")


@query(f"SELECT doc_id, doc_id::VARCHAR AS header, coalesce({LETTERS}, '') AS restored FROM documents")
def delta_round_trip(spark, d):
    return coded_and_back(spark, d).select(F.col("id").alias("doc_id"), F.when(F.col("header") == "", F.lit(None)).otherwise(F.col("header")).alias("header"), F.col("target").alias("restored"))


@query(f"SELECT doc_id, length({LETTERS}) AS n, length({LETTERS}) AS n_equal FROM documents")
def verify_decoded(spark, d):
    same = F.size(F.filter(F.arrays_zip(F.split("target", "").alias("x"), F.split("was", "").alias("y")), lambda z: (z["x"] == z["y"]) & (z["x"] != "")))
    return coded_and_back(spark, d).select(F.col("id").alias("doc_id"), F.length("was").cast("long").alias("n"), same.cast("long").alias("n_equal"))


@query()
def kmismatch_distance(spark, d):
    return delta.distance_table(pairs(spark, d), 2).withColumnRenamed("id", "doc_id")


@query(f"SELECT doc_id, {LETTERS} AS seq FROM documents")
def fasta_round_trip(spark, d):
    path = shared.new_folder(spark)
    fasta.write_fasta(t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("header"), T.letters(F.col("text")).alias("seq")), path)
    return fasta.read_fasta(spark, path).select(F.col("header").cast("long").alias("doc_id"), "seq")


@query(f"""WITH r AS (SELECT doc_id, unnest(l) AS run, unnest(range(len(l))) AS i FROM (SELECT doc_id, regexp_extract_all({CLEAN}, 'N+|[^N]+') AS l FROM documents))
SELECT doc_id, begin, len FROM (SELECT doc_id, run, length(run) AS len, (sum(length(run)) OVER (PARTITION BY doc_id ORDER BY i) - length(run))::BIGINT AS begin FROM r) WHERE run LIKE 'N%'""")
def n_runs(spark, d):
    r = t(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all(T.clean(F.col("text")), F.lit("(N+|[^N]+)"), 1)).alias("i", "run"))
    r = r.select("doc_id", "i", F.length("run").cast("long").alias("len"), F.col("run").startswith("N").alias("is_n"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("begin", F.sum("len").over(w) - F.col("len")).where("is_n").select("doc_id", "begin", "len")


@query(f"WITH k AS (SELECT unnest(list_transform(range(1, greatest(length(s) - 4, 1)), lambda i: substring(s, i, 6))) AS k FROM (SELECT {CLEAN} AS s FROM documents) WHERE length(s) >= 6) SELECT k, count(*) AS n, (sum(count(*)) OVER (ORDER BY k) - count(*))::BIGINT AS rank FROM k GROUP BY k")
def kmer_rank(spark, d):
    return scans.running(kmer_count(spark, d), ["k"], "n", "sum", "rank", exclusive=True)


# block codec


def texts(spark, d) -> DataFrame:
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.encode(F.col("text"), "utf-8").alias("data"))


def there_and_back(df: DataFrame, both) -> DataFrame:
    """doc_id, restored of each record by both(data of a batch's records)."""

    def run(batches):
        for b in batches:
            b["restored"] = [x.decode() for x in both([x or b"" for x in b.pop("data")])]
            yield b.rename(columns={"id": "doc_id"})

    return df.mapInPandas(run, "doc_id long, restored string")


SAME = "SELECT doc_id, coalesce(text, '') AS restored FROM documents"


@query(SAME)
def codec_round_trip(spark, d):
    back = codec.decompress_table(codec.compress_table(texts(spark, d), codec.Options(block=1 << 16)))
    return back.select(F.col("id").alias("doc_id"), F.decode("data", "utf-8").alias("restored"))


@query(SAME)
def codec_filters_round_trip(spark, d):
    o = codec.Options(block=1 << 16, sorter=5, adaptive=False, repeat=32, segments=True, reorder=True, contexts=True)
    back = codec.decompress_table(codec.compress_table(texts(spark, d), o))
    return back.select(F.col("id").alias("doc_id"), F.decode("data", "utf-8").alias("restored"))


@query("""WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), c AS (SELECT doc_id, len(h) // 2 AS n, unnest(range(len(h) // 2)) AS i, h FROM b),
x AS (SELECT doc_id, n, i, (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1 AS v FROM c),
s AS (SELECT doc_id, (1 + sum(v)) % 65521 AS lo, (any_value(n) + sum((n - i) * v)) % 65521 AS hi FROM x GROUP BY doc_id)
SELECT b.doc_id, 0::BIGINT AS block_no, 0::BIGINT AS "offset", (len(h) // 2)::BIGINT AS data_bytes, coalesce(hi * 65536 + lo, 1)::BIGINT AS data_adler FROM b LEFT JOIN s ON b.doc_id = s.doc_id""")
def codec_block_info(spark, d):
    def run(batches):
        for b in batches:
            info = [codec.block_info(x) for x in b["block"]]
            for k in ("data_bytes", "data_adler"):
                b[k] = [i[k] for i in info]
            yield b.drop(columns="block").rename(columns={"id": "doc_id"})

    return codec.compress_table(texts(spark, d)).mapInPandas(run, "doc_id long, block_no long, offset long, data_bytes long, data_adler long")


@query(SAME)
def repeats_round_trip(spark, d):
    return there_and_back(texts(spark, d), lambda b: [codec.restore_parts(codec.predict_parts(x, 32), 32) for x in b])


@query(SAME)
def sort_transform_round_trip(spark, d):
    return there_and_back(texts(spark, d), lambda b: [codec.undo_sort_transform(*codec.sort_transform(x, 5), 5) for x in b])


@query(SAME)
def run_ranks_round_trip(spark, d):
    return there_and_back(texts(spark, d), lambda b: [codec.undo_run_ranks(*codec.run_ranks(x)) for x in b])


@query(SAME)
def mixed_coder_round_trip(spark, d):
    """Through the coder that mixes three estimates."""
    return there_and_back(texts(spark, d), lambda b: codec.entropy_decode_all(codec.entropy_encode_all(b, codec.MIXED), codec.MIXED))


@query(SAME)
def range_coder_round_trip(spark, d):
    return there_and_back(texts(spark, d), lambda b: codec.entropy_decode_all(codec.entropy_encode_all(b)))


@query()
def detectors(spark, d):
    def run(batches):
        for b in batches:
            data = [x or b"" for x in b.pop("data")]
            b["n_segments"], b["record_size"], b["preceding"] = [len(codec.segments(x)) - 1 for x in data], [codec.record_size(x) for x in data], [codec.preceding_contexts(x) for x in data]
            yield b.rename(columns={"id": "doc_id"})

    return texts(spark, d).mapInPandas(run, "doc_id long, n_segments int, record_size int, preceding boolean")


@query(f"SELECT doc_id, array_to_string(l[1:len(l):3] || l[2:len(l):3] || l[3:len(l):3], '') AS columns FROM (SELECT doc_id, string_split({CLEAN}, '') AS l FROM documents)")
def reorder_records(spark, d):
    def run(batches):
        for b in batches:
            b["columns"] = [codec.reorder(s.encode(), 3).decode() for s in b.pop("s")]
            yield b

    return t(spark, d, "documents").select("doc_id", T.clean(F.coalesce("text", F.lit(""))).alias("s")).mapInPandas(run, "doc_id long, columns string")
