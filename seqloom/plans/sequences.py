"""Queries of sequences: case runs, packing, parallel decoding, containers, text files. They join the catalogue when this module is imported."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import delta, shared, suffix
from ..sources import container, fasta, raw
from .catalog import CLEAN, query, t
from .coding import LETTERS, pairs
from .strings import ONE, doubling, letters_of


@query(f"""WITH r AS (SELECT doc_id, regexp_extract_all(s, '([A-Z]*)([a-z]+)', 1) AS g, regexp_extract_all(s, '([A-Z]*)([a-z]+)', 2) AS l FROM (SELECT doc_id, {LETTERS} AS s FROM documents))
SELECT doc_id, run_no, length(g[run_no + 1]) AS gap, length(l[run_no + 1]) AS length FROM (SELECT *, unnest(range(len(l))) AS run_no FROM r)""")
def case_run_rows(spark, d):
    """Runs of lower case: letters since the run before, and how many."""
    s = t(spark, d, "documents").select("doc_id", T.letters(F.col("text")).alias("s"))
    lengths = lambda i: F.transform(F.regexp_extract_all("s", F.lit("([A-Z]*)([a-z]+)"), i), lambda x: F.length(x).cast("long"))
    r = s.select("doc_id", F.posexplode(F.arrays_zip(lengths(1).alias("gap"), lengths(2).alias("length"))).alias("run_no", "r"))
    return r.select("doc_id", F.col("run_no").cast("long").alias("run_no"), "r.gap", "r.length")


HALVED = "upper(s[:len(s) // 2]) || lower(s[len(s) // 2 + 1:])"


@query(f"""WITH b AS (SELECT doc_id, s, {HALVED} AS o FROM (SELECT doc_id, {LETTERS} AS s FROM documents) WHERE s <> ''),
c AS (SELECT doc_id, unnest(string_split(s, '')) AS x, unnest(string_split(o, '')) AS y, generate_subscripts(string_split(s, ''), 1) AS i FROM b),
f AS (SELECT *, x = y AS same, lag(x = y, 1, true) OVER (PARTITION BY doc_id ORDER BY i) AS was FROM c), g AS (SELECT *, sum(CASE WHEN same <> was THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run_no FROM f),
n AS (SELECT doc_id, run_no::BIGINT AS run_no, count(*) AS length FROM g GROUP BY 1, 2)
SELECT doc_id, run_no, length FROM n UNION ALL SELECT doc_id, 0, 0 FROM n GROUP BY doc_id HAVING min(run_no) = 1""")
def case_agreement(spark, d):
    """Runs of equal and other case between each document and itself with its halves in one case each."""
    s = t(spark, d, "documents").select("doc_id", T.letters(F.coalesce("text", F.lit(""))).alias("s"))
    half = F.floor(F.length("s") / 2).cast("int")
    both = s.withColumn("o", F.concat(F.upper(F.substring("s", F.lit(1), half)), F.lower(F.substring("s", half + 1, F.length("s")))))
    return delta.case_agreement(both, "doc_id", "s", "o").withColumnRenamed("id", "doc_id")


@query(f"WITH b AS (SELECT item_id, s, translate(s, 'ET', 'AI') AS o FROM (SELECT item_id, {CLEAN} AS s FROM benchmark)), c AS (SELECT item_id, unnest(string_split(s, '')) AS was, unnest(string_split(o, '')) AS now, generate_subscripts(string_split(s, ''), 1) - 1 AS pos FROM b) SELECT * FROM c WHERE was <> now")
def mismatch_positions(spark, d):
    """Where two texts of equal length differ, and in what."""
    b = t(spark, d, "benchmark").select("item_id", T.clean(F.col("text")).alias("s")).withColumn("o", F.translate("s", "ET", "AI"))
    c = b.select("item_id", F.posexplode(F.arrays_zip(F.split("s", "").alias("was"), F.split("o", "").alias("now"))).alias("pos", "x"))
    return c.select("item_id", "x.was", "x.now", F.col("pos").cast("long").alias("pos")).where("was <> now")


@query(f"SELECT doc_id, {CLEAN} || '$' || r AS joined, length({CLEAN}) + 1 AS shift FROM documents JOIN (SELECT {CLEAN} AS r FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)) ON true")
def concat_reference(spark, d):
    """A target, a separator and a reference as one text, and how far the reference's places move."""
    r = t(spark, d, "benchmark").agg(F.min_by(T.clean(F.col("text")), "item_id").alias("r"))
    s = t(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("s"))
    return s.crossJoin(F.broadcast(r)).select("doc_id", F.concat("s", F.lit("$"), "r").alias("joined"), (F.length("s") + 1).cast("long").alias("shift"))


@query("SELECT doc_id, lang || '_' || substring(md5(doc_id::VARCHAR), 1, 5) AS name FROM documents")
def random_name(spark, d):
    return t(spark, d, "documents").select("doc_id", F.concat("lang", F.lit("_"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 5)).alias("name"))


@query("SELECT doc_id, octet_length(b)::BIGINT AS n, ((octet_length(b) + 7) // 8 * 8)::BIGINT AS padded, hex(b) || repeat('00', (8 - octet_length(b) % 8) % 8) AS bytes FROM (SELECT doc_id, encode(text) AS b FROM documents)")
def raw_padding(spark, d):
    """A text's bytes, padded with zeros to a multiple of 8."""
    b = t(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b")).withColumn("p", raw.padded(F.col("b"), 8))
    return b.select("doc_id", F.octet_length("b").cast("long").alias("n"), F.octet_length("p").cast("long").alias("padded"), F.hex("p").alias("bytes"))


@query(f"""WITH o AS {ONE.format(clean=CLEAN, key='item_id', table='benchmark')}, p AS (SELECT s, unnest(range(len(s))) AS pos FROM o)
SELECT pos, {" + ".join(f"coalesce(ascii(nullif(substring(s, pos + {j + 1}, 1), '')) - 64, 0)::BIGINT * {64 ** (5 - j)}" for j in range(6))} AS key FROM p WHERE pos % 3 <> 0""")
def kmer_pack(spark, d):
    """The next six letters of every place that 3 doesn't divide, as one number; zeros beyond the end."""
    return suffix.packed_places(letters_of(spark, d, "benchmark", "item_id"), 6).where("pos % 3 <> 0")


@query(f"{doubling(ONE.format(clean=CLEAN, key='item_id', table='benchmark'), 'one')} SELECT pos, r - 1 AS rank FROM r14")
def sampled_suffix_order(spark, d):
    """Suffix order by ranking two suffixes of three and merging in the rest."""
    return suffix.three_way_order(letters_of(spark, d, "benchmark", "item_id").checkpoint())


@query(f"{doubling(ONE.format(clean=CLEAN, key='item_id', table='benchmark'), 'one')}, z AS (SELECT pos, rank() OVER (ORDER BY r) AS r FROM r14 WHERE pos % 3 <> 0) SELECT c.pos, c.pos % 3 AS third, ascii(ch) - 64 AS c0, coalesce(ascii(lead(ch) OVER (ORDER BY c.pos)) - 64, 0) AS c1, a.r - 1 AS r0, coalesce(b.r, 0) AS r1, coalesce(e.r, 0) AS r2 FROM c LEFT JOIN z a ON a.pos = c.pos LEFT JOIN z b ON b.pos = c.pos + 1 LEFT JOIN z e ON e.pos = c.pos + 2")
def sampled_suffix_rows(spark, d):
    """What the merge compares: letters, and ranks among the sampled suffixes."""
    return suffix.three_way_rows(letters_of(spark, d, "benchmark", "item_id").checkpoint())


@query(f"{doubling(ONE.format(clean=CLEAN, key='item_id', table='benchmark'), 'one')} SELECT r - 1 AS rank, pos FROM r14")
def array_round_trip(spark, d):
    """A suffix order written to files and read again."""
    path = shared.new_folder(spark)
    raw.write_array(suffix.suffix_ranks(letters_of(spark, d, "benchmark", "item_id")), path, "rank", "pos")
    return raw.read_array(spark, path)


@query(f"SELECT doc_id, coalesce({CLEAN}, '') AS restored FROM documents")
def decode_by_sums(spark, d):
    """Plain scripts decoded by running sums over all their tokens."""
    both = pairs(spark, d)
    path = shared.new_folder(spark)
    delta.token_table(both).write.parquet(path)
    strands = T.both_strands(T.clean(F.col("reference")))
    text = delta.joined_text(delta.decode_by_sums(spark.read.parquet(path), both.select("id", T.mask(strands).alias("strands"))))
    every = t(spark, d, "documents").select("doc_id")
    return every.join(text, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.coalesce("target", F.lit("")).alias("restored"))


@query(f"SELECT item_id, 'item ' || item_id AS header, {LETTERS} AS restored FROM benchmark")
def container_round_trip(spark, d):
    """FASTA in, scripts against the item before in blocks in files, and back."""
    path = shared.new_folder(spark)
    items = t(spark, d, "benchmark")
    fasta.write_fasta(items.select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("header"), T.letters(F.col("text")).alias("seq")), f"{path}/in")
    read = fasta.read_fasta(spark, f"{path}/in").withColumn("id", F.regexp_extract("header", r"(\d+)$", 1).cast("long"))
    w = Window.partitionBy((F.col("id") % 16).alias("p")).orderBy("id")
    both = read.select("id", F.concat(F.lit("part"), (F.col("id") % 4).cast("string")).alias("name"), "header", F.col("seq").alias("target"), F.lag("seq", 1, "").over(w).alias("reference"), F.lag("header", 1, "").over(w).alias("reference_header"))
    container.write_container(both, f"{path}/out")
    back = container.read_container(spark, f"{path}/out", both.select("id", "reference", "reference_header"))
    return back.select(F.col("id").alias("item_id"), "header", F.col("target").alias("restored"))


@query("SELECT item_id::VARCHAR AS name, replace(text, ' ', chr(10)) AS script FROM benchmark")
def script_files_round_trip(spark, d):
    path = shared.new_folder(spark)
    fasta.write_scripts(t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.replace(F.col("text"), F.lit(" "), F.lit("\n")).alias("script")), path)
    return fasta.read_scripts(spark, path).select(F.col("name").cast("string").alias("name"), "script")


@query("SELECT rpad(p_partkey::VARCHAR, 10, ' ') || ' ' || printf('%.8f', p_retailprice) || ' ' || printf('%.8f', p_size / 7.0) AS line FROM part")
def distance_lines(spark, d):
    """Lines of a distance matrix, written and read again."""
    path = shared.new_folder(spark)
    fasta.write_distances(t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("taxon"), F.array("p_retailprice", F.col("p_size") / 7.0).alias("distances")), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(f"SELECT doc_id, {CLEAN} AS seq FROM documents")
def fasta_with_comments(spark, d):
    """Records with comment lines between their lines, read without them and upper-cased."""
    path = shared.new_folder(spark)
    s = t(spark, d, "documents").select("doc_id", T.letters(F.coalesce("text", F.lit(""))).alias("s"))
    lines = F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n;a comment\n"), T.wrap(F.col("s")), F.lit("\n;another"))
    s.select(lines).write.text(path)
    return fasta.read_fasta(spark, path).select(F.col("header").cast("long").alias("doc_id"), F.upper("seq").alias("seq"))
