"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Words are apportioned as blocks of equal size. Sources get integer quotas of blocks by highest quotients
target / (2 k + 1); a source's quota is apportioned again to groups of its shards and from groups to shards, so that no
window sees more than a few thousand rows. A shard holds documents in a seeded order and takes whole rounds of its blocks
plus a run of blocks from a seeded start, so that all but two documents of a shard are taken in whole rounds. A shard's
blocks are equal to a word: its words are divided by the whole number of blocks that is nearest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, free_name, saved, with_row_number

#: Words in a block, words in a shard, shards in a group.
BLOCK, SHARD, GROUP = 8, 1 << 16, 1024


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target words of each source: share of all words by weight, at most most times a source's words.

    sources: source, source_size. The excess of capped sources is given to the others by weight until none is above its
    cap: a source is capped if its cap over its weight is below the level that the rest shares, so one running sum in
    the order of that ratio finds all of them. Weights repeat in the order of the sources' code points, null last.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode(F.col("source").cast("string"), "UTF-8"))) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    df = sources.withColumn("place", place).withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    everything = Window.partitionBy()
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    # level: words for each unit of weight if all sources before this one are capped and none from here on is
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), zero)) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero))
    df = df.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    first = F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("place").alias("p"), F.col("level").alias("l")))
    df = df.withColumn("from", F.min(first).over(everything))
    capped = F.col("from").isNull() | (F.struct(F.col("cap") / F.col("weight"), F.col("place")) < F.struct(F.col("from.r"), F.col("from.p")))
    return df.select("source", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("weight") * F.col("from.l")).alias("target"))


def sainte_lague(df: DataFrame, group: list[str], seats: Column, votes: str, order: list[str], out: str) -> DataFrame:
    """Integer seats for each row: in each group the highest quotients votes / (2 k + 1), ties to the first in order.

    seats: the group's seats, the same in all its rows. Seats that a row surely has are given at once: with the divisor
    votes / seats of the group, rounding misses the total by half a row each at most, so quotients far above that
    divisor win and those far below lose; only those near it are ranked.
    """
    w = Window.partitionBy(*group)
    df = df.withColumn("_seats", seats).withColumn("_all", F.sum(votes).over(w)).withColumn("_rows", F.count(F.lit(1)).over(w))
    fair = F.when(F.col("_all") > 0, F.col(votes) / F.col("_all") * F.col("_seats")).otherwise(F.lit(0.0))
    slack = F.ceil(F.when(F.col("_all") > 0, F.col(votes) / F.col("_all")).otherwise(F.lit(0.0)) * F.col("_rows")) + 2
    df = df.withColumn("_sure", F.greatest(F.lit(0), (F.floor(fair) - slack))).withColumn("_last", (F.floor(fair) + slack))
    df = df.withColumn("_left", F.col("_seats") - F.sum("_sure").over(w))
    each = df.where(F.col(votes) > 0).withColumn("_k", F.explode(F.sequence("_sure", "_last"))).withColumn("_q", F.col(votes) / (2 * F.col("_k") + 1))
    rank = F.row_number().over(w.orderBy(F.col("_q").desc(), *order, "_k"))
    keys = [*group, *order]
    won = each.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_left")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    back = df.select(*[c for c in df.columns]).alias("a").join(won.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left")
    return back.select("a.*", (F.col("a._sure") + F.coalesce(F.col("b._won"), F.lit(0))).cast("long").alias(out)).drop("_seats", "_all", "_rows", "_sure", "_last", "_left")


ADDED = ("size", "source_size", "target", "taken", "first_word", "end_word")


def plan(rows: DataFrame, seed: int, weights: tuple[float, ...], share: float, most: float, block: int, shard: int, group: int) -> DataFrame:
    """row and the columns ADDED for each of rows (row, id, source, text). Texts are read once; only row, source, a hash and the size travel."""
    key = F.concat_ws("\x1f", F.lit(str(seed)), F.col("id"), F.substring(F.coalesce("text", F.lit("")), 1, 64))
    sized = saved(rows.select("row", F.col("source").alias("src"), F.md5(F.encode(key, "UTF-8")).alias("h"), n_words(F.col("text")).alias("size")))

    sums = saved(sized.groupBy(F.col("src").alias("source")).agg(F.sum("size").alias("source_size")))
    want = saved(targets(sums, weights, share, most).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard))).withColumn("seats", F.floor(F.sum("target").over(Window.partitionBy()) / block + 0.5)))
    small = broadcast_if_small(want.select(F.col("source").alias("s"), "source_size", "target", "shards"))
    # rows that are equal in id and text differ in number, so that they spread over the shards
    number = F.conv(F.substring(F.md5(F.encode(F.concat_ws("\x1f", "h", F.col("row").cast("string")), "UTF-8")), 1, 8), 16, 10).cast("long")
    joined = sized.join(small, F.col("src").eqNullSafe(F.col("s")), "left").withColumn("shard", number % F.col("shards")).drop("s", "shards")
    # rows without words take nothing and need no place
    worded = joined.where("size > 0")

    # shards' words, then quotas: sources, groups of shards, shards
    shards = saved(worded.groupBy(F.col("src").alias("source"), "shard").agg(F.sum("size").alias("words")).withColumn("grp", F.floor(F.col("shard") / group)))
    by_source = sainte_lague(want, [], F.col("seats"), "target", ["source"], "quota").select(F.col("source").alias("s"), F.col("quota").alias("given"))
    groups = shards.groupBy("source", "grp").agg(F.sum("words").alias("words")).join(by_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    groups = sainte_lague(groups, ["source"], F.col("given"), "words", ["grp"], "quota").select(F.col("source").alias("s"), F.col("grp").alias("g"), F.col("quota").alias("given"))
    quotas = shards.join(groups, F.col("source").eqNullSafe(F.col("s")) & (F.col("grp") == F.col("g"))).drop("s", "g")
    quotas = sainte_lague(quotas, ["source", "grp"], F.col("given"), "words", ["shard"], "quota")
    blocks = F.greatest(F.lit(1), F.round(F.col("words") / block)).cast("long")
    quotas = saved(quotas.select(F.col("source").alias("s"), F.col("shard").alias("sh"), "words", blocks.alias("blocks"), F.least(F.col("quota"), blocks * int(most)).alias("quota")))

    # blocks of a shard: all of them `rounds` times, and `run` blocks more from block `first` on
    place = Window.partitionBy("src", "shard").orderBy("h", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = worded.withColumn("stop", F.sum("size").over(place)).join(quotas, F.col("src").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("sh")), "left")
    placed = placed.withColumn("rounds", F.floor(F.col("quota") / F.col("blocks"))).withColumn("run", F.col("quota") - F.col("rounds") * F.col("blocks"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.lit(f"start {seed}"), "src", F.col("shard").cast("string"))), 1, 8), 16, 10).cast("long")
    placed = placed.withColumn("first", draw % (F.col("blocks") - F.col("run") + 1)).withColumn("start", F.col("stop") - F.col("size"))
    edge = lambda i: F.floor(i * F.col("words") / F.col("blocks"))
    lo = F.greatest(F.col("start"), edge(F.col("first")))
    rest = F.greatest(F.lit(0), F.least(F.col("stop"), edge(F.col("first") + F.col("run"))) - lo)
    begin = lo - F.col("start")
    out = placed.select(
        "row", "size", "source_size", "target", (F.col("rounds") * F.col("size") + rest).alias("taken"), F.when(rest > 0, begin).otherwise(F.lit(0)).alias("first_word"), F.when(rest > 0, begin + rest).otherwise(F.lit(0)).alias("end_word")
    )
    none = joined.where("size = 0").select("row", "size", "source_size", "target", *[F.lit(0).alias(c) for c in ADDED[3:]])
    return out.unionByName(none).select("row", *[F.col(c).cast("double" if c == "target" else "long").alias(c) for c in ADDED])


def planned(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = BLOCK, shard: int = SHARD, group: int = GROUP, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """row, doc (a struct of all columns of docs) and ADDED for every row of docs; a struct's fields clash with no name."""
    row = free_name(docs, "mix_row")
    numbered = with_row_number(docs, row)
    texts = numbered.select(F.col(row).alias("row"), F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    whole = numbered.select(F.col(row).alias("doc_row"), F.struct(*docs.columns).alias("doc"))
    return whole.join(plan(texts, seed, weights, share, most, block, shard, group), F.col("doc_row") == F.col("row")).drop("doc_row")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Adds to every row of docs: size, source_size, target, taken, first_word, end_word. options: those of planned().

    size: words of the text (null: 0). source_size, target: words of its source, and how many the mix wants of them.
    taken: words the mix takes of the row, repeats counted, at most most times size for a whole number most; of them
    the words first_word to end_word (exclusive; from 0) are taken once more than the rest. Rows of a null source form
    a source. Rows without words take nothing. Rows may repeat; each is placed for itself by its number. An empty table
    gives an empty table. Columns of docs with one of the added names are replaced; others may have any name.
    """
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    return planned(docs, **options).select(*[F.col("doc").getField(c).alias(c) for c in kept], *ADDED)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with the columns of docs: a row for each whole round, and one with the words of the run.

    A row whose run is part of it holds these words with the white space between them; n_chars, where docs has it, is that
    of the new text. Null and empty texts and those without words take nothing and go. Repeated rows are taken each for
    itself. All other columns, of any name, stay as they are. An empty table gives an empty table.
    """
    text_col = options.get("text_col", "text")
    m = planned(docs, **options)
    extra = F.col("end_word") - F.col("first_word")
    rounds = F.when(F.col("size") > 0, ((F.col("taken") - extra) / F.col("size")).cast("int")).otherwise(F.lit(0))
    copies = (rounds + F.when(extra > 0, 1).otherwise(0)).cast("int")
    old = F.col("doc").getField(text_col)
    words = F.regexp_extract_all(old, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), 1)
    part = F.array_join(F.slice(words, (F.col("first_word") + 1).cast("int"), extra.cast("int")), "")
    each = m.where(copies > 0).withColumn("rounds", rounds).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    each = each.withColumn("new_text", F.when((F.col("copy") > F.col("rounds")) & (extra < F.col("size")), part).otherwise(old))
    new = {text_col.lower(): F.col("new_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("new_text").cast(docs.schema["n_chars"].dataType)
    return each.select(*[new.get(c.lower(), F.col("doc").getField(c)).alias(c) for c in docs.columns])
