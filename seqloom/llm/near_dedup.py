"""Near duplicates by order MinHash over word shingles, verified by banded alignment.

A document is the sequence of its shingles of K words, each labelled with its occurrence number, so that all are
distinct. For each of BANDS seeds the document's PICK smallest labelled shingles are taken and kept in text order; their
hash is a band key. Documents that share a key are candidates. Their words are aligned in a band around the diagonal that
is as wide as the threshold allows: with M words equal in the same order, of n and m, the edit similarity is
M / max(n, m), so a changed, added or missing word costs one word, wherever it stands.

Equal texts are one document from the start. In a bucket all members are compared with its most central one first, so
the work follows the number of members where they are alike. Buckets that this leaves with several classes are packed
into blocks of like length, and those blocks compared in pairs whose lengths allow the similarity: a block pair gives
links that connect what all its links connect, never a row for each pair, and no candidate link between different classes
is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, free_name, saved, with_row_number
from .components import components
from .packing import chunks

#: Words in a shingle, seeds, labelled shingles for each seed, least edit similarity.
K, BANDS, PICK, LEAST = 5, 12, 2, 0.8
#: Members of a bucket, and words of theirs, in a block.
BLOCK, BLOCK_WORDS = 256, 1 << 18
#: Characters sketched at once: arrays of this many words stay in a core's cache.
CHUNK_CHARS = 1 << 18


PAD = 0x5851F42D4C957F2D
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


class Words:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, cache: int = 400_000):
        self.seen: dict[bytes, int] = {}
        self.cache = cache

    def __call__(self, text: str) -> list[int]:
        words = text.encode().lower().split()
        try:
            return list(map(self.seen.__getitem__, words))
        except KeyError:
            if len(self.seen) > self.cache:
                self.seen.clear()
            for w in words:
                if w not in self.seen:
                    self.seen[w] = xxhash.xxh64_intdigest(w)
            return list(map(self.seen.__getitem__, words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def labelled_shingles(docs: list[list[int]], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the labelled shingles of documents (word hashes, none empty) one after the other, and where each document's begin.

    A document of fewer than k words is one shingle.
    """
    n = np.array([max(k, len(d)) for d in docs], np.int64)
    words = np.array([w for d in docs for w in (d if len(d) >= k else [*d, *[PAD] * (k - len(d))])], np.uint64)
    rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        rolled *= np.uint64(0x9E3779B97F4A7C15)
        rolled += words[j : j + len(rolled)]
    m = n - k + 1
    starts = np.cumsum(m) - m
    owner = np.repeat(np.arange(len(docs)), m)
    h = mixed(rolled[np.arange(len(owner)) + owner * (k - 1)])
    # occurrence numbers: equal shingles of a document are neighbours in the order of a number that both give
    both = h + owner.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    order = np.argsort(both, kind="stable")
    s = both[order]
    same = np.concatenate([[False], s[1:] == s[:-1]])
    if same.any():
        at = np.arange(len(s))
        occurrence = np.empty(len(s), np.uint64)
        occurrence[order] = (at - np.maximum.accumulate(np.where(same, 0, at))).astype(np.uint64)
        again = np.flatnonzero(occurrence)
        h[again] = mixed(h[again] + occurrence[again] * np.uint64(0xA0761D6478BD642F))
    return h, starts


def band_keys(h: np.ndarray, starts: np.ndarray, bands: int = BANDS, pick: int = PICK) -> np.ndarray:
    """A key for each document and seed: hash of its pick smallest labelled shingles in text order."""
    docs, m = len(starts), np.diff(np.append(starts, len(h)))
    out = np.zeros((docs, bands), np.uint64)
    if not docs:
        return out.view(np.int64)
    low = h ^ (h >> np.uint64(32))
    seeds = mixed(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    values = np.append(h, np.uint64(0))
    for b, seed in enumerate(seeds):
        x = low * seed
        x ^= x >> np.uint64(29)
        chosen = np.full((docs, pick), len(h), np.int64)
        for i in range(pick):
            least = np.minimum.reduceat(x, starts)
            at = np.flatnonzero(x == np.repeat(least, m))
            who = np.searchsorted(starts, at, side="right") - 1
            first = np.concatenate([[True], who[1:] != who[:-1]])  # of equal values the first
            at, who = at[first], who[first]
            ok = i < m[who]
            chosen[who[ok], i] = at[ok]
            x[at] = LAST
        chosen.sort(axis=1)
        key = np.full(docs, b + 1, np.uint64)
        for i in range(pick):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[chosen[:, i]])
        out[:, b] = key
    return out.view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Edit similarity of two sequences of words if it is at least least, else 0: words equal in order, in a band, over the longer length.

    An alignment with enough equal words leaves the diagonal by no more than the words that it may miss. Equal ends are
    taken off, which loses nothing; the rest is aligned by bits, a step for each word of b and a bit for each of a.
    """
    n, m = len(a), len(b)
    most = max(n, m)
    need = int(np.ceil(least * most - 1e-9))
    if not n or not m or min(n, m) < need:
        return 0.0
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[::-1][: short - head] != b[::-1][: short - head])
    tail = int(differ[0]) if len(differ) else short - head
    x, y = a[head : n - tail].tolist(), b[head : m - tail].tolist()
    if not x or not y:
        return (head + tail) / most if head + tail >= need else 0.0
    band = most - need
    masks: dict[int, int] = {}
    for i, w in enumerate(x):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(x)) - 1
    free, wide = full, 2 * band + 1 < len(x)
    strip = (1 << 2 * band + 1) - 1
    for j, w in enumerate(y):
        if hit := masks.get(w):
            if wide:
                hit &= strip << j - band if j >= band else strip >> band - j
            hit &= free
            free = (free + hit | free - hit) & full
    found = head + tail + len(x) - free.bit_count()
    return found / most if found >= need else 0.0


def sketches(docs: DataFrame, text_col: str, row: str, k: int, bands: int, pick: int) -> DataFrame:
    """row, digest (of the text), n, words (32-bit hashes), keys for each row; written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            texts = b["t"].fillna("")
            for part in chunks(texts, CHUNK_CHARS):
                own = texts.iloc[part].tolist()
                split = [words(t) for t in own]
                full = [i for i, w in enumerate(split) if w]
                keys = band_keys(*labelled_shingles([split[i] for i in full], k), bands, pick)
                lists = [[] for _ in own]
                for j, i in enumerate(full):
                    lists[i] = keys[j]
                short = [(np.array(w, np.uint64) >> np.uint64(32)).astype("<u4").tobytes() for w in split]
                yield pd.DataFrame({"row": b["row"].iloc[part].to_numpy(), "digest": [xxhash.xxh3_128_digest(t.encode()) for t in own], "n": [len(w) for w in split], "words": short, "keys": lists})

    return saved(docs.select(F.col(row).alias("row"), F.col(text_col).alias("t")).mapInPandas(run, "row long, digest binary, n int, words binary, keys array<long>"))


def verified(pairs: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """Those of pairs (a, b) that align. Both joins are plain joins of two shuffles, which Spark splits where one side's row has very many partners."""
    left = pairs.join(own.select(F.col("row").alias("a"), F.col("words").alias("wa")), "a")
    both = left.join(own.select(F.col("row").alias("b"), F.col("words").alias("wb")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yes = [aligned(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), least) > 0 for x, y in zip(p["wa"], p["wb"], strict=True)]
            yield p.loc[yes, ["a", "b"]]

    return both.select("a", "b", "wa", "wb").mapInPandas(run, "a long, b long")


def bucket_blocks(known: DataFrame, open_buckets: DataFrame, keys: DataFrame, texts: DataFrame, least: float, size: int, words: int) -> DataFrame:
    """The members of buckets that hold several classes, in blocks of like length: bucket, len (length's class), blk, rows, cs, texts, keys.

    Two texts as similar as least are in the same class of lengths or in neighbouring ones. A block has at most about size
    members and so many words, or one member.
    """
    step = -np.log(least)
    own = known.join(open_buckets, F.col("bucket") == F.col("ob")).select("bucket", "row", "c", F.floor(F.log(F.col("n").cast("double")) / step).cast("int").alias("len"))
    room = F.greatest(F.lit(1), F.least(F.lit(size), F.floor(F.lit(float(words)) / F.exp((F.col("l") + 1) * step)))).cast("long")
    counts = saved(own.groupBy(F.col("bucket").alias("ob"), F.col("len").alias("l")).agg(F.count(F.lit(1)).alias("members")).withColumn("parts", F.ceil(F.col("members") / room)))
    placed = own.join(counts, (F.col("bucket") == F.col("ob")) & (F.col("len") == F.col("l"))).withColumn("blk", F.pmod(F.xxhash64("row"), "parts").cast("int")).select("bucket", "len", "blk", "row", "c")
    whole = placed.join(texts, "row").join(keys.withColumnRenamed("row", "r"), F.col("row") == F.col("r"))
    return saved(whole.groupBy("bucket", "len", "blk").agg(F.collect_list("row").alias("rows"), F.collect_list("c").alias("cs"), F.collect_list("words").alias("texts"), F.collect_list("keys").alias("keys")))


def block_links(x: tuple, y: tuple | None, bucket: int, least: float) -> list[tuple[int, int]]:
    """Links inside a block, or between two, that connect what all links between different classes connect.

    x, y: (rows, classes, texts, keys). A pair is looked at in the first bucket that both are in. Products of matrices
    give the numbers of common words, each occurrence counted; pairs with enough of them are aligned unless already connected.
    """
    rows, cs, texts, keys = x if y is None else (np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]]), x[2] + y[2], np.concatenate([x[3], y[3]]))
    n, left = len(rows), len(x[0])
    if n < 2:
        return []
    bands = keys.shape[1]
    first = np.full((n, n), bands, np.int8)
    for b in range(bands - 1, -1, -1):
        first[keys[:, b][:, None] == keys[:, b][None, :]] = b
    mine = np.argmax(keys == bucket, axis=1)
    ms = np.array([len(t) for t in texts], np.int64)
    most = np.maximum(ms[:, None], ms[None, :])
    want = (first == np.minimum(mine[:, None], mine[None, :])) & (cs[:, None] != cs[None, :]) & (np.minimum(ms[:, None], ms[None, :]) >= least * most - 1e-9)
    want &= np.triu(np.ones((n, n), bool), 1)
    if y is not None:
        want[:left, :left] = want[left:, left:] = False
    if not want.any():
        return []
    alone = np.flatnonzero(want.any(axis=1) | want.any(axis=0))
    if len(alone) < n:  # rows without partners need no counts
        want, most, cs, rows, texts, ms, n = want[np.ix_(alone, alone)], most[np.ix_(alone, alone)], cs[alone], rows[alone], [texts[i] for i in alone], ms[alone], len(alone)
    if n > 2:
        values, starts = labelled_shingles([t.astype(np.uint64).tolist() for t in texts], 1)
        owner = np.repeat(np.arange(n), ms)
        _, column, times = np.unique(values, return_inverse=True, return_counts=True)
        ok = times[column] > 1
        owner, column = owner[ok], (np.cumsum(times > 1) - 1)[column[ok]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common, width = np.zeros((n, n), np.float32), max(1, (1 << 21) // n)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [lo, lo + width])
            m = np.zeros((n, width), np.float32)
            m[owner[a:b], column[a:b] - lo] = 1
            common += m @ m.T
        want &= common >= least * most - 1e-3
    parent: dict[int, int] = {}

    def find(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    for i, j in zip(*np.nonzero(want), strict=True):
        p, q = find(int(cs[i])), find(int(cs[j]))
        if p != q and aligned(texts[i], texts[j], least):
            parent[p] = q
            out.append((int(rows[i]), int(rows[j])))
    return out


def unpacked(r, s: str) -> tuple:
    return np.asarray(getattr(r, f"rows{s}"), np.int64), np.asarray(getattr(r, f"cs{s}"), np.int64), [np.frombuffer(t, "<u4") for t in getattr(r, f"texts{s}")], np.stack([np.asarray(k, np.int64) for k in getattr(r, f"keys{s}")])


def links_in_blocks(blocks: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that connect the classes inside buckets: each block in itself, and each pair of a bucket's blocks whose lengths are near enough."""
    names = ("rows", "cs", "texts", "keys")

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            found = [x for r in p.itertuples(index=False) if len(r.rows) > 1 for x in block_links(unpacked(r, ""), None, r.bucket, least)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            found = [x for r in p.itertuples(index=False) for x in block_links(unpacked(r, "_x"), unpacked(r, "_y"), r.bucket, least)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    thin = lambda s: blocks.select("bucket", F.col("len").alias(f"len_{s}"), F.col("blk").alias(f"blk_{s}"))
    near = (F.col("len_y") - F.col("len_x") == 1) | (F.col("len_y") == F.col("len_x")) & (F.col("blk_x") < F.col("blk_y"))
    pairs = thin("x").join(thin("y"), "bucket").where(near)
    side = lambda s: blocks.select("bucket", F.col("len").alias(f"len_{s}"), F.col("blk").alias(f"blk_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in names])
    both = pairs.join(side("x"), ["bucket", "len_x", "blk_x"]).join(side("y"), ["bucket", "len_y", "blk_y"])
    return blocks.select("bucket", *names).mapInPandas(within, "a long, b long").union(both.select("bucket", *[f"{c}_{s}" for s in "xy" for c in names]).mapInPandas(between, "a long, b long"))


def classes(sk: DataFrame, least: float = LEAST, block: int = BLOCK, block_words: int = BLOCK_WORDS) -> DataFrame:
    """row, rep (the smallest row of its class) for rows that have others in their class; sk: sketches()."""
    exact = saved(sk.groupBy("digest").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select(F.col("digest").alias("d"), "rep"))
    copies = saved(sk.select("row", "digest").join(exact, F.col("digest") == F.col("d")).where("row <> rep").select(F.col("row"), "rep"))
    own = sk.where("n > 0").select("row", "n", "keys").join(copies.select("row"), "row", "left_anti")
    rows = saved(own.select("row", "n", F.explode("keys").alias("bucket")))
    sizes = saved(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select(F.col("bucket").alias("k"), "members"))
    shared = saved(rows.join(sizes, F.col("bucket") == F.col("k")).select("bucket", "row", "n", "members"))
    # a bucket's head is its most central member: that whose other buckets are the largest
    central = saved(shared.groupBy("row").agg(F.sum("members").alias("weight")).withColumnRenamed("row", "r"))
    placed = saved(shared.join(central, F.col("row") == F.col("r")).select("bucket", "row", "n", "weight"))
    heads = saved(placed.groupBy("bucket").agg(F.max(F.struct(F.col("weight"), (-F.col("row")).alias("row"), "n")).alias("top")).select(F.col("bucket").alias("k"), (-F.col("top.row")).alias("head"), F.col("top.n").alias("hn")))
    members = saved(placed.join(heads, F.col("bucket") == F.col("k")).select("bucket", "row", "n", "head", "hn"))
    texts = saved(sk.select("row", "words").hint("merge").join(members.select("row").distinct(), "row", "left_semi"))

    fits = F.least("n", "hn") >= least * F.greatest("n", "hn") - 1e-9
    stars = members.where((F.col("row") != F.col("head")) & fits).select(F.least("head", "row").alias("a"), F.greatest("head", "row").alias("b")).distinct()
    first = saved(verified(stars, texts, least))
    comp = saved(components(first))

    def labelled(df: DataFrame, node: str, out: str) -> DataFrame:
        named = comp.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        return df.join(named, F.col(node) == F.col("_n"), "left").withColumn(out, F.coalesce("_c", node)).drop("_n", "_c")

    known = saved(labelled(labelled(members, "row", "c"), "head", "hc"))
    open_buckets = saved(known.where("c <> hc").groupBy("bucket").agg(F.count(F.lit(1)).alias("apart")).select(F.col("bucket").alias("ob")))
    second = None
    if open_buckets.limit(1).count():
        blocks = bucket_blocks(known, open_buckets, sk.select("row", "keys"), texts, least, block, block_words)
        second = saved(links_in_blocks(blocks, least))
        drop_saved(blocks)
    links = first if second is None else first.union(second)
    final = comp if second is None or not second.limit(1).count() else saved(components(links))
    near = final.where("node <> component").select(F.col("node").alias("row"), F.col("component").alias("rep"))
    # copies follow their representative
    named = near.select(F.col("row").alias("_r"), F.col("rep").alias("_c"))
    follow = copies.join(named, F.col("rep") == F.col("_r"), "left").select("row", F.coalesce("_c", "rep").alias("rep"))
    out = saved(near.union(follow))
    drop_saved(exact, copies, texts, rows, sizes, shared, central, placed, heads, members, first, known, open_buckets)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, bands: int = BANDS, pick: int = PICK, least: float = LEAST, block: int = BLOCK, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, class_id, kept, and row (the row's number), for every row of docs.

    class_id: smallest id among the rows that links connect with this one, itself included; rows are linked if their texts
    are equal or, being candidates, have an edit similarity of at least least. kept: the row is its class's first in the
    order of (id, row). Words are runs of bytes other than \\x20 and \\x09 to \\x0D with A-Z lower-cased. A text of fewer
    than k words is one shingle; texts without words link with equal texts only, null counting as empty. Null ids come
    after all others; a class of null ids has a null class_id. Rows may repeat. Other columns are ignored, whatever their
    names. An empty table gives an empty table.
    """
    row = free_name(docs, "dedup_row")
    d = with_row_number(docs, row).select(F.col(row).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sk = sketches(d, "text", "row", k, bands, pick)
    cls = classes(sk, least, block, block_words)
    drop_saved(sk)
    out = d.select("row", "doc_id").join(cls.select(F.col("row").alias("r"), "rep"), F.col("row") == F.col("r"), "left")
    out = saved(out.select("row", "doc_id", F.coalesce("rep", "row").alias("rep")))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    tops = saved(out.groupBy("rep").agg(F.min(order).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("rep").alias("top_rep"), F.col("top.doc_id").alias("class_id"), F.col("top.row").alias("top_row")))
    got = out.join(tops, F.col("rep") == F.col("top_rep"), "left")
    return got.select("row", "doc_id", F.when(F.col("top_rep").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), (F.col("top_rep").isNull() | (F.col("top_row") == F.col("row"))).alias("kept"))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with all their columns, of any name.

    Of each class the row with the smallest id stays, of equal ids the first by row number, null ids last; so null, empty
    and repeated texts leave one row, and an empty table an empty table.
    """
    row = free_name(docs, "dedup_row")
    gone = saved(near_duplicates(docs, **options).where("NOT kept").select(F.col("row").alias(row)))
    return with_row_number(docs, row).hint("merge").join(gone, row, "left_anti").select(*docs.columns)


__all__ = ["aligned", "band_keys", "keep_one_of_each", "labelled_shingles", "near_duplicates"]
