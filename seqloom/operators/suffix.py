"""Suffix order, inverse, common prefixes, Burrows-Wheeler transform, longest matches.

Records are independent and short beside the table, so each is indexed whole where it lies, with arrays; one text too long
for a task is ordered by the distributed form, prefix doubling over ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def packed(a: np.ndarray) -> tuple[np.ndarray, int, int]:
    """For each place the next letters as one number, zeros beyond the end; how many letters that are, and bits for each."""
    values, letter = np.unique(a, return_inverse=True)
    bits = max(1, len(values).bit_length())
    h = max(1, 63 // bits)
    wide = np.zeros(len(a) + h, np.int64)
    wide[: len(a)] = letter + 1
    key, have = wide[: len(a) + h].copy(), 1
    while have < h:  # keys of twice as many letters, from two of the shorter ones
        step = min(have, h - have)
        ahead = np.zeros_like(key)
        ahead[: len(key) - step] = key[step:]
        if step < have:  # the last letters of what is there and the first of what follows overlap
            ahead &= (1 << bits * have) - 1
            key = (key << bits * step) | (ahead & ((1 << bits * step) - 1))
        else:
            key = (key << bits * step) | ahead
        have += step
    return key[: len(a)], h, bits


def suffix_array(s: bytes | np.ndarray, keys: tuple[np.ndarray, int, int] | None = None) -> np.ndarray:
    """Positions in suffix order; a suffix that is a prefix of another comes first. keys: packed(s).

    Sorted by packed letters, then by doubling, where only suffixes that still share their rank are sorted again.
    """
    a = np.frombuffer(s, np.uint8) if isinstance(s, bytes) else s
    n = len(a)
    if n < 2:
        return np.arange(n)
    key, h, _ = keys or packed(a)
    sa = np.argsort(key, kind="stable")
    k = key[sa]
    fresh = np.concatenate([[True], k[1:] != k[:-1]])
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(fresh, slots, 0))
    alone = fresh & np.append(fresh[1:], True)
    left = np.flatnonzero(~alone)
    while len(left):
        p = sa[left]
        there = p + h
        after = np.where(there < n, rank[np.minimum(there, n - 1)] + 1, 0)
        both = rank[p] * (n + 1) + after
        order = np.argsort(both, kind="stable")
        p, both = p[order], both[order]
        sa[left] = p
        fresh = np.concatenate([[True], both[1:] != both[:-1]])
        rank[p] = np.maximum.accumulate(np.where(fresh, left, 0))
        left = left[~(fresh & np.append(fresh[1:], True))]
        h *= 2
    return sa


def plcp_array(a: np.ndarray, sa: np.ndarray, keys: tuple[np.ndarray, int, int] | None = None) -> np.ndarray:
    """For each position the common prefix with the suffix before its own in order, 0 for the first suffix's.

    Only irreducible positions are compared, those whose letter before differs from that before their neighbour's; along
    the others the prefix is one shorter with each step. Compared are packed letters.
    """
    n = len(a)
    if not n:
        return np.zeros(0, np.int64)
    key, h, bits = keys or packed(a)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    irreducible = np.ones(n, bool)
    i = np.arange(1, n)
    q = phi[1:]
    irreducible[1:] = (q <= 0) | (a[i - 1] != a[np.maximum(q, 1) - 1])
    at = np.flatnonzero(irreducible)
    found = np.zeros(len(at), np.int64)
    todo = np.flatnonzero(phi[at] >= 0)
    while len(todo):
        p, q = at[todo] + found[todo], phi[at[todo]] + found[todo]
        inside = np.maximum(p, q) < n
        todo, p, q = todo[inside], p[inside], q[inside]
        differ = key[p] ^ key[q]
        # letters that are equal in front of the highest bit that differs
        high = np.frexp(differ.astype(np.float64))[1].astype(np.int64)  # its number from 1, or one more by rounding
        high -= (differ >> np.maximum(high - 1, 0) == 0) & (differ > 0)
        found[todo] += np.where(differ == 0, h, h - -(-high // bits))
        todo = todo[differ == 0]
    found = np.minimum(found, n - np.maximum(at, np.maximum(phi[at], 0)))
    found[phi[at] < 0] = 0
    run = np.cumsum(irreducible) - 1
    return (at + found)[run] - np.arange(n)


class Extensions:
    """Common prefixes of any two suffixes, by lifting over ranks of doubled lengths; as many levels as the longest repeat has binary digits."""

    def __init__(self, a: np.ndarray):
        self.n = n = len(a)
        self.levels, h, rank = [], 1, np.unique(a, return_inverse=True)[1].astype(np.int64) + 1
        while n:
            self.levels.append((h, np.append(rank, 0).astype(np.int32)))
            if h >= n or rank.max() == n:
                break
            after = np.zeros(n, np.int64)
            after[: n - h] = rank[h:]
            rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
            h *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix lengths of the suffixes at i and at j, elementwise; i and j must differ."""
        n, got = self.n, np.zeros(len(i), np.int64)
        for h, rank in reversed(self.levels):
            p, q = np.minimum(i + got, n), np.minimum(j + got, n)
            # equal ranks of h letters mean h equal letters only where h letters are left
            got += np.where((rank[p] == rank[q]) & (np.maximum(p, q) + h <= n), h, 0)
        return got


def lcp_array(s: bytes, sa: np.ndarray) -> np.ndarray:
    """Common prefix with the suffix before in order, 0 for the first."""
    return plcp_array(np.frombuffer(s, np.uint8), sa)[sa]


def nearest_before(values: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the last marked place before it (-1: none), and the least of values after that up to the place."""
    at = np.arange(len(values))
    last = np.maximum.accumulate(np.where(marked, at, -1))
    before = np.concatenate([[-1], last[:-1]])
    # one running minimum for all: each stretch between marked places lies below the one before
    stretch = np.concatenate([[0], np.cumsum(marked)[:-1]])
    step = int(values.max(initial=0)) + 1
    low = np.minimum.accumulate(values - stretch * step) + stretch * step
    return before, low


def longest_matches(target: bytes, reference: bytes, never: bytes = b"N1", mismatches: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Length and reference position of each target position's longest match.

    The neighbours in suffix order are those before and after; running minima of common prefixes give their lengths. The
    neighbour before wins ties; letters of never match nothing. With mismatches, each match found is extended beyond so
    many differing letters, which count in its length, as long as both texts last.
    """
    n, m = len(target), len(reference)
    length, where = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n or not m:
        return length, where
    joined = np.frombuffer(target + b"\x00" + reference, np.uint8).astype(np.int64)
    # letters that never match get values of their own
    odd = np.flatnonzero(np.isin(joined, np.frombuffer(never + b"\x00", np.uint8)))
    joined[odd] = 256 + np.arange(len(odd))
    keys = packed(joined)
    sa = suffix_array(joined, keys)
    lcp = plcp_array(joined, sa, keys)[sa]
    of_ref = sa > n
    rows = np.flatnonzero(sa < n)
    before, low = nearest_before(lcp, of_ref)
    # backwards, a suffix's common prefix with the one after it stands at the one after it
    after, high = nearest_before(np.append(lcp[1:], 0)[::-1], of_ref[::-1])
    after, high = len(sa) - 1 - after[::-1], high[::-1]
    for near, there, got in ((before, before >= 0, low), (after, after < len(sa), high)):
        at = rows[there[rows]]
        p = sa[at]
        better = got[at] > length[p]
        length[p[better]], where[p[better]] = got[at][better], sa[near[at[better]]] - n - 1
    if mismatches:
        ext = Extensions(joined)
    for _ in range(mismatches):
        p, q = np.arange(n) + length, where + length
        ok = np.flatnonzero((p < n) & (q < m))
        length[ok] += 1
        p, q = p[ok] + 1, q[ok] + n + 2
        length[ok] += ext.common(p, q)
    return length, where


def bwt(s: bytes) -> tuple[bytes, int]:
    """Last column of the suffixes' order with an end mark left out, and the row the mark was in."""
    sa = suffix_array(s)
    a = np.frombuffer(s, np.uint8)
    if not len(a):
        return b"", 0
    row = int(np.flatnonzero(sa == 0)[0])
    last = a[sa - 1]
    return bytes([a[-1]]) + np.delete(last, row).tobytes(), row + 1


def unbwt(last: bytes, row: int) -> bytes:
    n = len(last)
    if not n:
        return b""
    a = np.frombuffer(last, np.uint8)
    full = np.insert(a.astype(np.int64) + 1, row, 0)
    order = np.argsort(full, kind="stable").tolist()
    out, at, values = bytearray(), order[0], full.tolist()
    for _ in range(n):
        at = order[at]
        out.append(values[at] - 1)
    return bytes(out)


def unbwt_by_squaring(last: bytes, row: int) -> bytes:
    """unbwt() without a step for each letter: what is known of the path is carried on by as much again, with the square of the way so far."""
    n = len(last)
    if not n:
        return b""
    full = np.insert(np.frombuffer(last, np.uint8).astype(np.int64) + 1, row, 0)
    way = np.argsort(full, kind="stable")
    path = way[way[:1]]
    while len(path) < n:
        path = np.concatenate([path, way[path]])
        if len(path) < n:
            way = way[way]
    return (full[path[:n]] - 1).astype(np.uint8).tobytes()


def index_records(df: DataFrame, id_col: str, seq_col: str, want: str = "lcp") -> DataFrame:
    """For every suffix of every record: id, rank, pos (want: pos), and lcp (want: lcp); or id, pos, plcp (want: plcp). Null and empty records have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, s in zip(b[id_col], b["seq"], strict=True):
                a = np.frombuffer((s or "").encode(), np.uint8)
                if not len(a):
                    continue
                keys = packed(a)
                sa = suffix_array(a, keys)
                if want == "pos":
                    yield pd.DataFrame({id_col: i, "rank": np.arange(len(sa)), "pos": sa})
                    continue
                plcp = plcp_array(a, sa, keys)
                yield pd.DataFrame({id_col: i, "pos": np.arange(len(sa)), "plcp": plcp} if want == "plcp" else {id_col: i, "rank": np.arange(len(sa)), "pos": sa, "lcp": plcp[sa]})

    kind = df.schema[id_col].dataType.simpleString()
    columns = {"pos": "rank long, pos long", "lcp": "rank long, pos long, lcp long", "plcp": "pos long, plcp long"}[want]
    return df.select(id_col, F.col(seq_col).alias("seq")).mapInPandas(run, f"{id_col} {kind}, {columns}")


#: Letters of a block when a long text is packed.
BLOCK = 1 << 16


def packed_places(chars: DataFrame, letters: int = 10) -> DataFrame:
    """pos, key of each place of one text (pos, code): the next letters as one number, zeros beyond the end. Codes are 1 to 63.

    Blocks of the text are packed where they lie; each needs the first letters of the next ones, a row a block.
    """
    block = F.floor(F.col("pos") / BLOCK).cast("long")
    whole = chars.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("own"))
    heads = chars.where(F.col("pos") % BLOCK < letters).groupBy((block - 1).alias("b")).agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("next"))
    both = whole.join(heads, F.col("block") == F.col("b"), "left").select(F.col("own.pos").alias("pos"), F.col("own.code").alias("own"), F.col("next.code").alias("next"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for pos, own, after in zip(b["pos"], b["own"], b["next"], strict=True):
                a = np.zeros(len(own) + letters, np.int64)
                a[: len(own)] = own
                if after is not None:
                    a[len(own) : len(own) + len(after)] = after
                key = np.zeros(len(own), np.int64)
                for j in range(letters):
                    key = key << 6 | a[j : j + len(own)]
                yield pd.DataFrame({"pos": pos, "key": key})

    return both.mapInPandas(run, "pos long, key long")


def suffix_ranks(chars: DataFrame, rounds: int = 64, letters: int = 10, among: Column | None = None) -> DataFrame:
    """pos, rank of one text of any length, from its rows (pos, code): ranks of packed letters, then prefix doubling, each round a shuffle by rank and one by position.

    Codes are 1 to 63, positions without gaps from 0. Only suffixes whose rank is still shared are ranked again; each
    round's ranks are a checkpoint. among: a condition on pos; only such positions are ranked, among themselves. With a
    position all those that follow at multiples of letters must be among them.
    """
    from .scans import running

    keys = packed_places(chars, letters)
    keys = (keys if among is None else keys.where(among)).checkpoint()
    first = running(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")), ["key"], "n", "sum", "rank", exclusive=True)
    ranks = keys.join(first, "key").select("pos", F.col("rank").cast("long").alias("rank"), (F.col("n") > 1).alias("open")).checkpoint()
    h = letters
    for _ in range(rounds):
        if not ranks.where("open").limit(1).count():
            break
        ahead = ranks.select((F.col("pos") - h).alias("pos"), (F.col("rank") + 1).alias("r2"))
        asked = ranks.where("open").join(ahead, "pos", "left").select("pos", "rank", F.coalesce("r2", F.lit(0)).alias("r2"))
        counted = asked.groupBy("rank", "r2").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("rank").orderBy("r2").rowsBetween(Window.unboundedPreceding, 0)
        moved = counted.select(F.col("rank").alias("o"), F.col("r2").alias("q"), (F.col("rank") + F.sum("n").over(w) - F.col("n")).alias("new"), (F.col("n") > 1).alias("open2"))
        done = asked.join(moved, (F.col("rank") == F.col("o")) & (F.col("r2") == F.col("q"))).select("pos", F.col("new").alias("rank"), F.col("open2").alias("open"))
        ranks = ranks.where("NOT open").union(done).checkpoint()
        h *= 2
    return ranks.select("pos", "rank")


def common_to(chars: DataFrame, ranks: DataFrame, most: int, letters: int = 10) -> DataFrame:
    """rank, pos, before (position of the suffix before in order, null for the first), lcp up to most, for one text of any length.

    Common prefixes are read from packed letters, a join for each letters of them; only pairs that are still equal go on.
    """
    keys = packed_places(chars, letters).checkpoint()
    up = ranks.select((F.col("rank") + 1).alias("r"), F.col("pos").alias("before"))
    todo = ranks.join(up, F.col("rank") == F.col("r"), "left").select("rank", "pos", "before", F.lit(0).cast("long").alias("lcp"), F.col("before").isNotNull().alias("open")).checkpoint()
    done = []
    for at in range(0, most, letters):
        k1 = keys.select((F.col("pos") - at).alias("pos"), F.col("key").alias("k1"))
        k2 = keys.select((F.col("pos") - at).alias("before"), F.col("key").alias("k2"))
        pairs = todo.where("open").join(k1, "pos", "left").join(k2, "before", "left")
        shifts = F.array(*[F.lit(6 * (letters - 1 - j)) for j in range(letters)])
        # a letter counts if all before it are equal and it is none of the zeros beyond an end
        same = F.size(F.filter(shifts, lambda b: (F.call_function("shiftright", F.col("k1"), b) == F.call_function("shiftright", F.col("k2"), b)) & (F.call_function("shiftright", F.col("k1"), b).bitwiseAND(F.lit(63)) > 0)))
        step = F.when(F.col("k1").isNull() | F.col("k2").isNull(), 0).otherwise(same)
        after = pairs.select("rank", "pos", "before", (F.col("lcp") + step).alias("lcp"), (step == letters).alias("open")).checkpoint()
        done.append(todo.where("NOT open"))
        todo = after
    out = todo
    for x in done:
        out = out.union(x)
    return out.select("rank", "pos", "before", F.least("lcp", F.lit(most)).cast("long").alias("lcp"))


def three_way_rows(chars: DataFrame) -> DataFrame:
    """pos, third (pos mod 3), c0, c1, r1, r2: letters at and after each position, and ranks of the sampled suffixes one and two on (0 beyond the end).

    The sample is every position that 3 doesn't divide, ranked by packed letters and doubling.
    """
    ranked = suffix_ranks(chars, letters=9, among=F.col("pos") % 3 != 0).checkpoint()
    on = lambda k: ranked.select((F.col("pos") - k).alias("pos"), (F.col("rank") + 1).alias(f"r{k}"))
    own = ranked.withColumnRenamed("rank", "r0")
    c1 = chars.select((F.col("pos") - 1).alias("pos"), F.col("code").alias("c1"))
    rows = chars.withColumnRenamed("code", "c0").join(c1, "pos", "left").join(own, "pos", "left").join(on(1), "pos", "left").join(on(2), "pos", "left")
    return rows.select("pos", (F.col("pos") % 3).alias("third"), "c0", F.coalesce("c1", F.lit(0)).alias("c1"), "r0", F.coalesce("r1", F.lit(0)).alias("r1"), F.coalesce("r2", F.lit(0)).alias("r2")).checkpoint()


def three_way_order(chars: DataFrame) -> DataFrame:
    """pos, rank of one text by sampling two suffixes of three and merging in the rest.

    A suffix at a multiple of 3 compares with one at 1 mod 3 by a letter and the rank after it, with one at 2 mod 3 by
    two letters and the rank after them: two sorts give the numbers of each kind before it, and theirs of its own kind.
    """
    from .scans import running

    rows = three_way_rows(chars)
    kind = lambda k: (F.col("third") == k).cast("long")

    def counted(third: int, order: list[str]) -> DataFrame:
        some = rows.where(F.col("third").isin(0, third)).withColumn("zero", kind(0)).withColumn("other", kind(third))
        return running(running(some, [*order, "pos"], "zero", "sum", "zeros", exclusive=True), [*order, "pos"], "other", "sum", "others", exclusive=True)

    one, two = counted(1, ["c0", "r1"]), counted(2, ["c0", "c1", "r2"])
    from_two = two.where("third = 0").select("pos", F.col("others").alias("twos"))
    zeros = one.where("third = 0").join(from_two, "pos").select("pos", (F.col("zeros") + F.col("others") + F.col("twos")).alias("rank"))
    rest = one.where("third = 1").union(two.where("third = 2")).select("pos", (F.col("r0") + F.col("zeros")).alias("rank"))
    return zeros.union(rest).select("pos", F.col("rank").cast("long").alias("rank"))
