"""Sequence functions as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letters(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z]", "")


def clean(text: Column) -> Column:
    """Letters, upper-cased after all else is gone."""
    return F.upper(letters(text))


def reverse_complement(seq: Column) -> Column:
    """The complement strand backwards; letters other than A, C, G, T are skipped."""
    return F.translate(F.reverse(F.regexp_replace(seq, "[^ACGT]", "")), "ACGT", "TGCA")


def both_strands(seq: Column) -> Column:
    return F.concat(seq, reverse_complement(seq))


def mask(seq: Column) -> Column:
    """N becomes 1, which no target has, so that N never matches."""
    return F.translate(seq, "N", "1")


def flip_case(text: Column) -> Column:
    return F.translate(text, UPPER + LOWER, LOWER + UPPER)


def wrap(seq: Column, width: int = 60) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def characters(seq: Column) -> Column:
    """(pos, ch) structs to explode."""
    return F.transform(F.split(seq, ""), lambda c, i: F.struct(i.cast("long").alias("pos"), c.alias("ch")))


def adler32(text: Column) -> Column:
    """Adler-32 of ASCII text in closed form, folded over its bytes."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    both = F.aggregate(codes, F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), lambda s, x: F.struct(((s["a"] + x) % 65521).alias("a"), ((s["b"] + s["a"] + x) % 65521).alias("b")))
    return both["b"] * 65536 + both["a"]


def runs(text: Column, pattern: str) -> Column:
    """Pieces of text that match pattern, each maximal run one element, with all that lies between as elements too."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"({pattern}+|(?!{pattern}).)"), 1), lambda x: F.length(x) > 0)


def letter_counts(df: DataFrame, text: str) -> DataFrame:
    """ch, n for each of A to Z over all texts, either case; other characters don't count. One row a task is summed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(256, np.int64)
        for b in batches:
            for s in b[text].dropna():
                total += np.bincount(np.frombuffer(s.encode(), np.uint8), minlength=256)
        yield pd.DataFrame({"ch": list(UPPER), "n": [int(total[ord(u)] + total[ord(v)]) for u, v in zip(UPPER, LOWER, strict=True)]})

    return df.select(text).mapInPandas(run, "ch string, n long").groupBy("ch").agg(F.sum("n").alias("n"))


def kmer_counts(df: DataFrame, seq: str, k: int, piece: int = 1 << 20) -> DataFrame:
    """k (text), n of all stretches of k letters A to Z of upper-case sequences, by numbers of base 32; long sequences are counted in pieces. k is at most 12."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shifts = np.arange(k - 1, -1, -1) * 5

        def counted(texts: list[str]) -> Iterator[pd.DataFrame]:
            # a letter below A between sequences keeps stretches from running on
            a = np.frombuffer("@".join(texts).encode(), np.uint8).astype(np.int64) - 64
            m = max(0, len(a) - k + 1)
            key, whole = np.zeros(m, np.int64), np.ones(m, bool)
            for j in range(k):
                key = key << 5 | a[j : j + m]
                whole &= a[j : j + m] > 0
            codes, n = np.unique(key[whole], return_counts=True)
            if len(codes):
                names = ((codes[:, None] >> shifts & 31) + 64).astype(np.uint8).tobytes().decode()
                yield pd.DataFrame({"k": [names[i : i + k] for i in range(0, len(names), k)], "n": n})

        some, size = [], 0
        for b in batches:
            for s in b[seq].dropna():
                for i in range(0, max(1, len(s) - k + 1), piece):
                    some.append(s[i : i + piece + k - 1])
                    size += len(some[-1])
                    if size >= piece:
                        yield from counted(some)
                        some, size = [], 0
        if some:
            yield from counted(some)

    return df.select(seq).mapInPandas(run, "k string, n long").groupBy("k").agg(F.sum("n").alias("n"))


def stretch_keys(df: DataFrame, id_col: str, seq: str, k: int) -> DataFrame:
    """id, k: a 64-bit hash of each different stretch of k letters of each sequence, from sums over powers of an odd number."""
    base = np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, s in zip(b["i"], b["s"], strict=True):
                a = np.frombuffer((s or "").encode(), np.uint8).astype(np.uint64)
                n = max(0, len(a) - k + 1)
                h = np.zeros(n, np.uint64)
                for j in range(k):
                    h = h * base + a[j : j + n]
                    h ^= h >> np.uint64(31)
                if n:
                    yield pd.DataFrame({"id": i, "k": np.unique(h).view(np.int64)})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("i"), F.col(seq).alias("s")).mapInPandas(run, f"id {kind}, k long")


def _cased(upper: pd.Series, lengths: pd.Series, low: pd.Series) -> pd.Series:
    out = []
    for s, n, first in zip(upper, lengths, low, strict=True):
        if s is None or n is None:
            out.append(None)
            continue
        a = np.frombuffer(s.encode(), np.uint8)
        n = np.asarray(n, np.int64)
        turned = np.repeat(np.arange(len(n)) % 2 == (0 if first else 1), n)
        out.append((a + 32 * turned.astype(np.uint8)).tobytes().decode())
    return pd.Series(out)


def apply_case(upper: Column, lengths: Column, low: Column) -> Column:
    """Upper-case letters with their case from the lengths of its runs, which take turns; low: whether the first is lower case. In one pass."""
    return F.pandas_udf(_cased, "string")(upper, lengths, low)
