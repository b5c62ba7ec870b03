"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

A document's weight is the ratio of its probability under the target model (documents labelled good) to that under the raw
model (all documents); the k largest of log weight + Gumbel noise are a sample without replacement in proportion to the
weights. Log ratios of buckets are whole numbers of 2^-20, so a document's sum is the same in any order, and noise comes
from a hash of the row. Texts are read twice, to count and to score; what is scored is written beside its key.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved
from .packing import chunks

BUCKETS = 1 << 15
#: Labelled rows used at most, those with the smallest hash; the classifier's documented bound.
MAX_LABELS = 50_000
#: Log ratios are whole numbers of 1 / UNIT.
UNIT = 1 << 20
TOKEN = re.compile(r"\w+|[^\w\s]+")


class Hasher:
    """Buckets of a text's words and punctuation runs and of its pairs of neighbours; equal neighbours are one bucket."""

    def __init__(self, cache: int = 300_000):
        self.seen: dict[str, int] = {}
        self.cache = cache

    def __call__(self, text: str) -> np.ndarray:
        tokens = TOKEN.findall(text)
        if not tokens:
            return np.zeros(0, np.int64)
        seen = self.seen
        try:
            h = np.fromiter(map(seen.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            if len(seen) > self.cache:
                seen.clear()
            for t in set(tokens):
                if t not in seen:
                    seen[t] = zlib.crc32(t.encode())
            h = np.fromiter(map(seen.__getitem__, tokens), np.int64, len(tokens))
        a, b = h[:-1], h[1:]
        pair = np.where(a == b, 1, ((a * 0x9E3779B1 + b) >> 7) & 0x7FFFFFFF) % BUCKETS
        return np.concatenate([h % BUCKETS, pair])


def _counts(docs: DataFrame, id_col: str, text_col: str, good: frozenset) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of the documents labelled good, and of all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, target, raw = Hasher(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            ids, texts = b["d"], b["t"].fillna("")
            for s in chunks(texts):
                for d, t in zip(ids.iloc[s], texts.iloc[s], strict=True):
                    c = np.bincount(hasher(t), minlength=BUCKETS)
                    raw += c
                    if d in good:
                        target += c
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": at, "target": target[at], "raw": raw[at]})

    rows = docs.select(F.col(id_col).cast("string").alias("d"), F.col(text_col).alias("t")).mapInPandas(run, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).collect()
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        target[r.bucket], raw[r.bucket] = r.target, r.raw
    return target, raw


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target over raw probability of each bucket, add-one smoothed, in units of 2^-20."""
    p, q = (target + 1) / (target.sum() + BUCKETS), (raw + 1) / (raw.sum() + BUCKETS)
    return np.rint(np.log(p / q) * UNIT).astype(np.int64)


def gumbel(seed: int, d: object, text: str) -> float:
    """Gumbel noise from a hash of seed, id and text."""
    a = zlib.crc32(f"{seed}\x1f{d}\x1f".encode())
    b = zlib.crc32(text.encode(), a)
    u = ((a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1
    return -float(np.log(-np.log(((u >> 11) + 0.5) / (1 << 53))))


def keys_of(hasher: Hasher, table: np.ndarray, seed: int, ids: list, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Log ratio and key of each row; ids are the ids' texts."""
    texts = ["" if t is None else t for t in texts]
    ratio = np.array([table[hasher(t)].sum() for t in texts], np.int64) / UNIT
    return ratio, ratio + np.array([gumbel(seed, d, t) for d, t in zip(ids, texts, strict=True)], float)


def kth_largest(keys: DataFrame, k: int, n: int) -> float:
    """The k-th largest of column key, exactly: histograms of a shrinking interval, then the few rows left."""
    if k >= n:
        return float("-inf")
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    above, bins = 0, 1024
    for _ in range(12):
        inside = keys.where((F.col("key") >= lo) & (F.col("key") <= hi))
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            return lo
        found = inside.groupBy(F.least(F.lit(bins - 1), F.floor((F.col("key") - lo) / width)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("bin")).collect()
        for r in found:
            if above + r.n >= k:
                break
            above += r.n
        lo, hi = r.lo, r.hi
        if lo == hi:
            return lo
    return lo


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = MAX_LABELS) -> tuple[np.ndarray, float]:
    """Log ratios of the buckets, and the share of good rows among the labelled (1 without labels)."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("string").alias("d"), (F.col(label_col) > 0).alias("good")).orderBy(F.xxhash64("d"), "d", "good").limit(max_labels).collect()
    good = frozenset(r.d for r in rows if r.good)
    share = sum(r.good for r in rows) / len(rows) if rows else 1.0
    return log_ratios(*_counts(docs, id_col, text_col, good)), share


def threshold(keys: DataFrame, share: float) -> float:
    """The key from which on rows are kept: that of row number round(share * rows) in falling order. keys: column key."""
    n = keys.count()
    return kth_largest(keys, round(n * share), n)


def with_keys(docs: DataFrame, table: np.ndarray, seed: int, id_col: str, text_col: str, columns: list[str]) -> DataFrame:
    """Those columns of docs, log_ratio and key of every row, written once: a struct doc keeps the columns' names apart."""
    kept = docs.select(F.struct(*columns).alias("doc"), F.col(id_col).cast("string").alias("d"), F.col(text_col).alias("t"))
    schema = T.StructType([kept.schema["doc"], T.StructField("log_ratio", T.DoubleType()), T.StructField("key", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            ratio, key = keys_of(hasher, table, seed, b.column(1).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ratio, pa.float64()), pa.array(key, pa.float64())], names=["doc", "log_ratio", "key"])

    return saved(kept.mapInArrow(run, schema))


def classify(docs: DataFrame, labels: DataFrame, seed: int = 0, share: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_ratio, key, kept for each row of docs.

    kept: the row is in the sample of round(share * rows) rows with the largest keys (share: by default that of good
    rows among the labelled); rows that tie with the last one are kept too, so equal rows share their fate. A null text
    is empty and has log ratio 0. Labels of unknown or null ids and null labels don't count; without labels the models
    are the same smoothed counts and all rows are kept. Other columns are ignored. An empty table gives an empty table.
    """
    table, good = fit(docs, labels, id_col, text_col)
    keys = with_keys(docs, table, seed, id_col, text_col, [id_col])
    least = threshold(keys.select("key"), good if share is None else share)
    return keys.select(F.col("doc").getField(id_col).alias("doc_id"), "log_ratio", "key", (F.col("key") >= F.lit(least)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, seed: int = 0, share: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns, of any name.

    Texts are scored once and written with their keys; no text is shuffled. Null and empty texts, ties, repeated rows and
    missing labels count as they do there; an empty table gives an empty table.
    """
    table, good = fit(docs, labels, id_col, text_col)
    keys = with_keys(docs, table, seed, id_col, text_col, docs.columns)
    least = threshold(keys.select("key"), good if share is None else share)
    return keys.where(F.col("key") >= F.lit(least)).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
