"""Vectors as rows of a table: validity, and blocks of them as binary columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame, row: str, vec_col: str, others: dict[str, str]) -> DataFrame:
    """row, the other columns under new names, dim, vec (little-endian doubles) of rows whose vector is not null, not zero, and all finite."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vecs = b.pop("vec")
            out, dims = [], []
            for v in vecs:
                x = np.zeros(0) if v is None else np.asarray(v, np.float64)
                good = len(x) > 0 and np.isfinite(x).all() and x.any()
                out.append(x.astype("<f8").tobytes() if good else None)
                dims.append(len(x))
            b["dim"], b["vec"] = np.array(dims, np.int32), out
            yield b[b["vec"].notna()]

    picked = df.select(F.col(row).alias("row"), *[F.col(c).cast("string").alias(n) for c, n in others.items()], F.when(~F.exists(F.col(vec_col), lambda x: x.isNull()), F.col(vec_col)).alias("vec"))
    return picked.mapInPandas(run, f"row long, {''.join(f'{n} string, ' for n in others.values())}dim int, vec binary")


def matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, dim)


def unscaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near one: exact, and safe from overflow."""
    _, e = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -e[:, None])
