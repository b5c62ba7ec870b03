"""Embedding near duplicates by an epsilon grid order join.

Unit vectors within a distance of eps = sqrt(2 - 2 * cosine) of each other are sorted by the cells, eps wide, that they
fall in on their leading principal axes. Runs of this sequence are blocks; eight neighbouring blocks form a node, eight
nodes a node above, and so on. Starting from each group's top, pairs of nodes are joined with their children and kept
unless the boxes around their projections are provably more than eps apart; what is left at the bottom are pairs of
blocks, and these are compared vector by vector. A pair of blocks gives each vector's number of links and a forest that
connects what they connect, never a row for each link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_saved, free_name, saved, with_row_number
from .components import components
from .vectors import matrix, unscaled, valid_vectors

#: Vectors in a block, axes that the order uses, axes of the boxes, children of a node (as a power of two).
BLOCK, AXES, BOX, FAN = 512, 4, 12, 3


def principal_axes(vecs: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and axes (columns, leading first) of all unit vectors, shorter ones padded; sums meet in two steps."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            x = np.zeros((len(b), dim + 1))
            for i, v in enumerate(b["vec"]):
                v = unscaled(np.frombuffer(v, "<f8")[None])[0]
                x[i, : len(v)] = v / np.sqrt((v * v).sum())
            x[:, dim] = 1
            total += x.T @ x
        yield pd.DataFrame({"s": [total.tobytes()]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim + 1) ** 2)
        for b in batches:
            for s in b["s"]:
                total += np.frombuffer(s)
        yield pd.DataFrame({"s": [total.tobytes()]})

    parts = vecs.select("vec").mapInPandas(sums, "s binary")
    some = max(1, vecs.rdd.getNumPartitions() // 64)
    total = sum((np.frombuffer(r.s) for r in parts.repartition(some).mapInPandas(merge, "s binary").collect()), np.zeros((dim + 1) ** 2)).reshape(dim + 1, dim + 1)
    n = max(1.0, total[dim, dim])
    mean = total[dim, :dim] / n
    _, axes = np.linalg.eigh(total[:dim, :dim] / n - np.outer(mean, mean))
    return mean, axes[:, ::-1]


def make_blocks(vecs: DataFrame, eps: float, dim: int, size: int, axes: int, box: int) -> DataFrame:
    """Blocks in grid order: part, i, grp (label and length), dim, n, rows, copies, vecs, lo0.., hi0.. (projections' bounds)."""
    mean, base = principal_axes(vecs, dim)
    box, axes = min(box, dim), min(axes, dim)
    lead = base[:, :box]

    def project(b: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(b), box))
        for i, v in enumerate(b["vec"]):
            v = unscaled(np.frombuffer(v, "<f8")[None])[0]
            out[i] = (v / np.sqrt((v * v).sum()) - mean[: len(v)]) @ lead[: len(v)] - mean[len(v) :] @ lead[len(v) :]
        return out

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = project(b)
            for a in range(axes):
                b[f"c{a}"] = np.floor(p[:, a] / eps).astype(np.int32)
            yield b

    order = ["grp", *[f"c{a}" for a in range(axes)], "row"]
    placed = vecs.mapInPandas(cells, f"row long, grp string, dim int, copies long, vec binary, {', '.join(f'c{a} int' for a in range(axes))}")
    parts = int(vecs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, i = TaskContext.get().partitionId(), 0

        def block(b: pd.DataFrame) -> pd.DataFrame:
            p = project(b)
            row = {"part": part, "i": i, "grp": b["grp"].iloc[0], "dim": int(b["dim"].iloc[0]), "n": len(b), "rows": b["row"].to_numpy("<i8").tobytes(), "copies": b["copies"].to_numpy("<i8").tobytes(), "vecs": b"".join(b["vec"])}
            return pd.DataFrame([row | {f"lo{a}": p[:, a].min() for a in range(box)} | {f"hi{a}": p[:, a].max() for a in range(box)}])

        rest = None
        for b in batches:
            rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
            while len(rest):
                same = int((rest["grp"] != rest["grp"].iloc[0]).to_numpy().argmax()) or len(rest)
                if same == len(rest) and same < size:
                    break  # the group may go on
                take = min(same, size)
                yield block(rest.iloc[:take])
                i += 1
                rest = rest.iloc[take:]
        if rest is not None and len(rest):
            yield block(rest)

    bounds = ", ".join([f"lo{a} double" for a in range(box)] + [f"hi{a} double" for a in range(box)])
    return saved(ordered.mapInPandas(cut, f"part int, i int, grp string, dim int, n int, rows binary, copies binary, vecs binary, {bounds}"))


def near_pairs(thin: DataFrame, eps: float, box: int) -> DataFrame:
    """grp, a, b (a <= b): pairs of blocks of a group that are not provably apart. thin: grp, seq, lo0.., hi0...

    Descends a tree of nodes, FAN bits of the sequence number a level; each level is a written table of pairs.
    """
    total = thin.count()
    depth = 0
    while total >> (FAN * depth):
        depth += 1
    pairs = thin.select("grp").distinct().select("grp", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for level in range(depth - 1, -1, -1):
        nodes = thin.withColumn("node", F.shiftright("seq", FAN * level)).groupBy("grp", "node").agg(*[F.min(f"lo{x}").alias(f"lo{x}") for x in range(box)], *[F.max(f"hi{x}").alias(f"hi{x}") for x in range(box)]).withColumn("up", F.shiftright("node", FAN))
        nodes = saved(nodes)
        left = nodes.select(F.col("grp"), F.col("up").alias("a"), F.col("node").alias("na"), *[F.col(f"{s}{x}").alias(f"{s}a{x}") for s in ("lo", "hi") for x in range(box)])
        right = nodes.select(F.col("grp"), F.col("up").alias("b"), F.col("node").alias("nb"), *[F.col(f"{s}{x}").alias(f"{s}b{x}") for s in ("lo", "hi") for x in range(box)])
        gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"loa{x}") - F.col(f"hib{x}"), F.col(f"lob{x}") - F.col(f"hia{x}")), F.lit(2.0)) for x in range(box)), F.lit(0.0))
        after = saved(pairs.join(left, ["grp", "a"]).join(right, ["grp", "b"]).where((F.col("na") <= F.col("nb")) & (gap <= eps * eps)).select("grp", F.col("na").alias("a"), F.col("nb").alias("b")))
        drop_saved(pairs, nodes)
        pairs = after
    return pairs


def forest(mask: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and the columns of a matrix of links the number of one vector that they are connected with: a row's own number, or a column's plus the rows."""
    n, m = mask.shape
    rows, cols = np.arange(n), np.arange(m) if same else np.full(m, n + m)
    while True:
        new_cols = np.minimum(cols, np.where(mask, rows[:, None], n + m).min(axis=0))
        if same:
            new_cols = np.minimum(new_cols, rows)
        new_rows = np.minimum(rows, np.where(mask, new_cols[None, :], n + m).min(axis=1))
        if same:
            new_rows = new_cols = np.minimum(new_rows, new_cols)
        if (new_rows == rows).all() and (new_cols == cols).all():
            return rows, cols
        rows, cols = new_rows, new_cols


def links_of(blocks: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """row, links (copies counted), root (a row that it is connected with): at most one row for each vector and pair of blocks."""
    side = lambda s: blocks.select("grp", F.col("seq").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("rows", "copies", "vecs")], *([F.col("dim")] if s == "a" else []))
    both = pairs.join(side("a"), ["grp", "a"]).join(side("b"), ["grp", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for r in p.itertuples(index=False):
                x, y = unscaled(matrix(r.vecs_a, r.dim)), unscaled(matrix(r.vecs_b, r.dim))
                ids, jds = np.frombuffer(r.rows_a, "<i8"), np.frombuffer(r.rows_b, "<i8")
                cos = (x @ y.T) / (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :])
                mask = cos >= least
                if r.a == r.b:
                    mask |= mask.T
                    np.fill_diagonal(mask, False)
                if not mask.any():
                    continue
                f, g = forest(mask, r.a == r.b)
                links = mask @ np.frombuffer(r.copies_b, "<i8")
                at = np.flatnonzero(mask.any(axis=1))
                yield pd.DataFrame({"row": ids[at], "links": links[at], "root": ids[f[at]]})
                if r.a != r.b:
                    at = np.flatnonzero(mask.any(axis=0))
                    yield pd.DataFrame({"row": jds[at], "links": (np.frombuffer(r.copies_a, "<i8") @ mask)[at], "root": ids[g[at]]})

    return saved(both.select("a", "b", "dim", "rows_a", "copies_a", "vecs_a", "rows_b", "copies_b", "vecs_b").mapInPandas(run, "row long, links long, root long"))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of df.

    Vectors of equal labels and lengths whose cosine, in double precision, is at least least are linked. Null labels,
    and vectors that are null, empty, zero or hold null or non-finite components link with nothing. Equal vectors of a
    label are one vector until the end, counted as many. Rows may repeat; ids may be null (a component's id is its
    smallest id, null if it has none, and a row without one counts as kept). Other columns are ignored. An empty table
    gives an empty table.
    """
    row = free_name(df, "vec_row")
    numbered = with_row_number(df, row)
    vecs = saved(valid_vectors(numbered.where(F.col(label_col).isNotNull()), row, vec_col, {label_col: "label"}).withColumn("grp", F.concat_ws("\x1f", "label", F.col("dim").cast("string"))))
    everything = numbered.select(F.col(row).alias("row"), F.col(id_col).alias("vec_id"))
    same = saved(vecs.groupBy("grp", "dim", "vec").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies")))
    dim = same.agg(F.max("dim")).first()[0]
    if dim is None:
        return everything.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    eps = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-7
    box = min(BOX, dim)
    blocks = make_blocks(same.select("row", "grp", "dim", "copies", "vec"), eps, dim, block, AXES, box)
    counts = saved(blocks.groupBy("part").agg(F.count(F.lit(1)).alias("n")))  # a row for each partition of the sort
    base = saved(counts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base")))
    numbered_blocks = blocks.join(broadcast_if_small(base), "part").withColumn("seq", F.col("base") + F.col("i"))
    thin = numbered_blocks.select("grp", "seq", *[f"{s}{x}" for s in ("lo", "hi") for x in range(box)])
    pairs = near_pairs(thin, eps, box)
    found = links_of(numbered_blocks, pairs, least)
    drop_saved(blocks, counts, base, pairs)

    comp = saved(components(found.select(F.col("row").alias("a"), F.col("root").alias("b"))))
    sums = found.groupBy("row").agg(F.sum("links").alias("links"))
    own = same.select(F.col("row").alias("rep"), "copies", F.col("grp").alias("g"), F.col("vec").alias("v"))
    rows = vecs.join(own, (F.col("grp") == F.col("g")) & (F.col("vec") == F.col("v"))).select("row", "rep", "copies")
    rows = rows.join(sums.withColumnRenamed("row", "r1"), F.col("rep") == F.col("r1"), "left").join(comp, F.col("rep") == F.col("node"), "left")
    rows = saved(rows.select("row", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("comp")))
    named = saved(everything.join(rows.withColumnRenamed("row", "r2"), F.col("row") == F.col("r2"), "left").select("row", "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "comp"))
    tops = saved(named.where("comp IS NOT NULL").groupBy("comp").agg(F.min("vec_id").alias("top")).withColumnRenamed("comp", "c2"))
    out = named.join(tops, F.col("comp") == F.col("c2"), "left").withColumn("component_id", F.when(F.col("c2").isNull(), F.col("vec_id")).otherwise(F.col("top")))
    drop_saved(vecs, same, found, comp, rows)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
