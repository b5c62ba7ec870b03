"""Nearest neighbours by learned partitions.

From a bounded sample of a node's rows a graph of nearest neighbours is made and cut into equal parts with few edges
across; a small network learns which parts hold the neighbours of a vector. Every row of the node goes into its most
probable part; a query is routed to as many of its most probable parts as held-out rows of the sample need. The table is
the first node; parts with more than LEAF rows are nodes of their own, split in the same way by a network of their own,
so the number of parts follows the rows. Rows of the last parts are ranked by exact distance: rows lie in blocks of
bounded size, queries in chunks, and pairs of these are compared.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_saved, free_name, saved, with_row_number
from .vectors import matrix, valid_vectors

#: Rows that a node's model is fit on, about, and of them the queries that set the number of parts to probe.
SAMPLE, HELD_OUT = 8192, 512
#: Rows of the sample for each part; parts of a node; rows of a part that is split again; rows in a block; queries in a chunk.
ROWS_PER_PART, FAN, LEAF, BLOCK, CHUNK = 256, 32, 1 << 14, 1024, 256
#: Share of the held-out rows' neighbours in the sample that the probed parts must hold.
COVER = 0.98
#: Largest components beyond which squares are taken of scaled vectors.
LARGE, SMALL = 1e140, 1e-140


def knn(x: np.ndarray, q: np.ndarray, k: int, skip_self: bool) -> np.ndarray:
    """Indices of the k nearest rows of x for each row of q."""
    k = min(k, len(x) - skip_self)
    out = np.empty((len(q), k), np.int64)
    if not k:
        return out
    xx = (x * x).sum(1)
    for s in range(0, len(q), 512):
        d = xx[None, :] - 2 * q[s : s + 512] @ x.T
        if skip_self:
            d[np.arange(len(d)), s + np.arange(len(d))] = np.inf
        out[s : s + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_cut(x: np.ndarray, near: np.ndarray, parts: int, passes: int = 12) -> np.ndarray:
    """A part for each node of the neighbour graph, parts of equal size: halves along the leading axis, then the pairs of
    nodes of both halves whose exchange removes most edges across are exchanged, and so on in each half."""
    part = np.zeros(len(x), np.int64)
    sets = [np.arange(len(x))]
    while len(sets) < parts:
        after = []
        for nodes in sets:
            y = x[nodes] - x[nodes].mean(0)
            _, v = np.linalg.eigh(y.T @ y)
            side = np.zeros(len(x), np.int8) - 1
            order = nodes[np.argsort(y @ v[:, -1], kind="stable")]
            side[order[: len(order) // 2]], side[order[len(order) // 2 :]] = 0, 1
            src, dst = np.repeat(nodes, near.shape[1]), near[nodes].ravel()
            inside = side[dst] >= 0
            src, dst = src[inside], dst[inside]
            for _ in range(passes):
                across = np.where(side[src] != side[dst], 1, -1)
                gain = np.bincount(src, across, len(x)) + np.bincount(dst, across, len(x))
                a, b = nodes[side[nodes] == 0], nodes[side[nodes] == 1]
                a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
                n = min(len(a), len(b))
                swap = int((gain[a[:n]] + gain[b[:n]] > 0).sum()) // 2  # half of them: gains change with each exchange
                if not swap:
                    break
                side[a[:swap]], side[b[:swap]] = 1, 0
            after += [nodes[side[nodes] == 0], nodes[side[nodes] == 1]]
        sets = after
    for i, nodes in enumerate(sets):
        part[nodes] = i
    return part


class Router:
    """A network of one hidden layer: probabilities that a part holds a vector's neighbours."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 60, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), max(1e-300, float(x.std()))
        d, p = x.shape[1], target.shape[1]
        self.w = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, p)), np.zeros(p)]
        m, v, step = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), 128):
                at = order[s : s + 128]
                z, h, prob = self._forward(x[at])
                out = (prob - target[at]) / len(at)
                back = (out @ self.w[2].T) * (h > 0)
                step += 1
                for i, g in enumerate((z.T @ back, back.sum(0), h.T @ out, out.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] -= 2e-3 * (1 - epoch / epochs) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = (x - self.mean) / self.scale
        h = np.maximum(z @ self.w[0] + self.w[1], 0)
        e = h @ self.w[2] + self.w[3]
        e = np.exp(e - e.max(1, keepdims=True))
        return z, h, e / e.sum(1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[2]


    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, mean=self.mean, scale=self.scale, **{f"w{i}": w.astype(np.float32) for i, w in enumerate(self.w)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Router:
        self, z = cls.__new__(cls), np.load(io.BytesIO(data))
        self.mean, self.scale, self.w = z["mean"], float(z["scale"]), [z[f"w{i}"].astype(float) for i in range(4)]
        return self


def fit(x: np.ndarray, k: int, seed: int = 0) -> tuple[Router, int, int]:
    """Router, number of parts (two at least) and parts to probe, from a sample's vectors."""
    parts = 2
    while parts < FAN and len(x) >= 2 * parts * ROWS_PER_PART:
        parts *= 2
    unit = max(1e-300, float(np.abs(x).max(initial=0)))
    x = x / unit  # no overflow in squares
    held = min(HELD_OUT, len(x) // 8)
    q, x = x[:held], x[held:]
    near = knn(x, x, k, True)
    part = balanced_cut(x, near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1.0 / (near.shape[1] + 1))
    target[np.arange(len(x)), part] += 1.0 / (near.shape[1] + 1)
    router = Router(x, target, seed=seed)
    assigned, order = router(x).argmax(1), np.argsort(-router(q), axis=1, kind="stable")
    router.mean, router.scale = router.mean * unit, router.scale * unit
    if not held:
        return router, parts, parts
    place = np.empty_like(order)
    place[np.arange(held)[:, None], order] = np.arange(parts)
    rank = np.take_along_axis(place, assigned[knn(x, q, k, False)], axis=1)
    probes = next(m for m in range(1, parts + 1) if m == parts or (rank < m).mean() >= COVER)
    return router, parts, probes


def blocks_of(df: DataFrame, size: int, counts: DataFrame) -> DataFrame:
    """Rows of df packed by node into blocks of about size rows: node, salt, rows, ids, vecs (joined). counts: node, n of df."""
    salted = df.join(broadcast_if_small(counts.select(F.col("node").alias("cn"), F.ceil(F.col("n") / size).alias("b"))), F.col("node") == F.col("cn")).withColumn("salt", F.pmod(F.xxhash64("row"), "b").cast("int"))
    # a group's lists are of the same rows in the same order; a block is bounded by its size
    return saved(salted.groupBy("node", "salt").agg(F.collect_list("row").alias("rows"), F.collect_list("id").alias("ids"), F.collect_list("vec").alias("vecs")))


def counts_of(df: DataFrame) -> DataFrame:
    return saved(df.groupBy("node").agg(F.count(F.lit(1)).alias("n")))


def routers_of(rows: DataFrame, nodes: DataFrame, dim: int, k: int, seed: int, sample: int) -> DataFrame:
    """node, router, parts, probes for each of nodes (node, n); each is fit in a task of its own on about sample of its rows."""
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(1 << 30)) / float(1 << 30)
    some = rows.join(broadcast_if_small(nodes.select(F.col("node").alias("nn"), "n")), F.col("node") == F.col("nn")).where(draw < share).select("node", "row", "vec")

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("row")
        order = np.random.default_rng(seed).permutation(len(b))
        router, parts, probes = fit(matrix(b"".join(b["vec"]), dim)[order], k, seed)
        return pd.DataFrame({"node": [b["node"].iloc[0]], "router": [router.dump()], "parts": [parts], "probes": [probes]})

    return saved(some.groupBy("node").applyInPandas(run, "node long, router binary, parts int, probes int"))


def flat_rows(r, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.asarray(r.rows, np.int64), np.asarray(r.ids, np.int64), matrix(b"".join(r.vecs), dim)


ROWS = "row long, id long, vec binary, node long"


def deeper(rows: DataFrame, counts: DataFrame, routers: DataFrame, dim: int, queries: bool, k: int) -> DataFrame:
    """rows (row, id, vec, node) in the parts of their nodes: rows each in the most probable one, queries in as many as the node probes.

    A query's parts hold more than k rows if the node does. routers have for queries also sizes, the rows of each part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for r in p.itertuples(index=False):
                row, ids, x = flat_rows(r, dim)
                prob = Router.load(r.router)(x)
                if queries:
                    order = np.argsort(-prob, axis=1, kind="stable")
                    held = np.cumsum(np.asarray(r.sizes, np.int64)[order], axis=1)
                    need = np.maximum(r.probes, 1 + (held < k + 1).sum(1)).clip(max=r.parts)
                    at, part = np.repeat(np.arange(len(x)), need), np.concatenate([o[:m] for o, m in zip(order, need, strict=True)])
                else:
                    at, part = np.arange(len(x)), prob.argmax(1)
                vecs = list(r.vecs)
                yield pd.DataFrame({"row": row[at], "id": ids[at], "vec": [vecs[i] for i in at], "node": r.node * (FAN + 1) + 1 + part.astype(np.int64)})

    blocks = blocks_of(rows, BLOCK, counts).join(broadcast_if_small(routers.withColumnRenamed("node", "rn")), F.col("node") == F.col("rn"))
    return saved(blocks.select("node", "rows", "ids", "vecs", "router", "parts", "probes", *(["sizes"] if queries else [])).mapInPandas(run, ROWS))


def search(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 0, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of df where is_query holds, itself left out.

    score: Euclidean distance in double precision; ties go to the smaller id. Vectors that are null, empty, zero or hold
    null or non-finite components take no part, nor do rows with a null id or a length other than that of most rows (of
    equally common lengths the smallest). A repeated row is a candidate of its own; of equal vectors only the k + 1 with
    the smallest ids can be among the nearest, so no more are indexed. Vectors so large or small that squares leave the
    range of doubles are scaled by a power of two first. With fewer than k candidates all are found. Other columns are
    ignored, whatever their names. Without queries or candidates there are no rows.
    """
    spark = df.sparkSession
    row, mark = free_name(df, "vec_row"), free_name(df, "vec_query")
    d = with_row_number(df, row).withColumn(mark, F.coalesce(is_query, F.lit(False))).where(F.col(id_col).isNotNull())
    vecs = saved(valid_vectors(d, row, vec_col, {id_col: "id", mark: "query"}).select("row", F.col("id").cast("long").alias("id"), (F.col("query") == "true").alias("query"), "dim", "vec"))
    top = vecs.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = top.dim
    usable = vecs.where(F.col("dim") == dim)
    copy = F.row_number().over(Window.partitionBy("vec").orderBy("id", "row"))
    root = lambda x: x.select("row", "id", "vec", F.lit(0).cast("long").alias("node"))
    rows = saved(root(usable.withColumn("copy", copy).where(F.col("copy") <= k + 1)))
    asked = saved(root(usable.where("query")))
    counts = counts_of(rows)
    done_rows, done_asked, first = [], [], True
    while True:
        large = counts if first else counts.where(F.col("n") > leaf)
        if not large.limit(1).count():
            break
        routers = routers_of(rows, large, dim, k, seed, sample)
        nodes = large.select(F.col("node").alias("ln"))
        part_of = lambda x: x.join(broadcast_if_small(nodes), F.col("node") == F.col("ln"), "left_semi")
        if not first:
            rest = broadcast_if_small(nodes)
            done_rows.append(rows.join(rest, F.col("node") == F.col("ln"), "left_anti"))
            done_asked.append(asked.join(rest, F.col("node") == F.col("ln"), "left_anti"))
        rows, first = deeper(part_of(rows), large, routers, dim, False, k), False
        after = counts_of(rows)
        parent = F.floor((F.col("node") - 1) / (FAN + 1)).cast("long")
        each = after.select(parent.alias("up"), F.pmod(F.col("node") - 1, F.lit(FAN + 1)).alias("part"), "n").groupBy("up").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("of"))
        sizes = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.coalesce(F.try_element_at("of", i.cast("long")), F.lit(0)))
        routers = saved(routers.join(each, F.col("node") == F.col("up")).withColumn("sizes", sizes).drop("up", "of"))
        mine = part_of(asked)
        asked = deeper(mine, counts_of(mine), routers, dim, True, k)
        # a node whose rows all went to one part is not split again: its vectors are too much alike
        stuck = after.join(large.select(F.col("node").alias("pn"), F.col("n").alias("before")), parent == F.col("pn")).where(F.col("n") > 0.9 * F.col("before")).select(F.col("node").alias("sn"))
        counts = saved(after.join(stuck, F.col("node") == F.col("sn"), "left_anti"))
    data, queries = rows, asked
    for x in done_rows:
        data = data.union(x)
    for x in done_asked:
        queries = queries.union(x)
    data, queries = (blocks_of(x, size, counts_of(x)) for x, size in ((data, BLOCK), (queries, CHUNK)))
    pairs = data.select("node", F.col("salt").alias("a")).join(queries.select("node", F.col("salt").alias("b")), "node")
    side = lambda t, s: t.select("node", F.col("salt").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("rows", "ids", "vecs")])
    both = pairs.join(side(data, "a"), ["node", "a"]).join(side(queries, "b"), ["node", "b"])

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for r in p.itertuples(index=False):
                x, q = matrix(b"".join(r.vecs_a), dim), matrix(b"".join(r.vecs_b), dim)
                rows, ids = np.asarray(r.rows_a, np.int64), np.asarray(r.ids_a, np.int64)
                q_rows, q_ids = np.asarray(r.rows_b, np.int64), np.asarray(r.ids_b, np.int64)
                yield nearest(x, rows, ids, q, q_rows, q_ids, k)

    found = both.select("rows_a", "ids_a", "vecs_a", "rows_b", "ids_b", "vecs_b").mapInPandas(rank, "q_row long, query_id long, vec_id long, row long, score double")
    best = F.row_number().over(Window.partitionBy("q_row").orderBy("score", "vec_id", "row"))
    drop_saved(vecs)
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(x: np.ndarray, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, q_rows: np.ndarray, q_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of x for each row of q by exact distance, ties to smaller ids."""
    most = max(np.abs(x).max(), np.abs(q).max())
    unit = 1.0
    if most > LARGE or most < SMALL:  # a power of two: scaling is exact
        unit = 2.0 ** np.floor(np.log2(most))
        x, q = x / unit, q / unit
    xx, qq = (x * x).sum(1), (q * q).sum(1)
    rough = xx[None, :] + qq[:, None] - 2 * q @ x.T
    rough[q_rows[:, None] == rows[None, :]] = np.inf
    margin = 1e-12 * (qq[:, None] + xx.max())
    kth = np.partition(rough, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1 : min(k, len(x))]
    i, j = np.nonzero((rough <= kth + margin) & np.isfinite(rough))
    exact = np.sqrt(((q[i] - x[j]) ** 2).sum(1)) * unit
    order = np.lexsort((ids[j], exact, i))
    i, j, exact = i[order], j[order], exact[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    ok = place < k
    return pd.DataFrame({"q_row": q_rows[i[ok]], "query_id": q_ids[i[ok]], "vec_id": ids[j[ok]], "row": rows[j[ok]], "score": exact[ok]})
