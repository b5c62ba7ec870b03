"""Operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import json
import math
import pathlib
import random
import re
import types
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqloom.llm import ann, components, grid_join, gru, html_extract, lm_score, mixing, near_dedup, packing, quality, queries, url_filter, warc

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in ["n", "r", "st", "l", "", "x"]]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def save(spark, tmp_path, rows, schema, name="t"):
    """As a table read from files, in several of them."""
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path := str(tmp_path / name))
    return spark.read.parquet(path)


DOCS = "doc_id long, text string, source string, size string, row string, target double"


@pytest.fixture()
def docs(spark, tmp_path):
    rows = [(i, prose(i % 37, 20 + i % 60), f"s{i % 5}" if i % 7 else None, "x", None, 1.0) for i in range(120)]
    rows += [(None, prose(1, 30), "s1", None, None, None), (None, None, None, None, None, None), (500, "", "s2", None, None, None), (501, " \t\n ", "s2", None, None, None), (7, prose(7, 27), "s2", None, None, None), (7, prose(7, 27), "s2", None, None, None), (502, prose(99, 30000), "s3", None, None, None), (503, "One", "only", None, None, None)]
    return save(spark, tmp_path, rows, DOCS)


def empty(spark, tmp_path, schema=DOCS):
    return save(spark, tmp_path, [], schema, "empty")


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_pack_is_the_stream_of_whole_texts(spark, tmp_path, docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    got = packing.pack(docs, path, window=256).collect()
    ids = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        ids[(r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [2]))] += 1
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.sequence_id].append((r.offset, r.length))
    total = sum(len(k[1]) * n for k, n in ids.items())
    for s, p in pieces.items():
        p.sort()
        assert [a for a, _ in p] == [sum(x for _, x in p[:i]) for i in range(len(p))]
        assert sum(x for _, x in p) == (256 if s < max(pieces) else total - 256 * max(pieces))
    # every piece's checksum is one of its document's, and every id lies in one piece
    want, have = collections.Counter(), collections.Counter((r.doc_id, r.doc_tokens) for r in got for _ in range(r.length))
    for (d, x), n in ids.items():
        want[(d, len(x))] += n * len(x)
    assert have == want
    for r in got:
        own = [x for (d, x) in ids if d == r.doc_id and len(x) == r.doc_tokens]
        assert r.ids_crc32 in {zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in own}
    assert packing.pack(empty(spark, tmp_path), path).count() == 0


def test_tokenizer_cache_keeps_odd_white_space_and_special_strings():
    path = queries.tokenizer_path()
    t = packing.CachedTokenizer(path, cache_words=4)
    texts = ["a\x1cb\u00a0c\u2003d", "<|endoftext|> it's  E\u0301 \u0301x", "x\x0by\x0cz\x85w", "", "1234 !!! |"]
    for _ in range(2):
        for text, got in zip(texts, t.encode(texts, 2), strict=True):
            assert np.frombuffer(got, t.dtype).tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids + [2]


def test_tokenizer_cache_over_all_letters_and_marks():
    """Words of every letter, number and combining mark, with marks after them, against the tokenizer."""
    import unicodedata

    t = packing.CachedTokenizer(queries.tokenizer_path())
    odd = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LNM"]
    r = random.Random(1)
    common = [c for c in odd if ord(c) < 0x3000]
    words = [r.choice(["", "a", "Ab"]) + c + r.choice(list(".,;:!?%$#&*|")) for c in common] + [c + "!" for c in r.sample(odd, 4000)] + ["GELD\u0130!", "DEK\u0130.", "TAR\u0130H\u0130,"]
    for _ in range(20000):
        words.append("".join(r.choice([r.choice("aE\u0130\u0131i"), r.choice(common), r.choice(".,!?'\"-|")]) for _ in range(r.randrange(1, 6))))
    got = t.encode(words, 2)
    want = t.tokenizer.encode_batch(words, add_special_tokens=False)
    assert [w for w, g, e in zip(words, got, want, strict=True) if np.frombuffer(g, t.dtype).tolist() != e.ids + [2]] == []


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            target.update({s: level * w[s] for s in open_})
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_targets_and_takes(spark, tmp_path, docs):
    got = mixing.mix(docs, shard=400, group=4).select("doc_id", "text", "source", "size", "source_size", "target", "taken").collect()
    assert len(got) == docs.count()
    sizes = collections.Counter()
    for r in got:
        assert r.size == n_words(r.text) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
    want, took = brute_targets(sizes), collections.Counter()
    for r in got:
        took[r.source] += r.taken
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12)
    for s in sizes:
        assert abs(took[s] - want[s]) <= max(mixing.BLOCK * 3, 0.05 * want[s])
    again = mixing.mix(docs, shard=400, group=4).select("doc_id", "text", "source", "size", "source_size", "target", "taken").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert mixing.mix(empty(spark, tmp_path)).count() == 0


def test_mixed_documents_are_what_mix_takes(docs):
    options = {"shard": 400, "group": 4}
    taken = sum(r.taken for r in mixing.mix(docs, **options).select("taken").collect())
    out = mixing.mixed_documents(docs, **options)
    assert out.columns == docs.columns
    rows = out.select("doc_id", "text").collect()
    assert sum(n_words(r.text) for r in rows) == taken
    whole = {}
    for r in docs.select("doc_id", "text").collect():
        whole.setdefault(r.doc_id, []).append((r.text or "").split())
    for r in rows:
        w = r.text.split()
        assert any(w == x[i : i + len(w)] for x in whole[r.doc_id] for i in range(len(x) - len(w) + 1))


CLASHES = ["_s", "_end", "_quota", "_copy", "_row", "_sha1", "_bytes", "_rounds", "row", "doc", "copy", "rounds", "src", "h", "shard", "new_text", "mix_row", "payload_digest", "digest", "revisit", "top_row", "run", "first", "dedup_row", "rep", "class_id", "kept"]


def test_clashing_columns_pass_through(spark, tmp_path):
    extra = {c: f"own {c}" for c in CLASHES}
    rows = [(i, prose(i, 30), f"s{i % 2}", f"http://h/{i}\n{i}", *extra.values()) for i in range(12)]
    d = save(spark, tmp_path, rows, "doc_id long, text string, source string, url string, " + ", ".join(f"{c} string" for c in CLASHES))
    whole = {r.doc_id: r.asDict() for r in d.collect()}
    mixed = mixing.mix(d)
    assert mixed.columns == [*d.columns, *mixing.ADDED]
    for r in mixed.collect():
        assert {k: r[k] for k in d.columns} == whole[r.doc_id] and r.size == 30
    for out in (mixing.mixed_documents(d), near_dedup.keep_one_of_each(d), quality.keep_good(d, spark.createDataFrame([], "doc_id long, quality int"))):
        assert out.columns == d.columns
        assert all({k: v for k, v in r.asDict().items() if k != "text"} == {k: v for k, v in whole[r.doc_id].items() if k != "text"} for r in out.collect())
    read = warc.read_bundles(warc.write_bundles(d, "doc_id", "url", "text")).collect()
    assert {(int(r.page_id), r.url, r.payload.decode()) for r in read} == {(i, w["url"], w["text"]) for i, w in whole.items()}
    assert packing.pack(d, queries.tokenizer_path()).count() == 12


def test_repeated_and_wordless_rows_spread_over_shards(spark, tmp_path):
    rows = [(None, None, None)] * 50 + [(1, "same words here", "s")] * 90 + [(2, "", "s")] * 20
    d = save(spark, tmp_path, rows, "doc_id long, text string, source string")
    got = mixing.mix(d, shard=30).collect()
    assert len(got) == 160 and all(r.taken <= 2 * r.size for r in got)
    assert abs(sum(r.taken for r in got) - 405) <= 16
    assert mixing.plan(d.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("id"), "source", "text"), 0, (5, 2, 1), 1.5, 2.0, 8, 30, 1024).count() == 160


def test_sainte_lague_is_highest_quotients(spark):
    r = random.Random(3)
    rows = [(g, i, r.choice([0, 1, 5, 5, 1000, r.randrange(10**6)])) for g in range(6) for i in range(1 + 9 * g)]
    seats = {g: r.randrange(300) for g in range(6)}
    df = spark.createDataFrame([(g, i, float(v), seats[g]) for g, i, v in rows], "g int, i int, v double, seats long")
    got = {(x.g, x.i): x.won for x in mixing.sainte_lague(df, ["g"], F.col("seats"), "v", ["i"], "won").collect()}
    for g in range(6):
        own = [(i, v) for h, i, v in rows if h == g]
        if not any(v for _, v in own):
            continue
        quotients = sorted(((-v / (2 * k + 1), i, k) for i, v in own if v for k in range(seats[g])))[: seats[g]]
        won = collections.Counter(i for _, i, _ in quotients)
        assert {i: got[(g, i)] for i, _ in own} == {i: won[i] for i, _ in own}


def test_quality_keeps_the_largest_keys(spark, tmp_path):
    junk = lambda i: " ".join(w.upper() + "!!" for w in prose(i, 40).split())
    rows = [(i, junk(i) if i % 5 == 0 else prose(i, 40), "s", "k", "r", 0.0) for i in range(200)] + [(None, None, None, None, None, None), (1000, "", None, None, None, None)] + [(2001, prose(1, 40), None, None, None, None)] * 3
    d = save(spark, tmp_path, rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 200, 3)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(d, labels).collect()
    assert len(got) == len(rows)
    share = sum(i % 5 != 0 for i in range(0, 200, 3)) / len(range(0, 200, 3))
    k = round(len(rows) * share)
    least = sorted((r.key for r in got), reverse=True)[k - 1]
    assert all(r.kept == (r.key >= least) for r in got)
    assert sum(r.kept for r in got if r.doc_id is not None and r.doc_id < 200 and r.doc_id % 5) >= 155
    assert sum(r.kept for r in got if r.doc_id is not None and r.doc_id < 200 and r.doc_id % 5 == 0) <= 12
    assert len({(r.key, r.kept) for r in got if r.doc_id == 2001}) == 1
    kept = quality.keep_good(d, labels)
    assert kept.schema == d.schema
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r.doc_id for r in got if r.kept)
    assert quality.classify(empty(spark, tmp_path), labels).count() == 0
    assert quality.keep_good(d, labels.limit(0)).count() == len(rows)


def test_quality_scores_of_each_row_by_hand(spark, sf):
    """Counts, ratios and noise of a whole table, document by document in plain code."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}

    def buckets(text):
        tokens = re.findall(r"\w+|[^\w\s]+", text or "")
        h = [zlib.crc32(t.encode()) for t in tokens]
        return [x % quality.BUCKETS for x in h] + [(1 if a == b else ((a * 0x9E3779B1 + b) >> 7) & 0x7FFFFFFF) % quality.BUCKETS for a, b in zip(h, h[1:], strict=False)]

    target, raw = collections.Counter(), collections.Counter()
    for r in docs:
        raw.update(own := buckets(r.text))
        if labels.get(r.doc_id):
            target.update(own)
    weight = {i: round(math.log((target[i] + 1) / (target.total() + quality.BUCKETS) / ((raw[i] + 1) / (raw.total() + quality.BUCKETS))) * quality.UNIT) for i in raw}
    want = {r.doc_id: sum(weight[i] for i in buckets(r.text)) / quality.UNIT for r in docs}
    got = queries.op4_importance_resampling(spark, sf).collect()
    assert len(got) == len(docs)
    text = {r.doc_id: r.text or "" for r in docs}
    for r in got:
        assert math.isclose(r.log_ratio, want[r.doc_id], abs_tol=2e-6 * (len(text[r.doc_id]) + 1))
        assert math.isclose(r.key, r.log_ratio + quality.gumbel(0, r.doc_id, text[r.doc_id]), rel_tol=1e-12)
    k = round(len(docs) * sum(x > 0 for x in labels.values()) / len(labels))
    assert sum(r.kept for r in got) == k and min(r.key for r in got if r.kept) > max(r.key for r in got if not r.kept)


def test_quality_ratio_by_hand():
    h = quality.Hasher()
    assert len(h("a b, a a")) == 9 and len(h("")) == 0
    t, r = np.bincount(h("a b"), minlength=quality.BUCKETS), np.bincount(np.concatenate([h("a b"), h("c c")]), minlength=quality.BUCKETS)
    w = quality.log_ratios(t, r)
    at = h("a")[0]
    assert math.isclose(w[at] / quality.UNIT, math.log((2 / (3 + quality.BUCKETS)) / (2 / (6 + quality.BUCKETS))), abs_tol=1e-6)


def test_kth_largest(spark):
    r = random.Random(5)
    v = [r.choice([0.0, 1.5, r.gauss(0, 9), 1e9]) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in v], "key double")
    for k in (1, 2, 250, 499, 500):
        assert quality.kth_largest(df, k, 501) == sorted(v, reverse=True)[k - 1]


def cosine_truth(rows, least=0.98):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    x = [None if v is None or not v or None in v or not np.isfinite(v).all() or not np.any(v) or label is None else np.array(v, float) / np.abs(v).max() for _, v, label in rows]
    for i in range(len(rows)):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= least:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    comp = {i: min((rows[j][0] for j in g if rows[j][0] is not None), default=None) for g in groups.values() for i in g}
    return collections.Counter((rows[i][0], links[i], comp[i], comp[i] == rows[i][0]) for i in range(len(rows)))


@pytest.mark.parametrize("block", [4, 64])
def test_grid_join_is_all_pairs(spark, tmp_path, block):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 6))
    rows = [(i, (centres[i % 12] * 3 + r.normal(size=6) * 0.25).tolist(), int(i % 3) if i % 11 else None) for i in range(150)]
    rows += [(200, None, 1), (201, [0.0] * 6, 1), (202, [float("nan")] + [1.0] * 5, 1), (203, [None] + [1.0] * 5, 1), (204, [1.0, 2.0], 1), (205, [1.0, 2.0], 1), (5, rows[5][1], 2), (206, rows[5][1], 2), (207, [1e300] * 6, 0), (208, [1e-300] * 6, 0), (209, [], 0)]
    df = save(spark, tmp_path, [(*x, "clash") for x in rows], "vec_id long, embedding array<double>, label int, grp string")
    got = grid_join.near_duplicates(df, block=block).collect()
    assert collections.Counter(map(tuple, got)) == cosine_truth(rows)
    assert grid_join.near_duplicates(df.limit(0)).count() == 0


def test_search_recall_and_distances(spark, tmp_path):
    r = np.random.default_rng(2)
    centres = r.normal(size=(30, 16)) * 2
    rows = [(i, (centres[i % 30] + r.normal(size=16)).tolist()) for i in range(3000)]
    odd = [(4000, None), (4100, [0.0] * 16), (4200, [float("inf")] * 16), (4300, [1.0, 2.0]), (None, [1.0] * 16), (4500, [None] * 16), (4600, [])]
    df = save(spark, tmp_path, [(*x, 1) for x in rows + odd], "vec_id long, embedding array<double>, row int")
    got = ann.search(df, F.col("vec_id") % 100 == 0).collect()
    x = np.array([v for _, v in rows])
    by = collections.defaultdict(list)
    for g in got:
        by[g.query_id].append(g)
        assert math.isclose(g.score, np.sqrt(((x[g.query_id] - x[g.vec_id]) ** 2).sum()), rel_tol=1e-12) and g.query_id != g.vec_id
    assert set(by) == set(range(0, 3000, 100))
    hits = 0
    for q, own in by.items():
        own.sort(key=lambda g: g["rank"])
        assert [g["rank"] for g in own] == list(range(1, 11)) and [(g.score, g.vec_id) for g in own] == sorted((g.score, g.vec_id) for g in own)
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len({g.vec_id for g in own} & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 300
    for n in (1, 2, 3, 4, 9):
        few = ann.search(df.where(f"vec_id < {n}"), F.col("vec_id") == 0).collect()
        assert sorted(g.vec_id for g in few) == list(range(1, n)) and sorted(g["rank"] for g in few) == list(range(1, n))
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def recall(spark, folder, **options):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = collections.defaultdict(set)
    for g in ann.search(df, F.col("vec_id") % 100 == 0, **options).collect():
        got[g.query_id].add(g.vec_id)
    rows = [r for r in df.collect() if r.embedding is not None and np.isfinite(r.embedding).all() and np.any(r.embedding)]
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    hits = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        hits, total = hits + len(best & got[ids[i]]), total + len(best)
    return hits / total


@pytest.mark.parametrize("options", [{}, {"leaf": 60, "sample": 200}])
@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_search_recall_on_whole_tables(spark, table, options):
    """Also with parts so small that nodes are split twice and more."""
    assert recall(spark, f"/root/testdata/{table}", **options) >= 0.9


def test_search_of_copies_and_extreme_vectors(spark, tmp_path):
    r = np.random.default_rng(5)
    x = [*(r.normal(size=(60, 4)) * 1e200), *[np.full(4, 3e200)] * 300, *[np.full(4, 1e-200)] * 3]
    rows = [(i, v.tolist(), "clash", "clash") for i, v in enumerate(x)]
    df = save(spark, tmp_path, rows, "vec_id long, embedding array<double>, node string, vec string")
    got = collections.defaultdict(list)
    for g in ann.search(df, F.col("vec_id").isin(0, 100, 200, 361), leaf=50, sample=64).collect():
        got[g.query_id].append((g["rank"], g.vec_id, g.score))
    assert [v for _, v, _ in sorted(got[100])] == list(range(60, 70)) and {s for _, _, s in got[100]} == {0.0}
    assert [v for _, v, _ in sorted(got[200])] == list(range(60, 70))
    for q in (0, 361):
        for _, v, s in got[q]:
            assert math.isclose(s, float(np.sqrt((((x[q] - x[v]) / 1e200) ** 2).sum()) * 1e200), rel_tol=1e-9) or s < 1e-190
        assert len(got[q]) == 10


def test_balanced_cut_is_balanced_and_cuts_less_than_chance():
    r = np.random.default_rng(0)
    x = r.normal(size=(1024, 8))
    near = ann.knn(x, x, 5, True)
    part = ann.balanced_cut(x, near, 8)
    assert np.bincount(part).tolist() == [128] * 8
    assert (part[near] == part[:, None]).mean() > 0.4


def edit_similarity(a, b):
    """Words equal in order over the longer length, by dynamic programming."""
    x, y = (t.encode().lower().split() for t in (a, b))
    row = [0] * (len(y) + 1)
    for i in x:
        new = [0]
        for j, v in enumerate(y):
            new.append(row[j] + 1 if v == i else max(row[j + 1], new[j]))
        row = new
    return row[-1] / max(len(x), len(y)) if x and y else 0.0


def copies_and_passages(r):
    texts, family = [], []
    for i in range(25):
        w = prose(1000 + i, r.choice([3, 8, 40, 90])).split()
        texts.append(" ".join(w))
        family.append(i)
        for _ in range(r.randrange(5)):
            v = list(w)
            for _ in range(r.randrange(3) if len(w) > 8 else 0):
                v[r.randrange(len(v))] = r.choice(WORDS)
            if len(w) > 8 and r.random() < 0.3:
                v.insert(r.randrange(len(v)), "zz")
            w = v if r.random() < 0.5 else w  # chains too
            texts.append(" ".join(v))
            family.append(i)
    passage = prose(77, 60)
    for i in range(8):
        texts.append(f"{prose(2000 + i, 150)} {passage}")
        family.append(100 + i)
    return texts, family


@pytest.mark.parametrize("block", [3, 256])
def test_near_duplicates_are_links_of_edit_similarity(spark, tmp_path, block):
    texts, family = copies_and_passages(random.Random(9))
    odd = ["a a a a a a a a a a", "a a a a a a a a a a a", "", "", "  ", "A B c d e f", "a b C d e  f", "\u0130x b c d e f"]
    rows = [(i, t, None, None, None, None) for i, t in enumerate(texts + odd)] + [(None, None, None, None, None, None), (None, texts[0], None, None, None, None), (3, texts[3], None, None, None, None)]
    d = save(spark, tmp_path, rows, DOCS)
    got = near_dedup.near_duplicates(d, block=block).collect()
    assert len(got) == len(rows)
    truth = {}
    for i, (_, a, *_rest) in enumerate(rows):
        for j in range(i):
            if (a or "") == (rows[j][1] or "") or edit_similarity(a or "", rows[j][1] or "") >= 0.8:
                truth.setdefault(i, set()).add(j)
                truth.setdefault(j, set()).add(i)
    # classes are unions of true links: inside a class every member is reached by true links
    ids = collections.defaultdict(set)
    for i, x in enumerate(rows):
        ids[x[0]].add(i)
    of = {x.doc_id: x.class_id for x in got if x.doc_id is not None}
    found = collections.defaultdict(set)
    for d_id, c in of.items():
        found[c] |= ids[d_id]
    for members in found.values():
        seen, todo = set(), [min(members)]
        while todo:
            i = todo.pop()
            seen.add(i)
            todo += truth.get(i, set()) & (members | ids[None]) - seen
        assert seen - ids[None] == members
    together = [(i, j) for i in range(len(texts)) for j in range(i) if family[i] == family[j]]
    assert sum(of[i] == of[j] for i, j in together) >= 0.9 * len(together)
    assert of[len(texts) + 2] == of[len(texts) + 3] and of[len(texts) + 5] == of[len(texts) + 6]
    assert sum(x.kept for x in got) == len(found)
    assert all(c == min(rows[i][0] for i in members) for c, members in found.items())
    assert sorted(x.class_id for x in got if x.doc_id is None) == sorted([of[0], of[len(texts) + 2]])
    kept = near_dedup.keep_one_of_each(d, block=block)
    assert kept.columns == d.columns and kept.count() == len(found)
    assert near_dedup.near_duplicates(empty(spark, tmp_path)).count() == 0


def test_a_bucket_of_many_classes_loses_no_link():
    """block_links over the blocks of one bucket of 400 members against all pairs."""
    r = random.Random(8)
    texts = []
    for i in range(100):
        w = [r.randrange(1, 2**31) for _ in range(r.choice([30, 60, 90]))]
        for _ in range(4):
            v = list(w)
            for _ in range(r.randrange(8)):
                v[r.randrange(len(v))] = r.randrange(1, 2**31)
            texts.append(np.array(v, "<u4"))
    n = len(texts)
    keys = np.full((n, 2), 7, np.int64)
    side = lambda at: (np.array(at), np.array(at), [texts[i] for i in at], keys[at])
    parts = [list(range(k, n, 5)) for k in range(5)]
    links = [x for i, p in enumerate(parts) for x in near_dedup.block_links(side(p), None, 7, 0.8) + [y for q in parts[i + 1 :] for y in near_dedup.block_links(side(p), side(q), 7, 0.8)]]

    def groups(pairs):
        parent = list(range(n))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in pairs:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(n)]

    want = [(i, j) for i in range(n) for j in range(i) if near_dedup.aligned(texts[i], texts[j]) > 0]
    assert groups(links) == groups(want) and len(set(groups(want))) >= 100


def test_aligned_is_the_longest_common_subsequence_in_the_band():
    r = random.Random(4)
    for _ in range(400):
        n = r.randrange(1, 60)
        a = [r.randrange(12) for _ in range(n)]
        b = [x if r.random() < 0.93 else r.randrange(12) for x in a if r.random() < 0.95]
        if r.random() < 0.5 and len(b) > 3:
            i = r.randrange(len(b) - 2)
            b[i], b[i + 2] = b[i + 2], b[i]
        b += r.sample(range(60, 70), r.randrange(3))
        s = edit_similarity(" ".join(map(str, a)), " ".join(map(str, b)))
        got = near_dedup.aligned(np.array(a, "<u4"), np.array(b, "<u4"))
        assert math.isclose(got, s) if s >= 0.8 else got == 0


def test_components(spark):
    r = random.Random(6)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in list(parent)}


PAGES = "page_id long, url string, html string, host string, text string"


def test_urls_against_plain_code(spark, tmp_path):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?q#f", "http://example.net/en/", "http://example.net/enx", "http://x.net", "http://x.net?y", "https://sub.example.com/de/1", "https://example.com.evil/de/", "https://w.org/fr/1", "https://worg/fr/", "x://y://z/a", "http://ÄB.net/#", "https://www.cheap-pills.example.com/en/1", "https://blog.ththan.example.com/en/1", "http://a\nb.net/c\nd?e"]
    df = save(spark, tmp_path, [(i if i else None, u, None, "clash", None) for i, u in enumerate(urls)], PAGES)
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = url_filter.plain_split(u or "")
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        g = got[i if i else None]
        assert (g.host, g.path, g.rule) == (host, path, max(fit)[1] if fit else None)
        assert g.verdict == (max(fit)[2] if fit else "block" if g.score >= 0.5 else "allow")
    assert got[14].verdict == "block" and got[15].verdict == "allow"
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_url_model_on_held_out_hosts():
    rows = url_filter.labelled_urls()
    right = 0
    hosts = sorted({url_filter.plain_split(u)[0] for u, _ in rows})
    for fold in range(4):
        out = set(hosts[fold::4])
        w, b = url_filter.train([r for r in rows if url_filter.plain_split(r[0])[0] not in out])
        for u, y in rows:
            if url_filter.plain_split(u)[0] in out:
                g = url_filter.grams(*url_filter.plain_split(u))
                right += ((w[g].sum() / np.sqrt(len(g)) + b) >= 0) == bool(y)
    assert right / len(rows) > 0.85


def test_url_scores_are_the_model_s(spark, sf):
    w, b = url_filter.train(url_filter.labelled_urls())
    for r in queries.op6_url_ngrams(spark, sf).collect():
        g = {zlib.crc32(f"{m}{t[i : i + n]}".encode()) % url_filter.BUCKETS for m, t in (("h", f"^{r.host}$"), ("p", f"^{r.path.lower()}$")) for n in url_filter.LENGTHS for i in range(len(t) - n + 1)}
        z = sum(w[i] for i in g) / math.sqrt(max(1, len(g))) + b
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_warc_round_trip(spark, tmp_path):
    big = "ä" * 600
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, "u", "y" * 1000), (7, "u", "y" * 1000), (None, "u", "y" * 1000), (8, "u", None), (8, "u", ""), (9, "a b\r\nc: d", "WARC/1.1\r\n\r\n"), (7, "u", "y" * 1000), (10, "u", "z" * 300000)]
    df = save(spark, tmp_path, [(*r, "clash", None) for r in rows], PAGES)
    bundles = warc.write_bundles(df, frame_bytes=2000, bundle_bytes=300)
    got = warc.read_bundles(bundles).collect()
    want = collections.Counter()
    top = {}
    for p, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if p is None else p)
    seen = set()
    for p, _, h in sorted(rows, key=lambda r: r[0] or 0):
        data = (h or "").encode()
        again = len(data) >= 1000 and (p != top[h or ""] or (p, h) in seen)
        seen.add((p, h))
        want[(None if p is None else str(p), len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", str(top[h or ""]) if again else None)] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    index = {r.record_id: r for r in warc.record_index(bundles).collect()}
    stored = {r.bundle_id: bytes(r.bundle) for r in bundles.collect()}
    assert len(stored) > 1
    import io

    import zstandard

    for r in got:
        at = index[r.record_id]
        head, payload = warc.read_at(stored[at.bundle_id], at.frame, at.offset)
        assert payload == bytes(r.payload) and head["X-Page-ID"] == json.dumps(r.page_id)
    plain = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(b), read_across_frames=True).read() for b in stored.values())
    assert plain.count(b"WARC-Record-ID: ") == len(rows)
    warc.export(bundles, str(tmp_path / "files"))
    assert sum(1 for _ in (tmp_path / "files").iterdir()) == len(stored)
    assert warc.read_bundles(warc.write_bundles(df.limit(0))).count() == 0


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{x:"</p>"}</style><script>var t="</p><article>";</script></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">buy</div><article><h1>Head &amp; more</h1><p><b>One  two.<br><p>Three&nbsp;<i>fo</i>ur &lt;x&gt;</p><aside>side</aside><div class="comments"><p>mine</p></div><form>f<input>g</form><p>five</article><footer>&copy; foot</footer></body>'


def kept_text(page):
    return [t for place, t in html_extract.blocks(page) if place != "e"]


def test_blocks_of_pages():
    assert [t for place, t in html_extract.blocks(PAGE) if place == "m"] == ["Head & more", "One two.", "Three four <x>", "five"]
    assert html_extract.blocks("") == []
    assert html_extract.blocks("<p>a<p>b<div>c</div>d") == [("l", "a"), ("l", "b"), ("l", "c"), ("l", "d")]
    assert kept_text("<article>cut off <b>he") == ["cut off he"]
    assert kept_text("a < b <p title='x>y'>c") == ["a < b", "c"]
    assert kept_text("<div>x" * 3000) == ["x"] * 3000
    for own in ('<p class="share-price">t</p>', '<p class="notice-board">t</p>', '<div class="related-work">t</div>', '<section id="ad-hoc">t</section>', "<article><header><h1>t</h1></header></article>", '<p data-id="comment">t</p>', '<article class="header">t</article>'):
        assert kept_text(own) == ["t"], own
    for own in ("title-card", "style-guide", "script-x", "template-x"):
        assert kept_text(f"<{own}>a</{own}><p>rest of the page</p>") == ["a", "rest of the page"]
    for other in ('<div class="ad">t</div>', '<div class="cookie-notice">t</div>', '<ul id="reader-comments">t</ul>', '<div class="left-sidebar">t</div>', "<footer>t</footer>", "<article><footer>t</footer></article>", "<form>t</form>", '<div role="navigation">t</div>', "<p hidden>t</p>"):
        assert kept_text(other) == [], other


def test_nesting_costs_no_more_than_its_depth():
    import time

    def took(n):
        began = time.process_time()
        html_extract.blocks("<div><span>x" * n)
        return time.process_time() - began

    took(1000)
    assert took(32000) < 32 * max(took(4000), 0.02)


def brute_extract(rows, depth, share, least):
    """Texts by counting every run of depth tokens over the distinct streams of each host."""
    pages = {i: html_extract.blocks(h or "") for i, (_, _, h, *_rest) in enumerate(rows)}
    host = {i: (re.search("://([^/?#]*)", rows[i][1] or "") or [None, ""])[1].lower() for i in pages}
    streams = {i: " ".join(t for place, t in pages[i] if place != "m").split() for i in pages}
    by_host = collections.defaultdict(set)
    for i, s in streams.items():
        if s:
            by_host[host[i]].add(("\n".join(t for place, t in pages[i] if place != "m"), tuple(s)))
    out = {}
    for i, blocks in pages.items():
        own = [s for _, s in by_host[host[i]]]
        n = collections.Counter(g for s in own for g in {s[k : k + depth] for k in range(len(s) - depth + 1)})
        need = max(least, math.ceil(share * len(own)))
        t = tuple(streams[i])
        gone = {k + j for k in range(len(t) - depth + 1) if n[t[k : k + depth]] >= need for j in range(depth)}
        at, left = 0, []
        for place, text in blocks:
            words = text.split() if place != "m" else []
            if place == "l":
                text = " ".join(w for k, w in enumerate(words) if at + k not in gone)
            if place != "e" and text:
                left.append(text)
            at += len(words)
        out[i] = "\n".join(left)
    return out


@pytest.mark.parametrize("chunk", [40, 1 << 20])
def test_extract_removes_what_hosts_repeat(spark, tmp_path, chunk):
    line = "this very long line is found on every page of the host"
    shared = prose(500, 30)
    rows = [(i, f"http://h/{i}", f"<body><div>{line}</div><p>{prose(i, 12)}</p><p>{shared if i % 5 == 0 else prose(90 + i, 9)}</p><nav>{shared if i == 3 else prose(i % 2, 12)}</nav><div>{line} again</div></body>", None, None) for i in range(12)]
    rows += [(20 + i, "http://copies/", f"<p>{prose(600, 40)}</p>", None, None) for i in range(5)]  # copies are one page
    rows += [(30 + i, "http://two/", f"<p>{prose(601, 40)} {i}</p>", None, None) for i in range(2)]  # two pages are too few
    rows += [(10, "http://other/", f"<body><p>{line}</p></body>", None, None), (11, "http://h/x", f"<article><p>{line}</p></article>", None, None), (12, None, None, "x", "y"), (13, "http://h/", "", None, None), (None, "broken", PAGE, "x", None)]
    df = save(spark, tmp_path, rows, PAGES)
    got = collections.Counter((r.page_id, r.text) for r in html_extract.extract(df, chunk=chunk).collect())
    want = brute_extract(rows, html_extract.DEPTH, html_extract.SHARE, html_extract.PAGES)
    assert got == collections.Counter((rows[i][0], t) for i, t in want.items())
    texts = {rows[i][0]: t for i, t in want.items()}
    assert line not in texts[0] and shared not in texts[0] and texts[10] == line and texts[11] == line and texts[12] == "" and texts[13] == "" and texts[20] == prose(600, 40) and texts[31].endswith(" 1")
    assert html_extract.extract(df.limit(0)).count() == 0


def test_extract_of_a_whole_table_is_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    want = brute_extract(rows, html_extract.DEPTH, html_extract.SHARE, html_extract.PAGES)
    got = queries.op2_host_suffix_array(spark, sf).collect()
    assert {(r.page_id, r.url, r.text, r.n_chars) for r in got} == {(rows[i][0], rows[i][1], t, len(t)) for i, t in want.items()}


def test_suffix_classes_are_the_sorted_prefixes():
    r = random.Random(3)
    for depth in (1, 2, 3, 8):
        streams = [[r.choice("abc") for _ in range(r.randrange(25))] for _ in range(9)]
        order, page, first = html_extract.suffix_classes(streams, depth)
        starts = np.cumsum([0] + [len(s) + 1 for s in streams])
        prefixes = [tuple(streams[p][o - starts[p] : o - starts[p] + depth]) for o, p in zip(order, page, strict=True)]
        every = collections.Counter(tuple(s[i : i + depth]) for s in streams for i in range(len(s) - depth + 1))
        assert collections.Counter(prefixes) == every
        assert [prefixes[i] for i in first] == list(dict.fromkeys(prefixes)) and len(first) == len(every)
        for least in (1, 2, 4):
            want = {html_extract.run_key(list(g)) for g in every if sum(any(tuple(s[i : i + depth]) == g for i in range(len(s) - depth + 1)) for s in streams) >= least}
            assert set(html_extract.candidate_runs(streams, least, depth)) == want


def test_gru_gradients_and_probabilities():
    r = np.random.default_rng(0)
    m = gru.Gru(np.array([9, 5, 3, 2, 1, 1, 1.0]), hidden=4, width=3, classes=3, seed=1)
    m.flat += r.standard_normal(m.flat.shape).astype(np.float32) * 0.3
    tokens, mask, h = r.integers(0, 7, (5, 3)), np.ones((5, 3), bool), np.zeros((3, 4), np.float32)
    mask[3:, 1] = False
    g = m._views(m.window(tokens, mask, h)[1], m.shapes)
    for k, v in m.p.items():
        flat = v.reshape(-1)
        for i in r.integers(0, v.size, 4):
            old = flat[i]
            flat[i] = old + 1e-2
            up = m.window(tokens, mask, h)[0]
            flat[i] = old - 1e-2
            down = m.window(tokens, mask, h)[0]
            flat[i] = old
            assert abs((up - down) / 2e-2 - g[k].reshape(-1)[i]) < 2e-3
    every = m.log_prob(np.repeat(r.standard_normal((1, 4)).astype(np.float32), 7, 0), np.arange(7))
    assert math.isclose(np.exp(every).sum(), 1, rel_tol=1e-5)
    docs = [r.integers(0, 7, n) for n in (1, 40, 3, 77, 40)]
    together = m.score(docs, room=64)
    for d, s in zip(docs, together, strict=True):
        h, total = np.zeros((1, 4), np.float32), 0.0
        for t in d:
            total += m.log_prob(h, np.array([t]))[0]
            h = m.step(m.gates()[[t]], h)[0]
        assert math.isclose(s, total, rel_tol=1e-4)
    learner = gru.Gru(np.array([1, 1, 1, 1.0]), hidden=8, width=4, classes=2)
    seqs = [np.arange(i, i + 60) % 4 for i in range(64)]
    before = learner.score(seqs).sum()
    for s in range(8):
        learner.train(seqs * 4, 0.02, lanes=16, seed=s)
    assert learner.score(seqs).sum() > 0.3 * before


def test_gru_windows_keep_their_memory():
    """Arrays of a window are not handed back and faulted in again: that was a quarter of the time of training."""
    import subprocess
    import sys

    code = """
import resource
import numpy as np
from seqloom.llm import gru
r = np.random.default_rng(0)
m = gru.Gru(np.sort(r.integers(1, 1000, 4096))[::-1])
segments = [r.integers(0, 4096, 128) for _ in range(512)]
faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
m.train(segments, 1e-3, lanes=256)
m.score(segments * 8)
before = faults()
m.train(segments, 1e-3, lanes=256)
between = faults()
m.score(segments * 8)
print((between - before) / 16, (faults() - between) / 64)
"""
    root = str(pathlib.Path(gru.__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env={"PYTHONPATH": root, "OMP_NUM_THREADS": "1"}, capture_output=True, text=True, check=True, timeout=120).stdout
    assert all(float(x) < 100 for x in out.split()), out  # pages a window


def test_gru_gradient_is_that_of_plain_steps():
    """Every weight's gradient and the last state, lanes that end in the window too, against the steps written out row by row in double precision."""
    r = np.random.default_rng(4)
    m = gru.Gru(np.array([90, 50, 30, 20, 11, 7, 5, 3, 1.0]), hidden=5, width=3, classes=4, seed=2)
    m.flat += r.standard_normal(m.flat.shape).astype(np.float32) * 0.3
    tokens, h0 = r.integers(0, 9, (6, 4)), r.standard_normal((4, 5)).astype(np.float32) * 0.5
    mask = np.arange(6)[:, None] < np.array([6, 2, 4, 6])
    p, n = {k: v.astype(np.float64) for k, v in m.p.items()}, m.hidden
    g = {k: np.zeros_like(v) for k, v in p.items()}
    loss, last = 0.0, []
    for j in range(4):
        kept, h = [], h0[j].astype(np.float64)
        for t in tokens[mask[:, j], j]:
            hs, k = np.append(h, 1), m.of[t]
            own = slice(m.first[k], m.first[k + 1])
            a, o = np.exp(hs @ p["wc"]), np.exp(p["wo"][own] @ hs)
            a, o = a / a.sum(), o / o.sum()
            loss -= np.log(a[k]) + np.log(o[t - m.first[k]])
            a[k] -= 1
            o[t - m.first[k]] -= 1
            g["wc"] += np.outer(hs, a)
            g["wo"][own] += np.outer(o, hs)
            out = (p["wc"] @ a + p["wo"][own].T @ o)[:n]
            x, s = p["emb"][t] @ p["wx"][:-1] + p["wx"][-1], h @ p["wh"]
            z, q = (1 / (1 + np.exp(-(x[i * n : i * n + n] + s[i * n : i * n + n]))) for i in (0, 1))
            c = np.tanh(x[2 * n :] + q * s[2 * n :])
            kept.append((t, h, out, z, q, c, s[2 * n :]))
            h = c + z * (h - c)
        last.append(h)
        d = np.zeros(n)
        for t, h, out, z, q, c, u in reversed(kept):
            dc = d * (1 - z) * (1 - c * c)
            dx = np.concatenate([d * (h - c) * z * (1 - z), dc * u * q * (1 - q), dc])
            ds = np.concatenate([dx[: 2 * n], dc * q])
            g["wh"] += np.outer(h, ds)
            g["wx"][:-1] += np.outer(p["emb"][t], dx)
            g["wx"][-1] += dx
            g["emb"][t] += p["wx"][:-1] @ dx
            d = d * z + p["wh"] @ ds + out
    got = m.window(tokens, mask, h0)
    assert math.isclose(got[0], loss / mask.sum(), rel_tol=1e-5) and np.allclose(got[2], last, atol=1e-5)
    for k, v in m._views(got[1], m.shapes).items():
        assert np.allclose(v, g[k] / mask.sum(), atol=1e-5), k
    m.p["wo"][:, :n] = m.p["wc"][:n] = 3000  # logits beyond 80 are cut, and nothing overflows
    with np.errstate(all="raise", under="ignore"):
        high = m.window(tokens, mask, np.abs(h0))
    assert np.isfinite(high[0]) and np.isfinite(high[1]).all()
    nothing = m.window(tokens, np.zeros_like(mask), h0)
    assert nothing[0] == 0 and not nothing[1].any() and np.array_equal(nothing[2], h0)


@pytest.mark.parametrize("head", [5, lm_score.HEAD])
def test_lm_score_base_and_totals(spark, tmp_path, docs, head, monkeypatch):
    monkeypatch.setattr(lm_score.Lexicon.__init__, "__defaults__", (head, 40))
    got = lm_score.score(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) + ["\0"]
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = collections.Counter(w for r in rows if not out(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if r.doc_id is None else r.doc_id, out(r.doc_id), len(tokens(r.text)), sum(w in c for w in tokens(r.text)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(r.text)), 6)) for r in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_lm_training_visits_every_token_once(spark, tmp_path, docs, monkeypatch):
    visited, averaged = [], lm_score.averaged

    def spy(parts, replicas):
        visited.append(parts.agg(F.sum("n")).first()[0])
        return averaged(parts, replicas)

    monkeypatch.setattr(lm_score, "averaged", spy)
    all_tokens = lm_score.score(docs).first().train_tokens
    assert sum(visited) == all_tokens > 0 and len(visited) == lm_score.ROUNDS


def test_lm_training_is_one_pass_on_small_tables(spark, tmp_path, docs, monkeypatch):
    rounds, visits, replica_round = [], [], lm_score.replica_round
    monkeypatch.setattr(lm_score, "replica_round", lambda shared, *a: rounds.append(a) or replica_round(shared, *a))
    lm_score.score(docs).count()
    monkeypatch.setattr(gru.Gru, "train", lambda self, segments, *a, **b: visits.append(len(segments)))
    freq = np.array([2.0, 1.0])
    shared = types.SimpleNamespace(value=(freq, gru.Gru(freq).get()))
    own = pd.DataFrame({"tokens": [np.zeros(3, "<u2").tobytes()] * 2, "n": [3, 3], "h": [1, 2]})
    for a in rounds:
        replica_round(shared, *a)(own)
    assert visits == [2] * lm_score.ROUNDS


@pytest.mark.parametrize("between", list(" \t\n\v\f\r"))
def test_lm_segments_are_whole_for_every_separator(spark, tmp_path, between):
    words = prose(3, 300).split()
    texts = save(spark, tmp_path, [(1, "1", False, between.join(words)), (2, "2", False, between.join(words[:256])), (3, "3", False, None)], "row long, d string, held_out boolean, t string")
    lex = lm_score.Lexicon(lm_score.count_words(texts.select("t")))
    got = lm_score.segments(lm_score.tokenized(texts, spark.sparkContext.broadcast(lex))).collect()
    assert sorted(r.n for r in got) == [1, 1, 45, 128, 128, 128, 128]


@pytest.mark.parametrize("head", [3, lm_score.HEAD])
def test_lm_score_of_each_row_by_plain_steps(spark, tmp_path, docs, head, monkeypatch):
    """Each word's probability: its token's, class by class, after the words before it, times its share of its kind."""
    kept = {}
    monkeypatch.setattr(lm_score.Lexicon.__init__, "__defaults__", (head, 40))
    train = lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda parts, lex, seed: kept.setdefault("model", train(parts, lex, seed)))
    got = lm_score.score(docs).collect()
    m = kept["model"]
    rows = docs.select("doc_id", "text").collect()
    c, end = collections.Counter(), 0
    for r in rows:
        if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2:
            c.update((r.text or "").encode().lower().split())
            end += 1
    known = sorted(c, key=lambda w: (-c[w], w))[: min(head, 40 - lm_score.KINDS - 1)]
    if head == 3:  # ties at the head's edge are left out
        known = [w for w in known if sum(n >= c[w] for n in c.values()) <= head]
    tail_n, tail_words = collections.Counter(), collections.Counter()
    for w, n in c.items():
        if w not in known:
            tail_n[lm_score.kind_of(w)] += n
            tail_words[lm_score.kind_of(w)] += 1
    names = [("kind", k) for k in range(lm_score.KINDS)] + [("end",)] + [("word", w) for w in known]
    freq = [tail_n[k] for k in range(lm_score.KINDS)] + [end] + [c[w] for w in known]
    order = sorted(range(len(names)), key=lambda i: -freq[i])
    token = {names[i]: j for j, i in enumerate(order)}
    assert [freq[i] for i in order] == m.freq.tolist()

    def log_prob(h, t):
        hs = np.append(h, 1)
        top = hs @ m.p["wc"]
        k = m.of[t]
        inside = m.p["wo"][m.first[k] : m.first[k + 1]] @ hs
        return top[k] - np.log(np.exp(top).sum()) + inside[t - m.first[k]] - np.log(np.exp(inside).sum())

    want = []
    for r in rows:
        h, total = np.zeros(m.hidden), 0.0
        for w in [*(r.text or "").encode().lower().split(), None]:
            name, share = ("end",) if w is None else ("word", w) if w in known else ("kind", lm_score.kind_of(w)), 0.0
            if name[0] == "kind":
                share = math.log10((c[w] + 1) / (tail_n[name[1]] + tail_words[name[1]] + 1))
            t = token[name]
            total += log_prob(h, t) / math.log(10) + share
            x = m.p["emb"][t] @ m.p["wx"][:-1] + m.p["wx"][-1]
            n, s = m.hidden, h @ m.p["wh"]
            z, g = (1 / (1 + np.exp(-(x[i * n : i * n + n] + s[i * n : i * n + n]))) for i in (0, 1))
            h = z * h + (1 - z) * np.tanh(x[2 * n :] + g * s[2 * n :])
        want.append((-1 if r.doc_id is None else r.doc_id, total))
    for (d, s), (e, u) in zip(sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in got), sorted(want), strict=True):
        assert d == e and math.isclose(s, u, rel_tol=2e-4, abs_tol=1e-3)


def test_kinds_of_words_by_both_codes(spark):
    r = random.Random(2)
    words = ["".join(r.choice("aZ09.,-!\u00e9\u0130\u4e2d\U0001f600\x1c\x85") for _ in range(r.randrange(1, 12))) for _ in range(500)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", lm_score.kind_column(F.col("w")).alias("k")).collect()
    assert all(x.k == lm_score.kind_of(x.w.encode()) for x in got)


def test_lm_score_of_nothing(spark, tmp_path):
    e = empty(spark, tmp_path)
    assert lm_score.score(e).count() == 0
    only_held_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    d = save(spark, tmp_path, [(only_held_out, "a b", None, None, None, None)], DOCS, "one")
    r = lm_score.score(d).collect()[0]
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(r.score)
