"""The pipeline against its stages by hand, and on tables of odd rows."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import mixing, near_dedup, quality, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table_of(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def stages(spark, folder, tmp):
    """Each stage's result, written and read again as the next one's docs."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp / f"stage{i}")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def rows(df, *columns):
    return collections.Counter(map(tuple, df.select(*columns).collect()))


def test_run_is_its_stages_and_each_is_its_operator(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    done = stages(spark, sf, tmp_path)
    assert [n for n, _ in done] == ["quality_classifier", "minhash_near_dedup", "mix_to_weights", "packing"]
    (_, good), (_, single), (_, mixed), (_, packed) = done
    for df in (good, single, mixed):
        assert df.schema == docs.schema
    everything = ("doc_id", "text", "lang", "source", "n_chars")
    judged = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.kept}
    assert rows(good, *everything) == rows(docs.where(F.col("doc_id").isin(list(judged))), *everything)
    kept = {r.doc_id for r in near_dedup.near_duplicates(good).collect() if r.kept}
    assert rows(single, *everything) == rows(good.where(F.col("doc_id").isin(list(kept))), *everything)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken = {r.doc_id: r.taken for r in mixing.mix(single).collect()}
    words, text = collections.Counter(), {r.doc_id: (r.text or "").split() for r in single.collect()}
    for r in mixed.collect():
        words[r.doc_id] += count(r.text)
        own = (r.text or "").split()
        assert r.n_chars == len(r.text) and any(own == text[r.doc_id][i : i + len(own)] for i in range(len(text[r.doc_id]) - len(own) + 1))
    assert {d: n for d, n in taken.items() if n} == dict(words)
    # packing: each document's ids in gapless pieces, sequences full but the last
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    want, pieces, sequences = collections.Counter(), packed.collect(), collections.Counter()
    for r in mixed.collect():
        want[(r.doc_id, len(tok.encode(r.text, add_special_tokens=False).ids) + 1)] += 1
    assert collections.Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == want
    for r in pieces:
        sequences[r.sequence_id] += r.length
    assert all(n == 4096 for s, n in sequences.items() if s != max(sequences)) and sum(sequences.values()) == sum(n * k for (_, n), k in want.items())
    # run() gives the same rows, but for the order in which documents stand in the stream
    again = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter((r.doc_id, r.doc_tokens) for r in again if r.start == 0) == want


@pytest.mark.parametrize("kind", ["odd", "empty", "alike", "unlabelled"])
def test_pipeline_on_odd_tables(spark, tmp_path, kind):
    text = "one two three four five six seven eight nine ten eleven twelve"
    table = {
        "odd": ([(None, None, None, None, None), (None, text, "en", None, 3), (1, "", "en", "a", 0), (2, " \n ", "en", "a", 3), (3, text, None, "b", None), (3, text, "en", "b", 9), (4, "x" * 300_000, "en", "c", 1), (5, "word " * 40_000, "en", "c", 1)], [(3, 1, 0), (None, 1, 0), (4, None, None), (99, 1, 1)]),
        "empty": ([], []),
        "alike": ([(i, text, "en", "a", len(text)) for i in range(40)], [(i, 1, 0) for i in range(20)]),
        "unlabelled": ([(i, f"{text} {i}", "en", f"s{i % 4}", 1) for i in range(30)], []),
    }[kind]
    folder = table_of(spark, tmp_path, *table)
    done = dict(stages(spark, folder, tmp_path))
    n = {name: df.count() for name, df in done.items()}
    if kind == "empty":
        assert set(n.values()) == {0}
    if kind in ("odd", "alike"):  # all labelled rows are good, so all are kept
        assert n["quality_classifier"] == len(table[0])
    if kind == "alike":
        assert n["minhash_near_dedup"] == 1
    if kind == "odd":
        # of null and empty texts one, of the text one, of white space one, and the two long ones
        assert n["minhash_near_dedup"] == 5
    pieces = done["packing"].collect()
    tokens = collections.Counter()
    for r in pieces:
        tokens[(r.doc_id, r.doc_tokens)] += r.length
    assert all(n % size == 0 for (_, size), n in tokens.items())
    assert all(r.ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes()) for r in pieces if r.doc_tokens == 1)
