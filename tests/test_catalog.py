"""Every catalogue query with SQL against DuckDB, and string-index operators against brute force."""

import random
import zlib

import duckdb
import pandas as pd
import pytest

from seqloom.operators import suffix
from seqloom.plans import arrays, catalog, coding, sequences, strings  # noqa: F401  they add their queries to the catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for n in TABLES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{sf}/{n}.parquet')")
    return c


def rows(df):
    plain = lambda v: None if pd.isna(v) else float(v) if hasattr(v, "dtype") or isinstance(v, int | float) else v
    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_is_its_sql(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def texts():
    r = random.Random(1)
    yield from (b"", b"A", b"A" * 50, b"AC" * 40, b"N" * 30, b"ACGNNNNNTTT")
    for _ in range(60):
        yield bytes(r.choice(b"ACGTN") for _ in range(r.randrange(60)))


def common(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def test_suffix_order_lcp_and_bwt():
    for s in texts():
        want = sorted(range(len(s)), key=lambda i: s[i:])
        sa = suffix.suffix_array(s)
        assert sa.tolist() == want
        assert suffix.lcp_array(s, sa).tolist() == [common(s[want[i] :], s[want[i - 1] :]) if i else 0 for i in range(len(s))]
        assert suffix.unbwt(*suffix.bwt(s)) == s


def test_longest_matches():
    r = random.Random(2)
    for s in texts():
        ref = bytes(r.choice(b"ACGT1") for _ in range(r.randrange(60)))
        length, where = suffix.longest_matches(s, ref)
        for i in range(len(s)):
            best = max((common(s[i:].split(b"N")[0], ref[j:]) for j in range(len(ref))), default=0)
            assert length[i] == best and (not best or s[i : i + best] == ref[where[i] : where[i] + best])


def test_distributed_suffix_ranks(spark):
    s = b"ACGTACGTTTACGNACGT" * 3
    got = suffix.suffix_ranks(spark.createDataFrame([(i, x - 64) for i, x in enumerate(s)], "pos long, code long")).collect()
    assert [r.pos for r in sorted(got, key=lambda r: r["rank"])] == sorted(range(len(s)), key=lambda i: s[i:])


def test_adler(spark, sf):
    got = {r.doc_id: r.adler for r in catalog.adler32(spark, sf).collect()}
    for r in catalog.seq_clean(spark, sf).collect():
        assert got[r.doc_id] == zlib.adler32(r.seq.encode())


def test_suffix_order_of_documents(spark, tmp_path):
    from pyspark.sql import functions as F

    from seqloom.functions import text as T
    
    rows = [(3, "gattaca ACGT acgt"), (1, "banana acgtacgt"), (2, None), (4, ""), (5, "acgtNN acgt")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    cleaned = spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", T.clean(F.col("text")).alias("s")).orderBy("doc_id").collect()
    x = "".join(r.s or "" for r in cleaned)
    got = {r.pos: r["rank"] for r in strings.suffix_order_of_documents(spark, str(tmp_path)).collect()}
    assert got == {p: k for k, p in enumerate(sorted(range(len(x)), key=lambda i: x[i:]))} and x


def test_long_text_in_many_blocks(spark, tmp_path, monkeypatch):
    """Blocks and ranges far smaller than repeats; no row for each suffix before the result."""
    from seqloom.operators import long_text

    r = random.Random(3)
    page = "".join(r.choice("abAC ") for _ in range(900))
    rows = [(i, r.choice([page, page[50:] + "x", "a" * 200, "", None, "éİ gat,taca"])) for i in range(40)]
    rows = [(k, (s or "") + (r.choice("xyz") if i % 3 else "") if s is not None else None) for i, (k, s) in enumerate(rows)]
    r.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    x = "".join(c for _, s in sorted(rows) for c in (s or "") if c.isascii() and c.isalpha()).upper()
    want = {p: k for k, p in enumerate(sorted(range(len(x)), key=lambda i: x[i:]))}

    def refuse(*a, **k):
        raise AssertionError("row by row")

    for halo, block, size in ((90, 257, 1000), (7, 5, 1 << 20), (1 << 16, 1 << 20, 3000), (700, 300, 1 << 20)):
        with monkeypatch.context() as m:
            m.setattr(suffix, "suffix_ranks", refuse)
            if block == 5:
                few = df.where("doc_id < 4")
                y = "".join(c for k, s in sorted(rows) if k < 4 for c in (s or "") if c.isascii() and c.isalpha()).upper()
                got = {q.pos: q["rank"] for q in long_text.text_ranks(few, "doc_id", "text", block=block, size=size, heavy=100, halo=halo).collect()}
                assert got == {p: k for k, p in enumerate(sorted(range(len(y)), key=lambda i: y[i:]))}
            else:
                got = {q.pos: q["rank"] for q in long_text.text_ranks(df, "doc_id", "text", block=block, size=size, heavy=100, halo=halo).collect()}
                assert got == want and len(want) > 5000
    with monkeypatch.context() as m:
        m.setattr(suffix, "suffix_ranks", refuse)
        assert {q.pos: q["rank"] for q in strings.suffix_order_of_documents(spark, str(tmp_path)).collect()} == want


def test_long_text_of_one_letter(spark, tmp_path):
    """More suffixes share a key than a task should hold: ordered row by row, the same result."""
    from seqloom.operators import long_text

    rows = [(2, "a" * 150), (1, "b" + "A" * 100 + "!"), (3, "ab")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    x = "B" + "A" * 250 + "AB"
    got = {q.pos: q["rank"] for q in long_text.text_ranks(spark.read.parquet(str(tmp_path / "documents.parquet")), "doc_id", "text", block=64, size=50).collect()}
    assert got == {p: k for k, p in enumerate(sorted(range(len(x)), key=lambda i: x[i:]))}


def test_long_text_side_by_side(spark, tmp_path):
    """Tasks that wait for each other, several passes and ranges: the same order, and no table of all ranks on disk (before: over 4 bytes a letter)."""
    from pathlib import Path

    from seqloom.operators import long_text

    r = random.Random(5)
    page = "".join(r.choice("abcd ") for _ in range(9000))
    rows = [(i, page[r.randrange(500) :] + r.choice(["", "x", "a" * 300, "ab" * 200])) for i in range(12)] + [(50, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    x = "".join(c for _, s in rows for c in (s or "") if c.isalpha()).upper()
    want = {p: k for k, p in enumerate(sorted(range(len(x)), key=lambda i: x[i:]))}
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    had = set(shared.iterdir())
    assert {q.pos: q["rank"] for q in long_text.text_ranks(df, "doc_id", "text").collect()} == want
    held = sum(f.stat().st_size for d in set(shared.iterdir()) - had for f in d.rglob("*") if f.is_file())
    assert 0 < held < 3 * len(x)
    got = long_text.text_ranks(df, "doc_id", "text", block=30_000, size=5000, heavy=100, alone=1000, part=50_000)
    for _ in range(2):  # a result can be read again
        assert {q.pos: q["rank"] for q in got.collect()} == want
