"""Array primitives, sources and indexes of long texts on small tables with nulls, ties, empty and long input, against plain code."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import codec, delta, primitives, scans, suffix
from seqloom.sources import container, raw


def numbers(r, n, nulls=0.1):
    return [None if r.random() < nulls else float(r.randrange(20)) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 63, 64, 65, 5000])
def test_minima_of_any_range(spark, n):
    r = random.Random(n)
    v = numbers(r, n)
    asked = [(q, *sorted((r.randrange(n), r.randrange(n)))) for q in range(200)] + [(200, 0, n - 1)]
    df = spark.createDataFrame(list(enumerate(v)), "idx long, value double")
    got = primitives.range_minima(df, spark.createDataFrame(asked, "q long, i long, j long"), n).collect()
    want = {}
    for q, i, j in asked:
        want[q] = min(((v[k], k) for k in range(i, j + 1) if v[k] is not None), default=(None, None))
    assert {x.q: (x.value, x.place) for x in got} == want and len(got) == 201


def test_bounds_of_repeated_and_absent_keys(spark):
    keys = [1.0, 1.0, 2.0, 5.0, 5.0, 5.0]
    got = primitives.search_bounds(spark.createDataFrame([(k,) for k in keys], "x double"), spark.createDataFrame([(i, x) for i, x in enumerate([0.0, 1.0, 1.0, 3.0, 5.0, 9.0])], "i int, x double"), "x").collect()
    assert {x.i: (x.lower_bound, x.upper_bound) for x in got} == {0: (0, 0), 1: (0, 2), 2: (0, 2), 3: (3, 3), 4: (3, 6), 5: (6, 6)}


def test_folds_of_an_operator_that_does_not_commute(spark):
    r = random.Random(3)
    rows = [(i, None if r.random() < 0.2 else r.choice("abcd")) for i in range(300)]
    for init, exclusive in ((None, False), ("<", False), ("<", True), (None, True)):
        got = {x.i: x.s for x in scans.folded(spark.createDataFrame(rows, "i long, v string").repartition(5), ["i"], "v", lambda a, b: a + b, "s", init, exclusive).collect()}
        t, want = init, {}
        for i, v in rows:
            before = t
            t = t if v is None else v if t is None else t + v
            want[i] = before if exclusive else t
        assert got == want


def test_places_in_segments_with_nulls_and_ties(spark):
    r = random.Random(5)
    rows = [(i, r.choice([None, "a", "b"]), r.choice([None, 1, 2, 3])) for i in range(120)]
    df = spark.createDataFrame(rows, "i long, g string, x int")
    key = lambda x: (x is not None, x)
    for x in scans.segment_places(df, ["g"], ["x"], ties=True).collect():
        assert x.place == 1 + sum(g == x.g and key(v) < key(x.x) for _, g, v in rows)
    got = scans.segment_places(df, ["g"], ["x", "i"]).collect()
    for x in got:
        assert x.place == 1 + sum(g == x.g and (key(v), i) < (key(x.x), x.i) for i, g, v in rows)
    assert {x.place for x in scans.segment_places(df, [], ["i"]).collect()} == set(range(1, 121))


def test_merged_ranges_keep_their_sizes(spark):
    r = random.Random(6)
    rows = [(i, i % 2, r.choice([0, 0, 0, 1, 2]), r.randrange(50)) for i in range(200)]
    got = primitives.remerge(spark.createDataFrame(rows, "i long, grp int, slice int, k int"), "grp", "slice", ["k", "i"]).collect()
    for g in (0, 1):
        merged = sorted((k, i) for i, h, _, k in rows if h == g)
        out = [(x.k, x.i) for x in sorted((x for x in got if x.grp == g), key=lambda x: (x.to_slice, x.place))]
        assert out == merged
        assert [sum(x.to_slice == s for x in got if x.grp == g) for s in range(3)] == [sum(s == t for _, h, t, _ in rows if h == g) for s in range(3)]


def test_raw_files_are_padded(spark, tmp_path):
    for i, n in enumerate((0, 1, 8, 13)):
        (tmp_path / f"f{i}.bin").write_bytes(bytes(range(1, n + 1)))
    got = {x.path[-6:]: (x.length, bytes(x.data)) for x in raw.read_padded(spark, str(tmp_path), 8).collect()}
    assert got == {f"f{i}.bin": (n, bytes(range(1, n + 1)).ljust(-(-n // 8) * 8, b"\0")) for i, n in enumerate((0, 1, 8, 13)) if n}


@pytest.mark.parametrize("text", ["A", "AB" * 40, "A" * 300, "BANANA" * 30 + "ANANAS", ""], ids=len)
def test_orders_of_one_text_by_both_ways(spark, text):
    chars = spark.createDataFrame([(i, ord(c) - 64) for i, c in enumerate(text)], "pos long, code long")
    want = sorted(range(len(text)), key=lambda i: text[i:])
    for how in (suffix.suffix_ranks, suffix.three_way_order):
        got = how(chars).collect()
        assert [x.pos for x in sorted(got, key=lambda x: x["rank"])] == want and sorted(x["rank"] for x in got) == list(range(len(text)))
    lcp = {x.pos: (x.before, x.lcp) for x in suffix.common_to(chars, suffix.suffix_ranks(chars), 25).collect()}
    for k, i in enumerate(want):
        j = want[k - 1] if k else None
        n = 0 if j is None else next((m for m in range(25) if max(i, j) + m >= len(text) or text[i + m] != text[j + m]), 25)
        assert lcp[i] == (j, n)


def test_packed_places_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 16)
    text = [random.Random(1).randrange(1, 27) for _ in range(100)]
    got = {x.pos: x.key for x in suffix.packed_places(spark.createDataFrame(list(enumerate(text)), "pos long, code long"), 10).collect()}
    for i in range(100):
        want = 0
        for j in range(10):
            want = want << 6 | (text[i + j] if i + j < 100 else 0)
        assert got[i] == want


def test_bwt_comes_back_by_squaring():
    r = random.Random(2)
    for n in (0, 1, 2, 3, 50, 1000):
        s = bytes(r.choice(b"abc\x00\xff") for _ in range(n))
        assert suffix.unbwt_by_squaring(*suffix.bwt(s)) == s == suffix.unbwt(*suffix.bwt(s))


def test_decoding_by_sums_is_decoding(spark):
    r = random.Random(9)
    seq = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    rows = []
    for i in range(6):
        ref = seq(400)
        parts = [ref[50:150], seq(3), ref[153:260], "N" * 30, delta.both_strands(ref)[500:640], seq(10), ref[:60]]
        r.shuffle(parts)
        rows.append((i, "".join(parts), ref))
    rows += [(6, "", "ACGT"), (7, None, None)]
    pairs = spark.createDataFrame(rows, "id long, target string, reference string")
    strands = spark.createDataFrame([(i, delta.both_strands(ref or "")) for i, _, ref in rows], "id long, strands string")
    got = {x.id: x.target for x in delta.joined_text(delta.decode_by_sums(delta.token_table(pairs), strands)).collect()}
    assert got == {i: t for i, t, _ in rows if t}
    bad = spark.createDataFrame([(1, 0, "?!")], "id long, token_no long, line string")
    assert delta.decode_by_sums(bad, strands).collect()[0].text is None


def test_container_comes_back_and_damage_is_found(spark, tmp_path):
    r = random.Random(4)
    ref = "".join(r.choice("ACGTacgt") for _ in range(3000))
    rows = [(i, f"n{i % 2}", f"head {i}", ref[100 * i : 100 * i + 1500] + "".join(r.choice("ACGT") for _ in range(40)), ref, "head 0") for i in range(4)]
    targets = spark.createDataFrame(rows, "id long, name string, header string, target string, reference string, reference_header string")
    path = str(tmp_path / "c")
    container.write_container(targets, path, codec.Options(block=512))
    back = container.read_container(spark, path, targets.select("id", "reference", "reference_header")).collect()
    assert {x.id: (x.header, x.target) for x in back} == {i: (h, t) for i, _, h, t, _, _ in rows}
    blocks = container.read_blocks(spark, path).withColumn("block", F.concat(F.expr("substring(block, 1, length(block) - 1)"), F.unhex(F.lit("00"))))
    blocks.write.partitionBy("name").parquet(str(tmp_path / "damaged"))
    with pytest.raises(Exception, match="damaged"):
        container.read_container(spark, str(tmp_path / "damaged"), targets.select("id", "reference", "reference_header")).collect()


def test_kmers_of_pieces(spark):
    from seqloom.functions import text as T

    seqs = ["ABCABCABC", "AB", "", None, "ABCAB" * 50]
    want = {}
    for s in seqs:
        for i in range(len(s or "") - 3):
            want[s[i : i + 4]] = want.get(s[i : i + 4], 0) + 1
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    for piece in (7, 1 << 20):
        assert {x.k: x.n for x in T.kmer_counts(df, "s", 4, piece).collect()} == want
    assert np.isclose(sum(x.n for x in T.letter_counts(df, "s").collect()), sum(len(s or "") for s in seqs))
