from seqloom.sources import fasta


def test_records_come_back(spark, tmp_path):
    rows = [("chr1 x", "ACGT" * 40), ("chr2", "acgtN" * 24), ("empty", ""), ("chr3", "A" * 60), ("a>b", "AC")]
    fasta.write_fasta(spark.createDataFrame(rows, "header string, seq string").coalesce(1), f"{tmp_path}/a")
    assert sorted(map(tuple, fasta.read_fasta(spark, f"{tmp_path}/a").collect())) == sorted(rows)


def test_comments_white_space_and_line_ends(spark, tmp_path):
    (tmp_path / "b.fa").write_bytes(b"; head\n>one\r\nAC GT\r\n;note\r\nac1\r\n>two\n\n>three")
    assert sorted(map(tuple, fasta.read_fasta(spark, f"{tmp_path}/b.fa").collect())) == [("one", "ACGTac"), ("three", ""), ("two", "")]
    (tmp_path / "c.fa").write_bytes(b"@one\nAC\n@two\nGT\n")
    assert sorted(map(tuple, fasta.read_fasta(spark, f"{tmp_path}/c.fa", "@").collect())) == [("one", "AC"), ("two", "GT")]


def test_a_file_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "d.fa").write_text("".join(f">r{i}\n{'ACGT' * 20}\n{'T' * (i % 7)}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = fasta.read_fasta(spark, f"{tmp_path}/d.fa")
        assert df.rdd.getNumPartitions() > 4
        assert sorted(map(tuple, df.collect())) == sorted((f"r{i}", "ACGT" * 20 + "T" * (i % 7)) for i in range(2000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_scripts_and_distances(spark, tmp_path):
    rows = [("chr1", "0\n0\n0\n  40\n 5 30"), ("chr2", "1\nx\nAC")]
    fasta.write_scripts(spark.createDataFrame(rows, "name string, script string"), f"{tmp_path}/s")
    assert sorted(map(tuple, fasta.read_scripts(spark, f"{tmp_path}/s").collect())) == rows
    fasta.write_distances(spark.createDataFrame([("a", [0.0, 0.125])], "taxon string, distances array<double>"), f"{tmp_path}/m")
    assert [r.value for r in spark.read.text(f"{tmp_path}/m").collect()] == ["a          0.00000000 0.12500000"]
