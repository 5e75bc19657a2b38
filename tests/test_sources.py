import gzip

import pytest

from sketchloom.sources import fastx

FASTQ = "junk\n@r1 one two\nACGT\nAC\n+\nIIII\nII\n@r2\nA\n+\nI\n"
FASTA = ">a first one\r\nACGT\r\n\r\nTT\r\n>b\nGG\n>c\n"


def test_parse_both_kinds():
    assert list(fastx.parse(FASTA.splitlines(True))) == [("a", "first one", "ACGTTT", None), ("b", None, "GG", None), ("c", None, "", None)]
    assert list(fastx.parse(FASTQ.splitlines(True))) == [("r1", "one two", "ACGTAC", "IIIIII"), ("r2", None, "A", "I")]


def test_malformed_quality():
    bad = "@r\nACGT\n+\nII\n"
    with pytest.raises(fastx.MalformedRecord):
        list(fastx.parse(bad.splitlines(True)))
    assert list(fastx.parse(bad.splitlines(True), strict=False)) == []


def test_read_plain_and_gzip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(FASTA)
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(FASTQ.encode()))
    got = sorted((r["name"], r["ordinal"], r["seq"], r["qual"]) for r in fastx.read(spark, str(tmp_path)).collect())
    assert got == [("a", 0, "ACGTTT", None), ("b", 1, "GG", None), ("c", 2, "", None), ("r1", 0, "ACGTAC", "IIIIII"), ("r2", 1, "A", "I")]
    fastx.register(spark)
    assert spark.read.format("fastx").load(str(tmp_path / "*")).count() == 5


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x", "some words", "ACGT" * 50), ("y", None, "TT")], "name string, comment string, seq string")
    fastx.write_fasta(df, str(tmp_path / "out"))
    assert sorted(fastx.read_fasta_splits(spark, str(tmp_path / "out")).collect()) == sorted(df.collect())


def test_marks_within_lines(spark, tmp_path):
    text = ">a x>y >z\r\nAC\r\nGT\r\n>b\n\nTT\n>c >d\n"
    want = [("a", "x>y >z", "ACGT"), ("b", None, "TT"), ("c", ">d", "")]
    (tmp_path / "p.fa").write_text(text, newline="")
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "p.fa.gz").write_bytes(gzip.compress(text.encode()))
    for path in (tmp_path / "p.fa", tmp_path / "z"):
        assert sorted(tuple(r) for r in fastx.read_fasta_splits(spark, str(path)).collect()) == want
    assert [(r["name"], r["seq"]) for r in fastx.first_records(fastx.read(spark, str(tmp_path / "p.fa"))).collect()] == [("a", "ACGT")]


def test_records_over_many_splits(spark, tmp_path):
    rows = [(f"r{k}", f"c>{k}" if k % 3 else None, "ACGTN" * (k % 40)) for k in range(3000)]
    df = spark.createDataFrame(rows, "name string, comment string, seq string")
    fastx.write_fasta(df.coalesce(1), str(tmp_path / "one"), width=17)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = fastx.read_fasta_splits(spark, str(tmp_path / "one"))
        assert got.rdd.getNumPartitions() > 10 and sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
