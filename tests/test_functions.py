import collections

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sketchloom.functions import hashing, kmers
from sketchloom.functions.register import murmur64_of, register


def rows(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8).reshape(1, -1)


def test_murmur128_known_vectors():
    a, b = hashing.murmur128(rows("hello"), 0)
    assert (hex(int(a[0])), hex(int(b[0]))) == ("0xcbd8a7b341bd9b02", "0x5b1e906a48ae1d19")
    assert int(hashing.murmur128(rows("ACGTACGTACGTACGTACGTA"), 42)[0][0]) == 13036166743686632327
    assert int(hashing.murmur128(np.zeros((1, 0), np.uint8), 0)[0][0]) == 0


def test_murmur32_known_vector():
    assert int(hashing.murmur32(rows("hello"), 0)[0]) == 0x248BFA47


def test_mersenne64_check_value():
    assert int(hashing.mersenne64(5489, 10_000)[-1]) == 9981545732273789042


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**42 - 1), min_size=2, max_size=30, unique=True))
def test_invertible_hash_keeps_values_apart(values):
    out = hashing.invertible64(np.array(values, np.uint64), 42)
    assert len(set(out.tolist())) == len(values) and int(out.max()) < 2**42


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20), st.integers(1, 500))
def test_jump_moves_keys_to_the_new_bucket_only(keys, buckets):
    a, b = hashing.jump(np.array(keys, np.uint64), buckets), hashing.jump(np.array(keys, np.uint64), buckets + 1)
    assert ((a == b) | (b == buckets)).all() and (0 <= a).all() and (a < buckets).all()


def test_leading_zeros():
    values = [1, 2, 3, 2**31, 2**32, 2**63, 2**64 - 1]
    assert hashing.leading_zeros(np.array(values, np.uint64)).tolist() == [64 - v.bit_length() for v in values]


def test_other_mixers():
    x = np.arange(20_000)
    for f in (hashing.fmix32, hashing.mueller32, hashing.jenkins32, hashing.splitmix64, hashing.fmix64):
        assert len(np.unique(f(x))) == len(x)
    # Known values: the first outputs of splitmix64 for seed 0 are the finaliser of multiples of the golden ratio.
    golden = np.array([0x9E3779B97F4A7C15, 2 * 0x9E3779B97F4A7C15 % 2**64], np.uint64)
    assert [hex(int(v)) for v in hashing.splitmix64(golden)] == ["0xe220a8397b1dcdaf", "0x6e789e6aa1b965f4"]
    assert int(hashing.fmix32(np.array([1]))[0]) == 0x514E28B7 and int(hashing.fmix64(np.array([1]))[0]) == 0xB456BCFC34C2CB2C
    assert hashing.halve64(np.arange(5, dtype=np.uint64)).dtype == np.uint32


def test_strands():
    seq = np.frombuffer(b"ACGTNacgtn", np.uint8)
    assert kmers.reverse_complement_bytes(seq).tobytes() == b"CACGTCACGT"
    own, other = b"ACGTTTGACCA", None
    a = np.frombuffer(own, np.uint8)
    other = np.frombuffer(kmers.reverse_complement_bytes(a).tobytes(), np.uint8)
    words = lambda s: sorted(r.tobytes() for r in kmers.canonical_windows(s, 4))
    assert words(a) == words(other)


def test_columns(spark):
    df = spark.createDataFrame([("ACGTN",), ("acg",), ("",), (None,)], "seq string")
    got = df.select(kmers.reverse_complement(F.col("seq")), kmers.upper(F.col("seq"))).collect()
    assert got[0][0] == "CACGT" and got[1][1] == "ACG" and got[3][0] is None


def test_kmers_in_slices(spark, monkeypatch):
    monkeypatch.setattr(kmers, "SLICE", 7)
    rows = [(1, "ACGTNACGTTTGACCATGACCA"), (2, "acgtACGT"), (3, "AC"), (4, ""), (5, None), (6, "ACGé日本ACGTé")]
    df = spark.createDataFrame(rows, "id long, seq string")
    cut = lambda s, k: [s[i : i + k] for i in range(len(s) - k + 1)]
    got = [tuple(r) for r in kmers.each_kmer(df, 4).collect()]
    assert sorted(got) == sorted((i, p + 1, w) for i, s in rows for p, w in enumerate(cut(s or "", 4)))
    assert kmers.each_kmer(df, 4, drop_last=1).where("id = 2").count() == 4
    flip = lambda w: w[::-1].translate(str.maketrans("ACGTN", "TGCAC"))
    ascii_rows = [(i, (s or "").upper()) for i, s in rows if i != 6]
    want = collections.Counter((i, min(w, flip(w))) for i, s in ascii_rows for w in cut(s, 4))
    plain = df.where("id <> 6")
    assert {(r["id"], r["kmer"]): r["n"] for r in kmers.count_kmers(plain, 4, True).collect()} == want
    total = collections.Counter(w for i, s in ascii_rows for w in cut(s, 4))
    assert {r["kmer"]: r["n"] for r in kmers.count_kmers(plain, 4, False, strands=False).collect()} == total


def test_sql_functions(spark):
    register(spark)
    got = spark.sql("select murmur64(x) h, reverse_complement(x) r, jump_hash(7, 10) j from values ('ACGTACGTACGTACGTACGTA'), (null) t(x)").collect()
    assert got[0]["h"] == 13036166743686632327 - 2**64 and got[1]["h"] is None and 0 <= got[0]["j"] < 10


def test_murmur_of_mixed_lengths():
    import pandas as pd

    got = murmur64_of(pd.Series(["a", "hello", None, "b"]), 0)
    assert got[1] == 0xCBD8A7B341BD9B02 - 2**64 and got.isna().tolist() == [False, False, True, False]


@pytest.mark.parametrize("bad", [dict(k=0), dict(size=0)])
def test_parameters_are_checked(bad):
    from sketchloom.params import MinHashParams

    with pytest.raises(ValueError):
        MinHashParams(**bad)


def test_kmers_of_an_id_are_not_shuffled(spark):
    """Only rows of ids that stand in several rows meet in a shuffle, and those with no id."""
    alone = spark.createDataFrame([(1, "ACGTNACGTTTGACCATGACCA"), (2, "acgtACGT")], "id long, seq string")
    counted = kmers.count_kmers(alone, 4, True)
    assert "Exchange" not in counted._jdf.queryExecution().toString()
    rows = [(1, "ACGTACGT"), (2, "ACGTT"), (1, "ACGTA"), (None, "ACGTA"), (None, "CCGTA")]
    got = {(r["id"], r["kmer"]): r["n"] for r in kmers.count_kmers(spark.createDataFrame(rows, "id long, seq string"), 4, True, strands=False).collect()}
    assert got == collections.Counter((i, s[p : p + 4]) for i, s in rows for p in range(len(s) - 3))


@pytest.mark.parametrize("k", [1, 3, 21, 23, 33])
def test_packed_kmers_and_others(monkeypatch, k):
    """N and other letters, whose other strand is of A, C, G and T, in parts and in classes of a long row."""
    import random

    import pyarrow as pa

    r = random.Random(k)
    flip = lambda w: kmers.reverse_complement_bytes(np.frombuffer(w.encode(), np.uint8)).tobytes().decode()
    spelt = lambda x: x["other"] or "".join("ACGT"[x["packed"] >> 2 * j & 3] if x["packed"] >= 0 else "ACGNT"[~x["packed"] >> 3 * j & 7] for j in range(k - 1, -1, -1))
    rows = ["".join(r.choices(s, k=n)) for s in ("ACGT", "ACGTN", "acgtNXY") for n in (0, k, 5, 190)] + [None]
    want = collections.Counter((i, min(w, flip(w))) for i, s in enumerate(rows) for w in ((s or "").upper()[p : p + k] for p in range(len(s or "") - k + 1)))
    for part, whole in ((1 << 17, 1 << 21), (37, 50)):
        monkeypatch.setattr(kmers, "SLICE", part)
        monkeypatch.setattr(kmers, "WHOLE", whole)
        batch = pa.RecordBatch.from_arrays([pa.array([9, *range(len(rows))]), pa.array(["ACGTACGT", *rows])], names=["id", "seq"]).slice(1)
        found = [((x["id"], spelt(x)), x["n"]) for out in kmers._Counter(k, True, True)([batch]) for x in out.to_pylist()]
        assert len(found) == len(want) and dict(found) == want
