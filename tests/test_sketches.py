import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom.functions import hashing, kmers
from sketchloom.operators import hll, minhash, order, weighted
from sketchloom.params import HllParams, MinHashParams, OrderParams, WeightedParams
from sketchloom.plans import compare, meetings

P = MinHashParams(k=11, size=50)


def dna(n: int, seed: int) -> str:
    return "".join(random.Random(seed).choices("ACGT", k=n))


@pytest.fixture(scope="module")
def seqs(spark):
    a = dna(800, 1)
    back = kmers.reverse_complement_bytes(np.frombuffer(a.encode(), np.uint8)).tobytes().decode()
    rows = [(1, a), (2, back), (3, a[:600] + dna(200, 2)), (4, dna(800, 3)), (5, "ACGT"), (6, ""), (7, None), (8, a.lower())]
    return spark.createDataFrame(rows, "id long, seq string").cache()


def hashes(seq: str, p: MinHashParams) -> set[int]:
    return {int(h) for h in minhash.hash_windows(np.frombuffer(seq.encode(), np.uint8), p)}


def test_sketch_is_the_least_hashes(seqs):
    got = {}
    for r in minhash.sketch(seqs, P).collect():
        got.setdefault(r["id"], []).append(r["hash"] % 2**64)
    assert sorted(got[1]) == sorted(hashes(dna(800, 1), P))[:50]
    assert sorted(got[1]) == sorted(got[2]) == sorted(got[8])
    assert not {5, 6, 7} & set(got)


def test_measures_against_sets(seqs):
    found = {(r["i"], r["j"]): r for r in compare.minhash_measures(minhash.sketch(seqs, P), P).collect()}
    a, b = (sorted(hashes(s, P))[:50] for s in (dna(800, 1), dna(800, 1)[:600] + dna(200, 2)))
    top = set(sorted(set(a) | set(b))[:50])
    j = len(top & set(a) & set(b)) / len(top)
    r = found[(1, 3)]
    assert r["jaccard"] == pytest.approx(j) and r["containment"] == pytest.approx(len(set(a) & set(b)) / 50)
    assert r["distance"] == pytest.approx(min(1, -math.log(2 * j / (1 + j)) / 11))
    assert found[(1, 2)]["jaccard"] == 1 and found[(1, 2)]["distance"] == 0
    assert (1, 4) not in found


def test_merge_is_the_sketch_of_the_union(seqs):
    parts = [seqs.where("id = 1"), seqs.where("id = 4").withColumn("id", F.lit(1).cast("long"))]
    merged = minhash.merge(*[minhash.sketch(x, P) for x in parts], P)
    whole = minhash.sketch(parts[0].unionByName(parts[1]), P)
    assert sorted(merged.collect()) == sorted(whole.collect())
    with pytest.raises(ValueError):
        minhash.merge(parts[0], parts[1], P, MinHashParams(k=12))


def test_cardinality_and_p_value(spark, seqs):
    r = minhash.stats(minhash.sketch(seqs.where("id = 4"), P)).first()
    assert r["sketch_size"] == 50 and 500 < r["cardinality"] < 1200
    df = spark.createDataFrame([(0, 50, 800.0, 800.0), (50, 50, 800.0, 800.0)], "x long, s long, a double, b double")
    got = [v[0] for v in df.select(minhash.p_value(F.col("x"), F.col("s"), F.col("a"), F.col("b"), 11)).collect()]
    assert got[0] == 1 and got[1] < 1e-9


def test_min_copies(spark):
    a = dna(100, 5)
    df = spark.createDataFrame([(1, a), (1, a[:60])], "id long, seq string")
    p = MinHashParams(k=11, size=1000, min_copies=2)
    assert {r["hash"] % 2**64 for r in minhash.sketch(df, p).collect()} == hashes(a[:60], p)


def test_hll(seqs):
    p = HllParams(p=8, k=11, drop_last=False)
    regs = hll.registers(seqs, p)
    counts = hll.histogram(regs, 8, seqs)
    for method in ("original", "improved", "mle"):
        got = {r[0]: r[1] for r in counts.select("id", hll.estimate(F.col("counts"), 8, method)).collect()}
        assert abs(got[1] - 789) < 200 and got[1] == got[2] and got[6] == pytest.approx(0, abs=1e-9)
    ids = seqs.where("id in (1, 2, 3, 4)")
    j = {(r["i"], r["j"]): r["jaccard"] for r in hll.jaccard(regs, compare.all_pairs(ids), 8).collect()}
    assert j[(1, 2)] == pytest.approx(1) and abs(j[(1, 3)] - 0.59) < 0.2 and j[(1, 4)] < 0.2
    again = hll.merge(regs, regs)
    assert sorted(again.collect()) == sorted(regs.collect())
    short = hll.registers(seqs.where("id = 5"), HllParams(p=8, k=4)).count()
    assert short == 0 and hll.registers(seqs.where("id = 5"), HllParams(p=8, k=4, drop_last=False)).count() == 1


def random_counts(n: int, p: int, seed: int) -> np.ndarray:
    idx, rank = hll.place(np.random.default_rng(seed).integers(0, 2**64, n, np.uint64), p)
    regs = np.zeros(1 << p, int)
    np.maximum.at(regs, idx, rank)
    return np.bincount(regs, minlength=64 - p + 2)


def log_likelihood(counts: np.ndarray, n: float) -> float:
    m, top = counts.sum(), len(counts) - 1
    below = [math.exp(-n / m / 2**k) for k in range(top)] + [1.0]
    return sum(c * math.log(b - a) for c, a, b in zip(counts, [0.0, *below], below) if c)


def test_likelihood_is_greatest_at_the_estimate():
    for n in (1, 7, 300, 10_000, 400_000):
        for p in (4, 8, 10):
            c = random_counts(n, p, n)
            x = float(hll.likely_estimates(c[None])[0])
            # A golden-section search of the likelihood itself.
            lo, hi = x / 2, x * 2
            for _ in range(80):
                a, b = hi - (hi - lo) * 0.6180339887498949, lo + (hi - lo) * 0.6180339887498949
                lo, hi = (lo, b) if log_likelihood(c, a) > log_likelihood(c, b) else (a, hi)
            assert x == pytest.approx((lo + hi) / 2, rel=1e-5)
            assert abs(x - n) < max(6 * n / math.sqrt(1 << p), 3)


def test_estimates_at_the_ends():
    empty, full = np.zeros((1, 58)), np.zeros((1, 58))
    empty[0, 0] = full[0, 57] = 256
    assert hll.likely_estimates(empty)[0] == 0 and hll.likely_estimates(full)[0] == np.inf
    assert hll.improved_estimates(empty)[0] == 0 and np.isinf(hll.improved_estimates(full)[0])
    top = np.zeros((1, 58))
    top[0, 56], top[0, 57] = 255, 1
    assert 1e17 < hll.likely_estimates(top)[0] < 1e20 and 1e17 < hll.improved_estimates(top)[0] < 1e20


def test_improved_estimates_of_random_registers():
    rows = np.stack([random_counts(n, 10, n) for n in (10, 1000, 50_000)])
    for x, n in zip(hll.improved_estimates(rows), (10, 1000, 50_000)):
        assert abs(x - n) < 0.15 * n + 2


def test_joint_estimate_of_known_overlap(spark):
    rng = np.random.default_rng(4)
    shared, a, b = (rng.integers(0, 2**64, n, np.uint64) for n in (3000, 2000, 1000))
    rows = []
    for i, values in ((1, np.concatenate((shared, a))), (2, np.concatenate((shared, b)))):
        idx, rank = hll.place(values, 10)
        regs = np.zeros(1024, int)
        np.maximum.at(regs, idx, rank)
        rows += [(i, k, int(r)) for k, r in enumerate(regs.tolist()) if r]
    regs = spark.createDataFrame(rows, "id long, idx int, rank int")
    got = hll.jaccard(regs, spark.createDataFrame([(1, 2)], "i long, j long"), 10).first()
    assert got["jaccard"] == pytest.approx(0.5, abs=0.08) and got["both"] == pytest.approx(3000, rel=0.15) and got["only_i"] == pytest.approx(2000, rel=0.25)


def plain_minimizers(seq: str, k: int, w: int) -> set[int]:
    code = {"A": 0, "C": 1, "G": 2, "T": 3}
    values = {}
    for i in range(k - 1, len(seq)):
        f = sum(code[c] * 4 ** (k - 1 - j) for j, c in enumerate(seq[i - k + 1 : i + 1]))
        b = sum((3 - code[c]) * 4**j for j, c in enumerate(seq[i - k + 1 : i + 1]))
        if f != b:
            values[i] = ((int(hashing.invertible64(np.array([min(f, b)], np.uint64), 2 * k)[0]) << 8) | (min(i - w + 2, k) % 2**64)) % 2**64
    return {min(values[j] for j in values if i - w < j <= i) for i in values if i >= w - 1} if len(seq) >= w + k - 1 else set()


@pytest.mark.parametrize("k,w", [(5, 4), (4, 7), (11, 1), (3, 12)])
def test_minimizers(k, w):
    for seed in range(5):
        seq = dna(120, seed)
        got = weighted.minimizer_set(np.frombuffer(seq.encode(), np.uint8), k, w)
        assert {int(x) for x in got} == plain_minimizers(seq, k, w)
    assert len(weighted.minimizer_set(np.frombuffer(b"ACG", np.uint8), k, w)) == 0


def test_weighted(seqs):
    p = WeightedParams(k=7, window=5, size=30)
    spectra = weighted.spectrum(weighted.minimizers(seqs.where("id in (1, 2, 3, 4, 8)"), p))
    estimates = weighted.estimates(spectra)
    assert estimates.where("estimate < 1 or estimate > freq + 50").count() == 0
    first = estimates.groupBy("id").agg(F.min(F.struct("bin", "freq", "estimate")).alias("x")).first()["x"]
    assert first["freq"] == first["estimate"]
    pairs = compare.all_pairs(seqs.where("id in (1, 3, 4, 8)"))
    j = {(r["i"], r["j"]): r["weighted_jaccard"] for r in weighted.jaccard(weighted.sketch(estimates, p), pairs).collect()}
    assert j[(1, 8)] == pytest.approx(1) and j[(1, 3)] > j[(1, 4)]


def test_order(seqs):
    p = OrderParams(k=9, l=2, m=40, reverse=True)
    sketches = order.sketch(seqs, p).cache()
    none = {r["id"] for r in sketches.where("data is null").collect()}
    assert none == {5, 6, 7}
    j = {(r["i"], r["j"]): r["similarity"] for r in order.similarity(sketches, compare.all_pairs(seqs)).collect()}
    assert j[(1, 2)] == 1 and 0 < j[(1, 3)] < 1 and j[(1, 4)] < 0.2 and j[(1, 5)] is None
    around = {(r["i"], r["j"]): r["similarity"] for r in order.similarity(sketches, compare.all_pairs(seqs), circular=True).collect()}
    assert around[(1, 2)] == 1 and around[(1, 3)] >= j[(1, 3)]


def test_order_blocks_by_definition():
    p = OrderParams(k=4, l=3, m=6)
    seq = dna(60, 9)
    seeds = hashing.mersenne64(p.seed, p.m)
    code = {"A": 0, "C": 1, "T": 2, "G": 3}
    seen, keys = {}, []
    for i in range(len(seq) - 3):
        packed = 0
        for c in seq[i : i + 4]:
            packed = (packed | code[c]) << 2
        keys.append(packed + seen.get(packed, 0))
        seen[packed] = seen.get(packed, 0) + 1
    got = order.blocks(np.frombuffer(seq.encode(), np.uint8), p, seeds)
    for block, s in zip(got, seeds):
        h = hashing.fmix64(np.array(keys, np.uint64), s)
        at = sorted(sorted(range(len(keys)), key=lambda i: (int(h[i]), i))[:3])
        assert block == "".join(seq[i : i + 4] for i in at)


def test_matrix_and_phylip(spark, seqs):
    some = seqs.where("id in (1, 2, 3)")
    p = WeightedParams(k=7, window=5, size=10)
    rows = compare.matrix(some, compare.all_pairs(some), P, p, OrderParams(k=9, m=20), HllParams(p=8, k=11)).collect()
    assert len(rows) == 3 and all(0 <= r[c] <= 1 for r in rows for c in ("weighted", "minhash", "order"))
    lines = {r["id"]: r["line"] for r in compare.phylip(some, compare.minhash_measures(minhash.sketch(some, P), P)).collect()}
    assert lines[None] == "3" and lines[1] == "1" and lines[2] == "2 0.000000" and len(lines[3].split()) == 3


def test_candidate_pairs_in_blocks(spark):
    rng = random.Random(6)
    rows = [(i, h) for i in range(40) for h in rng.sample(range(60), 6)] + [(i, 999) for i in range(40)] + [(100 + i, 7000 + h) for i in range(5) for h in range(9)]
    df = spark.createDataFrame(rows, "id long, hash long")
    of = {}
    for i, h in rows:
        of.setdefault(i, set()).add(h)
    want = {(i, j): len(of[i] & of[j]) for i in of for j in of if i < j and of[i] & of[j]}
    for block in (compare.BLOCK, 7):
        assert {(r["i"], r["j"]): r["shared"] for r in compare.candidate_pairs(df, block).collect()} == want
    ids = df.select("id").unionByName(spark.createDataFrame([(None,)], "id long"))
    every = [(r["i"], r["j"]) for r in compare.all_pairs(ids, blocks=4).collect()]
    assert sorted(every) == [(i, j) for i in sorted(of) for j in sorted(of) if i < j]
    assert compare.candidate_pairs(df.limit(0)).count() == 0 and compare.all_pairs(df.limit(0)).count() == 0


def test_sketches_carry_their_parameters(spark, seqs, tmp_path):
    from sketchloom import storage

    made = {"mh": minhash.sketch(seqs, P), "hl": hll.registers(seqs, HllParams(p=8, k=11)), "om": order.sketch(seqs, OrderParams(k=9, m=4)), "empty": minhash.sketch(seqs.limit(0), P)}
    for name, sketch in made.items():
        storage.save(sketch, str(tmp_path / name))
        again = storage.load(spark, str(tmp_path / name))
        assert storage.params_of(again) == storage.params_of(sketch) is not None
    again = storage.load(spark, str(tmp_path / "mh"))
    other = minhash.sketch(seqs, MinHashParams(k=12, size=50))
    for call in (lambda: minhash.merge(again, other, P), lambda: compare.minhash_measures(other, P), lambda: hll.merge(made["hl"], hll.registers(seqs, HllParams(p=9, k=11)))):
        with pytest.raises(ValueError):
            call()
    assert compare.minhash_measures(again, P).count() > 0
    with pytest.raises(ValueError):
        P.check(HllParams())


def test_equal_order_sketches(spark):
    df = spark.createDataFrame([(1, dna(100, 1)), (2, dna(100, 1)), (3, dna(100, 2)), (4, "A"), (5, "A")], "id long, seq string")
    sketches = order.sketch(df, OrderParams(k=9, m=6, reverse=True))
    got = {(r["i"], r["j"]): r["equal"] for r in order.equal(sketches, compare.all_pairs(df)).collect()}
    assert got[(1, 2)] and got[(4, 5)] and not got[(1, 3)] and not got[(1, 4)]


def test_rolling_registers_with_other_letters():
    r = random.Random(12)
    code = {"A": 0, "C": 1, "G": 2, "T": 3}
    for k in (1, 2, 5, 31):
        seq = "".join(r.choices("ACGTN", k=90))
        f, b, want = 0, 0, []
        for i, c in enumerate(seq):
            c = code.get(c, 4)
            f = (f << 2 | c) & ((1 << 2 * k) - 1)
            b = b >> 2 | (3 ^ c) << 2 * (k - 1)
            if i >= k - 1:
                want.append((f, b))
        got = weighted._strands(np.frombuffer(seq.encode(), np.uint8), k)
        assert list(zip(*(x.tolist() for x in got))) == want


def test_p_value_is_the_binomial_tail(spark):
    rows = [(x, s, 900.0 * s, 40_000.0) for s in (5, 20) for x in range(s + 1)] + [(3, 5, 0.0, 10.0)]
    df = spark.createDataFrame(rows, "x long, s long, a double, b double")
    for (x, s, a, b), v in zip(rows, [r[0] for r in df.select(minhash.p_value(F.col("x"), F.col("s"), F.col("a"), F.col("b"), 8)).collect()]):
        p, q = a / (a + 4**8), b / (b + 4**8)
        rate = p * q / (p + q - p * q)
        want = sum(math.comb(s, i) * rate**i * (1 - rate) ** (s - i) for i in range(x, s + 1)) if rate else float(x == 0)
        assert v == pytest.approx(min(1, want), rel=1e-9)


def test_pairs_are_counted_where_they_meet(spark):
    """No row of the plan is a pair before it is counted: shuffles carry sketches only, and copies are one unit."""
    rng = random.Random(3)
    texts = [dna(300, s) for s in range(12)]
    rows = [(n, texts[n % 12][: rng.choice((200, 300))] + dna(rng.choice((0, 40)), 50 + n % 5)) for n in range(60)]
    df = spark.createDataFrame(rows + [(100 + n, texts[0]) for n in range(30)] + [(None, texts[0])], "id long, seq string")
    p = MinHashParams(k=11, size=30)
    sketches = minhash.sketch(df, p).cache()
    of = {}
    for r in sketches.collect():
        of.setdefault(r["id"], set()).add(r["hash"] % 2**64)
    of.pop(None)
    want = {}
    for i in of:
        for j in of:
            if i < j and of[i] & of[j]:
                top = set(sorted(of[i] | of[j])[: p.size])
                want[(i, j)] = (len(of[i] & of[j] & top) / len(top), len(of[i] & of[j]) / min(len(of[i]), len(of[j])), len(of[i] & of[j]) / len(of[i] | of[j]))
    measured = compare.minhash_measures(sketches, p)
    assert not any(w in measured._jdf.queryExecution().toString() for w in ("Join", "Aggregate"))
    assert {(r["i"], r["j"]): (r["jaccard"], r["containment"]) for r in measured.collect()} == {k: v[:2] for k, v in want.items()}
    least = minhash.unsigned(F.col("hash"))
    for size, order_by, at in ((None, None, 2), (p.size, least, 0)):
        found = meetings.met(sketches, ("jaccard",), size, order_by, block=150).collect()
        assert len(found) == len(want) and {(r["i"], r["j"]): r["jaccard"] for r in found} == {k: v[at] for k, v in want.items()}
    named = sketches.select(F.concat(F.lit("s"), F.col("id")).alias("id"), F.struct(F.lit("x"), "hash").alias("hash"))
    assert meetings.met(named, ("shared",)).count() == len(want)


def test_slices_of_meetings(spark, monkeypatch):
    """With slices and units of a few, the same pairs."""
    from pyspark import cloudpickle

    rows = [(i, h) for i in range(30) for h in range(i % 7, 12)]
    df = spark.createDataFrame(rows, "id long, hash long")
    of = {i: set(range(i % 7, 12)) for i in range(30)}
    for name in ("STEP", "ROWS", "MEMBERS"):
        monkeypatch.setattr(meetings, name, 3)
    cloudpickle.register_pickle_by_value(meetings)  # so that workers have the same
    try:
        found = meetings.met(df, ("shared",)).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(meetings)
    assert sorted((r["i"], r["j"], r["shared"]) for r in found) == [(i, j, len(of[i] & of[j])) for i in of for j in of if i < j]


def test_tasks_send_only_hashes_of_sketches(spark, monkeypatch):
    """Rows of one id are merged before the shuffle, with any min_copies, and parts of a sequence count as one."""
    few = [dna(40, s) for s in range(6)]
    rows = [(n % 2 if n % 7 else None, few[n % 5] + dna(50, n)) for n in range(400)] + [(3, None), (3, "ACG")]
    df = spark.createDataFrame(rows, "id long, seq string").coalesce(1)
    every = {}
    for i, s in rows:
        for h in minhash.hash_windows(np.frombuffer((s or "").encode(), np.uint8), P).tolist():
            counts = every.setdefault(i, {})
            counts[h] = counts.get(h, 0) + 1
    for copies in (1, 3):
        p = MinHashParams(k=11, size=20, min_copies=copies)
        assert minhash.hashed(df, p).count() <= 3 * (20 if copies == 1 else 2000)
        want = sorted((str(i), h, n) for i, c in every.items() for h, n in sorted((h, n) for h, n in c.items() if n >= copies)[:20])
        assert sorted((str(r["id"]), r["hash"] % 2**64, r["multiplicity"]) for r in minhash.sketch(df, p).collect()) == want
    hashes = np.random.default_rng(1).integers(0, 50, 3000).astype(np.uint64)
    owner = np.random.default_rng(2).integers(0, 3, 3000)
    p = MinHashParams(k=11, size=4, min_copies=25)
    kept = list(zip(*(x.tolist() for x in minhash.fewest(owner, hashes, p))))
    for o in range(3):
        n = np.bincount(hashes[owner == o].astype(int), minlength=50)
        last = [h for h in range(50) if n[h] >= 25][:4][-1]
        assert [x[1:] for x in kept if x[0] == o] == [(h, n[h]) for h in range(last + 1) if n[h]]
