import collections
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import components, words
from pyspark.sql import functions as F

from sketchloom.llm import byte_bpe, katz, language_id, near_dedup, packing, quality, vp_search
from sketchloom.llm.components import components as connected

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def prose(n, seed, size=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# Near-duplicates


def family(seed, n, copies, edits):
    r = random.Random(seed)
    base = prose(n, seed).split()
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 5])
@pytest.mark.parametrize("n,num", [(3, 85), (5, 80)])
def test_links_against_brute_force(spark, n, num, block):
    texts = [t for k in range(5) for t in family(k, 60 + 10 * k, 14, 8)] + ["a b", "A  B", "a", "", None, " \t", "x" * 30_000]
    rows = [(1000 - 3 * k, t) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(table(spark, rows), n, num, block=block).collect()}
    assert got == components(rows, n, num, 100)


def test_rows_without_and_with_shared_ids(spark):
    a, b = prose(50, 1), prose(50, 2)
    rows = [(5, a), (5, b), (7, a), (9, b), (None, a), (11, prose(50, 3)), (11, prose(50, 3))]
    got = near_dedup.near_duplicates(table(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(5, 5), (5, 5), (7, 5), (9, 5), (11, 11), (11, 11)]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    left = near_dedup.drop_near_duplicates(table(spark, rows).withColumn("row", F.lit(1)))
    assert left.columns == ["doc_id", "text", "row"] and sorted(str(r["doc_id"]) for r in left.collect()) == ["11", "5", "5", "None"]
    assert near_dedup.near_duplicates(table(spark, rows).limit(0)).count() == 0
    assert near_dedup.drop_near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_no_row_without_an_id_is_lost(spark):
    a = prose(50, 1)
    rows = [(None, a, 1), (None, a, 1), (None, a, 2), (None, None, 1), (None, None, 1), (4, a, 1), (4, a, 2), (4, a, 2), (6, a, 9), (8, "", 1), (8, None, 1), (9, "", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rk1 long")
    left = [tuple(r) for r in near_dedup.drop_near_duplicates(df).collect()]
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    assert sorted((r for r in left if r[0] is None), key=key) == sorted(rows[:5], key=key)
    assert sorted(r[0] for r in left if r[0] is not None) == [4, 8, 8, 9]


def test_a_pair_under_the_distance_shares_a_key():
    signer = near_dedup.Signer(3, 8)
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, (1, 32), np.uint16)
        b = a.copy()
        at = rng.choice(32, 15, replace=False)
        b[0, at] ^= rng.integers(1, 1 << 16, 15, np.uint16)
        assert set(signer.keys(a)[0].tolist()) & set(signer.keys(b)[0].tolist())


def test_components_of_a_long_path(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(200)] + [(500, 400), (400, 450), (7, 7)]
    r.shuffle(edges)
    got = {x["node"]: x["component"] for x in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {k: 400 for k in (400, 450, 500)}


# Packing


def test_ids_equal_the_tokenizers():
    r = random.Random(0)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "É", "1", "²", "!", " ", "　", "日", "don't", "I'LL", "<|endoftext|>", "\x1c", "🙂"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(3000)] + [None, ""]
    encoder = byte_bpe.encoder(BPE)
    for lo, hi, ids, at in byte_bpe.encode_column(pa.array(texts), BPE, 0, 5000):
        for k in range(lo, hi):
            want = encoder.tokenizer.encode(texts[k] or "", add_special_tokens=False).ids
            assert ids[at[k - lo] : at[k - lo + 1]].tolist() == [*want, 0]


def test_plan_uses_every_rest_once():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 300, 20_000):
        h = np.bincount(rng.integers(1, 64, n), minlength=65)
        planned = packing.plan(h, 64)
        used = np.zeros(65, np.int64)
        for lengths, repeats in planned:
            assert sum(lengths) <= 64 and repeats > 0
            np.add.at(used, list(lengths), repeats)
        assert (used == h).all()
        if n > 1000:
            assert sum(r for _, r in planned) <= 1.01 * math.ceil((h * np.arange(65)).sum() / 64)


def test_pack_round_trip(spark):
    r = random.Random(9)
    rows = [(k, prose(r.randrange(0, 400), k)) for k in range(80)] + [(None, "x"), (3, "again"), (90, None), (91, ""), (92, "z " * 20_000)]
    got = packing.pack(table(spark, rows).repartition(5), ["doc_id"], BPE, window=256, with_ids=True).collect()
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for x in got:
        assert x["length"] == len(x["ids"]) and x["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<u4").tobytes())
        by_sequence[x["sequence_id"]].append((x["offset"], x["length"]))
        by_doc[x["doc_id"], x["doc_tokens"]].append((x["start"], x["ids"]))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    encoder = byte_bpe.encoder(BPE)
    want = sorted([*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows)
    assert sorted(sum((ids for _, ids in sorted(p)), []) for p in by_doc.values()) == want
    assert packing.pack(table(spark, rows).limit(0), ["doc_id"], BPE).count() == 0
    clash = table(spark, rows[:3]).withColumn("Offset", F.lit(7).cast("long"))
    assert packing.pack(clash, ["doc_id", "Offset"], BPE).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_padding_of_real_documents(spark):
    got = packing.query(spark, "/root/testdata/sf0.01").select("doc_id", "start", "length", "sequence_id", "offset").collect()
    fill = collections.Counter()
    for x in got:
        fill[x["sequence_id"]] += x["length"]
    assert max(fill.values()) <= 1024 and len({(x["sequence_id"], x["offset"]) for x in got}) == len(got)
    assert sum(fill.values()) / (1024 * len(fill)) > 0.99


# Language


@pytest.fixture(scope="module")
def tongues(spark):
    r = random.Random(13)
    syllables = {"aa": ["ka", "lo", "mi", "te"], "bb": ["zu", "sch", "rö", "ein"], "cc": ["qué", "ñi", "ora", "el"]}
    say = lambda k, n: " ".join("".join(r.choices(syllables[k], k=r.randrange(1, 4))) for _ in range(n))
    rows = [(i, say(k, r.randrange(3, 120)), k) for i, k in enumerate(r.choices(list(syllables), k=500))]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 !?", "cc"), (903, say("aa", 9), None), (None, say("bb", 30), "bb"), (5, rows[5][1], rows[5][2]), (904, say("cc", 20_000), "cc")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_of_held_out_texts(tongues):
    model, calibration = language_id.train(tongues.where(language_id.bucket("doc_id", 5) != 0))
    got = language_id.identify(tongues, model, calibration, ["doc_id"]).collect()
    truth = {r["doc_id"]: r["lang"] for r in tongues.collect()}
    assert len(got) == tongues.count()
    none = {r["doc_id"]: r for r in got if r["doc_id"] in (900, 901, 902)}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in none.values())
    held = [r for r in got if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["doc_id"] not in none and truth[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    assert model.languages == ["aa", "bb", "cc"]


def test_kneser_ney_sums_to_one():
    texts = ["abab abc cab", "bca cab ab"]
    from sketchloom.llm import kernels as K

    gram = np.concatenate([language_id.grams(*K.utf8(pa.array([t])))[0] for t in texts])
    model = language_id.Model(["x"], {"x": np.unique(gram, return_counts=True)})
    symbols = [ord(c) for c in "abc "]
    for context in ("aba", " ab", "zzz", "cab"):
        base = 0
        for c in context:
            base = base << 16 | ord(c)
        p = np.exp(model.log_probabilities(np.array([base << 16 | s for s in symbols], np.uint64)))[:, 0]
        # What is missing to 1 is what the uniform distribution gives to unknown symbols.
        unknown = np.exp(model.log_probabilities(np.array([base << 16 | 0xFFFE], np.uint64)))[0, 0]
        assert p.sum() + unknown == pytest.approx(1, abs=1e-5)


class PlainKneserNey:
    """Interpolated Kneser-Ney over characters by dictionaries."""

    def __init__(self, texts, order=4):
        self.order, self.tables = order, {}
        counts = collections.Counter()
        for t in texts:
            padded = " " * (order - 1) + t
            counts.update(padded[i : i + order] for i in range(len(t)))
        self.symbols = {g[-1] for g in counts}
        for n in range(order, 0, -1):
            ones, twos = (sum(c == r for c in counts.values()) for r in (1, 2))
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            total, kinds = collections.Counter(), collections.Counter()
            for g, c in counts.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.tables[n] = dict(counts), d, total, kinds
            counts = collections.Counter(g[1:] for g in counts)

    def p(self, gram, n=None):
        n = self.order if n is None else n
        if n == 0:
            return 1 / (len(self.symbols) + 1)
        counts, d, total, kinds = self.tables[n]
        g = gram[-n:]
        h = g[:-1]
        if not total[h]:
            return self.p(gram, n - 1)
        return max(counts.get(g, 0) - d, 0) / total[h] + min(d, 1) * kinds[h] / total[h] * self.p(gram, n - 1)


def test_kneser_ney_against_dictionaries():
    from sketchloom.llm import kernels as K

    r = random.Random(3)
    say = lambda parts: " ".join("".join(r.choices(parts, k=r.randrange(1, 4))) for _ in range(40))
    texts = {"x": [say(["ab", "ca", "b"]) for _ in range(6)], "y": [say(["de", "ba", "c"]) for _ in range(5)]}
    counts = {k: np.unique(np.concatenate([language_id.grams(*K.utf8(pa.array([t])))[0] for t in v]), return_counts=True) for k, v in texts.items()}
    model = language_id.Model(["x", "y"], counts)
    plain = {k: PlainKneserNey(v) for k, v in texts.items()}
    floor = 1 / (len({c for t in plain.values() for c in t.symbols}) + 1)
    for t in plain.values():
        t.p = lambda gram, n=None, t=t: floor if n == 0 else PlainKneserNey.p(t, gram, n)
    asked = ["abab", " aba", "zzab", "   a", "caba", "qqqq", "edba", "b ca", "ab d"] + [t[i : i + 4] for v in texts.values() for t in v for i in range(0, 60, 7)]
    packed = np.array([sum(ord(c) << 16 * (3 - k) for k, c in enumerate(g)) for g in asked], np.uint64)
    got = np.exp(model.log_probabilities(packed))
    for k, name in enumerate(("x", "y")):
        assert got[:, k] == pytest.approx([plain[name].p(g) for g in asked], rel=1e-5)


def test_equal_entropies_take_the_first_language(spark):
    df = spark.createDataFrame([(k, "abc cab bca abc", lang) for k in range(40) for lang in ("bb", "aa")], "doc_id long, text string, lang string")
    model, calibration = language_id.train(df)
    clash = df.limit(3).withColumn("SCORE", F.lit(9).cast("long")).withColumn("kept_0", F.lit(4).cast("long"))
    got = language_id.identify(clash, model, calibration, ["SCORE", "kept_0", "doc_id"])
    assert got.columns == ["kept_0", "doc_id", "lang_pred", "score", "rejected", "cross_entropy"]
    assert {(r["lang_pred"], r["kept_0"]) for r in got.collect()} == {("aa", 4)}


def test_no_language_learned(spark, tongues):
    model, calibration = language_id.train(tongues.withColumn("lang", F.lit(None).cast("string")))
    got = language_id.identify(tongues, model, calibration, ["doc_id"]).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert language_id.identify(tongues.limit(0), model, calibration, ["doc_id"]).count() == 0


# Quality


def test_graded_quality(spark):
    r = random.Random(17)
    docs, labels = [], []
    for k in range(900):
        kind = r.choice((0, 1, 2, 2))
        text = prose(r.randrange(5, 80), k).split()
        if kind == 0:
            text.insert(r.randrange(len(text)), r.choice(["vile", "nasty", "gross"]))
        if kind == 1:
            text = [w.upper() + "!!" for w in text]
        docs.append((k, " ".join(text), "x"))
        if k < 600:
            labels.append((k, int(kind == 2), int(kind == 0)))
        else:
            labels.append((k, None, 1))
    docs += [(2000, None, "x"), (2001, "", "x"), (None, "plain words", "x"), (2002, "w1 " * 100_000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, kept string")
    grades = spark.createDataFrame(labels + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(df, quality.graded(grades))
    assert model.thresholds[0] < model.thresholds[1] and (model.weights <= 0).all()
    got = {x["doc_id"]: x for x in quality.score(df, model).collect()}
    assert len(got) == len(docs)
    kinds = collections.defaultdict(list)
    for k, text, _ in docs[600:900]:
        kinds["bad" if "!!" in text or set(text.split()) & {"vile", "nasty", "gross"} else "good"].append(got[k]["kept"])
        assert 0 <= got[k]["tail_prob"] <= got[k]["p_not_toxic"] <= 1
        assert got[k]["expected_grade"] == pytest.approx(got[k]["tail_prob"] + got[k]["p_not_toxic"])
    assert np.mean(kinds["good"]) > 0.98 and np.mean(kinds["bad"]) < 0.05
    empty = quality.train(df, quality.graded(grades.limit(0)))
    assert quality.score(df.limit(0), empty).count() == 0 and quality.score(df, empty).where("kept").count() == len(docs)


def small_problem(seed, docs=60, size=8):
    r = np.random.default_rng(seed)
    has = r.random((docs, size)) < 0.3
    grade = np.clip(2 - has[:, 0] * 2 - has[:, 1] - (r.random(docs) < 0.1), 0, 2).astype(int)
    doc, column = np.nonzero(has)
    return quality.Objective(doc, column, grade, size, 1e-3, 2e-3), has, grade


def test_gradient_of_the_likelihood():
    f, _, _ = small_problem(1)
    x = np.append(-np.random.default_rng(2).random(8), [-1.5, 0.4])
    value, g = f(x)
    for k in range(len(x)):
        step = np.zeros(len(x))
        step[k] = 1e-6
        assert (f(x + step)[0] - f(x - step)[0]) / 2e-6 == pytest.approx(g[k], rel=1e-4, abs=1e-7)


def test_fit_against_another_search():
    for seed in range(3):
        f, has, grade = small_problem(seed)
        start = np.append(np.zeros(8), [-5.0, 0.5])
        x = quality.minimise(f, start, 500, 1e-9)
        assert (x[:-2] <= 0).all()
        # Coordinate search with shrinking steps, without gradients.
        y, step = start.copy(), 1.0
        best = f(y)[0]
        while step > 1e-7:
            moved = False
            for k in range(len(y)):
                for sign in (1, -1):
                    z = y.copy()
                    z[k] += sign * step
                    if k < 8:
                        z[k] = min(z[k], 0)
                    if (v := f(z)[0]) < best - 1e-13:
                        y, best, moved = z, v, True
            if not moved:
                step /= 2
        assert f(x)[0] == pytest.approx(best, abs=1e-5)
        # What the value means: weighted likelihood of the grades.
        t = np.array([-np.inf, x[-2], x[-2] + np.exp(x[-1]), np.inf])
        score = has @ x[:-2]
        p = [1 / (1 + math.exp(t[g] - s)) - 1 / (1 + math.exp(min(t[g + 1] - s, 700))) if g else 1 - 1 / (1 + math.exp(t[1] - s)) for s, g in zip(score, grade)]
        weight = [len(grade) / (len(set(grade)) * (grade == g).sum()) / len(grade) for g in grade]
        want = -sum(w * math.log(v) for w, v in zip(weight, p)) + 5e-4 * (x[:-2] @ x[:-2]) - 2e-3 * x[:-2].sum()
        assert f(x)[0] == pytest.approx(want, rel=1e-9)


def test_growing_sets_reach_the_solution_over_all_features(monkeypatch):
    r = np.random.default_rng(5)
    has = r.random((400, 60)) < 0.2
    grade = np.clip(2 - has[:, :3].sum(1), 0, 2).astype(int)
    at = np.concatenate(([0], np.cumsum(has.sum(1))))
    feature = np.nonzero(has)[1].astype(np.int64) * 11
    monkeypatch.setattr(quality, "MORE", 2)
    a = quality.fit(feature, at, grade)
    monkeypatch.setattr(quality, "MORE", 1000)
    b = quality.fit(feature, at, grade)
    assert a.feature.tolist() == b.feature.tolist() and a.weights == pytest.approx(b.weights, abs=2e-2) and a.thresholds == pytest.approx(b.thresholds, abs=2e-2)


def test_scores_replace_columns_of_their_names(spark):
    df = spark.createDataFrame([(1, "plain words", "x", 5)], "doc_id long, text string, KEPT string, grade int")
    model = quality.train(df, quality.graded(spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")))
    got = quality.score(df, model)
    assert got.columns == ["doc_id", "text", "grade", "expected_grade", "p_not_toxic", "tail_prob", "kept"] and got.first()["kept"] is True


# Neighbours


def test_neighbours_are_exact(spark):
    rng = np.random.default_rng(23)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    base[50:120] = base[7]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(base)]
    rows += [(301, None), (302, [0.0] * 8), (303, [float("nan")] + [1.0] * 7), (304, [None] + [1.0] * 7), (305, [float("inf")] + [0.0] * 7), (None, rows[0][1]), (306, [1.0]), (7, rows[7][1]), (400, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    asked = df.where("vec_id % 20 = 0 or vec_id = 7")
    for x in vp_search.search(df, asked, 10, query_block=7, shard_vectors=90).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    ids = np.array([*range(300), 400])
    points = np.concatenate((base, base[7:8])).astype(float)
    assert set(got) == {*range(0, 300, 20), 7, 400}
    for q, rows_ in got.items():
        d = vp_search.distances(points[ids == q][:1], points)[0]
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        assert sorted(rows_) == [(k + 1, int(ids[i]), float(d[i])) for k, i in enumerate(best)]
    few = vp_search.search(df.where("vec_id in (1, 2, 3)"), df.where("vec_id = 1"), 10).collect()
    assert len(few) == 2
    assert vp_search.search(df.limit(0), df.limit(0), 10).count() == 0


def test_ids_with_several_vectors(spark):
    rows = [(100, [1.0, 0.0], "x"), (100, [3.0, 0.0], "x"), (1, [1.0, 1.0], "x"), (1, [5.0, 0.0], "x"), (1, [5.0, 0.0], "y"), (2, [1.0, 3.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = vp_search.search(df, df.where("vec_id = 100"), 10).orderBy("rank").collect()
    assert [tuple(x) for x in got] == [(100, 1, 1, 1.0), (100, 2, 2, 3.0), (100, 3, 1, 4.0)]


def test_recall_of_a_relaxed_search():
    rng = np.random.default_rng(29)
    points = rng.normal(size=(3000, 16))
    tree = vp_search.Tree.build(points, np.arange(3000), 11, leaf=64)
    _, exact = tree.search(points[:50], np.arange(50), 10)
    _, loose = tree.search(points[:50], np.arange(50), 10, factor=1.5)
    assert np.mean([len({*a} & {*b}) / 10 for a, b in zip(exact, loose)]) >= 0.9


# Katz


def plain_discount(counts):
    """d(c) by Good-Turing with Katz's cutoff at 5, from a Counter."""
    n = [sum(c == r for c in counts.values()) for r in range(7)]

    def of(c):
        if c > 5:
            return 0.999
        try:
            top = 6 * n[6] / n[1]
            d = ((c + 1) * n[c + 1] / (c * n[c]) - top) / (1 - top)
        except ZeroDivisionError:
            d = 0
        return d if 0 < d < 1 else (c - 0.5) / c

    return of


def plain_katz(rows, held):
    text = [[*words(t), None] for _, t in rows]
    one, two = collections.Counter(), collections.Counter()
    for t, out in zip(text, held):
        if not out:
            one.update(t)
            two.update(zip(["<s>", *t[:-1]], t))
    n = sum(one.values())
    d1, d2 = plain_discount(one), plain_discount(two)
    p1 = {w: d1(c) * c / n for w, c in one.items()}
    total, left, low = collections.Counter(), collections.Counter(), collections.Counter()
    for (h, w), c in two.items():
        total[h] += c
        left[h] += (1 - d2(c)) * c
        low[h] += p1[w]
    alpha = {h: left[h] / total[h] / (1 - low[h]) for h in total}
    unknown = 1 - sum(p1.values()) if n else 1.0
    out = []
    for t in text:
        s = b = 0.0
        for h, w in zip(["<s>", *t[:-1]], t):
            c = two[h, w]
            s += math.log10(d2(c) * c / total[h] if c else alpha.get(h, 1.0) * p1.get(w, unknown))
            b += math.log10((one[w] + 0.1) / (n + 0.1 * (len(one) + 1)))
        out.append((len(t), sum(one[w] > 0 for w in t), n, b, s))
    return out, alpha, p1, unknown, two, total


@pytest.mark.parametrize("small", [False, True])
def test_scores_against_brute_force(spark, small):
    r = random.Random(31)
    rows = [(k, " ".join(f"W{int(r.paretovariate(0.8))}" for _ in range(r.randrange(80)))) for k in range(150)]
    rows += [(None, "w1 w2"), (200, None), (201, ""), (202, "w1 " * 5000), (3, rows[3][1]), (203, "é\x0bÉ")]
    held = [k is not None and k % 4 == 0 for k, _ in rows]
    df = spark.createDataFrame([(*row, h) for row, h in zip(rows, held)], "doc_id long, text string, out boolean").repartition(3)
    options = dict(partition_bytes=3000, chunk_bytes=1500, hot_share=0.05) if small else {}
    got = sorted((str(x["doc_id"]), x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6), round(x["score"], 6)) for x in katz.score(df, "out", **options).collect())
    want = sorted((str(k), n, known, total, round(b, 6), round(s, 6)) for (k, _), (n, known, total, b, s) in zip(rows, plain_katz(rows, held)[0]))
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-4)


@pytest.mark.parametrize("small", [False, True])
def test_backoff_weights_of_the_tables_sum_to_one(spark, small):
    from sketchloom.llm import kernels as K

    r = random.Random(37)
    rows = [(k, " ".join(f"w{int(r.paretovariate(0.9))}" for _ in range(30))) for k in range(60)]
    df = spark.createDataFrame([(*row, False) for row in rows], "doc_id long, text string, out boolean").repartition(3)
    t = katz.train(df, "out", **(dict(partition_bytes=1000, chunk_bytes=700, hot_share=0.05) if small else {}))
    _, alpha, p1, unknown, two, total = plain_katz(rows, [False] * len(rows))
    code = lambda w: int(katz.START) if w == "<s>" else int(katz.END) if w is None else K.string_hash(w)
    weight = {x["context"] % (1 << 64): 10 ** x["weight"] for x in t.weights.collect()}
    assert set(weight) == {code(h) for h in total} and t.weights.count() == len(weight)
    for h in total:
        assert weight[code(h)] == pytest.approx(alpha[h])
        seen = sum(float(t.model.pairs.kept(np.array([two[h, w]]))[0]) / total[h] for w in p1 if two[h, w])
        assert seen + weight[code(h)] * (unknown + sum(p for w, p in p1.items() if not two[h, w])) == pytest.approx(1)
    # The stored counts are the corpus's, each pair once.
    found = collections.Counter()
    for x in t.counted.where(F.col("kind") == katz.COUNTS).collect():
        a = katz._unpack(x["data"])
        word = np.repeat(np.cumsum(a["word"]), a["pairs"].astype(int))
        for h, w, c in zip(a["context"].tolist(), word.tolist(), a["pair"].tolist()):
            found[h, w] += c
    assert found == {(code(h), code(w)): c for (h, w), c in two.items()}


def test_other_columns_and_null_flags(spark):
    df = spark.createDataFrame([(1, "a b a", False, 5.0), (2, "a b", None, 5.0), (2, "a b", None, 5.0)], "doc_id long, text string, out boolean, score double")
    got = katz.score(df, "out").orderBy("doc_id").collect()
    assert got[0].__fields__ == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert [(x["held_out"], x["n_tokens"], x["train_tokens"]) for x in got] == [(False, 4, 4), (True, 3, 4), (True, 3, 4)] and got[1] == got[2]


def test_scores_without_training(spark):
    df = spark.createDataFrame([(1, "a b", True), (2, None, True)], "doc_id long, text string, out boolean")
    assert [(x["n_tokens"], x["n_known"], x["train_tokens"], x["base_score"], x["score"]) for x in katz.score(df, "out").orderBy("doc_id").collect()] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert katz.score(df.limit(0), "out").count() == 0
