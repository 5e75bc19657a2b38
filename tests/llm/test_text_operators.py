import random

import pytest
from brute import alnum, drop_lines, entropy, leaks, remove_repeats, sha, words
from pyspark.sql import functions as F

from sketchloom.llm import decontaminate, line_dedup, secret_scan, suffix_dedup

SCHEMA = "doc_id long, text string, row string, kept string, n_lines long"


def table(spark, texts, ids=None):
    """Rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "row", "kept", 7) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def prose(n, seed, size=200):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


# Lines


@pytest.mark.parametrize("in_place", [line_dedup.IN_PLACE_KEYS, 0])
def test_common_lines(spark, in_place):
    r = random.Random(3)
    lines = [f"line {k}" for k in range(40)] + ["  Ähm A\t", "ähm a", "", "\x0b", "É"]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randrange(1, 30))) for _ in range(60)]
    texts += [None, "", "\n\n", texts[0], texts[0], "only\r\nthis", "x" * 100_000 + "\nline 1"]
    got = line_dedup.drop_common_lines(table(spark, texts), in_place=in_place).collect()
    want = drop_lines(texts)
    assert sorted((r["text"], r["n_lines"], r["n_dropped"]) for r in got) == sorted(want)
    assert all(r["row"] == "row" and r["kept"] == "kept" for r in got)


def test_own_columns_replace_others_in_any_case(spark):
    df = spark.createDataFrame([(1, "a", 7, "x", "y")], "DOC_ID long, Text string, N_Lines long, n_dropped string, batch string")
    got = line_dedup.drop_common_lines(df)
    assert got.columns == ["DOC_ID", "Text", "batch", "n_lines", "n_dropped"] and got.collect() == [(1, "a", "y", 1, 0)]


def test_lines_of_repeated_ids_and_empty_tables(spark):
    texts = ["a\nb"] * 12 + ["a\nc"]
    got = line_dedup.drop_common_lines(table(spark, texts, [1] * 12 + [None])).collect()
    assert sorted(r["text"] for r in got) == [""] * 12 + ["c"]
    assert line_dedup.drop_common_lines(table(spark, ["x"]).limit(0)).count() == 0


def test_levels_of_runs(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2)
    seen = []
    for batch in (["a", "b"], ["a", "c"], ["a", "b"], ["b", "d"], ["a", "e"], ["a", "e"]):
        df = spark.createDataFrame([(t,) for t in batch], "text string")
        runs.add(df.select(line_dedup.line_hashes(F.col("text")).alias("hashes")))
        seen.append([len(x) for x in runs.levels])
    key = lambda *names: spark.createDataFrame([(n,) for n in names], "k string").select(F.xxhash64("k").alias("a"), F.xxhash64(F.lit(1), "k").alias("b"))
    assert sorted(runs.boilerplate().collect()) == sorted(key("a", "b").collect())
    assert seen == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1], [0, 1, 1]]
    # "a" was closed by the fourth batch, so later batches leave it out of their runs.
    closed = [x for c in runs.closed for x in spark.table(c).select("a", "b").collect()]
    assert key("a").first() in closed
    later = [x for r in runs.levels[1] for x in spark.table(r).select("a", "b", "n").collect()]
    assert [tuple(x) for x in later] == [(*key("e").first(), 2)]
    plan = runs._merged([runs.levels[1][0], runs.levels[2][0]])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.drop()
    assert not runs._paths


# Secrets


def test_base_spans_and_entropy(spark):
    r = random.Random(5)
    alphabet = secret_scan.CLASSES["base64"][0]
    key = "".join(r.sample(alphabet, 40))
    hexes = "".join(r.choices("0123456789ABCDEF", k=30)).upper()
    texts = [
        f"é token=ab token:abcdefgh AKIA{'Q' * 16} {key} end", f"id {hexes}!", "PassWord = 'short' password: \"longer/one\"", "a" * 60 + " " + "0" * 40,
        "550e8400-e29b-41d4-a716-446655440000 2024-01-01-2024-01-01-2024-01", "some-words-that-make-a-long-path/of-words-and-more", None, "", "x token=token:abcdefgh", "deadbeef" * 4,
    ]
    got = [[(s["kind"], s["start"], s["end"]) for s in row["secrets"]] for row in secret_scan.scan(table(spark, texts)).orderBy("doc_id").collect()]
    t = texts[0]
    at = t.index("token:abcdefgh")
    assert got[0][:2] == [("assign", at, at + 14), ("access", t.index("AKIA"), t.index("AKIA") + 20)]
    kind, s, e = got[0][2]
    assert kind == "entropy" and t.index(key) <= s < e <= t.index(key) + 40
    assert any(k == "entropy" for k, _, _ in got[1]) == any(entropy(hexes[i : i + 24]) >= 3.05 for i in range(7))
    assert [k for k, _, _ in got[2]] == ["assign"]
    assert got[3] == [("hex", 0, 60), ("hex", 61, 101)]
    assert not got[4] and not got[5] and not got[6] and not got[7] and not got[8]
    assert got[9] == [("hex", 0, 32)]


def test_windows_by_incremental_counts(spark):
    r = random.Random(8)
    alphabet, least = secret_scan.CLASSES["base64"]
    runs = ["".join(r.choices(alphabet[: r.choice((8, 20, 67))], k=r.randrange(24, 70))) for _ in range(60)] + ["A" * 24 + "."]
    df = spark.createDataFrame([(x,) for x in runs], "m string")
    got = df.select("m", secret_scan.window_span(F.split("m", ""), alphabet, least).alias("x")).collect()
    for row in got:
        m = row["m"]
        good = [i for i in range(len(m) - 23) if all(c in alphabet for c in m[i : i + 24]) and entropy(m[i : i + 24]) >= least]
        assert (row["x"] and (row["x"]["s"], row["x"]["e"])) == ((good[0], good[-1] + 24) if good else None)
    assert secret_scan.scan(table(spark, ["x"]).limit(0)).count() == 0


def test_long_runs_and_many_matches(spark):
    r = random.Random(9)
    alphabet = secret_scan.CLASSES["base64"][0]
    long_run = "".join(r.choices(alphabet, k=1_000_000))
    key = "".join(r.sample(alphabet, 40))
    many = f"token=abcdefgh {key} " * 50_000
    got = {x["doc_id"]: x["n"] for x in secret_scan.scan(table(spark, [long_run, many])).select("doc_id", F.size("secrets").alias("n")).collect()}
    assert got == {0: 1, 1: 100_000}


def test_spans_that_meet(spark):
    r = random.Random(10)
    rows = []
    for _ in range(200):
        base = sorted({r.randrange(60) for _ in range(r.randrange(6))})
        rows.append(([(s, s + r.randrange(1, 9)) for s in base], [(s, s + r.randrange(1, 9)) for s in r.sample(range(60), 5)]))
    df = spark.createDataFrame(rows, "base array<struct<start:int,end:int>>, found array<struct<s:int,e:int>>")
    for x in df.select("base", "found", secret_scan.without_overlap(F.col("found"), F.col("base")).alias("left")).collect():
        want = [(f["s"], f["e"]) for f in x["found"] if not any(b["start"] < f["e"] and f["s"] < b["end"] for b in x["base"])]
        assert sorted((f["s"], f["e"]) for f in x["left"]) == sorted(want)


def test_running_sums_over_blocks(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 4, 5, 23)], "v array<int>")
    for x in df.select("v", secret_scan.running(F.col("v"), 0, lambda a, b: a + b, block=4).alias("s")).collect():
        assert x["s"] == [sum(x["v"][:k]) for k in range(len(x["v"]))]


def test_a_column_named_secrets_is_replaced(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh", "mine", "other")], "doc_id long, text string, SECRETS string, secret string")
    got = secret_scan.scan(df)
    assert [c.lower() for c in got.columns] == ["doc_id", "text", "secrets", "secret"] and len(got.collect()[0][2]) == 1


# Benchmark


@pytest.fixture(scope="module")
def leaky():
    r = random.Random(11)
    items = [(k, prose(r.randrange(1, 25), 100 + k)) for k in range(12)] + [(3, prose(12, 99)), (50, None), (51, "!!!"), (None, prose(9, 7)), (12, "É-2 x")]
    docs = []
    for k in range(50):
        parts = [prose(r.randrange(0, 60), 1000 + k)]
        for _ in range(r.randrange(3)):
            parts.insert(r.randrange(len(parts) + 1), (r.choice(items[:13])[1]).upper().replace(" ", " - "))
        docs.append(" ".join(parts))
    return docs + [None, "", "É 2 X", docs[0], "w1 " * 50_000], items


@pytest.mark.parametrize("block", [decontaminate.BLOCK_CHARS, 400])
def test_windows_found_by_the_index(spark, leaky, block):
    docs, items = leaky
    table_ = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.search(table(spark, docs), table_, ["doc_id"], block_chars=block).orderBy("doc_id").collect()
    real = [(i, t) for i, t in items if i is not None and t is not None]
    for row, text in zip(got, docs):
        n = len(alnum(text))
        if n < 1000:
            assert (row["n_words"], row["n_hit"], row["item_ids"]) == leaks(text, real)
        assert row["n_words"] == n


def near(text, item, slop):
    w, terms = alnum(text), set(alnum(item))
    size = len(alnum(item)) + slop
    return bool(terms) and any(terms <= set(w[i : i + size]) for i in range(len(w)))


def test_all_terms_near_each_other(spark):
    r = random.Random(41)
    items = [(k, prose(r.randrange(1, 5), 300 + k, 9)) for k in range(8)] + [(9, "..."), (10, "none such")]
    docs = [prose(r.randrange(0, 40), 600 + k, 12) for k in range(60)] + [None, ""]
    got = decontaminate.search(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"], slop=2).orderBy("doc_id").collect()
    assert [x["near_ids"] for x in got] == [sorted(str(i) for i, t in items if near(d, t, 2)) for d in docs]


def test_proximity_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta epsilon zeta")], "item_id long, text string")
    docs = table(spark, ["gamma x alpha y beta", "alpha " + "z " * 30 + "beta gamma", "zeta epsilon delta", "x"])
    got = decontaminate.search(docs, items, ["doc_id"], slop=4).orderBy("doc_id").collect()
    assert [r["near_ids"] for r in got] == [["1"], [], ["2"], []] and all(r["item_ids"] == [] for r in got)
    assert all(r["near_ids"] == [] for r in decontaminate.search(docs, items, ["doc_id"], slop=None).collect())
    index = decontaminate.build_index(docs, ["doc_id"])
    again = decontaminate.search(docs, items, ["doc_id"], slop=4, shards=index).orderBy("doc_id").collect()
    assert again == got and decontaminate.search(docs, items, ["doc_id", "n_lines"]).columns == ["doc_id", "n_lines", "n_words", "n_hit", "item_ids", "near_ids"]
    assert decontaminate.search(docs.withColumn("N_Hit", F.lit(3)), items, ["N_Hit"]).columns == ["n_words", "n_hit", "item_ids", "near_ids"]
    assert decontaminate.search(docs, items.limit(0), ["doc_id"]).where("n_hit > 0").count() == 0
    assert decontaminate.search(docs.limit(0), items, ["doc_id"]).count() == 0
    left = decontaminate.drop_contaminated(docs.withColumn("text", F.concat("text", F.lit(" alpha beta gamma"))), items)
    assert left.count() == 0 and left.columns == docs.columns


# Repeated strings


def test_suffix_array_of_small_alphabets():
    import numpy as np

    r = random.Random(2)
    for n in (1, 2, 5, 40, 300):
        for size in (1, 2, 3, 200):
            t = [r.randrange(1, size + 1) if r.random() > 0.05 else 0 for _ in range(n - 1)] + [0]
            order = suffix_dedup.suffix_array(np.array(t), 400).tolist()
            key = lambda i: t[i : t.index(0, i) + 1]
            assert sorted(order) == list(range(n)) and all(key(a) <= key(b) for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("split,segment", [(8192, suffix_dedup.SEGMENT), (1, suffix_dedup.SEGMENT), (8192, 97)])
def test_repeats_are_removed(spark, split, segment):
    r = random.Random(21)
    passage = prose(60, 77)
    texts = [prose(r.randrange(5, 80), k) for k in range(25)]
    for k in range(0, 20, 3):
        cut = r.randrange(0, 200)
        texts[k] = texts[k] + " " + passage[cut : cut + 260] + " " + texts[k][:30]
    texts += [None, "", "é" * 60, "ab" * 300, texts[1], texts[2] + "!", prose(300, 5), prose(300, 5)[7:]]
    got = suffix_dedup.remove_repeats(table(spark, texts), ["doc_id"], length=40, gram=12, split=split, segment=segment).orderBy("doc_id").collect()
    want = remove_repeats(texts, 40)
    assert [(x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in got] == want


def test_adjacent_common_prefixes():
    import numpy as np

    a = np.frombuffer(b"abcdabcxabcd", np.uint8).reshape(3, 4)
    b = np.frombuffer(b"abcdabcdxbcd", np.uint8).reshape(3, 4)
    assert suffix_dedup.common_prefixes(a, b).tolist() == [4, 3, 0]


def test_a_very_long_text(spark):
    r = random.Random(33)
    body = "".join(r.choices("abcdefghij ", k=1_500_000))
    texts = [body + body[1000:1900], body[700_000:700_400], "z" * 10]
    got = suffix_dedup.remove_repeats(table(spark, texts), ["doc_id"], segment=1 << 18).orderBy("doc_id").collect()
    assert [(x["n_bytes"], x["n_removed"], x["n_spans"]) for x in got] == [(1_500_900, 900 + 900 + 400, 3), (400, 400, 1), (10, 0, 0)]
    clash = table(spark, texts).withColumn("N_Bytes", F.lit(1)).withColumn("t1", F.lit(5).cast("long"))
    got = suffix_dedup.remove_repeats(clash, ["N_Bytes", "t1", "doc_id"])
    assert got.columns == ["t1", "doc_id", "n_bytes", "n_removed", "n_spans", "kept"] and {(x["t1"], x["n_removed"]) for x in got.collect()} == {(5, 2200), (5, 400), (5, 0)}


def test_repeats_of_production_length(spark):
    texts = [prose(400, k) for k in range(6)]
    texts[2] = texts[2][:500] + texts[0][100:460] + texts[2][500:]
    texts[4] = texts[4] + texts[0][200:399] + "?"
    got = suffix_dedup.remove_repeats(table(spark, texts, [5, 5, None, 3, 4, 0]), ["doc_id"]).collect()
    assert sorted((x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in got) == sorted(remove_repeats(texts, 200))
    assert suffix_dedup.remove_repeats(table(spark, ["x"]).limit(0), ["doc_id"]).count() == 0


def test_digests():
    assert sha("") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855" and words("A\x0bb") == ["a", "b"]
