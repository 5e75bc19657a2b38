import collections
import os

import numpy as np
import pytest
from brute import components, drop_lines, leaks

from sketchloom.llm import byte_bpe, quality
from sketchloom.llm.shared import stored

SF = "/root/testdata/sf0.001"
corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test-stage")
        rows.append(docs.collect())
        if stage is not corpus_pipeline.pack:
            assert docs.columns == columns
    raw, good, lines, single, clean, packed = rows

    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    right = [(r["quality"] == 1 and r["toxic"] == 0) == (k in kept) for k, r in labels.items()]
    assert np.mean(right) > 0.95
    again = quality.score(spark.read.parquet(f"{SF}/documents.parquet"), quality.trained(spark, SF)).where("kept").collect()
    assert {r["doc_id"] for r in again} == kept

    want = collections.Counter((r["doc_id"], t) for r, (t, _, _) in zip(good, drop_lines([r["text"] for r in good])))
    assert collections.Counter((r["doc_id"], r["text"]) for r in lines) == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines)

    label = components([(r["doc_id"], r["text"]) for r in lines], 5, 80, 100)
    assert {r["doc_id"] for r in single} == {k for k, c in label.items() if k == c}

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in single if not leaks(r["text"], items)[2]}

    import public_tokenizers

    encoder = byte_bpe.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {r["doc_id"]: len(encoder.tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in clean}
    assert {r["doc_id"]: r["doc_tokens"] for r in packed} == tokens
    total = collections.Counter()
    for r in packed:
        total[r["doc_id"]] += r["length"]
    assert total == tokens
    assert len(raw) >= len(good) >= len(single) >= len(clean)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and len(corpus_pipeline.STAGES) == 5


EMPTY = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}


def written(spark, folder, **tables):
    for name, kind in EMPTY.items():
        spark.createDataFrame(tables.get(name, []), kind).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("missing", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, tmp_path, missing):
    words = [" ".join(f"w{k * 50 + i}" for i in range(30)) for k in range(4)]
    tables = {
        "documents": [(k, w, "en", "s", len(w)) for k, w in enumerate(words)],
        "labels": [(k, 1, 0) for k in range(4)],
        "benchmark": [(9, " ".join(words[2].split()[3:15]))],
    }
    del tables[missing]
    got = corpus_pipeline.run(spark, written(spark, tmp_path / "t", **tables)).collect()
    want = {"documents": set(), "labels": {0, 1, 3}, "benchmark": {0, 1, 2, 3}}[missing]
    assert {r["doc_id"] for r in got} == want


def test_nulls_and_repeated_rows(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(40))
    near = text.replace("w39", "other")
    docs = [(5, text, "en", "s", 1), (5, text, "en", "s", 1), (3, near, None, None, None), (None, text, "en", "s", 1), (None, None, None, None, None), (8, None, "en", "s", None), (9, "", "en", "s", 0)]
    folder = written(spark, tmp_path / "t", documents=docs, labels=[(5, 1, 0), (None, 0, 0), (8, None, 1)], benchmark=[(None, text), (1, None)])
    stages = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stages.append(stored(stage(spark, stages[-1], folder), "test-stage"))
    ids = [sorted(str(r["doc_id"]) for r in s.collect()) for s in stages[:5]]
    assert ids[1] == ids[2] == ids[0]
    # The near copies 3 and 5 are one, rows without an id stay each.
    assert ids[3] == ids[4] == ["3", "8", "9", "None", "None"]
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in stages[5].collect() if r["doc_id"] in (8, 9)) == [("8", 1), ("9", 1)]
