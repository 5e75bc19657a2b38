from sketchloom.operators import hll, minhash
from sketchloom.params import HllParams, MinHashParams
from sketchloom.streaming import sketches


def test_streams_agree_with_batches(spark, tmp_path):
    p, h = MinHashParams(k=5, size=20), HllParams(p=6, k=5)
    parts = [[(1, "ACGTTGCATGCCATGA"), (2, "GGGTTTACACGTTGCA")], [(1, "TTGACCAGTGGACATT")]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "id long, seq string").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("id long, seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    whole = spark.createDataFrame(sum(parts, []), "id long, seq string")
    for name, df in (("mh", sketches.minhash_sketches(stream, p)), ("hl", sketches.hll_registers(stream, h))):
        q = df.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    want = {}
    for r in minhash.sketch(whole, p).collect():
        want.setdefault(r["id"], set()).add(r["hash"])
    got = {}
    for r in spark.table("mh").collect():
        got[r["id"]] = got.get(r["id"], set()) | set(r["hashes"])
    assert all(want[k] <= got[k] for k in want)
    last = {r["id"]: dict(zip(r["hashes"], r["multiplicities"])) for r in sorted(spark.table("mh").collect(), key=lambda r: sum(r["multiplicities"]))}
    for r in minhash.sketch(whole, MinHashParams(k=5, size=1000)).collect():
        if r["hash"] in last[r["id"]]:
            assert last[r["id"]][r["hash"]] <= r["multiplicity"]
    assert sum(last[2].values()) == sum(r["multiplicity"] for r in minhash.sketch(whole, p).collect() if r["id"] == 2)
    top = {(r["id"], r["idx"]): r["rank"] for r in hll.registers(whole, h).collect()}
    seen = {}
    for r in spark.table("hl").collect():
        seen[(r["id"], r["idx"])] = max(seen.get((r["id"], r["idx"]), 0), r["rank"])
    assert seen == top
