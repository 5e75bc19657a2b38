"""Pairs of sketches: which to compare, and all measures side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.operators import hll, minhash, order, weighted
from sketchloom.params import HllParams, MinHashParams, OrderParams, WeightedParams
from sketchloom.plans import meetings
from sketchloom.storage import same_params

BLOCK = meetings.BLOCK


def _met(members: DataFrame, keys: list[str], blocks: Column) -> DataFrame:
    """members (id and keys) with (i, j), i < j, that share the keys: an equi-join on blocks of them, so that many members are many groups.

    Each two blocks meet once, the lower one's members from the left.
    """
    own = F.pmod(F.xxhash64(F.lit(9), "id"), blocks).cast("int")
    placed = members.withColumn("own", own).withColumn("blocks", blocks.cast("int"))
    more = [c for c in members.columns if c not in ("id", *keys)]
    left = placed.select(F.col("id").alias("x"), *keys, *more, F.col("own").alias("lo"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("hi"))
    right = placed.select(F.col("id").alias("y"), *keys, F.col("own").alias("hi"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("lo"))
    both = left.join(right, [*keys, "lo", "hi"]).where("lo < hi or x < y")
    return both.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), *more)


def all_pairs(ids: DataFrame, blocks: int = 16) -> DataFrame:
    """(i, j), i < j: every pair, which is as many rows as the square; `candidate_pairs` leaves out pairs that share nothing."""
    return _met(ids.select("id").where("id is not null").distinct(), [], F.lit(blocks))


def candidate_pairs(sketches: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, j, shared), i < j: pairs that share a hash. All other pairs have Jaccard 0.

    Blocks of ids with `block` hashes meet two by two; a pair is counted where it meets. Ids with the same hashes meet once.
    """
    return meetings.met(sketches, ("shared",), block=block)


def minhash_measures(sketches: DataFrame, p: MinHashParams, pairs: DataFrame | None = None) -> DataFrame:
    """(i, j, jaccard, containment, distance) of candidate pairs, or of `pairs`. Sketches that bear other parameters than p are refused."""
    same_params(sketches, given=p)
    if pairs is None:
        found = meetings.met(sketches, ("jaccard", "containment"), p.size, minhash.unsigned(F.col("hash")))
        return found.withColumn("distance", minhash.distance(F.col("jaccard"), p.k))
    held = minhash.arrays(sketches)
    both = pairs.select("i", "j").join(held.select(F.col("id").alias("i"), F.col("hashes").alias("a")), "i").join(held.select(F.col("id").alias("j"), F.col("hashes").alias("b")), "j")
    measured = both.select("i", "j", minhash.jaccard(F.col("a"), F.col("b"), p.size).alias("jaccard"), minhash.containment(F.col("a"), F.col("b")).alias("containment"))
    return measured.withColumn("distance", minhash.distance(F.col("jaccard"), p.k))


def matrix(df: DataFrame, pairs: DataFrame, mh: MinHashParams = MinHashParams(), wm: WeightedParams = WeightedParams(), om: OrderParams = OrderParams(), hl: HllParams = HllParams()) -> DataFrame:
    """(i, j, weighted, minhash, order, hll): four distances of each pair of (id, seq); null where a sketch is empty."""
    a = minhash_measures(minhash.sketch(df, mh), mh, pairs).select("i", "j", F.col("distance").alias("minhash"))
    w = weighted.jaccard(weighted.sketch(weighted.estimates(weighted.spectrum(weighted.minimizers(df, wm))), wm), pairs).select("i", "j", (1 - F.col("weighted_jaccard")).alias("weighted"))
    o = order.similarity(order.sketch(df, om), pairs).select("i", "j", (1 - F.col("similarity")).alias("order"))
    h = hll.jaccard(hll.registers(df, hl), pairs, hl.p).select("i", "j", (1 - F.col("jaccard")).alias("hll"))
    out = pairs.select("i", "j")
    for part in (w, a, o, h):
        out = out.join(part, ["i", "j"], "left")
    return out.select("i", "j", "weighted", "minhash", "order", "hll")


def closest(measured: DataFrame, k: int, by: str = "distance") -> DataFrame:
    """The k closest pairs; ties to the lesser ids."""
    return measured.orderBy(by, "i", "j").limit(k)


def phylip(ids: DataFrame, measured: DataFrame, value: str = "distance", missing: float = 1.0) -> DataFrame:
    """(id, line): rows of a lower-triangular distance matrix; absent pairs have distance `missing`. The first line, the number of rows, has a null id.

    A line of the format holds all lesser ids, so a row has up to as many cells as there are ids.
    """
    ids = ids.select("id").where("id is not null").distinct()
    cells = all_pairs(ids).join(measured.select("i", "j", F.col(value).alias("d")), ["i", "j"], "left")
    told = F.array_sort(F.collect_list(F.struct("i", F.format_string("%.6f", F.coalesce("d", F.lit(missing))).alias("d"))))
    rows = cells.groupBy("j").agg(told.alias("cells"))
    lines = ids.join(rows, ids["id"] == rows["j"], "left").select("id", F.concat_ws(" ", F.col("id").cast("string"), F.col("cells.d")).alias("line"))
    return ids.agg(F.count("*").cast("string").alias("line")).select(F.lit(None).cast("long").alias("id"), "line").unionByName(lines)
