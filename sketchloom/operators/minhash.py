"""Bottom-s MinHash sketches in long form (id, hash, multiplicity), and their measures.

A hash is kept as the signed long of its 64 bits; where order matters the sign bit is turned, so that
signed order is unsigned order. Tasks hash parts of bounded size, whatever the length of a sequence, and send of each id in a part
only hashes that may be in its sketch; the rest is a sum and a ranked window, for which Spark limits groups before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.functions import hashing, kmers
from sketchloom.params import MinHashParams
from sketchloom.storage import same_params, with_params

_TURN = -(1 << 63)
#: K-mers whose hashes a task holds at once.
HELD = 1 << 20


def unsigned(h: Column) -> Column:
    """A long that sorts as the unsigned value of h."""
    return h.bitwiseXOR(F.lit(_TURN))


def hash_windows(seq: np.ndarray, p: MinHashParams) -> np.ndarray:
    seq = kmers.upper_bytes(seq)
    rows = kmers.canonical_windows(seq, p.k) if p.canonical else kmers.windows(seq, p.k)
    return hashing.murmur128(rows, p.seed)[0] if len(rows) else np.zeros(0, np.uint64)


def fewest(owner: np.ndarray, hashes: np.ndarray, p: MinHashParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, n): the distinct hashes of each owner that may be in its sketch, and how many there are.

    Of some of an owner's hashes, `size` that are there min_copies times are in no place worse among all of them; so
    what is greater than those is in no sketch.
    """
    order = np.argsort(hashes, kind="stable")
    if len(owner) and owner.min() != owner.max():
        order = order[np.argsort(owner[order], kind="stable")]
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(owner)))
    owner, hashes = owner[first], hashes[first]
    enough = np.append(0, np.cumsum(n >= p.min_copies))[: len(n)]
    begin = np.ones(len(owner), bool)
    begin[1:] = owner[1:] != owner[:-1]
    at = np.flatnonzero(begin)
    keep = enough - np.repeat(enough[at], np.diff(np.append(at, len(owner)))) < p.size
    return owner[keep], hashes[keep], n[keep]


def hashed(df: DataFrame, p: MinHashParams, id_type: str = "long") -> DataFrame:
    """(id, hash, n) of (id, seq): of every HELD k-mers the hashes that may be in their ids' sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("id").dictionary_encode(null_encoding="encode")
            ids, of = coded.dictionary, coded.indices.to_numpy()
            held, size = [], 0
            for seq, starts, rows in kmers.spans(batch.column("seq"), p.k, kmers.SLICE):
                held.append((of[rows], hash_windows(seq, p)[starts]))
                size += len(starts)
                if size >= HELD:
                    yield out(ids, held)
                    held, size = [], 0
            if held:
                yield out(ids, held)

    def out(ids: pa.Array, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        owner, hashes, n = fewest(*(np.concatenate(x) for x in zip(*held)), p)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(hashes.view(np.int64)), pa.array(n, pa.int64())], names=["id", "hash", "n"])

    return df.select("id", "seq").mapInArrow(run, f"id {id_type}, hash long, n long")


def least(counted: DataFrame, p: MinHashParams) -> DataFrame:
    """The `size` least hashes of each id among those with at least min_copies."""
    summed = counted.groupBy("id", "hash").agg(F.sum("n").alias("multiplicity")).where(F.col("multiplicity") >= p.min_copies)
    order = Window.partitionBy("id").orderBy(unsigned(F.col("hash")))
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.size).select("id", "hash", "multiplicity")


def sketch(df: DataFrame, p: MinHashParams = MinHashParams(), id_type: str = "long") -> DataFrame:
    """Sketches of (id, seq), with their parameters; rows that share an id are one collection. Ids without k-mers have no rows."""
    return with_params(least(hashed(df, p, id_type), p), p)


def merge(a: DataFrame, b: DataFrame, p: MinHashParams, q: MinHashParams | None = None) -> DataFrame:
    """The sketch of both collections, of p's size."""
    p.check(q or p)
    same_params(a, b, given=p)
    return with_params(least(a.unionByName(b).withColumnRenamed("multiplicity", "n"), p), p)


def arrays(sketches: DataFrame) -> DataFrame:
    """(id, hashes): one array for each id, in unsigned order with the sign bit turned."""
    return sketches.groupBy("id").agg(F.array_sort(F.collect_list(unsigned(F.col("hash")))).alias("hashes"))


def stats(sketches: DataFrame) -> DataFrame:
    """id, sketch_size, multiplicity_sum, mean_multiplicity, cardinality (2^64 * n / greatest hash)."""
    top = F.max(unsigned(F.col("hash"))).cast("double") + 2.0**63
    return sketches.groupBy("id").agg(
        F.count("*").alias("sketch_size"), F.sum("multiplicity").alias("multiplicity_sum"), F.avg("multiplicity").alias("mean_multiplicity"),
        (F.lit(2.0**64) * F.count("*") / top).alias("cardinality"),
    )


def total_length(df: DataFrame) -> DataFrame:
    return df.groupBy("id").agg(F.sum(F.octet_length(F.coalesce("seq", F.lit("")))).cast("long").alias("total_length"))


def jaccard(a: Column, b: Column, size: int) -> Column:
    """Of two arrays of `arrays`: shared among the `size` least of the union; null if both are empty."""
    top = F.slice(F.array_sort(F.array_union(a, b)), 1, size)
    return F.try_divide(F.size(F.array_intersect(F.array_intersect(a, b), top)).cast("double"), F.size(top).cast("double"))


def containment(a: Column, b: Column) -> Column:
    """Shared hashes over those of the smaller sketch; null if it is empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b)).cast("double"))


def distance(j: Column, k: int) -> Column:
    """Mutation distance from a Jaccard index, 0 to 1."""
    return F.when(j == 1, 0.0).when(j == 0, 1.0).otherwise(F.least(F.lit(1.0), -F.ln(2 * j / (1 + j)) / k))


def p_value(shared: Column, size: Column, length_a: Column, length_b: Column, k: int, alphabet: int = 4) -> Column:
    """Probability of at least `shared` common hashes for random sequences of these lengths (binomial tail)."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, s: pd.Series, r: pd.Series) -> pd.Series:
        x, s, r = (v.to_numpy(float) for v in (x, s, r))
        i = np.arange(int(s.max(initial=0)) + 1)
        # ln of the binomial coefficients of each s, by running sums over i.
        steps = np.log(np.maximum(s[:, None] - i[1:] + 1, 1e-300)) - np.log(i[1:])
        choose = np.concatenate((np.zeros((len(s), 1)), np.cumsum(steps, axis=1)), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = np.exp(choose + i * np.log(r)[:, None] + (s[:, None] - i) * np.log1p(-r)[:, None])
        total = np.where((i >= x[:, None]) & (i <= s[:, None]), terms, 0).sum(1)
        return pd.Series(np.where(x == 0, 1.0, np.where(r <= 0, 0.0, np.where(r >= 1, 1.0, np.minimum(1.0, total)))))

    space = float(alphabet) ** k
    a, b = length_a / (length_a + space), length_b / (length_b + space)
    return tail(shared, size, a * b / (a + b - a * b))
