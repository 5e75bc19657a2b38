"""Weighted MinHash: minimizers, their spectrum, count-min estimates and consistent weighted samples.

Minimizers are found by array operations over whole sequences; a row's distinct minimizers count once, and rows
of one id add up. The random tables of consistent weighted sampling are not held: each of a bin's numbers is a hash of
(seed, bin, slot), so only bins that occur are ever drawn, alike on every executor and in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.functions import hashing, kmers
from sketchloom.params import WeightedParams
from sketchloom.storage import with_params

#: Cells and rows of the count-min sketch: ceil(2 / 0.001) and ceil(log(1 - 0.99) / log(0.5)).
CELLS, ROWS = 2000, 7
#: 2^32 over the golden ratio: steps of a counter that is hashed.
GOLDEN32 = 0x9E3779B9

# Two bits for A, C, G, T and U; 4 for all else, which spills into the next base's bits.
_CODE = np.full(256, 4, np.uint8)
for _k, _pair in enumerate(("Aa", "Cc", "Gg", "TtUu")):
    _CODE[[ord(c) for c in _pair]] = _k


def _strands(seq: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed k-mers that end at each base from the k-th on, of both strands, as rolling registers of 2k bits.

    A code of 4 has a third bit, which joins the next base's in either register: one that moves up loses it at the
    register's end, one that moves down still holds it when its base has left.
    """
    code = _CODE[seq].astype(np.uint64)
    n = len(seq) - k + 1
    forward, backward = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(k):
        part = code[j : j + n]
        forward |= part << np.uint64(2 * (k - 1 - j))
        backward |= (part ^ np.uint64(3)) << np.uint64(2 * j)
    forward &= np.uint64((1 << 2 * k) - 1)
    backward[1:] |= code[: n - 1] >> np.uint64(2)
    return forward, backward


def minimizer_set(seq: np.ndarray, k: int, w: int, fixed_span: bool = False) -> np.ndarray:
    """Distinct minimizers of a sequence: hash * 256 + span, the least of each window of w positions.

    A position i (the base that ends a k-mer) has span min(i - w + 2, k), as long as windows grow in from the left;
    fixed_span takes k. K-mers that equal their reverse complement have neither a hash nor a window of their own.
    """
    if len(seq) < w + k - 1:
        return np.zeros(0, np.uint64)
    forward, backward = _strands(seq, k)
    at = np.arange(k - 1, len(seq))
    span = np.full(len(at), k) if fixed_span else np.minimum(at - w + 2, k)
    value = (hashing.invertible64(np.minimum(forward, backward), 2 * k) << np.uint64(8)) | span.astype(np.int64).view(np.uint64)
    valid = forward != backward
    value[~valid] = ~np.uint64(0)
    least = value.copy()
    reach = 1
    while reach < w:  # minima over doubling reaches, then up to w
        step = min(reach, w - reach)
        least[step:] = np.minimum(least[step:], least[:-step])
        reach += step
    return np.unique(least[valid & (at >= w - 1)])


def minimizers(df: DataFrame, p: WeightedParams = WeightedParams(), id_type: str = "long") -> DataFrame:
    """(id, minimizer, bin), the distinct minimizers of each row of (id, seq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [minimizer_set(s, p.k, p.window) for s in kmers.sequences(batch.column("seq"))]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found]) if found else np.zeros(0, np.int64)
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            columns = [batch.column("id").take(pa.array(at, pa.int64())), pa.array(flat.view(np.int64)), pa.array(hashing.jump(flat, p.bins))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "minimizer", "bin"])

    return df.select("id", "seq").mapInArrow(run, f"id {id_type}, minimizer long, bin long")


def spectrum(found: DataFrame) -> DataFrame:
    """(id, bin, freq) of minimizers."""
    return found.groupBy("id", "bin").agg(F.count("*").cast("double").alias("freq"))


def estimates(spectra: DataFrame) -> DataFrame:
    """(id, bin, freq, estimate): count-min as bins arrive in ascending order, so a cell holds what came so far.

    An id's spectrum is one task's work: it has at most as many rows as there are bins, k^4.
    """
    types = dict(spectra.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bin")
        bins, freq = table["bin"].to_numpy(), table["freq"].to_numpy()
        least = np.full(len(bins), np.inf)
        for row in range(ROWS):
            cell = hashing.jump(bins.astype(np.uint64) * np.uint64(1 + row), CELLS)
            order = np.argsort(cell, kind="stable")
            total = np.cumsum(freq[order])
            first = np.flatnonzero(np.concatenate(([True], np.diff(cell[order]) != 0)))
            before = np.repeat(total[first] - freq[order][first], np.diff(np.append(first, len(order))))
            sums = np.empty(len(bins))
            sums[order] = total - before
            least = np.minimum(least, sums)
        return table.append_column("estimate", pa.array(least))

    return spectra.select("id", "bin", "freq").groupBy("id").applyInArrow(run, f"id {types['id']}, bin long, freq double, estimate double")


def uniforms(bins: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Five numbers in (0, 1) for each bin and slot: 32-bit hashes of a counter that starts at the hash of bin and seed."""
    counter = np.arange(size * 5, dtype=np.uint32).reshape(size, 5) * np.uint32(GOLDEN32)
    return (hashing.fmix32(hashing.fmix32(bins, seed)[:, None, None] + counter) + 0.5) / 2.0**32


def random_tables(bins: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r ~ Gamma(2, 1), c = ln Gamma(2, 1), b ~ U(0, 1) * r for each bin (rows) and slot. Gamma(2, 1) is minus the logarithm of two uniforms' product."""
    u = uniforms(bins, size, seed)
    logs = -np.log(u[..., :4])
    r, c = logs[..., 0] + logs[..., 1], np.log(logs[..., 2] + logs[..., 3])
    return r, c, u[..., 4] * r


def sketch(estimated: DataFrame, p: WeightedParams = WeightedParams()) -> DataFrame:
    """(id, slot, bin, weight): for each slot the bin with the least sample, ties to the lesser bin. Samples may be negative.

    A task sends at most one row for each slot and id of a batch on.
    """
    types = dict(estimated.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.slice(lo, 4000)
                bins, freq = part.column("bin").to_numpy(), part.column("estimate").to_numpy()
                owner = part.column("id").dictionary_encode().indices.to_numpy(zero_copy_only=False)
                order = np.argsort(owner, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], np.diff(owner[order]) != 0)))
                sizes = np.diff(np.append(first, len(order)))
                distinct, at = np.unique(bins[order], return_inverse=True)
                r, c, b = random_tables(distinct, p.size, p.seed)
                sample = c[at] / (np.exp(np.log(freq[order])[:, None] - c[at] * b[at]) * np.exp(r[at]))
                least = np.minimum.reduceat(sample, first, axis=0)
                mine = np.where(sample == np.repeat(least, sizes, axis=0), bins[order][:, None], np.iinfo(np.int64).max)
                chosen = np.minimum.reduceat(mine, first, axis=0)
                columns = [part.column("id").take(pa.array(np.repeat(order[first], p.size))), pa.array(np.tile(np.arange(p.size, dtype=np.int32), len(first))), pa.array(chosen.reshape(-1)), pa.array(least.reshape(-1))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "slot", "bin", "weight"])

    drawn = estimated.select("id", "bin", "estimate").mapInArrow(run, f"id {types['id']}, slot int, bin long, weight double")
    least = drawn.groupBy("id", "slot").agg(F.min(F.struct("weight", "bin")).alias("x")).select("id", "slot", F.col("x.bin").alias("bin"), F.col("x.weight").alias("weight"))
    return with_params(least, p)


def jaccard(sketches: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, weighted_jaccard): slots with equal bins add the lesser to the greater weight, others the greater only; weights as absolute values.

    A sketch is one array of its slots, so a pair is one row throughout.
    """
    held = sketches.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("slot", "bin", F.abs("weight").alias("w")))).alias("slots"))
    both = pairs.select("i", "j").join(held.select(F.col("id").alias("i"), F.col("slots").alias("a")), "i").join(held.select(F.col("id").alias("j"), F.col("slots").alias("b")), "j")
    added = lambda values: F.aggregate(values, F.lit(0.0), lambda total, x: total + x)
    shared = F.zip_with("a", "b", lambda x, y: F.when(x["bin"] == y["bin"], F.least(x["w"], y["w"])).otherwise(0.0))
    every = F.zip_with("a", "b", lambda x, y: F.greatest(x["w"], y["w"]))
    return both.select("i", "j", F.try_divide(added(shared), added(every)).alias("weighted_jaccard"))
