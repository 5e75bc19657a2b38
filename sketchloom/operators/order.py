"""Order MinHash: for each of m seeds the l least-hashed k-mers of a sequence, in the order in which they stand.

Equal blocks mean equal k-mers in equal order, a proxy of edit similarity. A task hashes a sequence's
k-mers under a block of seeds at a time, so memory is bounded whatever m is; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.functions import hashing, kmers
from sketchloom.params import OrderParams
from sketchloom.storage import with_params

#: Hashes that are held at once.
HELD = 1 << 21
# Bits 1 and 2 of a base's byte: A 0, C 1, T 2, G and N 3, whatever the case.
_CODE = ((np.arange(256) & 6) >> 1).astype(np.uint8)


def occurrences(packed: np.ndarray) -> np.ndarray:
    """How often the same k-mer stood before."""
    order = np.argsort(packed, kind="stable")
    s = packed[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    out = np.empty(len(s), np.int64)
    out[order] = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    return out


def blocks(seq: np.ndarray, p: OrderParams, seeds: np.ndarray) -> list[str] | None:
    """m strings of l k-mers each; None for fewer than l k-mers. Ties take the earlier k-mer."""
    take = max(p.l, 1)
    n = len(seq) - p.k + 1
    if n < take:
        return None
    # Codes stand two bits up, as if a base were to follow; occurrences add to what is below.
    key = kmers.pack(seq, p.k, _CODE) << np.uint64(2)
    if p.l > 0:
        key = key + occurrences(key).astype(np.uint64)
    text = seq.tobytes().decode("latin-1")
    out = []
    step = max(1, HELD // n)
    for lo in range(0, len(seeds), step):
        h = hashing.fmix64(key[None], seeds[lo : lo + step, None])
        if n > take:
            edge = np.partition(h, take - 1, axis=1)[:, take - 1]
            for row, most in zip(h, edge):
                at = np.flatnonzero(row <= most)
                at = np.sort(at[np.lexsort((at, row[at]))[:take]])
                out.append("".join(text[i : i + p.k] for i in at.tolist()))
        else:
            out += ["".join(text[i : i + p.k] for i in range(n))] * len(h)
    return out


def sketch(df: DataFrame, p: OrderParams = OrderParams(), id_type: str = "long") -> DataFrame:
    """(id, k, l, m, seed, data, rcdata) of (id, seq). data is null for sequences with fewer than l k-mers, rcdata unless p.reverse."""
    seeds = hashing.mersenne64(p.seed, p.m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = kmers.sequences(batch.column("seq"))
            for lo in range(0, len(seqs), 200):
                some = seqs[lo : lo + 200]
                data = [blocks(s, p, seeds) for s in some]
                back = [blocks(kmers.reverse_complement_bytes(s), p, seeds) if p.reverse else None for s in some]
                n = len(some)
                columns = [batch.column("id").slice(lo, n), *(pa.array([x] * n, pa.int32()) for x in (p.k, p.l, p.m)), pa.array([p.seed] * n, pa.int64())]
                columns += [pa.array(x, pa.list_(pa.string())) for x in (data, back)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "k", "l", "m", "seed", "data", "rcdata"])

    return with_params(df.select("id", "seq").mapInArrow(run, f"id {id_type}, k int, l int, m int, seed long, data array<string>, rcdata array<string>"), p)


def equal(sketches: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, equal): whether two sketches agree in k, l, m, seed and all blocks of both strands; null equals null."""
    whole = F.struct("k", "l", "m", "seed", "data", "rcdata")
    a, b = (sketches.select(F.col("id").alias(s), whole.alias(f"whole_{s}")) for s in "ij")
    return pairs.select("i", "j").join(a, "i").join(b, "j").select("i", "j", F.col("whole_i").eqNullSafe(F.col("whole_j")).alias("equal"))


def _share(a: Column, b: Column, m: Column, circular: int = 0) -> Column:
    if circular:  # k: blocks match if one is a rotation of the other by whole k-mers
        turned = lambda x, r: F.concat(F.substr(x, r * circular + 1), F.substr(x, F.lit(1), r * circular))
        turns = lambda x: F.sequence(F.lit(0), F.greatest(F.floor(F.length(x) / circular).cast("int") - 1, F.lit(0)))
        same = F.zip_with(a, b, lambda x, y: (F.length(x) == F.length(y)) & F.exists(turns(x), lambda r: turned(x, r) == y))
    else:
        same = F.zip_with(a, b, lambda x, y: x == y)
    return F.size(F.filter(same, lambda x: F.coalesce(x, F.lit(False)))).cast("double") / m


def similarity(sketches: DataFrame, pairs: DataFrame, circular: bool = False) -> DataFrame:
    """(i, j, similarity): equal blocks over m, the lesser of both; the greater of both strands where one has a reverse sketch.

    Null for unlike k, l or seed, or without a sketch.
    """
    side = lambda s: sketches.select(*[F.col(c).alias(f"{c}_{s}") for c in ("k", "l", "m", "seed", "data", "rcdata")], F.col("id").alias(s))
    both = pairs.select("i", "j").join(side("i"), "i").join(side("j"), "j")
    m = F.least("m_i", "m_j")
    rotation = 0
    if circular:
        first = sketches.select("k").first()
        rotation = first["k"] if first else 0
    own = _share(F.col("data_i"), F.col("data_j"), m, rotation)
    back = F.when(F.col("rcdata_i").isNotNull(), _share(F.col("rcdata_i"), F.col("data_j"), m, rotation)).when(F.col("rcdata_j").isNotNull(), _share(F.col("data_i"), F.col("rcdata_j"), m, rotation))
    alike = (F.col("k_i") == F.col("k_j")) & (F.col("l_i") == F.col("l_j")) & (F.col("seed_i") == F.col("seed_j")) & F.col("data_i").isNotNull() & F.col("data_j").isNotNull()
    return both.select("i", "j", F.when(alike, F.greatest(own, back)).alias("similarity"))
