"""Functions for SQL: spark.sql("select murmur64(kmer) ...") and others, as vectorised UDFs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from sketchloom.functions import hashing, kmers


def _hashed(texts: pa.Array, of: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """A long for each text, from the rows of bytes of the texts of one length."""
    data = texts.cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, 8 * data.offset) if len(data) else np.zeros(1, np.int64)
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    some = data.is_valid().to_numpy(zero_copy_only=False)
    length = np.where(some, np.diff(ends), -1)
    out = np.zeros(len(data), np.int64)
    for n in np.unique(length[some]).tolist():
        at = np.flatnonzero(length == n)
        together = len(at) and ends[at[-1]] - ends[at[0]] == n * (len(at) - 1)
        rows = raw[ends[at[0]] : ends[at[0]] + n * len(at)].reshape(len(at), n) if together else raw[ends[at][:, None] + np.arange(n)].reshape(len(at), n)
        out[at] = of(rows)
    return pa.array(out, pa.int64(), mask=~some)


def murmur64_of(texts: pd.Series, seed: int = 42) -> pd.Series:
    """`murmur64` of a series, with any seed."""
    return pd.Series(_hashed(pa.array(texts, pa.string()), lambda rows: _word64(rows, seed)).to_pandas(types_mapper=None, integer_object_nulls=True), dtype="Int64")


def _word64(rows: np.ndarray, seed: int = 42) -> np.ndarray:
    return hashing.murmur128(rows, seed)[0].view(np.int64)


@F.arrow_udf(LongType())
def murmur64(texts: pa.Array) -> pa.Array:
    """First word of the 128-bit hash of each text, as a signed long; texts of one length go together."""
    return _hashed(texts, _word64)


@F.arrow_udf(LongType())
def murmur32(texts: pa.Array) -> pa.Array:
    """The 32-bit hash of each text, from 0 to 2^32 - 1; texts of one length go together."""
    return _hashed(texts, lambda rows: hashing.murmur32(rows).astype(np.int64))


def mixers(ids: DataFrame) -> DataFrame:
    """(id, and a column for each integer hash of it): 32-bit ones of its low 32 bits."""
    of = {"fmix32": hashing.fmix32, "mueller32": hashing.mueller32, "jenkins32": hashing.jenkins32, "splitmix64": hashing.splitmix64, "halve64": hashing.halve64, "fmix64": hashing.fmix64}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("id").to_numpy().view(np.uint64)
            columns = [f((x & np.uint64(0xFFFFFFFF)).astype(np.uint32) if name in ("fmix32", "mueller32", "jenkins32") else x) for name, f in of.items()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c.astype(np.uint64).view(np.int64)) for c in columns]], names=["id", *of])

    return ids.mapInArrow(run, "id long, " + ", ".join(f"{name} long" for name in of))


@F.pandas_udf(StringType())
def reverse_complement(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else kmers.reverse_complement_bytes(np.frombuffer(t.encode(), np.uint8)).tobytes().decode())


@F.pandas_udf(LongType())
def jump_hash(keys: pd.Series, buckets: pd.Series) -> pd.Series:
    out = np.empty(len(keys), np.int64)
    for n, at in buckets.reset_index(drop=True).groupby(buckets.to_numpy()).groups.items():
        out[at] = hashing.jump(keys.to_numpy()[at].astype(np.int64).view(np.uint64), int(n))
    return pd.Series(out)


def register(spark: SparkSession) -> None:
    for name, function in {"murmur64": murmur64, "murmur32": murmur32, "reverse_complement": reverse_complement, "jump_hash": jump_hash}.items():
        spark.udf.register(name, function)
