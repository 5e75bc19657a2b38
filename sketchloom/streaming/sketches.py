"""Sketches of a stream of (id, seq): the same building blocks, with state by id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sketchloom.operators import hll, minhash
from sketchloom.params import HllParams, MinHashParams


def hll_registers(stream: DataFrame, p: HllParams = HllParams()) -> DataFrame:
    """Registers as a running maximum; write in update mode."""
    return hll.registers(stream, p)


def minhash_sketches(stream: DataFrame, p: MinHashParams = MinHashParams()) -> DataFrame:
    """(id, hashes, multiplicities), the sketch of each id that got new rows; write in update mode. State is one sketch for each id.

    A hash that left a sketch never comes back, as there are p.size lesser ones from then on; so multiplicities are
    those of all rows, as in a batch.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [np.array(x, np.int64) for x in state.get] if state.exists else [np.zeros(0, np.int64)] * 2
        for f in frames:
            every = np.concatenate((held[0], f["hash"].to_numpy(np.int64))).view(np.uint64)
            n = np.concatenate((held[1], f["n"].to_numpy(np.int64)))
            least, at = np.unique(every, return_inverse=True)
            summed = np.bincount(at, weights=n, minlength=len(least)).astype(np.int64)
            held = [least[: p.size].view(np.int64), summed[: p.size]]
        state.update(tuple(x.tolist() for x in held))
        yield pd.DataFrame({"id": [key[0]], "hashes": [held[0].tolist()], "multiplicities": [held[1].tolist()]})

    kept = "hashes array<long>, multiplicities array<long>"
    return minhash.hashed(stream, p).groupBy("id").applyInPandasWithState(update, f"id long, {kept}", kept, "update", GroupStateTimeout.NoTimeout)


def collected(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What a stream in update mode has written once all that is there now was read: its rows and the batch they are from."""
    spark = stream.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/part={batch}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in stream.dtypes)}, batch long").parquet(path)


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each id among those of `collected`."""
    newest = F.max_by(F.struct(*[c for c in rows.columns if c not in ("id", "batch")]), "batch")
    return rows.groupBy("id").agg(newest.alias("x")).select("id", "x.*")
