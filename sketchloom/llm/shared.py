"""Tables and rows that several stages of one operator share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sketchloom.storage import drop_path, drop_stored, stored, table_path

__all__ = ["ascii_lower", "documents", "drop_path", "drop_stored", "keeping", "others", "row_key", "schema", "stored", "table_path"]


def others(df: DataFrame, *own: str) -> list[str]:
    """The columns of df that no operator's own column replaces. Names are alike in any case, as Spark takes them."""
    taken = {c.lower() for c in own}
    return [c for c in df.columns if c.lower() not in taken]


def keeping(docs: DataFrame, keep: list[str], own: tuple[str, ...], *more: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """docs with its kept columns under names that meet no other, those names, and what gives a result the old ones back.

    Kept columns with a name of `own`, the result's own columns, in any case are left out: the result's replace them.
    """
    taken = {c.lower() for c in own}
    keep = [k for k in keep if k.lower() not in taken]
    inner = [f"kept_{k}" for k in range(len(keep))]
    return docs.select(*[F.col(f"`{k}`").alias(i) for k, i in zip(keep, inner)], *more), inner, lambda out: out.withColumnsRenamed(dict(zip(inner, keep)))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def ascii_lower(col: Column) -> Column:
    """A-Z become a-z, all other characters stay. lower() has a fast way for ASCII strings."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


def row_key(*columns: str) -> list[Column]:
    """Two longs that tell rows apart by these columns; equal rows have equal keys."""
    return [F.xxhash64(*columns).alias("rk1"), F.xxhash64(F.lit(1), *columns).alias("rk2")]


LONG, STRING, DOUBLE, BOOL, BINARY, INT = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType(), T.BinaryType(), T.IntegerType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
