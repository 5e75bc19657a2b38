"""Stored tables in the folder that driver and executors share, and sketches that carry their parameters."""

from __future__ import annotations

import atexit
import contextlib
import dataclasses
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from sketchloom import params

_KEY = "sketch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master has a folder of its own where none is named."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"{tempfile.gettempdir()}/sketchloom-{spark.sparkContext.applicationId}"
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, name: str, *partition_by: str, group_bytes: int | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors. Spark drops the shuffle files behind it.

    group_bytes: of a row group, which writers and readers hold at once; less than Spark's 128 MB for rows of megabytes.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes)
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_stored(*tables: DataFrame) -> None:
    """Delete stored tables that no later job reads."""
    for df in tables:
        folders = {re.sub(r"^(.*/[^/]+-[0-9a-f]{32})/.*$", r"\1", f) for f in df.inputFiles()}
        for folder in folders:
            drop_path(df.sparkSession, folder)


def with_params(sketch: DataFrame, of: params.Params) -> DataFrame:
    """A sketch whose parameters go with it: as metadata of its column id, which Parquet keeps."""
    return sketch.withMetadata("id", {_KEY: type(of).__name__, **dataclasses.asdict(of)})


def params_of(sketch: DataFrame) -> params.Params | None:
    """The parameters that came with a sketch; None for a table that bears none."""
    held = dict(next((f.metadata for f in sketch.schema.fields if f.name == "id"), {}))
    kind = held.pop(_KEY, None)
    return getattr(params, kind)(**held) if kind else None


def same_params(*sketches: DataFrame, given: params.Params | None = None) -> None:
    """Fails if sketches that bear parameters, and those given, cannot be compared."""
    known = [p for p in (given, *map(params_of, sketches)) if p is not None]
    for p in known[1:]:
        known[0].check(p)


def save(sketch: DataFrame, path: str) -> None:
    sketch.write.option("compression", "zstd").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A saved sketch with its parameters."""
    return spark.read.parquet(path)
