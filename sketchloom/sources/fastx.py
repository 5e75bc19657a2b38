"""FASTA and FASTQ files, plain or gzip, as rows (file, ordinal, name, comment, seq, qual); and their sink.

A record begins with > or @. Its name ends at the first white space, the rest of the line is the comment. The
sequence goes on until a line that begins with >, + or @; blank lines are skipped. After + as many quality
characters follow as the sequence has. A record without enough or with too many of them is malformed.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, ordinal bigint, name string, comment string, seq string, qual string"
_GZIP = b"\x1f\x8b"


class MalformedRecord(ValueError):
    pass


def parse(lines: Iterable[str], strict: bool = True) -> Iterator[tuple[str, str | None, str, str | None]]:
    """(name, comment, seq, qual) of each record. strict: raise on a malformed one, else stop there."""
    source = (line.removesuffix("\n").removesuffix("\r") for line in lines)
    header = next((x for x in source if x[:1] in (">", "@")), None)
    while header is not None:
        words = header[1:].split(None, 1) if header[1:2].strip() else ["", *header[1:].split(None, 1)][:2]
        name, comment = words[0] if words else "", words[1] if len(words) > 1 else None
        parts, following = [], None
        for line in source:
            if line[:1] in (">", "+", "@"):
                following = line
                break
            parts.append(line)
        seq = "".join(parts)
        if following is None or following[0] != "+":
            yield name, comment, seq, None
            header = following
            continue
        quality, size = [], 0
        while size < len(seq):
            line = next(source, None)
            if line is None:
                break
            quality.append(line)
            size += len(line)
        if size != len(seq):
            if strict:
                raise MalformedRecord(f"record {name!r}: {size} quality characters for {len(seq)} bases")
            return
        yield name, comment, seq, "".join(quality)
        header = next((x for x in source if x[:1] in (">", "@")), None)


def _records(content: bytes, strict: bool) -> Iterator[tuple]:
    raw = io.BytesIO(content)
    stream = gzip.GzipFile(fileobj=raw) if content[:2] == _GZIP else raw
    return parse(io.TextIOWrapper(stream, "utf-8", errors="replace", newline="\n"), strict)


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Records of all files under a path, of any file system that Spark reads. A file is one task's work and held
    whole, as quality lines cannot be told from headers without what stands before them; that takes files up to 2 GB.
    `read_fasta_splits` has no such bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "ordinal", "name", "comment", "seq", "qual"]
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                held, size = [], 0
                for k, record in enumerate(_records(content, strict)):
                    held.append((file, k, *record))
                    size += len(record[2])
                    if size > 8 << 20:
                        yield _batch(held, names)
                        held, size = [], 0
                if held:
                    yield _batch(held, names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_fasta_splits(spark: SparkSession, path: str) -> DataFrame:
    """(name, comment, seq) of FASTA files. Plain ones are split among tasks at any record, gzip ones are read as a stream.

    A record begins with > at the start of a line, so > may stand within a line. Files begin with a record.
    """
    rows = spark.read.option("lineSep", "\n>").text(path)
    # The separator takes the > of all records but a file's first.
    record = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract("record", r"^([^\r\n]*)", 1)
    return rows.select(record.alias("record")).where("record <> ''").select(
        F.regexp_extract(head, r"^(\S*)", 1).alias("name"),
        F.nullif(F.regexp_extract(head, r"^\S*\s+(.*)$", 1), F.lit("")).alias("comment"),
        F.regexp_replace(F.regexp_replace("record", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"),
    )


def first_records(records: DataFrame) -> DataFrame:
    """The first record of each file of `read`."""
    return records.where("ordinal = 0")


def write_fasta(df: DataFrame, path: str, width: int = 80) -> None:
    """(name, comment, seq) as FASTA text."""
    head = F.concat(F.lit(">"), F.col("name"), F.coalesce(F.concat(F.lit(" "), F.col("comment")), F.lit("")))
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(head, F.lit("\n"), body).alias("value")).write.text(path)


def write_fastq(df: DataFrame, path: str, compression: str = "none") -> None:
    """(name, comment, seq, qual) as FASTQ text of four lines a record."""
    head = F.concat(F.lit("@"), F.col("name"), F.coalesce(F.concat(F.lit(" "), F.col("comment")), F.lit("")))
    df.select(F.concat_ws("\n", head, "seq", F.lit("+"), "qual").alias("value")).write.option("compression", compression).text(path)


class FastxSource(DataSource):
    """`spark.read.format("fastx").load(path)` for files that the executors can open, one partition each."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastxReader(self.options)


class FastxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.strict = options["path"], options.get("strict", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        import glob

        return [InputPartition(f) for f in sorted(glob.glob(self.path))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            zipped = f.read(2) == _GZIP
        with gzip.open(partition.value, "rt", newline="\n") if zipped else open(partition.value, newline="\n") as lines:
            for k, record in enumerate(parse(lines, self.strict)):
                yield (partition.value, k, *record)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastxSource)
