"""Packing documents into sequences by non-negative least squares over the histogram of lengths.

Every document is cut into whole windows and one rest; whole windows are sequences as they
are. For the rests, shallow combinations of lengths (one, two or three) that fill a window exactly
are enumerated; non-negative least squares finds how often to repeat each so that the histogram of
rests is met; the counts are rounded down to what is there, and what remains is packed greedily, longest
first, again with a repeat count for each combination. The plan therefore has at most a few thousand rows,
whatever the input: its size depends on the window only.

Pieces are numbered within (task, length); the counts of (task, length) give each task's offset, so a
piece's rank within its length needs no global sort, and a frequent length is not one task's work. The
rank picks the sequence. The ids are computed once; pieces are stored with their checksum.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sketchloom.llm import byte_bpe
from sketchloom.llm.shared import INT, LONG, documents, keeping, schema, stored

WINDOW = 1024
END = 0
#: Lengths that triples are made of: so many of the most frequent.
TRIPLE_LENGTHS = 64


def combinations(histogram: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Combinations of up to three lengths that fill the window, of lengths that occur. histogram[n]: rests of length n."""
    there = [n for n in range(1, window) if histogram[n]]
    have = set(there)
    found = [(window - n, n) for n in there if 2 * n <= window and window - n in have]
    common = sorted(sorted(there, key=lambda n: -histogram[n])[:TRIPLE_LENGTHS])
    for i, a in enumerate(common):
        for b in common[i:]:
            c = window - a - b
            if c >= b and c in have:
                found.append((c, b, a))
    return found


def nnls(columns: list[tuple[int, ...]], target: np.ndarray, sweeps: int = 60, tolerance: float = 1e-3) -> np.ndarray:
    """Least squares with x >= 0 by coordinate descent; a column counts its lengths."""
    rest = target.astype(float)
    x = np.zeros(len(columns))
    sparse = [(np.unique(c), np.unique(c, return_counts=True)[1].astype(float)) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for k, (rows, n) in enumerate(sparse):
            step = max(-x[k], float(rest[rows] @ n) / float(n @ n))
            if step:
                x[k] += step
                rest[rows] -= step * n
                moved = max(moved, abs(step))
        if moved < tolerance * max(1.0, float(target.max(initial=0))):
            break
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats): together exactly the rests of the histogram."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...], most: int) -> int:
        kinds, n = np.unique(lengths, return_counts=True)
        repeats = int(min(most, (left[kinds] // n).min()))
        if repeats > 0:
            left[kinds] -= repeats * n
            out.append((lengths, repeats))
        return repeats

    columns = combinations(histogram, window)
    x = nnls(columns, left)
    for k in np.argsort(-x, kind="stable"):
        use(columns[k], int(x[k] + 1e-9))
    while left.any():
        lengths: list[int] = []
        gap = window
        spare = left.copy()
        while gap:
            fit = np.flatnonzero(spare[: gap + 1])
            if not len(fit):
                break
            lengths.append(int(fit[-1]))
            spare[fit[-1]] -= 1
            gap -= lengths[-1]
        use(tuple(lengths), int(left.max()))
    return out


class Placement:
    """From a piece's length and rank within its length to its sequence and offset."""

    def __init__(self, planned: list[tuple[tuple[int, ...], int]], window: int = WINDOW):
        used = np.zeros(window + 1, np.int64)
        rows, sequence = [], 0
        for lengths, repeats in planned:
            offset = 0
            for n in lengths:
                rows.append((n, used[n], repeats, sequence, offset))
                used[n] += repeats
                offset += n
            sequence += repeats
        rows.sort()
        self.sequences = sequence
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.length, self.first, self.repeats, self.sequence, self.offset = table.T
        self.begin = np.searchsorted(self.length, np.arange(window + 2))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.begin[length], self.begin[length + 1]
        while (wide := hi - lo > 1).any():  # the last block of this length that begins at or before the rank
            mid = (lo + hi) // 2
            right = self.first[np.minimum(mid, len(self.first) - 1)] <= rank
            lo, hi = np.where(wide & right, mid, lo), np.where(wide & ~right, mid, hi)
        return self.sequence[lo] + rank - self.first[lo], self.offset[lo]


def pieces(docs: DataFrame, keep: list[str], tokenizer: str, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """Whole windows and rests of all documents, stored: kept long columns, start, length, ids_crc32, doc_tokens, task, no."""
    fields = {k: LONG for k in keep} | dict(start=LONG, length=LONG, ids_crc32=LONG, doc_tokens=LONG, task=LONG, no=LONG)
    out = schema(**fields)
    if with_ids:
        from pyspark.sql.types import ArrayType, StructField

        out = out.add(StructField("ids", ArrayType(INT)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, ids, at in byte_bpe.encode_column(batch.column("text"), tokenizer, end):
                tokens = np.diff(at)
                n = -(-tokens // window)
                doc = np.repeat(np.arange(hi - lo), n)
                start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * window
                length = np.minimum(tokens[doc] - start, window)
                raw = memoryview(ids.astype("<u4").tobytes())
                begin = at[:-1][doc] + start
                crc = [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begin.tolist(), (begin + length).tolist())]
                columns = [batch.column(k).slice(lo, hi - lo).take(pa.array(doc)) for k in keep]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc, tokens[doc], np.full(len(doc), task), done + np.arange(len(doc)))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                done += len(doc)
                for a in range(0, len(doc), 50_000):
                    yield pa.RecordBatch.from_arrays([c.slice(a, 50_000) for c in columns], names=out.names)

    return stored(docs.select(*keep, "text").mapInArrow(cut, out), "pieces")


def pack(docs: DataFrame, keep: list[str], tokenizer: str, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row for each piece: kept columns, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Null and empty texts are the id `end` alone. Sequences are gapless from offset 0 and hold at most
    `window` ids; no id is lost or doubled. No documents give no rows. Repeated rows are packed each. Kept columns that
    bear a name of the result's own in any case are left out.
    """
    spark = docs.sparkSession
    docs, keep, back = keeping(docs, keep, ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"), "text")
    cut = pieces(docs, keep, tokenizer, window, end, with_ids)
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    histogram = np.zeros(window + 1, np.int64)
    for n, total in offsets.groupBy("length").agg(F.sum("n")).collect():  # at most `window` rows
        histogram[n] = total
    histogram[window] = 0  # whole windows are placed already
    placement = Placement(plan(histogram, window), window)
    sent = spark.sparkContext.broadcast(placement)
    within = Window.partitionBy("task", "length").orderBy("no")
    ranked = cut.withColumn("rank", F.row_number().over(within) - 1).join(offsets.select("task", "length", "before"), ["task", "length"]).withColumn("rank", (F.col("rank") + F.col("before")).cast("long"))
    result = schema(**{k: LONG for k in keep}, start=LONG, length=LONG, ids_crc32=LONG, doc_tokens=LONG, sequence_id=LONG, offset=LONG)
    if with_ids:
        result = result.add(cut.schema["ids"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = p.sequences + rank, np.zeros(len(rank), np.int64)
            rest = length < window
            if rest.any():
                sequence[rest], offset[rest] = p.place(length[rest], rank[rest])
            new = {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(c) if c in new else batch.column(c) for c in result.names], names=result.names)

    return back(ranked.select(*[c for c in result.names if c not in ("sequence_id", "offset")], "rank").mapInArrow(put, result))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir, "doc_id", "text"), ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"))


SQL = None
