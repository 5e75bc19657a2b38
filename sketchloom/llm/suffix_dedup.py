"""Removal of repeated 200-byte strings by suffix arrays, distributed by minimizers.

Every string of `LENGTH` bytes is owned by its leftmost least hash among its `GRAM`-byte substrings, the
*anchor*. Equal strings have equal anchors at equal distances, so repeats meet if what is around an
anchor is grouped by the anchor's hash: strings of different groups never match. An anchor's *context*
is the stretch that holds all strings it owns. Three cases remain:

- the anchor's hash occurs once: none of its strings is repeated;
- the whole context occurs more than once: all of its strings are. Copies are summed before any shuffle;
- else the distinct contexts of a group are put into suffix arrays. Two-stage sorting: suffixes smaller
  than their successors are sorted directly, the others follow by scans of the buckets; neighbours
  in the array that share `LENGTH` bytes are repeats.

A group of over `SPLIT` distinct contexts, too large for one task's array, is dealt by the strings themselves: those with
the same 128-bit hash meet, which is where an array's neighbours would have a common prefix of `LENGTH`.
Documents are known by a 128-bit hash of their text, as equal texts have equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import kernels as K
from sketchloom.llm.near_dedup import groups
from sketchloom.llm.shared import BINARY, INT, LONG, documents, drop_stored, keeping, schema, stored

LENGTH = 200
GRAM = 64
#: Distinct contexts of a group that one suffix array takes at most.
SPLIT = 8192
#: Bytes of contexts in one suffix array; a larger group is still one.
ARRAY_BYTES = 1 << 16
#: Starts of strings that are looked at together; a longer text is cut into such stretches, which overlap by a string.
SEGMENT = 1 << 24
#: Low bits of a hash that make room for positions, so that ties go to the leftmost.
_POSITION_BITS = 28


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For each anchor: text, first and last string owned (byte starts in data), the anchor's start, hashes of anchor and context."""
    if len(data) >> _POSITION_BITS:
        raise ValueError("too many bytes at once")
    window = length - gram + 1
    counts = np.maximum(np.diff(off) - length + 1, 0)
    if not counts.sum():
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    hashes = K.range_hash_sums(K.byte_values(data))
    n = len(data) - gram + 1
    at = np.arange(n)
    low = np.uint64(_POSITION_BITS)
    gram_hash = hashes(at, at + gram)
    keyed = np.concatenate((((gram_hash >> low) << low) | at.astype(np.uint64), np.full(-n % window, ~np.uint64(0)))).reshape(-1, window)
    # The least of a sliding window is the lesser of a suffix minimum and a prefix minimum of two blocks.
    ahead = np.minimum.accumulate(keyed, 1).reshape(-1)
    behind = np.minimum.accumulate(keyed[:, ::-1], 1)[:, ::-1].reshape(-1)
    last = n - window + 1
    least = (np.minimum(behind[:last], ahead[window - 1 : window - 1 + last]) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    ends = np.cumsum(counts)
    start = np.arange(ends[-1]) + np.repeat(off[:-1] - (ends - counts), counts)
    text = np.repeat(np.arange(len(counts)), counts)
    owner = least[start]
    first = K.grouped_starts(owner)
    lo, hi, anchor = start[first], start[np.append(first[1:], len(start)) - 1], owner[first]
    context = hashes(lo, hi + length) ^ K.mix((anchor - lo + 1).astype(np.uint64))
    return text[first], lo, hi, anchor, gram_hash[anchor].view(np.int64), context.view(np.int64)


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols. Symbol 0 ends a text; symbols are at most 256."""
    n = len(symbols)
    if n < 2:
        return np.arange(n)
    # A suffix is smaller than its successor if its symbol is, or is equal and the successor is of that kind.
    change = np.flatnonzero(symbols[:-1] != symbols[1:])
    following = np.searchsorted(change, np.arange(n - 1))
    decided = following < len(change)
    where = change[np.minimum(following, max(len(change) - 1, 0))] if len(change) else np.zeros(n - 1, np.int64)
    smaller = np.zeros(n, bool)
    smaller[:-1] = decided & (symbols[where] < symbols[np.minimum(where + 1, n - 1)])
    smaller |= symbols == 0  # ends are put in order directly, by position
    raw = symbols.astype(">u2").tobytes()
    direct = np.flatnonzero(smaller).tolist()
    direct.sort(key=lambda i: raw[2 * i : 2 * (i + depth)])
    ordered = np.array(direct, np.int64)
    counts = np.bincount(symbols, minlength=257)
    own = symbols[ordered]
    at = np.searchsorted(own, np.arange(258))
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for symbol in np.flatnonzero(counts).tolist():
        # What precedes this bucket's suffixes and is larger than its successor goes to its own bucket, in this order.
        wave = np.concatenate(induced[symbol]) if induced[symbol] else np.zeros(0, np.int64)
        bucket = [wave]
        while len(wave):  # runs of one symbol
            before = wave[wave > 0] - 1
            wave = before[(symbols[before] == symbol) & ~smaller[before]]
            bucket.append(wave)
        bucket.append(ordered[at[symbol] : at[symbol + 1]])
        bucket_all = np.concatenate(bucket)
        out.append(bucket_all)
        before = bucket_all[bucket_all > 0] - 1
        before = before[(symbols[before] > symbol) & ~smaller[before]]
        kinds = symbols[before]
        for k in np.unique(kinds).tolist():
            induced[k].append(before[kinds == k])
    return np.concatenate(out)


def common_prefixes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of a with that of b."""
    differs = a != b
    return np.where(differs.any(1), differs.argmax(1), a.shape[1])


def stretches_of(off: np.ndarray, length: int, segment: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text, first byte, last byte) of stretches of about a block; a text over `segment` bytes has several."""
    for lo, hi in K.blocks(off):
        size = int(off[hi] - off[lo])
        for begin in range(0, max(1, size if hi - lo == 1 else 1), segment):
            end = min(size, begin + segment + length - 1) if hi - lo == 1 else size
            if begin == 0 or end - begin >= length:
                yield lo, hi, int(off[lo]) + begin, int(off[lo]) + end


def repeated(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, which of its `length`-byte strings (by start) also start anywhere else in the contexts."""
    sizes = np.array([len(c) for c in contexts])
    joined = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    symbols = joined.astype(np.int64) + 1
    ends = np.cumsum(sizes + 1)
    symbols[ends - 1] = 0
    begin = ends - 1 - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    whole = np.arange(len(symbols)) + length <= (ends - 1)[owner]
    order = suffix_array(symbols, length)
    order = order[whole[order]]
    marks = np.zeros(len(symbols), bool)
    if len(order) > 1:
        windows = np.lib.stride_tricks.sliding_window_view(joined, length)
        for lo in range(0, len(order) - 1, 4096):
            a, b = order[lo : lo + 4096], order[lo + 1 : lo + 4097]
            a = a[: len(b)]
            same = common_prefixes(windows[a], windows[b]) >= length
            marks[a[same]] = True
            marks[b[same]] = True
    return [marks[s : s + max(0, n - length + 1)] for s, n in zip(begin, sizes)]


def ranges(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of True."""
    edge = np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return docs.select(*more, t.alias("text")).select(*more, F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")


def _packed(texts: DataFrame, keep: list[str]) -> DataFrame:
    """Texts as compressed bytes, so that what is shuffled is a third as large."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            z = pa.array([compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], z], names=[*keep, "z"])

    return texts.select(*keep, "text").mapInArrow(pack, schema(**{k: LONG for k in keep}, z=BINARY))


def repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, split: int = SPLIT, segment: int = SEGMENT) -> DataFrame:
    """(t1, t2, at): ranges of starts of repeated strings, packed as first * 2**32 + last. texts: t1, t2, text, a row for each document."""
    spark = texts.sparkSession
    fields = dict(t1=LONG, t2=LONG, lo=INT, hi=INT, gram=LONG, context=LONG)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.utf8(batch.column("text"))
            for lo, hi, begin, end in stretches_of(off, length, segment):
                text, first, last, _, gram_hash, context = anchors(data[begin:end], np.clip(off[lo : hi + 1] - begin, 0, end - begin), length, gram)
                t1, t2 = (batch.column(c).to_numpy()[lo:hi][text] for c in ("t1", "t2"))
                base = begin - off[lo:hi][text]
                columns = [pa.array(x) for x in (t1, t2, (first + base).astype(np.int32), (last + base).astype(np.int32), gram_hash, context)]
                for a in range(0, len(text), 20_000):
                    yield pa.RecordBatch.from_arrays([c.slice(a, 20_000) for c in columns], names=list(fields))

    found = stored(texts.mapInArrow(find, schema(**fields)), "anchors")
    # What is joined with the anchors is stored first, so that AQE can split the hot grams of either join.
    shared = stored(found.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("least"), F.max("context").alias("most")).where("n > 1").select("gram", (F.col("least") == F.col("most")).alias("single")), "shared-grams")
    among = stored(found.join(shared, "gram"), "shared-anchors")
    drop_stored(found, shared)

    pack = (F.shiftleft(F.col("lo").cast("long"), 32) + F.col("hi")).alias("at")
    several = among.where("not single")
    kinds = stored(several.groupBy("gram", "context").agg(F.count("*").alias("copies")), "kinds")
    by_gram = stored(kinds.groupBy("gram").agg(F.count("*").alias("contexts"), F.min("copies").alias("rarest")), "grams")
    known = stored(kinds.join(by_gram, "gram"), "contexts")
    counted = stored(several.join(known, ["gram", "context"]), "counted-anchors")
    drop_stored(kinds, by_gram)
    settled = among.where("single").select("t1", "t2", pack).unionByName(counted.where("copies > 1").select("t1", "t2", pack))
    # One context of each kind stands for its copies.
    open_ = counted.where("rarest = 1").dropDuplicates(["gram", "context"])
    by_text = open_.groupBy("t1", "t2").agg(F.collect_list(F.struct("gram", "context", "lo", "hi", (F.col("contexts") > split).cast("int").alias("hot"), (F.col("copies") == 1).cast("int").alias("alone"))).alias("spots"))
    cut = schema(t1=LONG, t2=LONG, lo=INT, hot=INT, alone=INT, gram=LONG, bytes=BINARY)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in batch.to_pylist():
                raw = expand(row["z"])
                s = row["spots"]
                columns = [[row["t1"]] * len(s), [row["t2"]] * len(s), [x["lo"] for x in s], [x["hot"] for x in s], [x["alone"] for x in s], [x["gram"] for x in s], [raw[x["lo"] : x["hi"] + length] for x in s]]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=cut.names)

    once = _packed(texts, ["t1", "t2"]).join(by_text, ["t1", "t2"]).dropDuplicates(["t1", "t2"])
    stretches = stored(once.mapInArrow(contexts, cut), "stretches")
    out = schema(t1=LONG, t2=LONG, at=LONG)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def done() -> pa.RecordBatch:
            rows = pa.concat_tables(held)
            raw = rows["bytes"].to_pylist()
            t1, t2, lo, alone = (rows[c].to_numpy() for c in ("t1", "t2", "lo", "alone"))
            which, first, last = [], [], []
            for k, marks in enumerate(repeated(raw, length)):
                if alone[k]:
                    a, b = ranges(marks)
                    which += [k] * len(a)
                    first += (a + lo[k]).tolist()
                    last += (b + lo[k]).tolist()
            which = np.array(which, np.int64)
            at = np.array(first, np.int64) << 32 | np.array(last, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(t1[which]), pa.array(t2[which]), pa.array(at)], names=out.names)

        for g in groups(batches, ["gram"]):
            held.append(g)
            size += g.nbytes
            if size >= ARRAY_BYTES:
                yield done()
                held, size = [], 0
        if held:
            yield done()

    sorted_ = stretches.where("hot = 0").repartition("gram").sortWithinPartitions("gram").mapInArrow(sort, out)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["bytes"], np.uint8)
                at = np.arange(len(data) - length + 1)
                h1 = K.range_hashes(K.byte_values(data), at, at + length).view(np.int64)
                h2 = K.range_hashes(K.byte_values(data ^ 0x5A), at, at + length).view(np.int64)
                n = len(at)
                columns = [pa.array(np.full(n, row["t1"])), pa.array(np.full(n, row["t2"])), pa.array((at + row["lo"]) << 32 | (at + row["lo"])), pa.array(h1), pa.array(h2), pa.array(np.full(n, row["alone"], np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["t1", "t2", "at", "h1", "h2", "alone"])

    if known.where(F.col("contexts") > split).limit(1).count():
        every = stored(stretches.where("hot = 1").mapInArrow(strings, schema(t1=LONG, t2=LONG, at=LONG, h1=LONG, h2=LONG, alone=INT)), "strings")
        often = every.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
        sorted_ = sorted_.unionByName(every.where("alone = 1").join(often, ["h1", "h2"], "left_semi").select("t1", "t2", "at"))
    marks = stored(settled.unionByName(sorted_), "repeat-marks")
    drop_stored(among, known, counted, stretches)
    return marks


def remove_repeats(docs: DataFrame, keep: list[str], length: int = LENGTH, gram: int = GRAM, split: int = SPLIT, segment: int = SEGMENT) -> DataFrame:
    """keep (long columns of docs), n_bytes, n_removed, n_spans, kept (bytes), a row for each row of docs.

    A byte goes if a `length`-byte string that covers it also starts elsewhere, in the same or another
    text, as the input stands. Null is an empty text; shorter texts stay whole. Equal rows are copies of each
    other, so they lose all that is at least `length` bytes. Columns of docs that are not in keep are left out, and
    kept ones that bear a name of the result's own in any case. No rows give no rows.
    """
    docs, keep, back = keeping(docs, keep, ("n_bytes", "n_removed", "n_spans", "kept"), "text")
    texts = _texts(docs, *keep)
    marks = repeats(texts.select("t1", "t2", "text"), length, gram, split, segment).groupBy("t1", "t2").agg(F.collect_set("at").alias("at"))
    out = schema(**{k: LONG for k in keep}, n_bytes=LONG, n_removed=LONG, n_spans=LONG, kept=BINARY)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            kept, sizes, removed, spans = [], [], [], []
            ats = batch.column("at")
            for k, z in enumerate(batch.column("z").to_pylist()):
                raw = expand(z)
                at = ats[k].values
                sizes.append(len(raw))
                if at is None or not len(at):
                    kept.append(raw)
                    removed.append(0)
                    spans.append(0)
                    continue
                at = at.to_numpy(zero_copy_only=False)
                first, last = at >> 32, at & 0xFFFFFFFF
                delta = np.zeros(len(raw) + 1, np.int64)
                np.add.at(delta, first, 1)
                np.add.at(delta, last + length, -1)
                gone = np.cumsum(delta[:-1]) > 0
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
                removed.append(int(gone.sum()))
                spans.append(len(ranges(gone)[0]))
            columns = [*[batch.column(c) for c in keep], *[pa.array(x, pa.int64()) for x in (sizes, removed, spans)], pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    joined = _packed(texts, [*keep, "t1", "t2"]).join(marks, ["t1", "t2"], "left")
    return back(joined.select(*keep, "z", "at").mapInArrow(remove, out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(documents(spark, sf_dir, "doc_id", "text"), ["doc_id"])
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
with d as (select doc_id, row_number() over () as r, hex(encode(coalesce(text, ''))) as h from documents),
w as (select r, unnest(range(0, (len(h) // 2 - 200 + 1)::bigint)) as s from d where len(h) >= 400),
k as (select r, s, md5(substr(h, 2 * s + 1, 400)) as m from w join d using (r)),
rep as (select r, s from k where m in (select m from k group by m having count(*) > 1)),
edge as (select r, s, s - coalesce(lag(s) over (partition by r order by s), -1000) > 200 as new from rep),
isle as (select r, s, sum(new::int) over (partition by r order by s) as g from edge),
span as (select r, g, min(s) as a, max(s) + 200 as b from isle group by r, g),
gap as (
  select r, coalesce(lag(b) over (partition by r order by a), 0) as a, a as b from span
  union all select r, max(b) as a, null as b from span group by r
),
kept as (select r, string_agg(case when b is null then substr(h, 2 * a + 1) else substr(h, 2 * a + 1, 2 * (b - a)) end, '' order by a, b nulls last) as h from gap join d using (r) group by r),
stat as (select r, sum(b - a) as n_removed, count(*) as n_spans from span group by r)
select doc_id, (len(d.h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join stat using (r) left join kept using (r)
"""
