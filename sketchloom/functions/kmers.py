"""Sequences and their k-mers, as columns and as numpy windows over Arrow batches.

Windows are cut from a sequence's bytes in slices, so time is linear and memory is bounded whatever a sequence's
length; `substring` at each position would walk the sequence from its start every time.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.functions import hashing
from sketchloom.storage import stored

#: K-mers that are held at once.
SLICE = 1 << 17
BASES = "ACGT"

# The complement of a byte is chosen by two of its bits; A, C, G, T and N in either case give T, G, C, A and C.
COMPLEMENTS = "TGAC"


def complement(byte: int) -> str:
    return COMPLEMENTS[(byte >> 1) & 3]


_COMPLEMENT = np.array([ord(complement(b)) for b in range(256)], np.uint8)
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[ord("a") : ord("z") + 1] -= 32


def upper(seq: Column) -> Column:
    """a-z become A-Z; other characters stay."""
    return F.translate(seq, string.ascii_lowercase, string.ascii_uppercase)


def reverse_complement(seq: Column) -> Column:
    """Any ASCII character has a complement."""
    every = "".join(chr(b) for b in range(1, 128))
    return F.translate(F.reverse(seq), every, "".join(complement(ord(c)) for c in every))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement, by bytes."""
    return F.least(kmer, reverse_complement(kmer))


def acgt_only(text: Column) -> Column:
    """The bases in a text, upper-case."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^ACGTacgt]", ""))


def sequences(column: pa.Array) -> list[np.ndarray]:
    """Bytes of each sequence; null is empty."""
    return [np.frombuffer((s or "").encode(), np.uint8) for s in column.to_pylist()]


def upper_bytes(seq: np.ndarray) -> np.ndarray:
    return _UPPER[seq]


def windows(seq: np.ndarray, k: int, drop_last: bool = False) -> np.ndarray:
    """A row of bytes for each k-mer."""
    if len(seq) < k + drop_last:
        return np.zeros((0, k), np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(seq, k)
    return rows[:-1] if drop_last else rows


def reverse_complement_bytes(seq: np.ndarray) -> np.ndarray:
    return _COMPLEMENT[seq[::-1]]


def canonical_windows(seq: np.ndarray, k: int, drop_last: bool = False) -> np.ndarray:
    """For each k-mer the lesser of its two strands."""
    own = windows(seq, k, drop_last)
    if not len(own):
        return own
    other = np.lib.stride_tricks.sliding_window_view(reverse_complement_bytes(seq), k)[::-1][: len(own)]
    take_other, alike = np.zeros(len(own), bool), np.ones(len(own), bool)
    for at in range(0, k, 8):
        a, b = (hashing.lanes(x, at, at + 8).byteswap() for x in (own, other))
        take_other |= alike & (b < a)
        alike &= a == b
    return np.where(take_other[:, None], other, own)


def pack(seq: np.ndarray, k: int, codes: np.ndarray, bits: int = 2) -> np.ndarray:
    """The k-mers as numbers of `bits` bits a base: windows of 1, 2, 4, ... bases, of which those of k are put together."""
    part, width = codes[seq].astype(np.uint64), 1
    total, have = np.zeros(len(part) + 1, np.uint64), 0
    n = max(0, len(seq) - k + 1)
    while n:
        if k & width:
            total = (total[:n] << np.uint64(bits * width)) | part[have : have + n]
            have += width
        if have == k:
            return total
        part = (part[:-width] << np.uint64(bits * width)) | part[width:]
        width *= 2
    return total[:n]


def spans(column: pa.Array, k: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, rows): parts of the sequences end to end, the k-mers in each that lie in one row, and their rows.

    A part has at most `most` starts, whatever the length of a sequence; each k-mer is in one part.
    """
    held = column if isinstance(column, (pa.StringArray, pa.LargeStringArray)) else column.cast(pa.string())
    held = held.fill_null("") if held.null_count else held
    kind = np.int64 if isinstance(held, pa.LargeStringArray) else np.int32
    ends = np.frombuffer(held.buffers()[1], kind, len(held) + 1, held.offset * np.dtype(kind).itemsize).astype(np.int64) if len(held) else np.zeros(1, np.int64)
    data = np.frombuffer(held.buffers()[2], np.uint8) if len(held) and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    for lo in range(int(ends[0]), int(ends[-1]), most):
        hi = min(lo + most, int(ends[-1]))
        a, b = np.searchsorted(ends, lo, "right") - 1, np.searchsorted(ends, hi, "left")
        edges = np.clip(ends[a : b + 1], lo, hi)
        rows = np.repeat(np.arange(a, b), np.diff(edges))
        starts = np.flatnonzero(np.arange(lo, hi) + k <= ends[rows + 1])
        yield upper_bytes(data[lo : min(hi + k - 1, int(ends[-1]))]), starts, rows[starts]


def characters(data: bytes) -> np.ndarray:
    """Where each character of UTF-8 text begins, and the text's end."""
    raw = np.frombuffer(data, np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


def texts(rows: np.ndarray) -> pa.Array:
    """Rows of ASCII bytes as strings."""
    n, k = rows.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * k).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes()))


def each_kmer(df: DataFrame, k: int, drop_last: int = 0, id_type: str = "long") -> DataFrame:
    """(id, pos, kmer) of (id, seq): all k-mers as they stand, pos from 1. Sequences shorter than k and nulls have none.

    A k-mer is k characters, so sequences need not be ASCII.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, seq in enumerate(batch.column("seq").to_pylist()):
                data = (seq or "").encode()
                at = characters(data)
                n = len(at) - k - drop_last
                for lo in range(0, max(n, 0), SLICE):
                    m = min(SLICE, n - lo)
                    if len(at) == len(data) + 1:
                        found = texts(np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8)[lo : lo + m + k - 1], k))
                    else:
                        found = pa.array([data[a:b].decode() for a, b in zip(at[lo : lo + m], at[lo + k : lo + k + m])], pa.string())
                    ids = batch.column("id").take(pa.array(np.full(m, row)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(lo + 1, lo + m + 1, dtype=np.int32)), found], names=["id", "pos", "kmer"])

    return df.select("id", "seq").mapInArrow(run, f"id {id_type}, pos int, kmer string")


#: Letters of packed k-mers by their bits, in the order of their bytes.
LETTERS = {2: "ACGT", 3: "ACGNT"}
#: Starts of k-mers of a sequence that are counted at once.
WHOLE = 1 << 21


def packed_kmers(seq: np.ndarray, k: int, bits: int, strands: bool) -> np.ndarray:
    """The k-mers of upper-case bytes as numbers that sort as they do; strands: the lesser of both."""
    code = np.zeros(256, np.uint8)
    code[[ord(c) for c in LETTERS[bits]]] = range(len(LETTERS[bits]))
    own = pack(seq, k, code, bits)
    return np.minimum(own, pack(reverse_complement_bytes(seq), k, code, bits)[::-1]) if strands else own


def unpacked(packed: Column, k: int, bits: int) -> Column:
    """The letters of packed k-mers, some at a time from a table."""
    width = 12 // bits if bits == 2 else 3
    letters = LETTERS[bits].ljust(1 << bits, "?")
    parts = []
    for lo in range(0, k, width):
        n = min(width, k - lo)
        table = F.split(F.lit(",".join("".join(letters[x >> bits * (n - 1 - j) & (1 << bits) - 1] for j in range(n)) for x in range(1 << bits * n))), ",")
        parts.append(F.get(table, F.shiftright(packed, bits * (k - lo - n)).bitwiseAND(F.lit((1 << bits * n) - 1)).cast("int")))
    return F.concat(*parts)


def _summed(keys: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of keys, the last of which matters most, and how many there are of each, or the sum of n."""
    bits = [int(x.max()).bit_length() if len(x) and x.min() >= 0 else 64 for x in keys]
    if n is None and len(keys) == 1:
        keys = [np.sort(keys[0])]
    elif n is None and sum(bits) < 64:  # two keys as one number
        both = np.sort(keys[1] << bits[0] | keys[0])
        keys = [both & ((1 << bits[0]) - 1), both >> bits[0]]
    else:
        order = np.lexsort(keys)
        keys, n = [x[order] for x in keys], None if n is None else n[order]
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(new))) if n is None else np.add.reduceat(n, first) if len(first) else n
    return [x[first] for x in keys], times


class _Counter:
    """Counts the k-mers of batches of (id, seq). A packed one is of A, C, G and T; with N, the complement of a number of 3 bits a letter."""

    def __init__(self, k: int, by_id: bool, strands: bool):
        self.k, self.by_id, self.strands = k, by_id, strands
        self.good = {bits: np.isin(np.arange(256), [ord(c) for c in letters]) for bits, letters in LETTERS.items() if bits * k <= 63}

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id"] * self.by_id + ["packed", "other", "n"]
        for batch in batches:
            for a, b, classes in self.parts(batch.column("seq")) if self.by_id else [(0, batch.num_rows, 1)]:
                column, ids = batch.column("seq").slice(a, b - a), batch.column("id").slice(a, b - a)
                for c in range(classes):
                    for owner, packed, other, n in self.counted(column, c, classes):
                        yield pa.RecordBatch.from_arrays(([ids.take(pa.array(owner))] if self.by_id else []) + [packed, other, pa.array(n, pa.int64())], names=names)

    def parts(self, column: pa.Array) -> Iterator[tuple[int, int, int]]:
        """Ranges of rows that are summed in one go; a long row has classes of k-mers, each of which is."""
        ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        a, before = 0, 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, before + SLICE, "right")))
            yield a, b, -(-max(1, int(ends[b - 1]) - before) // WHOLE)
            a, before = b, int(ends[b - 1])

    def counted(self, column: pa.Array, c: int, classes: int) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]]:
        held, odd = [], []
        for seq, starts, rows in spans(column, self.k, SLICE):
            packed, fits, found = self.packed(seq, starts)
            mine = fits if classes == 1 else fits & (hashing.fmix64(packed.view(np.uint64)) % np.uint64(classes) == c)
            held.append(_summed([packed[mine]] + [rows[mine]] * self.by_id))
            if len(found):
                owner = (rows[~fits] if self.by_id else np.zeros(len(found), np.int64)).astype(">i8")
                keyed = np.concatenate((owner.view(np.uint8).reshape(-1, 8), found), 1)
                if classes > 1:
                    keyed = keyed[hashing.murmur128(found)[0] % np.uint64(classes) == c]
                odd.append(np.unique(keyed, axis=0, return_counts=True))
            if not self.by_id:
                yield from self.written(held, odd)
                held, odd = [], []
        yield from self.written(held, odd)

    def packed(self, seq: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the k-mers at the starts, which of them fit, and the bytes of the others.

        The other strand of any letters is of A, C, G and T.
        """
        k, out = self.k, np.zeros(len(starts), np.int64)

        def within(good: np.ndarray) -> np.ndarray:
            if good[seq].all():
                return np.ones(len(starts), bool)
            so_far = np.append(0, np.cumsum(~good[seq]))
            return so_far[starts + k] == so_far[starts]

        fits = within(self.good[2]) if 2 in self.good else np.zeros(len(starts), bool)
        if fits.any():
            out[fits] = packed_kmers(seq, k, 2, self.strands)[starts[fits]].view(np.int64)
        more = within(self.good[3]) & ~fits if 3 in self.good and not fits.all() else np.zeros(len(starts), bool)
        if more.any():
            at = starts[more]
            own = packed_kmers(seq, k, 3, False)[at]
            out[more] = ~own.view(np.int64)
            if self.strands:
                other = reverse_complement_bytes(seq)
                lesser = packed_kmers(other, k, 3, False)[::-1][at] < own
                out[more] = np.where(lesser, packed_kmers(other, k, 2, False)[::-1][at].view(np.int64), out[more])
            fits |= more
        left = np.flatnonzero(~fits)
        found = (canonical_windows if self.strands else windows)(seq, k)[starts[left]] if len(left) else np.zeros((0, k), np.uint8)
        plain = self.good[2][found].all(1) if 2 in self.good else np.zeros(len(found), bool)
        if plain.any():
            one = packed_kmers(np.ascontiguousarray(found[plain]).reshape(-1), k, 2, False)[::k]
            out[left[plain]] = one.view(np.int64)
            fits[left[plain]] = True
        return out, fits, found[~plain]

    def written(self, held: list, odd: list) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]]:
        if held:
            keys, n = held[0] if len(held) == 1 else _summed([np.concatenate(x) for x in zip(*(h[0] for h in held))], np.concatenate([h[1] for h in held]))
            yield keys[-1], pa.array(keys[0]), pa.nulls(len(n), pa.string()), n
        if odd:
            found, n = odd[0]
            if len(odd) > 1:
                found, at = np.unique(np.concatenate([x[0] for x in odd]), axis=0, return_inverse=True)
                n = np.bincount(at.reshape(-1), np.concatenate([x[1] for x in odd]), len(found)).astype(np.int64)
            yield np.ascontiguousarray(found[:, :8]).view(">i8").reshape(-1).astype(np.int64), pa.nulls(len(n), pa.int64()), texts(found[:, 8:]), n


def packed_counts(df: DataFrame, k: int, by_id: bool, strands: bool = True, id_type: str = "long") -> DataFrame:
    """(packed, other, n), or with id, of (id, seq), for `kmer_of`. Only rows whose id other rows bear as well are shuffled with by_id."""
    fields = (f"id {id_type}, " if by_id else "") + "packed long, other string, n long"
    rows = df.select("id", "seq")
    counts = lambda x: x.mapInArrow(_Counter(k, by_id, strands), fields)
    keys = (["id"] if by_id else []) + ["packed", "other"]
    summed = lambda x: counts(x).groupBy(*keys).agg(F.sum("n").alias("n"))
    if not by_id or df.isStreaming:
        return summed(rows)
    again = stored(rows.groupBy("id").agg(F.count("*").alias("times")).where("times > 1").select(F.struct("id").alias("again")), "repeated-ids")
    if again.isEmpty():
        return counts(rows)
    marked = rows.select("*", F.struct("id").alias("own"))
    one, several = (marked.join(again, F.col("own") == F.col("again"), how).select("id", "seq") for how in ("left_anti", "left_semi"))
    return counts(one).unionByName(summed(several))


def kmer_of(k: int) -> Column:
    """The k-mer of packed and other."""
    forms = F.when(F.col("other").isNotNull(), F.col("other"))
    if 3 * k <= 63:
        forms = forms.when(F.col("packed") < 0, unpacked(F.bitwise_not("packed"), k, 3))
    return forms.otherwise(unpacked(F.col("packed"), k, 2) if k <= 31 else F.lit(None))


def count_kmers(df: DataFrame, k: int, by_id: bool, strands: bool = True, id_type: str = "long") -> DataFrame:
    """(kmer, n), or (id, kmer, n), of (id, seq): how often each k-mer stands; strands: under its canonical form.

    a-z are upper-cased. K-mers of A, C, G and T, of up to 31 bases, and of those and N, of up to 21, are counted as numbers and
    written out after their counts are summed; others as strings. A slice's equal k-mers are summed before any shuffle; k-mers
    of an id that only one row bears are never shuffled.
    """
    counted = packed_counts(df, k, by_id, strands, id_type)
    return counted.select(*["id"] * by_id, kmer_of(k).alias("kmer"), "n")
