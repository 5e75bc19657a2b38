"""Near-duplicate detection: a multi-index Hamming join of b-bit MinHash signatures, confirmed on whole sets.

A document's set of word shingles gives a signature of 4*m symbols of 16 bits. Two signatures at
Hamming distance 2*m - 1 or less differ, by the pigeonhole principle, in at most one symbol of
some chunk of four. Enumerating the one allowed error (each symbol of a chunk left out in turn) gives
4*m keys, and each such pair shares one of them: all pairs under the distance are found. m is the least for which two
sets at the similarity threshold exceed that distance with a probability below `MISS`.

Documents with equal sets are one class first. A key that only one class has is dropped by a count that is
summed before the shuffle, and keys with the same members are one bucket. Buckets get their members' whole
sets; inside a bucket, bit vectors give exact intersections, classes that are connected already are skipped,
and only links that connect something are returned, so a bucket of n classes returns fewer than n rows. A
bucket of over `BLOCK` classes or `BLOCK_BYTES` of sets is cut into blocks. Blocks are linked in themselves first,
and to each other by a few members of each. What that leaves outside the bucket's largest component is then
compared with all the bucket's blocks; members of one component never are, as a link between them would add
nothing. So a bucket of near copies costs its size, not the square of it.

Links are lost only where two sets at the threshold differ in more symbols than the distance allows: for a pair
right at the threshold with a probability below `MISS`, for more similar ones far less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sketchloom.llm import kernels as K
from sketchloom.llm.components import components
from sketchloom.llm.shared import BINARY, LONG, documents, drop_stored, row_key, schema, stored

CHUNK = 4
MISS = 1e-5
BLOCK = 2048
#: Bytes of the sets of a block, about. A larger set is a block's only one.
BLOCK_BYTES = 32 << 20
#: Members of a block that are compared with those of the bucket's other blocks at once.
HUBS = 4
#: Up to so many ids of 8 bytes are broadcast.
BROADCAST_IDS = 200_000


def chunks_for(similarity: float, miss: float = MISS) -> int:
    """The least number m of chunks: P(more than 2m - 1 of 4m symbols differ) < miss."""
    q = 1 - similarity
    for m in range(2, 64):
        n, most = CHUNK * m, 2 * m - 1
        if sum(math.comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(most + 1, n + 1)) < miss:
            return m
    raise ValueError("similarity is too low")


class Signer:
    def __init__(self, words: int, chunks: int):
        self.words, self.size = words, CHUNK * chunks
        rng = np.random.default_rng(20240229)
        self.a = rng.integers(0, 1 << 63, self.size, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, self.size, np.uint64)

    def sets(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of each text, ascending, and where each text's begin."""
        hashed, at = K.word_hashes(data, off, K.SPACE)
        hashed, at = K.shingle_hashes(hashed, at, self.words)
        parts = [np.unique(hashed[at[k] : at[k + 1]]) for k in range(len(at) - 1)]
        out = np.zeros(len(at), np.int64)
        np.cumsum([len(p) for p in parts], out=out[1:])
        return np.concatenate(parts) if parts else hashed, out

    def sign(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """uint16 symbols, one row for each set; zeros for empty sets."""
        out = np.zeros((len(at) - 1, self.size), np.uint16)
        some = np.flatnonzero(np.diff(at))
        if len(some):
            for k in range(self.size):
                out[some, k] = K.mix(np.minimum.reduceat(values * self.a[k] + self.b[k], at[:-1][some])) & np.uint64(0xFFFF)
        return out

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """64-bit keys, one row for each signature: each chunk with each of its symbols left out."""
        s = signatures.astype(np.uint64).reshape(len(signatures), -1, CHUNK)
        out = np.empty((len(s), s.shape[1], CHUNK), np.uint64)
        for gone in range(CHUNK):
            key = np.zeros(s.shape[:2], np.uint64)
            for k in range(CHUNK):
                if k != gone:
                    key = (key << np.uint64(16)) | s[:, :, k]
            out[:, :, gone] = K.mix(key + (np.arange(s.shape[1], dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(gone + 1)) * np.uint64(0x9E3779B97F4A7C15))
        return out.reshape(len(s), -1)


def signatures(docs: DataFrame, keep: list[str], signer: Signer) -> DataFrame:
    """keep (long columns), n_shingles, a 128-bit fingerprint of the set (f1, f2), signature. Stored."""
    out = schema(**{k: LONG for k in keep}, n_shingles=LONG, f1=LONG, f2=LONG, signature=BINARY)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.utf8(batch.column("text"))
            for lo, hi in K.blocks(off):
                values, at = signer.sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                total = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(v))) for v in (values, K.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
                sums = [(t[at[1:]] - t[at[:-1]]).view(np.int64) for t in total]
                raw = [s.tobytes() for s in signer.sign(values, at)]
                columns = [batch.column(k).slice(lo, hi - lo) for k in keep]
                columns += [pa.array(np.diff(at)), pa.array(sums[0]), pa.array(sums[1]), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return stored(docs.select(*keep, "text").mapInArrow(sign, out), "signatures")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that share the keys, from batches sorted by them; a group may span batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.table(batch)
        columns = [table[k].to_numpy() for k in keys]
        new = np.zeros(table.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        cuts = [0, *np.flatnonzero(new).tolist(), table.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if held and (lo > 0 or first != last):
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(lo, hi - lo))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.concat_tables(held)


class Links:
    """Connects sets of one bucket; find() by an array of labels."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, a: int, others: np.ndarray) -> list[int]:
        """Joins a with others; one of the others for each component that was new to a."""
        labels, first = np.unique(self.label[others], return_index=True)
        fresh = labels != self.label[a]
        if fresh.any():
            self.label[np.isin(self.label, labels)] = self.label[a]
        return others[first[fresh]].tolist()


def linked(ids: np.ndarray, side: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], num: int, den: int, most: int, chunk_bits: int = 1 << 17) -> list[tuple[int, int]]:
    """Links that connect a bucket: den * intersection >= num * union, among pairs at Hamming distance up to `most`.

    side: for a pair of blocks, rows of block 0 are compared with rows of block 1 only; within a block all have side -1.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    by = np.argsort(values, kind="stable")
    start = K.grouped_starts(values[by])
    count = np.diff(np.append(start, len(by)))
    column = np.cumsum(count > 1) - 1
    shared = np.repeat(count > 1, count)
    rows, columns = owner[by][shared], np.repeat(column, count)[shared]
    width = int(column[-1]) + 1 if len(column) else 0
    bits = []
    for lo in range(0, width, chunk_bits):
        part = (columns >= lo) & (columns < lo + chunk_bits)
        words = -(-min(chunk_bits, width - lo) // 64)
        table = np.zeros((n, words), np.uint64)
        c = columns[part] - lo
        np.bitwise_or.at(table, (rows[part], c >> 6), np.uint64(1) << (c & 63).astype(np.uint64))
        bits.append(table)
    links, found = Links(n), []
    for a in range(n):
        b = np.flatnonzero((links.label != links.label[a]) & ((side != side[a]) | (side < 0)))
        if side[a] < 0:
            b = b[b > a]
        elif side[a] == 1:
            continue
        # Sizes alone rule out many: the intersection is at most the smaller set.
        b = b[den * np.minimum(sizes[b], sizes[a]) >= num * np.maximum(sizes[b], sizes[a])]
        if len(b):
            b = b[(sigs[b] != sigs[a]).sum(1) <= most]
        if len(b):
            common = sum(np.bitwise_count(t[b] & t[a]).sum(1, dtype=np.int64) for t in bits) if bits else np.zeros(len(b), np.int64)
            for other in links.union(a, b[den * common >= num * (sizes[b] + sizes[a] - common)]):
                found.append((int(ids[a]), int(ids[other])))
    return found


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, block: int = BLOCK, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and the columns named in keep, a row for each row of docs.

    Documents are linked at den * intersection >= num * union of their sets of `words`-word shingles
    (A-Z lower-cased, words parted by white space); fewer words are one shingle. Null, empty and wordless texts
    have an empty set and are their own component. Rows without a doc_id take no part: their component_id is
    null. Rows that share a doc_id are one node.
    """
    keep = keep or []
    signer = Signer(words, chunks_for(num / den))
    most = signer.size // 2 - 1
    signed = signatures(docs.select("doc_id", *keep, "text"), ["doc_id", *keep], signer)
    classes = stored(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")),
        "classes",
    )
    key_fields = dict(key=LONG, rep=LONG, f1=LONG, n_shingles=LONG)

    def enumerate_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, signer.size)
            keys = signer.keys(raw).view(np.int64)
            for lo in range(0, len(raw), 2000):
                part = keys[lo : lo + 2000]
                columns = [pa.array(np.repeat(batch.column(c).to_numpy()[lo : lo + 2000], signer.size)) for c in ("rep", "f1", "n_shingles")]
                yield pa.RecordBatch.from_arrays([pa.array(part.reshape(-1)), *columns], names=list(key_fields))

    keys = classes.select("rep", "f1", "n_shingles", "signature").mapInArrow(enumerate_keys, schema(**key_fields))
    member = F.xxhash64("rep", "f1")
    counted = keys.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), F.bit_xor(member).alias("x"), F.bit_xor(F.xxhash64(F.lit(5), "f1", "rep")).alias("y")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("shingles") * 8 / BLOCK_BYTES)).cast("int")
    buckets = stored(counted.groupBy("n", "shingles", "x", "y").agg(F.min("key").alias("key")).select("key", blocks.alias("blocks")), "buckets")
    small = buckets.count() <= BROADCAST_IDS
    own = F.pmod(F.xxhash64(F.lit(9), "rep"), F.col("blocks")).cast("int")
    members = stored(keys.join(F.broadcast(buckets) if small else buckets, "key").select("key", "rep", "f1", "blocks", own.alias("own")), "members")

    wanted = members.select("rep", "f1").distinct()
    few = wanted.count() <= BROADCAST_IDS
    wanted = F.broadcast(wanted) if few else wanted

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.utf8(batch.column("text"))
            for lo, hi in K.blocks(off):
                values, at = signer.sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
                f1 = (total[at[1:]] - total[at[:-1]]).view(np.int64)
                raw = [values[at[k] : at[k + 1]].tobytes() for k in range(hi - lo)]
                sigs = [s.tobytes() for s in signer.sign(values, at)]
                columns = [batch.column("doc_id").slice(lo, hi - lo), pa.array(f1), pa.array(raw, pa.binary()), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "f1", "values", "sig"])

    chosen = docs.select("doc_id", "text").join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = chosen.mapInArrow(extract, schema(rep=LONG, f1=LONG, values=BINARY, sig=BINARY)).dropDuplicates(["rep", "f1"])
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, int]] = []
        for g in groups(batches, ["key", "i", "j"]):
            if g.num_rows > 1:
                sigs = np.frombuffer(b"".join(g["sig"].to_pylist()), np.uint16).reshape(-1, signer.size)
                done += linked(g["rep"].to_numpy(), g["side"].to_numpy(), sigs, [np.frombuffer(v, np.uint64) for v in g["values"].to_pylist()], num, den, most)
            if len(done) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([y for _, y in done], pa.int64())], names=["a", "b"])
                done = []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([y for _, y in done], pa.int64())], names=["a", "b"])

    def links(placed: DataFrame) -> DataFrame:
        """placed: key, rep, f1, group (i, j) and side."""
        dealt = placed.join(sets, ["rep", "f1"]).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return dealt.select("key", "i", "j", "rep", "side", "sig", "values").mapInArrow(confirm, schema(a=LONG, b=LONG))

    lone = F.lit(-1).alias("side")
    inside = members.select("key", "rep", "f1", F.col("own").alias("i"), F.col("own").alias("j"), lone)
    many = buckets.where("blocks > 1")
    if not many.limit(1).count():
        edges = links(inside)
    else:
        large = members.where("blocks > 1")
        order = Window.partitionBy("key", "own").orderBy("rep")
        hubs = large.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= HUBS).select("key", "rep", "f1", F.lit(-1).alias("i"), F.lit(-1).alias("j"), lone)
        first = stored(links(inside.unionByName(hubs)), "links")
        label = stored(components(first).withColumnRenamed("node", "rep"), "labels")
        tagged = stored(large.join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "tagged")
        sizes = tagged.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.max("n").alias("n"), F.sum("n").alias("every"))
        mixed = sizes.where("n < every").select("key", "most", F.ceil((F.col("every") - F.col("n")) / block).cast("int").alias("odd_blocks"))
        rest = tagged.join(mixed, "key")
        # The odd ones have blocks numbered from `blocks` on; they meet all others and each other.
        odd = rest.where("component <> most").withColumn("own", F.col("blocks") + F.pmod(F.xxhash64(F.lit(10), "rep"), F.col("odd_blocks")).cast("int"))
        others_ = rest.where("component = most")
        against = F.explode(F.sequence(F.lit(0), F.col("blocks") + F.col("odd_blocks") - 1))
        side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side")
        ends = (F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        pairs = odd.withColumn("other", against).select("key", "rep", "f1", *ends, side)
        met = others_.withColumn("other", F.explode(F.sequence(F.col("blocks"), F.col("blocks") + F.col("odd_blocks") - 1))).select("key", "rep", "f1", *ends, side)
        edges = first.unionByName(links(pairs.unionByName(met)))
    # A doc_id with several sets is one node: link the classes that it belongs to.
    repeated = signed.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo <> hi").select("doc_id")
    split = signed.join(repeated, "doc_id").where("n_shingles > 0").join(classes.select("n_shingles", "f1", "f2", "rep"), ["n_shingles", "f1", "f2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(edges.unionByName(split))
    drop_stored(members, buckets)
    with_class = signed.drop("signature").join(classes.select("n_shingles", "f1", "f2", "rep"), ["n_shingles", "f1", "f2"], "left")
    joined = with_class.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "rep", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), *keep)


def drop_near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each group of near-duplicates: that with the smallest doc_id; columns stay as they are.

    Documents without words stay, and all rows without a doc_id. Rows with the same doc_id and text are one document,
    whose row with the least hash of all its columns stays. Rows with the same doc_id and other texts are one node,
    so they stay or go together.
    """
    names = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    keyed = docs.select(whole.alias("row"), F.col("doc_id").alias("d"), *row_key("doc_id", "text"))
    found = stored(near_duplicates(docs.select("doc_id", "text", *row_key("doc_id", "text")), words, num, den, keep=["rk1", "rk2"]), "near-rows")
    known = found.where("doc_id is not null").groupBy("rk1", "rk2").agg(F.count("*").alias("rows"), F.max(F.col("component_id") != F.col("doc_id")).alias("goes"))
    # Few rows go or are repeated; the others stay where they are.
    moved = stored(known.where("goes or rows > 1"), "near-moved")
    few = moved.count() <= BROADCAST_IDS
    moved = F.broadcast(moved) if few else moved
    single = keyed.where("d is not null").join(moved, ["rk1", "rk2"], "left_anti").select("row").unionByName(keyed.where("d is null").select("row"))
    again = keyed.where("d is not null").join(moved.where("not goes"), ["rk1", "rk2"])
    # The rest of a repeated row's columns decide, equal rows are interchangeable.
    order = Window.partitionBy("rk1", "rk2").orderBy("h")
    first = again.withColumn("h", F.xxhash64("row")).withColumn("rank", F.row_number().over(order)).where("rank = 1").select("row")
    return single.unionByName(first).select(*[F.col("row")[c].alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir, "doc_id", "text"), words=3, num=85)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = r"""
with recursive d as (
  select doc_id, row_number() over () as r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), sh as (
  select distinct r, array_to_string(list_slice(w, i, i + least(3, len(w)) - 1), ' ') as s
  from (select r, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) as i from d where len(w) > 0)
), n as (select r, count(*) as n from sh group by r),
classes as (select min(r) as c, any_value(n) as n, list(r) as members from (select r, count(*) as n, list(s order by s) as l from sh group by r) group by l),
csh as (select c, s from classes join sh on sh.r = classes.c),
pairs as (
  select a.c as x, b.c as y from csh a join csh b on a.s = b.s and a.c < b.c group by a.c, b.c
  having 100 * count(*) >= 85 * ((select n from classes where classes.c = a.c) + (select n from classes where classes.c = b.c) - count(*))
), links as (select x, y from pairs union all select y, x from pairs union all select c, c from classes),
reach as (select x, y from links union select reach.x, links.y from reach join links on reach.y = links.x),
of_row as (select unnest(members) as r, c from classes),
least_id as (select reach.x as c, min(doc_id) as component_id from reach join of_row on of_row.c = reach.y join d using (r) group by reach.x)
select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component_id, doc_id) as component_id, doc_id = coalesce(component_id, doc_id) as kept
from d left join n using (r) left join of_row using (r) left join least_id using (c)
"""
