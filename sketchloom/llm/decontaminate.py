"""Benchmark decontamination by a distributed positional inverted index.

`build_index` turns every few megabytes of documents into one stored row, a *shard*: the terms
that occur, and for each its posting list of word positions. Positions run on over the shard's
documents with a gap between two, so no phrase crosses from one into the next. `search` reads the
shards, not the texts. For each window of test words it starts from the window's rarest term in
that shard, shifts the posting list by the term's offset, and intersects with the lists of the
next rarest terms; a term without postings ends its windows at once. What is left after all terms
are exact occurrences. The same lists give proximity matches: all of an item's terms
close together in any order.

The index is split by documents, so no posting list of a frequent word meets in one task, and
nothing is shuffled at all. Test items are taken in blocks of about `BLOCK_CHARS` characters;
one block at a time is sent to all tasks, and each shard's hits are carried from block to block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sketchloom.llm import kernels as K
from sketchloom.llm.shared import BINARY, LONG, STRING, documents, keeping, row_key, schema, stored

#: Words of a window; an item of fewer words is one window.
WINDOW = 8
#: Words that a stretch with all of an item's terms may have more than the item.
SLOP = 8
#: Characters of test items in a block.
BLOCK_CHARS = 16_000_000
#: Bytes of documents in a shard.
SHARD_BYTES = 2 << 20
#: Of a row group of stored shards, whose rows have megabytes.
GROUP_BYTES = 8 << 20
#: Up to so many keys of 16 bytes are broadcast.
BROADCAST_KEYS = 200_000


class Windows:
    """Windows of a block of items: `terms` are indices into the sorted `vocabulary`, -1 behind a short item's end."""

    def __init__(self, items: list[tuple[int, str | None]], width: int = WINDOW):
        data, off = K.utf8(pa.array([t for _, t in items], pa.string()))
        hashed, at = K.word_hashes(data, off, K.NOT_ALNUM)
        self.vocabulary, coded = np.unique(hashed, return_inverse=True)
        rows, owner = [], []
        for k, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
            n = hi - lo
            if n:
                starts = np.arange(max(1, n - width + 1))
                w = np.full((len(starts), width), -1, np.int64)
                size = min(width, n)
                w[:, :size] = coded[lo + starts[:, None] + np.arange(size)]
                rows.append(w)
                owner += [k] * len(starts)
        self.terms = np.concatenate(rows) if rows else np.zeros((0, width), np.int64)
        self.owner = np.array(owner, np.int64)
        self.size = (self.terms >= 0).sum(1)
        self.ids = [i for i, _ in items]
        # Equal windows are looked up once.
        self.distinct, self.which = np.unique(self.terms, axis=0, return_inverse=True) if len(self.terms) else (self.terms, self.owner)
        self.which = self.which.reshape(-1)
        self.words = np.diff(at)
        owned = np.unique(np.repeat(np.arange(len(self.ids)), self.words) * max(len(self.vocabulary), 1) + coded.reshape(-1))
        self.owned = owned % max(len(self.vocabulary), 1)
        self.owned_at = np.searchsorted(owned // max(len(self.vocabulary), 1), np.arange(len(self.ids) + 1))

    def item_terms(self, k: int) -> np.ndarray:
        """The distinct terms of an item."""
        return self.owned[self.owned_at[k] : self.owned_at[k + 1]]

    def rare(self, counts: np.ndarray) -> np.ndarray:
        """Which items have words, all of which have postings."""
        missing = np.concatenate(([0], np.cumsum(counts[self.owned] == 0)))
        return (self.words > 0) & (missing[self.owned_at[1:]] == missing[self.owned_at[:-1]])


def build_index(docs: DataFrame, keep: list[str], vocabulary: np.ndarray | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shards of the documents' words, stored. keep: long columns that go with each document.

    vocabulary: sorted hashes of the terms whose postings are kept, to prune an index that serves one set of items;
    None keeps all. Null and empty texts have no words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    out = schema(**{k: ArrayType(LONG) for k in keep}, n_words=BINARY, base=BINARY, terms=BINARY, offsets=BINARY, positions=BINARY)

    def shard(parts: list[tuple[list, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """parts: kept columns, word hashes and where each document's begin."""
        vocab = sent.value
        n_words = np.concatenate([np.diff(at) for _, _, at in parts])
        base = np.zeros(len(n_words) + 1, np.int64)
        np.cumsum(n_words + 1, out=base[1:])
        hashed = np.concatenate([h for _, h, _ in parts])
        position = np.arange(len(hashed)) + np.repeat(np.arange(len(n_words)), n_words)
        if vocab is None:
            terms, code = np.unique(hashed, return_inverse=True)
        else:
            code = np.searchsorted(vocab, hashed)
            known = vocab[np.minimum(code, len(vocab) - 1)] == hashed if len(vocab) else np.zeros(len(hashed), bool)
            code, position, terms = code[known], position[known], vocab
        order = np.argsort(code.astype(np.uint16) if len(terms) < 1 << 16 else code, kind="stable")
        counts = np.bincount(code, minlength=len(terms))
        there = counts > 0
        offsets = np.concatenate(([0], np.cumsum(counts[there])))
        columns = [pa.array([sum((p[0][k].to_pylist() for p in parts), [])], pa.list_(pa.int64())) for k in range(len(keep))]
        blobs = (n_words.astype(np.int32), base.astype(np.int64), terms[there].astype(np.uint64), offsets.astype(np.int64), position[order].astype(np.int32))
        return pa.RecordBatch.from_arrays(columns + [pa.array([b.tobytes()], pa.binary()) for b in blobs], names=out.names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            data, off = K.utf8(batch.column("text"))
            for lo, hi in K.blocks(off):
                d = data[off[lo] : off[hi]]
                hashed, at = K.word_hashes(d, off[lo : hi + 1] - off[lo], K.NOT_ALNUM)
                parts.append(([batch.column(k).slice(lo, hi - lo) for k in keep], hashed, at))
                size += len(d)
                if size >= shard_bytes:
                    yield shard(parts)
                    parts, size = [], 0
        if parts:
            yield shard(parts)

    return stored(docs.select(*keep, "text").mapInArrow(build, out), "shards", group_bytes=GROUP_BYTES)


class Shard:
    """A stored row's posting lists, made ready for look-ups in a block of windows."""

    def __init__(self, row: dict, vocabulary: np.ndarray):
        self.n_words = np.frombuffer(row["n_words"], np.int32)
        self.base = np.frombuffer(row["base"], np.int64)
        terms, offsets, positions = (np.frombuffer(row[k], t) for k, t in (("terms", np.uint64), ("offsets", np.int64), ("positions", np.int32)))
        self.length = int(self.base[-1])
        code = np.searchsorted(vocabulary, terms)
        known = np.flatnonzero(vocabulary[np.minimum(code, len(vocabulary) - 1)] == terms) if len(vocabulary) else np.zeros(0, np.int64)
        counts = np.diff(offsets)[known]
        self.code, self.counts = code[known], np.zeros(len(vocabulary), np.int64)
        self.counts[self.code] = counts
        take = np.repeat(offsets[known] - np.concatenate(([0], np.cumsum(counts)[:-1])) if len(known) else offsets[:0], counts) + np.arange(counts.sum())
        self.positions = positions[take].astype(np.int64)
        self.begin = np.zeros(len(vocabulary) + 1, np.int64)
        np.cumsum(self.counts, out=self.begin[1:])
        #: (term, position), ascending: one search tells if a term stands at a position.
        self.keys = np.repeat(np.arange(len(vocabulary)), self.counts) * (self.length + 1) + self.positions

    def stands(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(term), bool)
        key = term * (self.length + 1) + position
        at = np.searchsorted(self.keys, key)
        return (position >= 0) & (position <= self.length) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key)

    def occurrences(self, terms: np.ndarray, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Windows and the positions at which they begin: offset-adjusted lists, intersected from the rarest term on."""
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        present = terms >= 0
        lengths = np.where(present, self.counts[np.maximum(terms, 0)], np.iinfo(np.int64).max)
        order = np.argsort(lengths, axis=1, kind="stable")
        alive = np.flatnonzero(lengths.min(1) > 0)
        found_w, found_p = [], []
        rarest = lengths[alive, order[alive, 0]]
        ends = np.cumsum(rarest)
        lo = 0
        while lo < len(alive):  # as many windows at a time as have about `chunk` first postings
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + chunk, "right")))
            some, n = alive[lo:hi], rarest[lo:hi]
            w = np.repeat(some, n)
            first = order[some, 0]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            p = self.positions[np.repeat(self.begin[terms[some, first]], n) + inner] - np.repeat(first, n)
            for k in range(1, terms.shape[1]):
                offset = order[w, k]
                term = terms[w, offset]
                ok = (term < 0) | self.stands(np.maximum(term, 0), p + offset)
                w, p = w[ok], p[ok]
            found_w.append(w)
            found_p.append(p)
            lo = hi
        return np.concatenate(found_w) if found_w else np.zeros(0, np.int64), np.concatenate(found_p) if found_p else np.zeros(0, np.int64)

    def near(self, terms: np.ndarray, stretch: int) -> np.ndarray:
        """Documents in which all the terms stand within `stretch` consecutive words, in any order."""
        terms = terms[np.argsort(self.counts[terms], kind="stable")]
        lists = [self.positions[self.begin[t] : self.begin[t + 1]] for t in terms]
        p = lists[0]
        lo = self.base[np.searchsorted(self.base, p, "right") - 1]
        hi = self.base[np.searchsorted(self.base, p, "right")] - 1
        lo, hi = np.maximum(lo, p - stretch + 1), np.minimum(hi, p + stretch)
        for other in lists[1:]:  # from the rarest term on, spots that lack another term near by go
            ok = np.searchsorted(other, lo) < np.searchsorted(other, hi)
            p, lo, hi = p[ok], lo[ok], hi[ok]
            if not len(p):
                return p
        found = []
        for a, b in zip(lo.tolist(), hi.tolist()):
            around = [x[np.searchsorted(x, a) : np.searchsorted(x, b)] for x in lists]
            ends = np.unique(np.concatenate(around))
            # The least of the terms' last positions up to an end tells if a stretch that ends there holds all.
            last = np.min([np.where((at := np.searchsorted(x, ends, "right")) > 0, x[np.maximum(at - 1, 0)], -1) for x in around], axis=0)
            if (last > ends - stretch).any() and (last[last > ends - stretch] >= a).any():
                found.append(a)
        return np.unique(np.searchsorted(self.base, np.array(found, np.int64), "right") - 1)


def _real(items: DataFrame) -> DataFrame:
    return items.where("item_id is not null and text is not null").select("item_id", "text")


def block_count(items: DataFrame, block_chars: int = BLOCK_CHARS) -> int:
    total = _real(items).agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, -(-total // block_chars))


def item_blocks(items: DataFrame, n: int) -> Iterator[list[tuple[int, str]]]:
    """Items in n blocks, one at a time; rows without an id or a text are none."""
    for k in range(n):
        part = _real(items) if n == 1 else _real(items).where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield [tuple(r) for r in part.collect()]


def search(docs: DataFrame, items: DataFrame, keep: list[str], slop: int | None = SLOP, block_chars: int = BLOCK_CHARS, shards: DataFrame | None = None) -> DataFrame:
    """One row for each document: kept columns, n_words, n_hit, item_ids (found, sorted as strings), near_ids.

    Items without words are found nowhere. Items that share an id are one item. near_ids are the items all of whose
    distinct terms stand within as many consecutive words as the item has, and `slop` more, in any order; None looks for
    none. No items or no documents give no hits or no rows. Repeated rows get a row each. Kept columns that bear a name
    of the result's own in any case are left out. shards: an index that build_index made of these docs with these kept
    columns, to search it again; else one of all terms is built.
    """
    spark = docs.sparkSession
    docs, keep, back = keeping(docs, keep, ("n_words", "n_hit", "item_ids", "near_ids"), "text")
    shards = build_index(docs, keep) if shards is None else shards.withColumnsRenamed(dict(zip(shards.columns, keep)))
    carried = {"hit": BINARY, "doc": BINARY, "item": BINARY, "near_doc": BINARY, "near_item": BINARY}
    state = schema(**{k: ArrayType(LONG) for k in keep}, n_words=BINARY, base=BINARY, terms=BINARY, offsets=BINARY, positions=BINARY, **carried)

    def step(windows, first: bool, last: bool):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            win = windows.value
            for batch in batches:
                for number in range(batch.num_rows):
                    row = batch.slice(number, 1).to_pylist()[0]
                    s = Shard(row, win.vocabulary)
                    w, p = s.occurrences(win.distinct)
                    marks = np.zeros(s.length + 1, np.int32)
                    size = (win.distinct[w] >= 0).sum(1)
                    np.add.at(marks, p, 1)
                    np.add.at(marks, p + size, -1)
                    hit = np.cumsum(marks)[: s.length] > 0
                    # Windows that several items share go to each of them.
                    by = np.argsort(win.which, kind="stable")
                    at = np.searchsorted(win.which[by], np.arange(len(win.distinct) + 1))
                    n = at[w + 1] - at[w]
                    owner = win.owner[by[np.repeat(at[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]]
                    doc = np.repeat(np.searchsorted(s.base, p, "right") - 1, n)
                    ids = np.array(win.ids, np.int64)
                    near_doc, near_item = [], []
                    for k in np.flatnonzero(win.rare(s.counts)).tolist() if slop is not None else ():
                        d = s.near(win.item_terms(k), int(win.words[k]) + slop)
                        near_doc += d.tolist()
                        near_item += [win.ids[k]] * len(d)
                    found = {"doc": doc, "item": ids[owner] if len(owner) else owner, "near_doc": np.array(near_doc, np.int64), "near_item": np.array(near_item, np.int64)}
                    if not first:
                        hit = hit | np.frombuffer(row["hit"], bool)
                        found = {k: np.concatenate((np.frombuffer(row[k], np.int64), v)) for k, v in found.items()}
                    if last:
                        yield answers(row, s, hit, found)
                    else:
                        done = row | {"hit": hit.tobytes()} | {k: v.astype(np.int64).tobytes() for k, v in found.items()}
                        yield pa.RecordBatch.from_pylist([done], schema=pa.schema([(f, pa.list_(pa.int64()) if f in keep else pa.binary()) for f in state.names]))

        return find

    result = schema(**{k: LONG for k in keep}, n_words=LONG, n_hit=LONG, item_ids=ArrayType(STRING), near_ids=ArrayType(STRING))

    def answers(row: dict, s: Shard, hit: np.ndarray, found: dict) -> pa.RecordBatch:
        total = np.concatenate(([0], np.cumsum(hit)))
        n = len(s.n_words)
        lists = {}
        for doc, item in (("doc", "item"), ("near_doc", "near_item")):
            of: list[set] = [set() for _ in range(n)]
            for d, i in zip(found[doc].tolist(), found[item].tolist()):
                of[d].add(str(i))
            lists[doc] = [sorted(x) for x in of]
        columns = [pa.array(row[k], pa.int64()) for k in keep]
        columns += [pa.array(s.n_words.astype(np.int64)), pa.array((total[s.base[1:]] - total[s.base[:-1]]).astype(np.int64))]
        columns += [pa.array(lists[k], pa.list_(pa.string())) for k in ("doc", "near_doc")]
        return pa.RecordBatch.from_arrays(columns, names=result.names)

    n_blocks = block_count(items, block_chars)
    for k, block in enumerate(item_blocks(items, n_blocks)):
        last = k == n_blocks - 1
        sent = spark.sparkContext.broadcast(Windows(block))
        found = shards.mapInArrow(step(sent, k == 0, last), result if last else state)
        if last:
            return back(found)
        # One block's windows are held at a time; what was found goes on in the stored shards.
        shards = stored(found, "shards", group_bytes=GROUP_BYTES)
        sent.unpersist()
    raise AssertionError("there is always a block")


def drop_contaminated(docs: DataFrame, items: DataFrame, min_items: int = 1) -> DataFrame:
    """docs without those in which windows of at least min_items items occur; all columns stay as they are.

    Rows that share doc_id and text stay or go together. Null texts and wordless ones stay.
    """
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *row_key("doc_id", "text"))
    found = search(docs.select(*row_key("doc_id", "text"), "text"), items, ["rk1", "rk2"], slop=None)
    bad = stored(found.where(F.size("item_ids") >= min_items).select("rk1", "rk2").distinct(), "contaminated")
    small = bad.count() <= BROADCAST_KEYS
    return keyed.join(F.broadcast(bad) if small else bad, ["rk1", "rk2"], "left_anti").select(*[F.col("row")[c].alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = search(documents(spark, sf_dir, "doc_id", "text"), items, ["doc_id"])
    n = F.size("item_ids").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"), F.array_join("near_ids", ",").alias("near_ids"))


SQL = r"""
with d as (
  select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null
), win as (
  select item_id, least(8, len(w)) as n, array_to_string(list_slice(w, i, i + least(8, len(w)) - 1), ' ') as k
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) as i from b where len(w) > 0)
), sizes as (select distinct n from win),
pos as (
  select r, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') as k
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)
), hits as (select r, p, n, item_id from pos join win using (n, k)),
hit_words as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + n)) as q from hits) group by r),
found as (select r, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct r, item_id::varchar as i from hits) group by r),
dw as (select r, p, w[p] as t from (select r, w, unnest(range(1, len(w) + 1)) as p from d)),
bt as (select item_no, any_value(item_id) as item_id, any_value(n) as n, t from (select item_no, item_id, n, unnest(w) as t from (select row_number() over () as item_no, item_id, len(w) as n, w from b)) group by item_no, t),
used as (select * from dw where t in (select t from bt)),
freq as (select r, t, count(*) as c from used group by r, t),
cover as (select item_no, r, count(*) as k from bt join freq using (t) group by item_no, r),
full_items as (select item_no, r from cover join (select item_no, count(*) as k from bt group by item_no) using (item_no, k)),
spots as (select f.item_no, f.r, x.t, x.p, bt.n from full_items f join bt using (item_no) join used x on x.r = f.r and x.t = bt.t),
together as (
  select a.item_no, a.r from spots a join spots o on o.item_no = a.item_no and o.r = a.r and o.p between a.p - a.n - {SLOP} + 1 and a.p
  group by a.item_no, a.r, a.p having count(distinct o.t) = (select count(*) from bt where bt.item_no = a.item_no)
),
near as (select r, string_agg(i, ',' order by i) as ids from (select distinct r, item_id::varchar as i from together join bt using (item_no)) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(found.ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated, coalesce(near.ids, '') as near_ids
from d left join hit_words using (r) left join found using (r) left join near using (r)
""".replace("{SLOP}", str(SLOP))
