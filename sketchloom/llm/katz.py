"""Scoring with a Katz backoff bigram model: Good-Turing discounts and exactly normalised backoff weights.

P(w | h) = d(c) * c(h, w) / c(h) for pairs seen in training, else alpha(h) * P(w); P(w) is the
Good-Turing discounted unigram, whose left-over mass belongs to unknown words. alpha(h) is the mass that
discounting leaves in h over the unigram mass of the words not seen after h. Counts over `CUTOFF` keep
`LARGE` of their mass (Katz would leave all of it, and contexts with frequent successors alone nothing for others).

Nothing of the model is held in one place, and every table grows with the corpus in rows of bounded size:

1. Tasks code a few megabytes of documents (a *chunk*): its vocabulary as sorted hashes, and its tokens as places in
   it. Chunks are stored.
2. A chunk sends each of its distinct (context, word) pairs once, with its count, to the partition of the word. All of a
   word's pairs meet there, which gives the counts of words and pairs. A partition stores its counts as sorted
   arrays, and answers each chunk with the counts of its pairs and words, in the order in which they came. Frequent words
   would make a partition large; those are counted beforehand and their pairs go to the partition of the context.
3. Counts of counts give the discounts. Partitions of contexts gather from the stored counts what discounting leaves and the
   unigram mass of the words seen, and store the backoff weights, a row for each context.
4. A chunk meets its answers and evaluates its tokens: the pair's discounted share if it was seen, else the word's. What
   backs off asks the stored weights of its context by a join, summed by document.

Between chunks and partitions go as many messages as any shuffle has blocks, and they are no larger in sum for more
partitions; `chunk_bytes` and `partition_bytes` may grow with the executors' memory.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sketchloom.llm import kernels as K
from sketchloom.llm.language_id import bucket
from sketchloom.llm.shared import BINARY, BOOL, DOUBLE, INT, LONG, documents, drop_stored, schema, stored

#: Good-Turing applies to counts up to this.
CUTOFF = 5
LARGE = 0.999
CHUNK_BYTES = 8 << 20
#: Bytes of text for each partition: a worker holds a partition's pairs as arrays.
PARTITION_BYTES = 16_000_000
#: Pairs in a row of stored counts.
COUNT_ROWS = 50_000
#: Of a row group of tables whose rows have megabytes.
GROUP_BYTES = 8 << 20
#: Words of this share of the tokens are dealt by context, or of half a partition's share where that is less.
HOT_SHARE = 0.004
#: The least share of such words, which bounds their number by twice its inverse.
LEAST_SHARE = 1e-6

END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
ANSWER, COUNTS, TOTALS = range(3)
_COUNTED = schema(kind=INT, uid=LONG, part=INT, data=BINARY, totals=ArrayType(LONG))


def _pack(**arrays) -> bytes:
    """Arrays as bytes, each plane of their values' bytes by itself, compressed."""
    planes = {k: (v.dtype.str, np.ascontiguousarray(v.view(np.uint8).reshape(-1, v.dtype.itemsize).T).tobytes()) for k, v in arrays.items()}
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes, 5))


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    planes = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    return {k: np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind) for k, (kind, raw) in planes.items()}


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _gaps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=np.uint64(0))


def _by_count(n: np.ndarray) -> np.ndarray:
    """Places of a vocabulary, the most frequent word's first: frequent words have short ranks, which compress."""
    return np.argsort(-n.astype(np.int64), kind="stable")


def _edges(n: int) -> np.ndarray:
    """Where the n parts of the hash range end, without the last."""
    return np.array([(k << 64) // n for k in range(1, n)], np.uint64)


def _within(ascending: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each x is among the values, and where."""
    if not len(ascending):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)
    return ascending[at] == x, at


class Discounts:
    """Of counts 1..CUTOFF, from counts of counts 1..CUTOFF + 1; `large` beyond."""

    def __init__(self, n: np.ndarray, large: float = LARGE):
        n = np.asarray(n, float)
        r = np.arange(1, CUTOFF + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            top = (CUTOFF + 1) * n[CUTOFF] / n[0]
            d = ((r + 1) * n[1:] / (r * n[:-1]) - top) / (1 - top)
            fine = np.isfinite(d) & (d > 0) & (d < 1)
        self.small = np.where(fine, d, (r - 0.5) / r)  # where counts of counts are too few or uneven for Good-Turing
        self.large = large

    def kept(self, count: np.ndarray) -> np.ndarray:
        """d(c) * c."""
        return np.concatenate(([0.0], self.small, [self.large]))[np.minimum(count, CUTOFF + 1)] * count


class Model:
    """What is known of the whole corpus: tokens, kinds, discounts."""

    def __init__(self, totals: np.ndarray):
        """totals: training tokens, distinct words, training documents, counts of counts of words, then of pairs."""
        self.tokens, self.kinds, self.documents = (int(x) for x in totals[:3])
        of_words = totals[3 : 3 + CUTOFF + 1]
        self.words = Discounts(of_words)
        self.pairs = Discounts(totals[3 + CUTOFF + 1 :])
        r = np.arange(1, CUTOFF + 1)
        small = (r * of_words[:CUTOFF]).sum()
        left = ((1 - self.words.small) * r * of_words[:CUTOFF]).sum() + (1 - self.words.large) * (self.tokens - small)
        self.unknown = left / self.tokens if self.tokens else 1.0

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """log10 P(w) of words with these counts; 0 is an unknown word."""
        return np.log10(np.where(count > 0, self.words.kept(count) / max(self.tokens, 1), self.unknown))

    def backoff(self, total: np.ndarray, pairs: np.ndarray, words: np.ndarray, large: np.ndarray) -> np.ndarray:
        """log10 alpha(h): from c(h), its pairs by count, and the words seen after h by their own counts, those of larger ones summed."""
        r = np.arange(1, CUTOFF + 1)
        left = pairs @ ((1 - self.pairs.small) * r) + (1 - self.pairs.large) * (total - pairs @ r)
        seen = (words @ (self.words.small * r) + self.words.large * large) / max(self.tokens, 1)
        return np.log10(left / total) - np.log10(1 - seen)


@dataclass
class Trained:
    """chunks: the coded documents; counted: counts by partition of words, and answers to chunks; weights: (context, weight)."""

    chunks: DataFrame
    counted: DataFrame
    weights: DataFrame
    model: Model
    place: Placing


class Placing:
    """Where pairs go. Built alike by what sends pairs and by what reads the answers."""

    def __init__(self, parts: int, hot: dict[int, int]):
        self.parts = parts
        self.edges = _edges(parts)
        self.hot = np.sort(np.array(list(hot), np.uint64))
        self.hot_counts = np.array([hot[int(k)] for k in self.hot], np.int64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, hashes, "right")


class Chunk:
    """A stored chunk, ready to send its pairs and to read the answers.

    entry: for each token its pair, in the order in which pairs are sent: by partition, those of hot words last.
    """

    def __init__(self, row: dict, place: Placing):
        a, words = _unpack(row["data"]), _unpack(row["words"])
        self.n = a["n"].astype(np.int64)
        self.held = np.unpackbits(a["held"], count=len(self.n)).astype(bool)
        self.vocabulary = np.cumsum(words["vocabulary"])
        self.code = _by_count(words["n"]).astype(np.int32)[a["rank"]]
        size = len(self.vocabulary)
        first = np.cumsum(self.n) - self.n
        self.context = np.empty(len(self.code), np.int32)
        self.context[1:] = self.code[:-1]
        self.context[first] = size
        hashes = np.append(self.vocabulary, START)
        pair, inverse = np.unique(self.code * np.int64(size + 1) + self.context, return_inverse=True)
        word, context = (pair // (size + 1)).astype(np.int32), (pair % (size + 1)).astype(np.int32)
        self.often, _ = _within(place.hot, self.vocabulary)
        by_context = self.often[word]
        part = place.of(np.where(by_context, hashes[context], hashes[word]))
        # Words ascend with their partitions already, so only pairs of hot words have to move.
        order = np.argsort(part * 2 + by_context, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.entry = rank[inverse.reshape(-1)]
        self.word, self.other, self.by_context, self.part = word[order], context[order], by_context[order], part[order]
        self.hashes = hashes

    def messages(self) -> Iterator[tuple[int, bytes]]:
        """For each partition the pairs of its words, and those of hot words whose context is its own."""
        training = np.bincount(self.entry, weights=np.repeat(~self.held, self.n), minlength=len(self.word)).astype(np.int64)
        cut = np.append(K.grouped_starts(self.part), len(self.part))
        for lo, hi in zip(cut[:-1], cut[1:]):
            some = slice(lo, hi)
            hot = self.by_context[some]
            word, context, n = self.hashes[self.word[some]], self.hashes[self.other[some]], _narrow(training[some])
            yield int(self.part[lo]), _pack(word=_gaps(word[~hot]), context=context[~hot], n=n[~hot], hot_word=word[hot], hot_context=context[hot], hot_n=n[hot])


def code_chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Stored chunks: uid, training tokens, vocabulary with training counts, and all that `Chunk` reads. docs: doc_id, held, text.

    A chunk ends with the text that fills it, so it is larger by at most a block or one text.
    """
    out = schema(uid=LONG, tokens=LONG, ids=ArrayType(LONG), words=BINARY, data=BINARY)

    def chunk(parts: list, uid: int) -> pa.RecordBatch:
        n = np.concatenate([np.diff(at) for _, at, _, _ in parts]) + 1
        held = np.concatenate([x for _, _, _, x in parts])
        token = np.full(n.sum(), END, np.uint64)
        inner = np.ones(len(token), bool)
        inner[np.cumsum(n) - 1] = False
        token[inner] = np.concatenate([h for h, _, _, _ in parts])
        vocabulary, code = np.unique(token, return_inverse=True)
        code = code.reshape(-1)
        counts = np.bincount(code, weights=np.repeat(~held, n), minlength=len(vocabulary)).astype(np.int64)
        ids = pa.concat_arrays([d for _, _, d, _ in parts])
        rank = np.empty(len(vocabulary), np.int64)
        rank[_by_count(counts)] = np.arange(len(vocabulary))
        words = _pack(vocabulary=_gaps(vocabulary), n=_narrow(counts))
        data = _pack(rank=_narrow(rank[code]), n=_narrow(n), held=np.packbits(held))
        columns = [pa.array([uid], pa.int64()), pa.array([counts.sum()], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([words], pa.binary()), pa.array([data], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, parts, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            data, off = K.utf8(batch.column("text"))
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in K.blocks(off):
                hashed, at = K.word_hashes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], K.SPACE)
                parts.append((hashed, at, batch.column("doc_id").slice(lo, hi - lo), held[lo:hi]))
                size += int(off[hi] - off[lo])
                if size >= chunk_bytes:
                    yield chunk(parts, task << 32 | done)
                    done, parts, size = done + 1, [], 0
        if parts:
            yield chunk(parts, task << 32 | done)

    return stored(docs.select("doc_id", "held", "text").mapInArrow(run, out), "katz-chunks", group_bytes=GROUP_BYTES)


def hot_words(chunks: DataFrame, share: float) -> dict[int, int]:
    """Counts in training of all words with at least this share of the tokens, of some others, and of ends.

    A word over the share has more than half of it in chunks where it has at least half the share, so what chunks
    report finds it; at most 2 / share words have that much.
    """

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column("words").to_pylist():
                a = _unpack(row)
                n = a["n"].astype(np.int64)
                some = n > max(0.0, n.sum() * share / 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(a["vocabulary"])[some].view(np.int64)), pa.array(n[some])], names=["word", "n"])

    tokens = chunks.agg(F.sum("tokens")).first()[0] or 0
    found = chunks.select("words").mapInArrow(frequent, schema(word=LONG, n=LONG)).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= tokens * share / 2)
    chosen = np.unique(np.append(np.array([r["word"] for r in found.select("word").collect()], np.int64).view(np.uint64), END))
    sent = chunks.sparkSession.sparkContext.broadcast(chosen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for row in batch.column("words").to_pylist():
                a = _unpack(row)
                there, at = _within(sent.value, np.cumsum(a["vocabulary"]))
                total += np.bincount(at[there], weights=a["n"][there], minlength=len(total)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sent.value.view(np.int64)), pa.array(total)], names=["word", "n"])

    counted = chunks.select("words").mapInArrow(count, schema(word=LONG, n=LONG)).groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {int(w): 0 for w in chosen} | {int(np.int64(r["word"]).view(np.uint64)): r["n"] for r in counted}


def count_pairs(chunks: DataFrame, place: Placing) -> DataFrame:
    """Stored: for each partition its counts and counts of counts, and for each chunk that sent it pairs an answer."""
    sent = chunks.sparkSession.sparkContext.broadcast(place)
    message = schema(part=INT, uid=LONG, data=BINARY)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for part, data in Chunk(row, sent.value).messages():
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([row["uid"]], pa.int64()), pa.array([data], pa.binary())], names=message.names)

    def rows(kind: int, part: int, uids: list, data: list, totals: list | None = None) -> pa.RecordBatch:
        n = len(data)
        columns = [pa.array([kind] * n, pa.int32()), pa.array(uids, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(data, pa.binary()), pa.array(totals or [None] * n, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=_COUNTED.names)

    def one(part: int, uids: np.ndarray, sent_data: list[bytes]) -> Iterator[pa.RecordBatch]:
        place = sent.value
        tokens, contexts, counts, sizes = [], [], [], []
        for data in sent_data:
            a = _unpack(data)
            tokens += [np.cumsum(a["word"]), a["hot_word"]]
            contexts += [a["context"], a["hot_context"]]
            counts += [a["n"].astype(np.int32), a["hot_n"].astype(np.int32)]
            sizes.append((len(a["word"]), len(a["hot_word"])))
        token, context, n = np.concatenate(tokens), np.concatenate(contexts), np.concatenate(counts)
        del tokens, contexts, counts
        order = np.lexsort((context, token))
        token, context = token[order], context[order]
        new_word = np.ones(len(token), bool)
        new_word[1:] = token[1:] != token[:-1]
        new_pair = new_word.copy()
        new_pair[1:] |= context[1:] != context[:-1]
        pair_of = np.empty(len(order), np.int32)
        pair_of[order] = np.cumsum(new_pair, dtype=np.int32) - 1
        pair_count = np.add.reduceat(n[order], np.flatnonzero(new_pair)).astype(np.int64)
        pair_context = context[new_pair]
        first = np.flatnonzero(new_word[new_pair])
        word = token[new_word]
        del order, token, context, n, new_word, new_pair
        word_count = np.add.reduceat(pair_count, first)
        often, at = _within(place.hot, word)
        own = word_count[~often]
        word_count[often] = place.hot_counts[at[often]]
        per_word = np.diff(np.append(first, len(pair_count)))
        totals = [own.sum(), (own > 0).sum(), 0, *((own == r).sum() for r in range(1, CUTOFF + 2)), *((pair_count == r).sum() for r in range(1, CUTOFF + 2))]
        yield rows(TOTALS, part, [0], [None], [[int(x) for x in totals]])
        word_of_pair = np.repeat(np.arange(len(word), dtype=np.int32), per_word)
        lo = 0
        for uid, (plain, hot) in zip(uids.tolist(), sizes):
            at = pair_of[lo : lo + plain + hot]
            lo += plain + hot
            words = word_of_pair[at[:plain]]
            yield rows(ANSWER, part, [uid], [_pack(pair=_narrow(pair_count[at]), word=_narrow(word_count[words[K.grouped_starts(words)]]))])
        seen = pair_count > 0
        of, context, n = word_of_pair[seen], pair_context[seen], pair_count[seen]
        for lo in range(0, len(of), COUNT_ROWS):
            some = slice(lo, lo + COUNT_ROWS)
            at = K.grouped_starts(of[some])
            here = of[some][at]
            yield rows(COUNTS, part, [0], [_pack(word=_gaps(word[here]), count=_narrow(word_count[here]), pairs=_narrow(np.diff(np.append(at, len(of[some])))), context=context[some], pair=_narrow(n[some]))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            part = table["part"].to_numpy()
            for p in np.unique(part).tolist():  # one, unless Spark was told to join partitions
                own = table.filter(pa.array(part == p))
                yield from one(p, own["uid"].to_numpy(), [d.as_buffer() for d in own["data"]])

    dealt = chunks.select("uid", "words", "data").mapInArrow(send, message).repartitionById(place.parts, F.col("part"))
    return stored(dealt.mapInArrow(count, _COUNTED), "katz-counts", group_bytes=GROUP_BYTES)


def weigh(counted: DataFrame, model: Model, place: Placing) -> DataFrame:
    """Stored backoff weights: (context, weight), log10 alpha of each context seen in training."""
    sent = counted.sparkSession.sparkContext.broadcast((model, place))
    message = schema(part=INT, data=BINARY)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value[1]
        for batch in batches:
            for row in batch.column("data").to_pylist():
                a = _unpack(row)
                word = np.repeat(a["count"].astype(np.int64), a["pairs"].astype(np.int64))
                order = np.argsort(a["context"], kind="stable")
                context, pair, word = a["context"][order], a["pair"][order].astype(np.int64), word[order]
                cut = np.concatenate(([0], np.searchsorted(context, place.edges), [len(context)]))
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    some = slice(cut[k], cut[k + 1])
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(**_statistics(context[some], pair[some], word[some]))], pa.binary())], names=message.names)

    def weight(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value[0]
        tables = [_unpack(d) for batch in batches for d in batch.column("data").to_pylist()]
        if tables:
            context, which = np.unique(np.concatenate([np.cumsum(t["context"]) for t in tables]), return_inverse=True)
            column = lambda name: np.bincount(which, weights=np.concatenate([t[name] for t in tables]), minlength=len(context))
            pairs, words = (np.stack([column(f"{x}{r}") for r in range(1, CUTOFF + 1)], 1) for x in "pw")
            found = model.backoff(column("total"), pairs, words, column("large"))
            for lo in range(0, len(context), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(context[lo : lo + 100_000].view(np.int64)), pa.array(found[lo : lo + 100_000])], names=["context", "weight"])

    dealt = counted.where(F.col("kind") == COUNTS).select("data").mapInArrow(gather, message).repartitionById(place.parts, F.col("part"))
    return stored(dealt.mapInArrow(weight, schema(context=LONG, weight=DOUBLE)), "katz-weights")


def _statistics(context: np.ndarray, pair: np.ndarray, word: np.ndarray) -> dict[str, np.ndarray]:
    """Of each context (ascending): its tokens, its pairs by count, the words after it by their counts, and the larger words' counts summed."""
    first = K.grouped_starts(context)
    added = lambda x: np.add.reduceat(x, first)
    out = {"context": _gaps(context[first]), "total": _narrow(added(pair)), "large": _narrow(added(np.where(word > CUTOFF, word, 0)))}
    for r in range(1, CUTOFF + 1):
        out[f"p{r}"] = _narrow(added((pair == r).astype(np.int64)))
        out[f"w{r}"] = _narrow(added((word == r).astype(np.int64)))
    return out


def train(docs: DataFrame, held: str, partition_bytes: int = PARTITION_BYTES, chunk_bytes: int = CHUNK_BYTES, hot_share: float = HOT_SHARE) -> Trained:
    sized = docs.select("doc_id", F.coalesce(held, F.lit(True)).alias("held"), "text")
    total_bytes = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total_bytes // partition_bytes))
    chunks = code_chunks(sized, chunk_bytes)
    hot = hot_words(chunks, max(LEAST_SHARE, min(hot_share, 0.5 / parts)))
    place = Placing(parts, hot)
    counted = count_pairs(chunks, place)
    totals = np.zeros(3 + 2 * (CUTOFF + 1), np.int64)
    for k, n in counted.where(F.col("kind") == TOTALS).select(F.posexplode("totals").alias("k", "n")).groupBy("k").agg(F.sum("n")).collect():
        totals[k] = n
    totals[0] += place.hot_counts.sum()
    totals[1] += (place.hot_counts > 0).sum()
    totals[2] = hot[int(END)]
    for r in range(CUTOFF + 1):
        totals[3 + r] += (place.hot_counts == r + 1).sum()
    model = Model(totals)
    return Trained(chunks, counted, weigh(counted, model, place), model, place)


def score(docs: DataFrame, held: str, partition_bytes: int = PARTITION_BYTES, chunk_bytes: int = CHUNK_BYTES, hot_share: float = HOT_SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of docs (doc_id, text and the boolean `held`).

    Rows with `held` teach nothing, nor do rows where it is null. A-Z are lower-cased; words are parted by white space, and one end
    follows each text, so null and empty texts are one token. Without training rows every token is unknown, and both scores
    are 0. Repeated rows count and are scored each; other columns, whatever their names, are left out. No rows give no rows.
    """
    t = train(docs, held, partition_bytes, chunk_bytes, hot_share)
    sent = docs.sparkSession.sparkContext.broadcast((t.model, t.place))
    out = schema(uid=LONG, doc=INT, doc_id=LONG, held_out=BOOL, n_tokens=LONG, n_known=LONG, base_score=DOUBLE, score=DOUBLE, context=LONG, n=LONG)

    def evaluate(row: dict, answers: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        m, place = sent.value
        c = Chunk(row, place)
        parts = [_unpack(d) for _, d in sorted(answers)]
        pair = np.concatenate([p["pair"] for p in parts]).astype(np.int64)[c.entry]
        count = np.empty(len(c.vocabulary) + 1, np.int64)
        count[:-1][~c.often] = np.concatenate([p["word"] for p in parts]).astype(np.int64)
        count[:-1][c.often] = place.hot_counts[np.searchsorted(place.hot, c.vocabulary[c.often])]
        count[-1] = m.documents
        lower = m.unigram(count[:-1])
        known = count[c.context]
        seen = pair > 0
        # The pair's share where it was seen, else the word's; the context's weight follows where the context was.
        with np.errstate(divide="ignore", invalid="ignore"):
            each = np.where(seen, np.log10(m.pairs.kept(pair)) - np.log10(known), lower[c.code])
        base = np.log10(count[:-1] + 0.1)[c.code] - math.log10(m.tokens + 0.1 * (m.kinds + 1))
        first = np.cumsum(c.n) - c.n
        added = lambda x: np.add.reduceat(x, first)
        size = len(c.n)
        fixed = {"uid": np.full(size, row["uid"]), "doc": np.arange(size, dtype=np.int32), "doc_id": row["ids"], "held_out": c.held, "n_tokens": c.n, "n_known": added((count[c.code] > 0).astype(np.int64)), "base_score": added(base), "score": added(each)}
        back = np.flatnonzero(~seen & (known > 0))
        doc = np.repeat(np.arange(size), c.n)[back]
        asked, n = np.unique(doc * len(count) + c.context[back], return_counts=True)
        more = {"uid": np.full(len(asked), row["uid"]), "doc": (asked // len(count)).astype(np.int32), "context": c.hashes[asked % len(count)].view(np.int64), "n": n}
        for columns, rows in ((fixed, size), (more, len(asked))):
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            arrays = [pa.array(columns[k], kind) if k in columns else pa.nulls(rows, kind) for k, kind in zip(out.names, kinds)]
            batch = pa.RecordBatch.from_arrays(arrays, names=out.names)
            for lo in range(0, rows, 50_000):
                yield batch.slice(lo, 50_000)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, dict] = {}
        answers: dict[int, list] = {}
        for batch in batches:  # a few chunks; their rows are compressed
            for row in batch.to_pylist():
                if row["part"] < 0:
                    chunks[row["uid"]] = row
                else:
                    answers.setdefault(row["uid"], []).append((row["part"], row["data"]))
        for uid in list(chunks):
            yield from evaluate(chunks.pop(uid), answers.pop(uid))

    own = t.chunks.select("uid", F.lit(-1).alias("part"), "data", "words", "ids")
    replies = t.counted.where(F.col("kind") == ANSWER).select("uid", "part", "data", F.lit(None).cast("binary").alias("words"), F.lit(None).cast("array<long>").alias("ids"))
    met = own.unionByName(replies).repartition(max(1, t.chunks.count()), "uid")
    scored = stored(met.mapInArrow(finish, out), "katz-scored")
    drop_stored(t.chunks, t.counted)
    asked = scored.where("context is not null").select("uid", "doc", "context", "n").join(t.weights, "context")
    extra = asked.groupBy("uid", "doc").agg(F.sum(F.col("n") * F.col("weight")).alias("extra"))
    done = scored.where("context is null").drop("context", "n").join(extra, ["uid", "doc"], "left")
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(t.model.tokens).cast("long").alias("train_tokens"), "base_score", (F.col("score") + F.coalesce("extra", F.lit(0.0))).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("held", bucket("doc_id", 10) == 0)
    return score(docs, "held")


SQL = None
