"""Language identification with interpolated Kneser-Ney character models.

Text becomes letters in lower case with one space between; a symbol has 16 bits, so a 4-gram is one
64-bit integer. For each language, order 4 uses counts, the lower orders the number of distinct symbols
before an n-gram, each with absolute discounting and interpolation down to a uniform distribution. The
n-grams of an order are stored as one sorted array of hashes with a row of values for each language, so
one binary search serves all languages.

The language with the least cross-entropy per symbol wins. On a part of the sample that no model was
trained on, each language's usual cross-entropy and the reliability of the margin to the runner-up are
measured: `score` is the calibrated probability that the choice is right, and `rejected` marks texts
that look like none of the languages.

Models are trained on about `SAMPLE` documents of each language, chosen by a hash of doc_id; their
n-grams are counted on the executors and their distinct n-grams come to the driver.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import kernels as K
from sketchloom.llm.byte_bpe import code_points
from sketchloom.llm.shared import BOOL, DOUBLE, LONG, STRING, documents, keeping, schema

ORDER = 4
#: Documents of each language that are used to train and calibrate, about.
SAMPLE = 1200
#: Share of the sample that only calibrates, in tenths.
CALIBRATION = 2
UNDETERMINED = "und"
#: Scored n-grams that a worker remembers.
REMEMBERED = 800_000
BLANK = 32


class Symbols:
    """Letters in lower case, all else blank; letters beyond 16 bits share one symbol."""

    def __init__(self):
        self.table = np.zeros(0x110000, np.uint16)
        self.table[:128] = BLANK
        self.table[65:91] = np.arange(97, 123)
        self.table[97:123] = np.arange(97, 123)

    def of(self, cp: np.ndarray) -> np.ndarray:
        s = self.table[cp]
        if not s.all():
            for c in np.unique(cp[s == 0]).tolist():
                low = chr(c).lower()
                letter = unicodedata.category(chr(c))[0] == "L"
                self.table[c] = (min(ord(low), 0xFFFF) if len(low) == 1 else min(c, 0xFFFF)) if letter else BLANK
            s = self.table[cp]
        return s


_symbols = Symbols()


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ORDER-grams that end at each symbol, where each text's begin, and each text's number of letters."""
    cp, at = code_points(data, off)
    s = _symbols.of(cp)
    start = np.zeros(len(s) + 1, bool)
    start[at] = True
    blank = s == BLANK
    before = np.ones(len(s), bool)
    before[1:] = blank[:-1]
    keep = ~(blank & (before | start[: len(s)]))
    kept = np.concatenate(([0], np.cumsum(keep)))[at]
    letters = np.concatenate(([0], np.cumsum(~blank)))[at]
    s = s[keep]
    n = np.diff(kept)
    # ORDER - 1 blanks stand before each text.
    where = np.arange(len(s)) + np.repeat((ORDER - 1) * np.arange(1, len(n) + 1), n)
    padded = np.full(len(s) + (ORDER - 1) * len(n), BLANK, np.uint64)
    padded[where] = s
    packed = np.zeros(len(s), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        packed = (packed << np.uint64(16)) | padded[where - back]
    return packed, kept, np.diff(letters)


def _suffix(packed: np.ndarray, n: int) -> np.ndarray:
    return packed & np.uint64((1 << 16 * n) - 1)


class Model:
    """Sorted hash arrays: for each order n-gram -> discounted share, and context -> weight of the lower order, by language."""

    def __init__(self, languages: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """counts: for each language distinct ORDER-grams and how often each was seen."""
        self.languages = languages
        self.grams, self.shares, self.contexts, self.weights = [], [], [], []
        symbols = {int(x) for g, _ in counts.values() for x in np.unique(_suffix(g, 1))}
        self.floor = 1.0 / (len(symbols) + 1)
        by_order: list[list] = [[] for _ in range(ORDER)]
        for name in languages:
            gram, count = counts[name]
            for n in range(ORDER, 0, -1):
                by_order[n - 1].append(self._discounted(gram, count))
                if n > 1:  # the lower order counts distinct symbols before each n-gram
                    gram, count = np.unique(_suffix(gram, n - 1), return_counts=True)
        for entries in by_order:
            self.grams.append(self._merged([(g, v) for g, v, _, _ in entries], 0.0))
            self.contexts.append(self._merged([(c, w) for _, _, c, w in entries], 1.0))

    @staticmethod
    def _discounted(gram: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        context, which = np.unique(gram >> np.uint64(16), return_inverse=True)
        total = np.bincount(which, weights=count)
        kinds = np.bincount(which)
        return gram, np.maximum(count - discount, 0) / total[which], context, np.minimum(discount, 1) * kinds / total

    def _merged(self, columns: list[tuple[np.ndarray, np.ndarray]], missing: float) -> tuple[np.ndarray, np.ndarray]:
        keys = [K.mix(k) for k, _ in columns]
        every = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        values = np.full((len(every) + 1, len(columns)), missing, np.float32)  # the last row is for what isn't there
        for k, (key, (_, value)) in enumerate(zip(keys, columns)):
            values[np.searchsorted(every, key), k] = value
        return every, values

    @staticmethod
    def _get(table: tuple[np.ndarray, np.ndarray], packed: np.ndarray) -> np.ndarray:
        keys, values = table
        if not len(keys):
            return np.broadcast_to(values[-1], (len(packed), values.shape[1]))
        hashed = K.mix(packed)
        at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
        return values[np.where(keys[at] == hashed, at, len(keys))]

    def log_probabilities(self, packed: np.ndarray) -> np.ndarray:
        """Natural logarithms, one column for each language, of the last symbol given those before it."""
        p = np.full((len(packed), len(self.languages)), self.floor)
        for n in range(1, ORDER + 1):
            own = _suffix(packed, n)
            p = self._get(self.grams[n - 1], own) + self._get(self.contexts[n - 1], own >> np.uint64(16)) * p
        return np.log(p)


class Scorer:
    """A model with the n-grams that a worker has scored."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.values = np.zeros((0, len(self.model.languages)), np.float32)

    def entropies(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per symbol for each language, symbols and letters of each text."""
        packed, at, letters = grams(data, off)
        codes, distinct = pd.factorize(packed)
        place = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.keys):
            new = self.keys[np.minimum(place, len(self.keys) - 1)] != distinct
        if new.any():
            if len(self.keys) > REMEMBERED:
                self._forget()
                new[:] = True
            keys = np.concatenate((self.keys, distinct[new]))
            values = np.concatenate((self.values, self.model.log_probabilities(distinct[new]).astype(np.float32)))
            by = np.argsort(keys)
            self.keys, self.values = keys[by], values[by]
            place = np.searchsorted(self.keys, distinct)
        n = np.diff(at)
        out = np.zeros((len(n), len(self.model.languages)))
        some = np.flatnonzero(n)
        for k in range(out.shape[1]):
            if len(some):
                out[some, k] = -np.add.reduceat(self.values[:, k][place].astype(float)[codes], at[:-1][some]) / n[some]
        return out, n, letters


class Calibration:
    """Each language's limit of cross-entropy, and the logistic curve from margin to probability."""

    def __init__(self, entropies: np.ndarray, symbols: np.ndarray, truth: np.ndarray):
        best = entropies.argmin(1) if entropies.shape[1] else np.zeros(len(truth), np.int64)
        self.limits = np.full(entropies.shape[1], np.inf)
        for k in range(entropies.shape[1]):
            own = entropies[(truth == k) & (best == k), k]
            if len(own) >= 20:
                self.limits[k] = np.median(own) + 6 * max(np.quantile(own, 0.84) - np.median(own), 0.02)
        x, y = self.evidence(entropies, symbols), (best == truth).astype(float)
        y = (y * (len(y) + 1) + 0.5) / (len(y) + 2) if len(y) else y  # never quite sure
        self.slope, self.offset = 1.0, 0.0
        for _ in range(30):  # Newton steps of a logistic regression with a weak prior at (1, 0)
            p = 1 / (1 + np.exp(-(self.slope * x + self.offset)))
            w = p * (1 - p)
            g = np.array([((p - y) * x).sum() + (self.slope - 1) * 0.1, (p - y).sum() + self.offset * 0.1])
            h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
            step = np.clip(np.linalg.solve(h, g), -1, 1)
            self.slope, self.offset = max(1e-3, self.slope - step[0]), self.offset - step[1]

    @staticmethod
    def evidence(entropies: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        if entropies.shape[1] < 2:
            return np.full(len(entropies), 3.0)
        two = np.partition(entropies, 1, axis=1)[:, :2]
        return np.log1p((two[:, 1] - two[:, 0]) * symbols)

    def probability(self, entropies: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.evidence(entropies, symbols) + self.offset)))


def bucket(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null is an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[Model, Calibration]:
    """docs: doc_id, text, lang. Rows with a null in text or lang teach nothing. Rows that share doc_id and lang are one document of the sample, with the least of their texts."""
    docs = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("lang") == k, min(1.0, sample / n)) for k, n in counts.items()], F.lit(0.0))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(10 << 16))
    picked = docs.where(draw < share * (10 << 16)).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    chosen = picked.withColumn("calibrates", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(12)), F.lit(10)) < CALIBRATION)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), object)
            data, off = K.utf8(batch.column("text"))
            for name in sorted(set(lang)):
                parts = [grams(data[off[k] : off[k + 1]], np.array([0, off[k + 1] - off[k]]))[0] for k in np.flatnonzero(lang == name)]
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    found = chosen.where("not calibrates").mapInArrow(count, schema(lang=STRING, gram=LONG, n=LONG)).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(found["lang"].to_pylist()))
    lang, gram, n = np.array(found["lang"].to_pylist(), object), found["gram"].to_numpy().view(np.uint64), found["n"].to_numpy()
    by_language = {}
    for name in languages:
        own = lang == name
        order = np.argsort(gram[own])
        by_language[name] = gram[own][order], n[own][order]
    model = Model(languages, by_language)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            h, symbols, letters = scorer.entropies(*K.utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(symbols), pa.array(letters), pa.array(h.tolist(), pa.list_(pa.float64()))], names=["lang", "symbols", "letters", "h"])

    from pyspark.sql.types import ArrayType

    rows = chosen.where("calibrates").mapInArrow(measure, schema(lang=STRING, symbols=LONG, letters=LONG, h=ArrayType(DOUBLE))).where("letters > 0").collect() if languages else []
    index = {name: k for k, name in enumerate(languages)}
    h = np.array([r["h"] for r in rows]).reshape(len(rows), len(languages))
    return model, Calibration(h, np.array([r["symbols"] for r in rows], float), np.array([index.get(r["lang"], -1) for r in rows], np.int64))


def identify(docs: DataFrame, model: Model, calibration: Calibration, keep: list[str]) -> DataFrame:
    """keep (long columns of docs), lang_pred, score, rejected, cross_entropy (nats per symbol).

    Only text is looked at. Null, empty and letterless texts are `und` with score 0, as is everything
    if no language was learned. Equal entropies choose the language first in order. Rows are taken one by one; kept
    columns that bear a name of the result's own in any case are left out. No rows give no rows.
    """
    docs, keep, back = keeping(docs, keep, ("lang_pred", "score", "rejected", "cross_entropy"), "text")
    sent = docs.sparkSession.sparkContext.broadcast((model, calibration))
    out = schema(**{k: LONG for k in keep}, lang_pred=STRING, score=DOUBLE, rejected=BOOL, cross_entropy=DOUBLE)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, calibration = sent.value
        scorer = Scorer(model)
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in batches:
            data, off = K.utf8(batch.column("text"))
            for lo, hi in K.blocks(off):
                columns = [batch.column(k).slice(lo, hi - lo) for k in keep]
                if model.languages:
                    h, symbols, letters = scorer.entropies(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    none = letters == 0
                    best = h.argmin(1)
                    least = h[np.arange(len(h)), best]
                    score = np.where(none, 0.0, calibration.probability(h, symbols))
                    rejected = none | (least > calibration.limits[best])
                    best = np.where(none, len(names) - 1, best)
                else:
                    best, score, least = np.zeros(hi - lo, np.int64), np.zeros(hi - lo), np.zeros(hi - lo)
                    rejected = np.ones(hi - lo, bool)
                columns += [pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected), pa.array(least)]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return back(docs.mapInArrow(choose, out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model, calibration = train(docs.where(bucket("doc_id", 5) != 0))
    found = identify(docs, model, calibration, ["doc_id"])
    return found.select("doc_id", (bucket("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


SQL = None
