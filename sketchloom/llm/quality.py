"""Ordinal quality classifier: a cumulative-link model over hashed text.

Grades are ordered: 0 toxic, 1 poor, 2 good. One weight vector over hashed features gives a
document's score s; ordered thresholds t1 < t2 give P(grade >= k) = logistic(s - tk), from which come
the expected grade and the tail probability P(grade = 2) that selection uses. Features are present
or absent: words (letters and digits, A-Z lower-cased), their beginnings, shapes of three characters
(case, digit, mark), and words that stand four times in a row.

It is fitted on at most `SAMPLE` labelled documents per grade, chosen by a hash of doc_id; the
features of those alone come to the driver. Scoring is one pass over all whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sketchloom.llm import kernels as K
from sketchloom.llm.shared import BINARY, BOOL, DOUBLE, INT, documents, schema

#: Bits of a feature's hash. Only features with a weight are held, so a wide hash costs nothing and collisions are rare.
BITS = 40
GRADES = 3
#: Labelled documents that the fit uses, about so many of each grade.
SAMPLE = 2500
#: Features in fewer documents of the sample get no weight.
LEAST_DOCS = 5
KEEP = 0.25
#: Most steps for one set of features, most sets, features that join a set at once, and the slope that counts as none.
STEPS, ROUNDS, MORE, TOLERANCE = 200, 30, 500, 1e-6
#: First bytes of a word that are features too.
PREFIXES = (4, 5, 6, 7, 8)

# Lower case, upper case, digit and beyond ASCII are one shape each; marks and white space stand for themselves.
SHAPE = np.arange(256, dtype=np.int64)
SHAPE[ord("a") : ord("z") + 1] = ord("a")
SHAPE[ord("A") : ord("Z") + 1] = ord("A")
SHAPE[ord("0") : ord("9") + 1] = ord("0")
SHAPE[128:] = 128


def _within(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def features(data: np.ndarray, off: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text, ascending, and where each text's begin. only: sorted features to keep."""

    def distinct(doc: np.ndarray, feature: np.ndarray) -> np.ndarray:
        if only is not None:
            use = _within(only, feature)
            doc, feature = doc[use], feature[use]
        keys = np.sort((doc << BITS) | feature)
        return keys[K.grouped_starts(keys)]

    mask = np.uint64((1 << BITS) - 1)
    lower = K.LOWER[data]
    starts, ends, at = K.words(lower, off, K.NOT_ALNUM)
    hashed = K.range_hashes(K.byte_values(lower), starts, ends)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
    parts = [distinct(doc, (hashed & mask).astype(np.int64))]
    stem = K.range_hash_sums(K.byte_values(lower))
    for size in PREFIXES:
        longer = np.flatnonzero(ends - starts > size)
        parts.append(distinct(doc[longer], (K.mix(stem(starts[longer], starts[longer] + size) + np.uint64(size)) & mask).astype(np.int64)))
    same = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
    again = np.flatnonzero(same[2:] & same[1:-1] & same[:-2])
    repeated = int(K.mix(np.array([1], np.uint64))[0] & mask)
    parts.append(distinct(doc[again], np.full(len(again), repeated)))
    if len(data) > 2:
        s = SHAPE[data]
        code = (s[:-2] << 16) | (s[1:-1] << 8) | s[2:]
        plain = (ord("a") << 16) | (ord("a") << 8) | ord("a")
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        inner = np.flatnonzero((code != plain) & ~edge[1:-2] & ~edge[2:-1])
        owner = np.searchsorted(off, inner, "right") - 1
        parts.append(distinct(owner, (K.mix(code[inner].astype(np.uint64)) & mask).astype(np.int64)))
    keys = np.sort(np.concatenate(parts))
    keys = keys[K.grouped_starts(keys)]
    return keys & int(mask), np.searchsorted(keys >> BITS, np.arange(len(off)))


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Model:
    def __init__(self, feature: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.feature, self.weights, self.thresholds = feature, weights, thresholds

    def at_least(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """P(grade >= k) of each text, a column for each k from 1."""
        feature, at = features(data, off, self.feature)
        total = np.concatenate(([0.0], np.cumsum(self.weights[np.searchsorted(self.feature, feature)])))
        return logistic((total[at[1:]] - total[at[:-1]])[:, None] - self.thresholds)


class Objective:
    """The penalised likelihood of the cumulative-link model, grades weighted alike, over weights and two numbers that make the thresholds.

    x: weights, all at most 0; the first threshold; the logarithm of the second's distance from it. With weights at most 0
    the L1 penalty is linear, so the objective is smooth where it is defined.
    """

    def __init__(self, doc: np.ndarray, column: np.ndarray, grade: np.ndarray, size: int, decay: float, sparse: float):
        self.doc, self.column, self.grade, self.size, self.decay, self.sparse = doc, column, grade, size, decay, sparse
        counts = np.bincount(grade, minlength=GRADES)
        self.each = (len(grade) / (np.count_nonzero(counts) * np.maximum(counts, 1)))[grade] / len(grade)

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """The value at x and its gradient."""
        grade, each, w = self.grade, self.each, x[:-2]
        t = np.array([-np.inf, x[-2], x[-2] + np.exp(x[-1]), np.inf])
        score = np.bincount(self.doc, weights=w[self.column], minlength=len(grade))
        low, high = logistic(score - t[grade]), logistic(score - t[grade + 1])
        p = np.maximum(low - high, 1e-12)
        value = -(each * np.log(p)).sum() + self.decay / 2 * (w @ w) - self.sparse * w.sum()
        by_score = -(1 - low - high) * each
        g = np.empty_like(x)
        g[:-2] = np.bincount(self.column, weights=by_score[self.doc], minlength=self.size) + self.decay * w - self.sparse
        by_low, by_high = low * (1 - low) / p * each, -high * (1 - high) / p * each
        first = by_low[grade == 1].sum() + by_high[grade == 0].sum()
        second = by_low[grade == 2].sum() + by_high[grade == 1].sum()
        g[-2], g[-1] = first + second, second * np.exp(x[-1])
        return float(value), g


def minimise(f: Objective, x: np.ndarray, steps: int, tolerance: float = TOLERANCE, memory: int = 8) -> np.ndarray:
    """Projected quasi-Newton: limited-memory BFGS over the weights that may move, halved steps back onto weights of at most 0."""
    bounded = np.ones(len(x), bool)
    bounded[-2:] = False
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        # A weight at 0 whose gradient is negative would have to rise, so it stays.
        free = ~bounded | (x < 0) | (g > 0)
        if np.abs(g[free]).max(initial=0) < tolerance:
            break
        d = np.where(free, g, 0.0)
        used = []
        for s, y in reversed(past):
            s, y = np.where(free, s, 0.0), np.where(free, y, 0.0)
            if (curve := s @ y) > 1e-14:
                a = (s @ d) / curve
                d -= a * y
                used.append((s, y, a, curve))
        if used:
            d *= used[0][3] / (used[0][1] @ used[0][1])
        else:
            d /= max(1.0, np.abs(d).sum())
        for s, y, a, curve in reversed(used):
            d += s * (a - (y @ d) / curve)
        d = np.where(free, d, 0.0)
        if g @ d <= 0:
            d, past = np.where(free, g, 0.0), []
        rate = 1.0
        while True:
            new = x - rate * d
            np.minimum(new[:-2], 0, out=new[:-2])
            after, slope = f(new)
            if after <= value - 1e-4 * (g @ (x - new)) or rate < 1e-10:
                break
            rate /= 2
        past = [*past, (new - x, slope - g)][-memory:]
        done = value - after < tolerance * 1e-3 * max(1.0, abs(value))
        x, value, g = new, after, slope
        if done:
            break
    return x


def fit(feature: np.ndarray, at: np.ndarray, grade: np.ndarray, steps: int = STEPS, decay: float = 1e-5, sparse: float = 1e-3) -> Model:
    """Maximum likelihood of the cumulative-link model, grades weighted alike, over the whole sample.

    Weights are at most 0: features speak against a document, never for it, so a short text with few
    features is as good as the thresholds say, and no amount of plain prose makes up for an insult. `sparse`
    and `decay` are the weights' L1 and L2 penalties. Few weights differ from 0, so the steps are over those features that
    would leave 0 at the solution for the others, until there are none: the solution is that over all features.
    """
    if not len(grade):
        return Model(feature[:0], np.zeros(0), np.array([-5.0, -3.35]))
    ordered = np.sort(feature)
    first = K.grouped_starts(ordered)
    active = ordered[first[np.diff(np.append(first, len(ordered))) >= LEAST_DOCS]]
    del ordered, first
    docs, columns = [], []
    for lo in range(0, len(grade), 500):  # a part of the documents at a time, as few features are frequent
        some = feature[at[lo] : at[min(lo + 500, len(grade))]]
        use = np.flatnonzero(_within(active, some))
        docs.append((np.searchsorted(at, use + at[lo], "right") - 1).astype(np.int32))
        columns.append(np.searchsorted(active, some[use]).astype(np.int32))
    doc, column = np.concatenate(docs), np.concatenate(columns)
    del docs, columns
    x = np.zeros(len(active) + 2)
    x[-2:] = -5.0, 0.5
    every, inside = Objective(doc, column, grade, len(active), decay, sparse), np.zeros(len(active), bool)
    for _ in range(ROUNDS):
        slope = np.where(inside, 0.0, every(x)[1][:-2])
        rising = np.flatnonzero(slope > TOLERANCE)
        if not len(rising) and inside.any():
            break
        inside[rising[np.argsort(-slope[rising], kind="stable")][:MORE]] = True
        some, places = inside[column], np.cumsum(inside, dtype=np.int32) - 1
        part = Objective(doc[some], places[column[some]], grade, int(inside.sum()), decay, sparse)
        x[np.append(inside, [True, True])] = minimise(part, x[np.append(inside, [True, True])], steps)
    held = x[:-2] < 0
    return Model(active[held], x[:-2][held], np.array([x[-2], x[-2] + np.exp(x[-1])]))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from quality and toxic; rows that lack one of the three columns are left out. Of several grades of a document the lowest counts."""
    grade = F.when(F.col("toxic") != 0, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on a hash sample of about `sample` graded documents of each grade, all where there are fewer.

    Rows that share a doc_id are one document of the sample, with the least of their texts.
    """
    counts = {r["grade"]: r["n"] for r in grades.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("grade") == g, min(1.0, sample / n)) for g, n in counts.items()]) if counts else F.lit(1.0)
    chosen = grades.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 20)) < share * (1 << 20)).select(F.col("doc_id").alias("d"), "grade")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.utf8(batch.column("text"))
            for lo, hi in K.blocks(off):
                feature, at = features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                blobs = [feature[at[k] : at[k + 1]].tobytes() for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column("grade").slice(lo, hi - lo), pa.array(blobs, pa.binary())], names=["grade", "f"])

    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("d")).groupBy("d", "grade").agg(F.min("text").alias("text"))
    rows = picked.select("grade", "text").mapInArrow(extract, schema(grade=INT, f=BINARY)).toArrow()
    at = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([f.as_buffer().size // 8 for f in rows["f"]], out=at[1:])
    grade = rows["grade"].to_numpy().astype(np.int64)
    feature = np.empty(at[-1], np.int64)
    for k, f in enumerate(rows["f"]):
        feature[at[k] : at[k + 1]] = np.frombuffer(f.as_buffer(), np.int64)
    del rows
    return fit(feature, at, grade)


def score(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """docs with expected_grade, p_not_toxic, tail_prob (grade 2) and kept (tail_prob >= keep) added.

    Null and empty texts have no features; they get what the thresholds alone say. Rows are scored
    one by one; columns of docs that bear one of the four names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    new = ["expected_grade", "p_not_toxic", "tail_prob", "kept"]
    whole = docs.drop(*new)
    out = T.StructType([*whole.schema.fields, *schema(**dict(zip(new, (DOUBLE, DOUBLE, DOUBLE, BOOL)))).fields])

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            data, off = K.utf8(batch.column("text"))
            for lo, hi in K.blocks(off):
                p = m.at_least(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                columns = [c.slice(lo, hi - lo) for c in batch.columns]
                columns += [pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 1] >= keep)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *new])

    return whole.mapInArrow(grade, out)


def trained(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> Model:
    docs = documents(spark, sf_dir, "doc_id", "text") if docs is None else docs
    return train(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = trained(spark, sf_dir)
    return score(documents(spark, sf_dir, "doc_id", "text"), model).drop("text")


SQL = None
