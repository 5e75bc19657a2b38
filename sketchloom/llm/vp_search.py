"""Nearest neighbours by vantage-point trees, one per shard.

A hash of vec_id deals the vectors to shards of about `SHARD_VECTORS`; each shard's tree is built in
one task and stored. A node holds a vantage point and, for each half of its points, the least and
greatest distance from it. A search skips a half when the triangle inequality says that all its points
are further than the k-th neighbour so far: bound * factor > radius. With factor 1 that is exact; a
larger factor skips more. Distances are sums of squared differences in double precision, added in the
order of the components, so equal vectors have equal scores.

Queries are packed into blocks of `QUERY_BLOCK` on the executors; a block, whose size is fixed, is sent to all
shards and answered before the next. Each shard answers with its k best for each query, and those are merged. Equal
vectors of a shard are one point that carries its k + 1 smallest ids: no more can be among k neighbours, so that loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sketchloom.llm.shared import BINARY, DOUBLE, INT, LONG, schema, stored

SHARD_VECTORS = 20_000
QUERY_BLOCK = 20_000
LEAF = 512
#: Queries that walk a tree together.
QUERY_PART = 4000


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances, one row for each query; squares are added in the order of the components."""
    total = np.zeros((len(queries), len(points)))
    for d in range(points.shape[1]):
        gap = queries[:, d, None] - points[None, :, d]
        total += gap * gap
    return np.sqrt(total)


class Tree:
    """Arrays of a vantage-point tree. children is -1 at leaves; points of a node are a range of rows."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, id_at: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        rng = np.random.default_rng(len(points))
        nodes: list[list] = []  # lo, hi, vantage, left, right, least and greatest distance of either half
        pending = [(0, len(points), -1, 0)]
        while pending:
            lo, hi, parent, side = pending.pop()
            me = len(nodes)
            if parent >= 0:
                nodes[parent][3 + side] = me
            nodes.append([lo, hi, -1, -1, -1, 0.0, 0.0, 0.0, 0.0])
            if hi - lo <= leaf:
                continue
            own = order[lo:hi]
            vantage = int(own[rng.integers(hi - lo)])
            d = distances(points[vantage][None], points[own])[0]
            by = np.argsort(d, kind="stable")
            order[lo:hi] = own[by]
            d, half = d[by], (hi - lo) // 2
            nodes[me][2] = vantage
            nodes[me][5:] = d[0], d[half - 1], d[half], d[-1]
            pending += [(lo, lo + half, me, 0), (lo + half, hi, me, 1)]
        table = np.array(nodes, float).reshape(-1, 9)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.nodes, self.bounds = table[:, :5].astype(np.int64), table[:, 5:]
        self.nodes[self.nodes[:, 2] >= 0, 2] = place[self.nodes[self.nodes[:, 2] >= 0, 2]]
        self.points = points[order]
        n = np.diff(id_at)[order]
        ends = np.cumsum(n)
        self.ids = ids[np.repeat(id_at[:-1][order] - (ends - n), n) + np.arange(len(ids))] if len(ids) else ids
        self.id_at = np.concatenate(([0], ends)).astype(np.int64)

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray, same: int, leaf: int = LEAF) -> Tree:
        """same: how many ids a point may carry, the smallest of those with equal vectors."""
        by = np.lexsort((ids, *vectors.T[::-1]))
        vectors, ids = vectors[by], ids[by]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(1)
        first = np.flatnonzero(new)
        rank = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
        keep = rank < same
        return cls(vectors[first].astype(float), ids[keep], np.append(np.flatnonzero(new[keep]), keep.sum()).astype(np.int64), leaf)

    def pack(self) -> list[bytes]:
        return [a.tobytes() for a in (self.nodes, self.bounds, self.points, self.ids, self.id_at)]

    @classmethod
    def unpack(cls, nodes: bytes, bounds: bytes, points: bytes, ids: bytes, id_at: bytes, dims: int) -> Tree:
        self = cls.__new__(cls)
        self.nodes, self.bounds = np.frombuffer(nodes, np.int64).reshape(-1, 5), np.frombuffer(bounds).reshape(-1, 4)
        self.points, self.ids, self.id_at = np.frombuffer(points).reshape(-1, dims), np.frombuffer(ids, np.int64), np.frombuffer(id_at, np.int64)
        return self

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest, nearest first and ties to the smaller id; inf and -1 fill up. own: ids to leave out."""
        best = np.full((len(queries), k), np.inf)
        found = np.full((len(queries), k), -1, np.int64)
        pending = [(0, np.arange(len(queries)), np.zeros(len(queries)))] if len(self.points) and len(queries) else []
        while pending:
            node, active, bound = pending.pop()
            use = bound * factor <= best[active, -1]
            active = active[use]
            if not len(active):
                continue
            lo, hi, vantage, *children = self.nodes[node]
            if vantage < 0:
                self._offer(active, queries, own, int(lo), int(hi), best, found)
                continue
            d = distances(queries[active], self.points[vantage][None])[:, 0]
            b = self.bounds[node]
            gaps = [np.maximum(0, np.maximum(b[2 * side] - d, d - b[2 * side + 1])) for side in (0, 1)]
            gaps = [np.maximum(g, bound[use]) for g in gaps]
            near_left = gaps[0] - gaps[1] < 0
            near_left |= (gaps[0] == gaps[1]) & (d <= (b[1] + b[2]) / 2)
            # Nearer half first: what is pushed last is taken first.
            for some, sides in ((near_left, (1, 0)), (~near_left, (0, 1))):
                pending += [(children[side], active[some], gaps[side][some]) for side in sides]
        return best, found

    def _offer(self, active: np.ndarray, queries: np.ndarray, own: np.ndarray, lo: int, hi: int, best: np.ndarray, found: np.ndarray) -> None:
        """Compare a leaf. A matrix product gives distances up to a known error; only pairs that may be among the k best are summed exactly."""
        k, points = best.shape[1], self.points[lo:hi]
        length = (points * points).sum(1)
        for part in np.array_split(active, max(1, len(active) * (hi - lo) // 2_000_000)):
            q = queries[part]
            size = (q * q).sum(1)
            near = size[:, None] + length[None] - 2 * (q @ points.T)
            error = 1e-11 * (size + length.max())
            limit = best[part, -1] ** 2 * (1 + 1e-12) + error
            if hi - lo > k + 1:  # one may be the query itself
                limit = np.minimum(limit, np.partition(near, k, axis=1)[:, k] + 2 * error)
            row, column = np.nonzero(near <= limit[:, None])
            if not len(row):
                continue
            total = np.zeros(len(row))
            for d in range(points.shape[1]):
                gap = q[row, d] - points[column, d]
                total += gap * gap
            n = np.diff(self.id_at[lo : hi + 1])[column]
            ids = self.ids[np.repeat(self.id_at[lo:hi][column] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            row, score = np.repeat(row, n), np.repeat(np.sqrt(total), n)
            other = ids != own[part][row]
            touched, row = np.unique(row[other], return_inverse=True)
            some = part[touched]
            row = np.concatenate((np.repeat(np.arange(len(some)), k), row))
            score = np.concatenate((best[some].reshape(-1), score[other]))
            ids = np.concatenate((found[some].reshape(-1), ids[other]))
            by = np.lexsort((ids, score, row))
            first = np.searchsorted(row[by], np.arange(len(some)))
            take = by[first[:, None] + np.arange(k)]
            best[some] = score[take]
            found[some] = np.where(np.isinf(score[take]), -1, ids[take])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of vectors that take part: not null, not zero, all components finite. Equal rows count once."""
    e = F.col("embedding")
    big = F.lit(float("inf"))
    fine = vectors.where("vec_id is not null and embedding is not null").where(
        F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(e, lambda x: x != 0)
    )
    return fine.select("vec_id", "embedding").distinct()


def build_index(vectors: DataFrame, k: int, shard_vectors: int = SHARD_VECTORS, leaf: int = LEAF) -> tuple[DataFrame, int]:
    """Stored trees, one row for each shard, and the vectors' length (0 if there are none). vectors: a stored table of `usable` ones.

    Of vectors of several lengths, those of the most frequent one are searched, the shortest of these if there are several.
    """
    sizes = vectors.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").take(1)
    dims, n = (sizes[0]["dims"], sizes[0]["n"]) if sizes else (0, 0)
    shards = max(1, -(-n // shard_vectors))
    out = schema(shard=INT, zero=INT, nodes=BINARY, bounds=BINARY, points=BINARY, ids=BINARY, id_at=BINARY)

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        flat = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        tree = Tree.build(flat.reshape(-1, dims), table["vec_id"].to_numpy(), k + 1, leaf)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), *(pa.array([b], pa.binary()) for b in tree.pack())], names=out.names)

    # Rows of one id are dealt apart, as an id may have many vectors.
    dealt = vectors.where(F.size("embedding") == dims).withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int"))
    return stored(dealt.groupBy("shard").applyInArrow(grow, out), "vp-trees"), dims


def _blocks(asked: DataFrame, dims: int, query_block: int) -> tuple[DataFrame, int]:
    """Queries packed into stored rows (block, own, points) of about query_block each, and how many there are."""
    n = max(1, -(-asked.count() // query_block))
    out = schema(block=INT, own=BINARY, points=BINARY)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        flat = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([table["vec_id"].to_numpy().tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary())], names=out.names)

    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n)).cast("int"))
    return stored(dealt.groupBy("block").applyInArrow(pack, out), "vp-queries"), n


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, query_block: int = QUERY_BLOCK, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest vectors but its own, all if there are fewer.

    vectors and queries hold vec_id and embedding, other columns are left out; see `usable` for those that take part.
    Rows that share a vec_id but differ in their vector are candidates each, so an id may be found more than once, and
    none of them is a candidate of a query of that id; as a query such an id has the smallest of its vectors. Ties go to
    the smaller vec_id. No vectors or no queries give no rows.
    """
    fine = stored(usable(vectors), "vp-vectors")
    trees, dims = build_index(fine, k, shard_vectors)
    asked = stored(usable(queries).where(F.size("embedding") == dims).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vp-asked")
    blocks, n = _blocks(asked, dims, query_block)
    out = schema(query_id=LONG, vec_id=LONG, score=DOUBLE)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row.pop("own"), np.int64)
                points = np.frombuffer(row.pop("asked")).reshape(len(own), dims)
                for lo in range(0, len(own), QUERY_PART):
                    part = own[lo : lo + QUERY_PART]
                    best, ids = Tree.unpack(**row, dims=dims).search(points[lo : lo + QUERY_PART], part, k, factor)
                    there = ids >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, there.sum(1))), pa.array(ids[there]), pa.array(best[there])], names=out.names)

    def of_block(block: int) -> DataFrame:
        # One row of at most about query_block vectors goes to all shards; it is never in the driver's own hands.
        one = blocks.where(F.col("block") == block).select((F.col("block") - block).alias("zero"), "own", F.col("points").alias("asked"))
        met = trees.join(F.broadcast(one), "zero").drop("zero", "shard")
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return met.mapInArrow(answer, out).withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = of_block(0)
    if n > 1:  # each block's answers are stored before the next block is sent
        found = stored(found, "vp-found")
        for block in range(1, n):
            found = found.unionByName(stored(of_block(block), "vp-found"))
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


SQL = """
with v as (
  select distinct vec_id, embedding as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), w as (select * from v where len(e) = (select len(e) from v group by 1 order by count(*) desc, 1 limit 1)),
a as (select vec_id, min(e) as e from w where vec_id % 100 = 0 group by vec_id),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i]::double - c.e[i]::double) * (q.e[i]::double - c.e[i]::double)))) as score
  from a q join w c on q.vec_id <> c.vec_id
)
select query_id, rank, vec_id, score from (
  select *, (row_number() over (partition by query_id order by score, vec_id))::int as rank from s
) where rank <= 10
"""
