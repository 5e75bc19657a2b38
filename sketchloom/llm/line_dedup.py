"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without white space at its ends and with A-Z lower-cased; its hash has
128 bits. A `LineRuns` store holds, for each key, in how many documents it was found, as runs: tables that
are bucketed by hash and sorted in each bucket. A batch of documents is counted once; keys that already
reached the threshold (the *closed* keys) are anti-joined away, the rest become a run of level 0. When a level
holds `fanout` runs they are merged bucket by bucket into one run of the next level, and keys that reach the
threshold move to the closed keys. So each key is rewritten once per level, not once per batch, and
neither the anti-join nor a merge shuffles a run.

Everything is made of DataFrame operations. A frequent line is summed before the shuffle, so it
costs one row per task. If the boilerplate keys are counted and lie under `IN_PLACE_KEYS`, lines are marked where they
stand and no text is moved; beyond that the marks come by joins, broadcast only under `BROADCAST_KEYS`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm.shared import ascii_lower, documents, drop_path, drop_stored, others, row_key, stored, table_path

#: White space that is stripped from a line's ends: space and \t\n\v\f\r.
STRIPPED = " \t\n\x0b\x0c\r"
#: Up to so many keys of 16 bytes are constants of the plan.
IN_PLACE_KEYS = 20_000
#: Up to so many keys of 16 bytes are broadcast.
BROADCAST_KEYS = 200_000


def line_hashes(text: Column, min_length: int = 1) -> Column:
    """array<struct<a,b>>, one for each line; null for keys shorter than min_length code points."""
    keys = F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.btrim(x, F.lit(STRIPPED)))
    return F.transform(keys, lambda k: F.when(F.length(k) >= min_length, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))))


class LineRuns:
    """Levelled runs of (a, b, n): a key's hash and in how many documents it was found."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, max(2, fanout)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.closed: list[str] = []
        self._paths: dict[str, str] = {}

    def add(self, hashed: DataFrame) -> None:
        """Count a batch, with a column `hashes`, and add what isn't closed as a run."""
        lines = hashed.select(F.explode(F.array_distinct("hashes")).alias("h")).where("h is not null").select("h.a", "h.b")
        new = lines.groupBy("a", "b").agg(F.count("*").alias("n"))
        batch = self._write(new, "batch")
        if self.closed:
            new = self._read(batch)
            for closed in self.closed:  # buckets of the same number meet
                new = new.join(self._read(closed).hint("merge"), ["a", "b"], "left_anti")
            self.levels[0].append(self._write(new, "run"))
            self._forget(batch)
        else:
            self.levels[0].append(batch)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def boilerplate(self) -> DataFrame:
        """Keys (a, b) found in at least min_docs documents."""
        runs = [r for level in self.levels for r in level]
        parts = [self._read(c).select("a", "b") for c in self.closed]
        if runs:
            parts.append(self._merged(runs).where(F.col("n") >= self.min_docs).select("a", "b"))
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        return found

    def drop(self) -> None:
        """Delete all runs."""
        for name in list(self._paths):
            self._forget(name)

    def _merged(self, runs: list[str]) -> DataFrame:
        """Runs joined in the order of their hashes; buckets of the same number meet, so nothing is shuffled."""
        found = self._read(runs[0])
        for r in runs[1:]:
            both = found.join(self._read(r).select("a", "b", F.col("n").alias("m")).hint("merge"), ["a", "b"], "full_outer")
            found = both.select("a", "b", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return found

    def _compact(self, level: int) -> None:
        merged = self._write(self._merged(self.levels[level]), "run")
        for r in self.levels[level]:
            self._forget(r)
        self.levels[level] = []
        if len(self.levels) == level + 1:
            self.levels.append([])
        full = F.col("n") >= self.min_docs
        self.closed.append(self._write(self._read(merged).where(full), "closed"))
        self.levels[level + 1].append(self._write(self._read(merged).where(~full), "run"))
        self._forget(merged)

    def _write(self, counted: DataFrame, kind: str) -> str:
        """A table of the shared folder, dealt to buckets by both words of the hash and sorted by them."""
        path = table_path(self.spark, f"line-{kind}")
        name = re.sub(r"\W", "_", path.rsplit("/", 1)[1])
        dealt = counted.repartition(self.buckets, "a", "b")
        dealt.write.bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("path", path).option("compression", "zstd").saveAsTable(name)
        self._paths[name] = path
        return name

    def _read(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def _forget(self, name: str) -> None:
        self.spark.sql(f"drop table {name}")
        drop_path(self.spark, self._paths.pop(name))


def _listed(values: list[int]) -> str:
    return ",".join(f"{v}L" if v > -(1 << 63) else f"{v + 1}L - 1L" for v in values) or "null"


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_length: int = 1, batches: int = 4, fanout: int = 2, in_place: int = IN_PLACE_KEYS) -> DataFrame:
    """docs, whose columns doc_id and text are used, with text replaced by its lines that stay, and n_lines and n_dropped.

    Lines whose key has at least min_length code points and is found in at least min_docs rows of docs go from every
    document. Null or empty text is one empty line and stays as an empty text; a text that loses all its lines
    becomes empty. Rows are documents: repeated rows count once each. Other columns pass through, but for those named
    n_lines or n_dropped in any case, which the operator's own replace. docs is counted in `batches`, each a hash
    range of its rows. No rows give no rows.
    """
    spark = docs.sparkSession
    passed = others(docs, "n_lines", "n_dropped")
    t = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").alias("d"), t.alias("t")).select(*row_key("d", "t"), line_hashes(F.col("t"), min_length).alias("hashes"))
    hashed = stored(keyed.withColumn("batch", F.pmod("rk1", F.lit(batches)).cast("int")), "line-hashes", "batch")
    runs = LineRuns(spark, min_docs, fanout)
    for k in range(batches):
        runs.add(hashed.where(F.col("batch") == k))
    common = stored(runs.boilerplate(), "line-boilerplate")
    runs.drop()
    n = common.count()
    whole = F.struct(*[F.col(f"`{c}`") for c in passed]).alias("row")
    if n <= in_place:
        keys = common.collect()  # at most `in_place` pairs of longs
        drop_stored(hashed, common)
        first, second = (_listed(sorted({k[c] for k in keys})) for c in (0, 1))
        # Both words of a hash are looked up by themselves, as sets of longs. Keys too short have no place in the sets.
        sets = F.struct(F.expr(f"transform(hashes, h -> h.a in ({first}) and h.b in ({second}))").alias("gone"))
        lines = F.split("t", "\n")
        marked = docs.select(whole, t.alias("t")).select("row", "t", line_hashes(F.col("t"), min_length).alias("hashes")).select("row", "t", sets.alias("m"), F.size(lines).cast("long").alias("n_lines"))
        gone = F.col("m.gone")
        n_gone = F.size(F.filter(gone, lambda x: x)).cast("long")
        kept = F.when(~F.exists(gone, lambda x: x), F.col("t")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.get(gone, i), F.lit(False))), "\n"))
        out = marked.select("row", kept.alias("kept"), "n_lines", n_gone.alias("n_dropped"))
    else:
        at = hashed.select("rk1", "rk2", F.posexplode("hashes").alias("i", "h")).where("h is not null").select("rk1", "rk2", "i", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
        hits = at.join(F.broadcast(common) if n <= BROADCAST_KEYS else common, ["a", "b"]).groupBy("rk1", "rk2").agg(F.collect_set("i").alias("drop"))
        left = docs.select(whole, F.col("doc_id").alias("d"), t.alias("t")).select("row", "t", *row_key("d", "t"))
        lines = F.split("t", "\n")
        kept = F.when(F.col("drop").isNull(), F.col("t")).otherwise(F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "drop"), lambda i: F.get(lines, i)), "\n"))
        # Which lines stay is a property of the text, so sizes come from the arrays, not from the result. size() of a null array may be -1.
        n_gone = F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size("drop")).cast("long")
        out = left.join(hits, ["rk1", "rk2"], "left").select("row", kept.alias("kept"), F.size(lines).cast("long").alias("n_lines"), n_gone.alias("n_dropped"))
    return out.select(*[F.col("kept").alias(c) if c.lower() == "text" else F.col("row")[c].alias(c) for c in passed], "n_lines", "n_dropped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_common_lines(documents(spark, sf_dir, "doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
with l as (
  select doc_id, r, i, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as k
  from (
    select doc_id, r, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as i
    from (select doc_id, row_number() over () as r, string_split(coalesce(text, ''), chr(10)) as lines from documents)
  )
), common as (
  select k from l where length(k) >= 1 group by k having count(distinct r) >= 10
), marked as (
  select doc_id, r, i, line, k in (select k from common) as gone from l
)
select doc_id, count(*)::bigint as n_lines, coalesce(sum(gone::int), 0)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id, r
"""
