"""Registered queries of the sketch library and their SQL.

Sequences are the bases in the texts of `documents`, each document an id, or each `source` a collection of
many sequences. Doubles are rounded to 9 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sketchloom import oracle as O
from sketchloom.functions import hashing
from sketchloom.functions import kmers as km
from sketchloom.functions.register import jump_hash, mixers, murmur32, murmur64
from sketchloom.operators import hll, minhash, order, weighted
from sketchloom.params import HllParams, MinHashParams, OrderParams, WeightedParams
from sketchloom.plans import compare, meetings
from sketchloom.sources import fastx
from sketchloom.storage import load, params_of, same_params, save, stored, table_path
from sketchloom.streaming import sketches as streams

K = 21
MH = MinHashParams(k=K, size=100)
TEXT = MinHashParams(k=12, size=50, canonical=False)
HL = HllParams(p=8)
OM = OrderParams(k=K, l=2, m=8)
WM = WeightedParams()
EVEN = WeightedParams(k=4, window=6)
ITEM_MH = MinHashParams(k=11, size=200)
ITEM_WM = WeightedParams(k=11, window=5, size=20)
ITEM_HL = HllParams(p=8, k=11)
ITEM_OM = OrderParams(k=5, l=2, m=20, reverse=True)

_QUERIES: dict[str, tuple[Callable, str | None]] = {}


def _query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), km.acgt_only(F.col("text")).alias("seq"))


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.substring("source", 4, 20).cast("long").alias("id"), "lang", km.acgt_only(F.col("text")).alias("seq"))


def dna_with_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases and N in either case, as they stand."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("id"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTNacgtn]", "").alias("seq"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), km.acgt_only(F.col("text")).alias("seq"))


def places(*columns: str) -> list:
    return [F.round(c, 9).alias(c) for c in columns]


# Sequences and k-mers


@_query(f"with {O.SEQS} select id, seq, {O.rc('seq')} as rc from seqs")
def revcomp(spark, sf):
    return dna(spark, sf).select("id", "seq", km.reverse_complement(F.col("seq")).alias("rc"))


@_query("select doc_id as id, translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as seq from documents")
def upper_sequences(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select(F.col("doc_id").alias("id"), km.upper(F.coalesce("text", F.lit(""))).alias("seq"))


@_query(f"with {O.SEQS}, {O.kmers(K)} select id, pos::int as pos, kmer from kmers")
def kmers(spark, sf):
    return km.each_kmer(dna(spark, sf), K)


@_query(f"with {O.SEQS}, {O.kmers(K)}, {O.CANONICAL} select id, kmer, count(*)::bigint as n from canon group by id, kmer")
def canonical_kmers(spark, sf):
    return km.count_kmers(dna(spark, sf), K, by_id=True)


@_query(f"with {O.SEQS}, {O.kmers(K)}, {O.CANONICAL} select kmer, count(*)::bigint as n from canon group by kmer")
def kmer_spectrum_exact(spark, sf):
    return km.count_kmers(dna(spark, sf), K, by_id=False)


@_query(f"with {O.WITH_N}, {O.kmers(K)}, {O.CANONICAL} select kmer, count(*)::bigint as n from canon group by kmer")
def kmers_with_n(spark, sf):
    """K-mers are not filtered: N is a letter like others, whose complement is C; lower case counts as upper case."""
    return km.count_kmers(dna_with_n(spark, sf), K, by_id=False)


@_query(f"with {O.SEQS}, {O.kmers(K)} select id, pos::int as pos, (row_number() over (partition by id, kmer order by pos) - 1)::int as occurrence from kmers")
def occurrence_number(spark, sf):
    earlier = Window.partitionBy("id", "kmer").orderBy("pos")
    return kmers(spark, sf).select("id", "pos", (F.row_number().over(earlier) - 1).alias("occurrence"))


# Hash functions


@_query(f"with {O.SEQS}, {O.kmers(K)}, {O.CANONICAL}, {O.murmur('canon', K)} select kmer, {O.SIGNED.format('h')} as hash from hashes")
def murmur_kmers(spark, sf):
    return kmer_spectrum_exact(spark, sf).select("kmer", murmur64("kmer").alias("hash"))


@_query(f"with {O.SEQS}, {O.kmers(K)}, {O.CANONICAL}, {O.murmur32(K)} select kmer, x::bigint as hash from h32")
def murmur32_kmers(spark, sf):
    return kmer_spectrum_exact(spark, sf).select("kmer", murmur32("kmer").alias("hash"))


_U32 = "4294967296::ubigint"
_MUELLER = [("shift", 16), ("times", hashing.MUELLER32), ("shift", 16), ("times", hashing.MUELLER32), ("shift", 16)]


def _mixers() -> str:
    down, up = (lambda x, by: f"({x} // {1 << by}::ubigint)"), (lambda x, by: f"({x} * {1 << by}::ubigint)")
    steps = ["x + x * 4096 + 2127912214", f"xor(xor(x, {down('x', 19)}), 3345072700)", "x + x * 32 + 374761393", f"xor(({up('x', 9)}) % {_U32}, (x + 3550635116) % {_U32})", "x + x * 8 + 4251993797", f"xor(xor(x, {down('x', 16)}), 3042594569)"]
    jenkins = ", ".join(f"j{n + 1} as (select id, ({e})::ubigint % {_U32} as x from {'ids' if n == 0 else f'j{n}'})" for n, e in enumerate(steps))
    half = [
        f"({O.M64} - 1 - x + x * 262144::uhugeint) % {O.M64}", f"{O._xor('x', 'x // 2147483648::uhugeint')} * 21 % {O.M64}",
        f"{O._xor('x', 'x // 2048::uhugeint')} * 65 % {O.M64}", f"{O._xor('x', 'x // 4194304::uhugeint')} % 4294967296::uhugeint",
    ]
    halves = ", ".join(f"v{n + 1} as (select id, {e} as x from {'wide' if n == 0 else f'v{n}'})" for n, e in enumerate(half))
    split = [O._mul(O._shift_xor("x", 30), hashing.SPLITMIX64[0]), O._mul(O._shift_xor("x", 27), hashing.SPLITMIX64[1]), O._shift_xor("x", 31)]
    splits = ", ".join(f"s{n + 1} as (select id, {e} as x from {'wide' if n == 0 else f's{n}'})" for n, e in enumerate(split))
    return f"""with ids as (select id, id::ubigint as x from (select distinct doc_id as id from documents where doc_id is not null)), wide as (select id, x::uhugeint as x from ids),
{O.mixed32("f", "ids", "id")}, {O.mixed32("t", "ids", "id", _MUELLER)}, {jenkins}, {splits}, {halves}, {", ".join(O.fmix_steps("g", "wide", "x", "id"))}
select id, f5.x::bigint as fmix32, t5.x::bigint as mueller32, j6.x::bigint as jenkins32, {O.SIGNED.format("s3.x")} as splitmix64, v4.x::bigint as halve64, {O.SIGNED.format("g3.x")} as fmix64
from f5 join t5 using (id) join j6 using (id) join s3 using (id) join v4 using (id) join g3 using (id)"""


@_query(_mixers())
def integer_mixers(spark, sf):
    """The integer hashes of document ids."""
    ids = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    return mixers(ids)


@_query(f"with recursive keys as (select distinct doc_id as id, doc_id::uhugeint as k from documents where doc_id is not null), {O.jump('j', 'keys', 1000)} select id, bucket from keys join j using (k)")
def jump_hashes(spark, sf):
    ids = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    return ids.select("id", jump_hash("id", F.lit(1000)).alias("bucket"))


# Lengths


@_query(f"with {O.SEQS} select id, length(seq)::bigint as total_length from seqs")
def total_length(spark, sf):
    return minhash.total_length(dna(spark, sf))


# MinHash


@_query(f"{O.sketches(O.SEQS, K, MH.size)} select id, {O.SIGNED.format('h')} as hash, multiplicity::bigint as multiplicity from sk")
def minhash_sketch(spark, sf):
    return minhash.sketch(dna(spark, sf), MH)


@_query(f"{O.sketches(O.BY_SOURCE, K, MH.size, 2)} select id, {O.SIGNED.format('h')} as hash, multiplicity::bigint as multiplicity from sk")
def minhash_min_copies(spark, sf):
    return minhash.sketch(by_source(spark, sf), MinHashParams(k=K, size=MH.size, min_copies=2))


@_query(f"{O.sketches(O.BY_SOURCE, K, MH.size)} select id, {O.SIGNED.format('h')} as hash, multiplicity::bigint as multiplicity from sk")
def minhash_merge(spark, sf):
    """The sketch of each source from those of its English and its other documents."""
    every = by_source(spark, sf)
    parts = [minhash.sketch(every.where(c), MH) for c in ("lang = 'en'", "lang is null or lang <> 'en'")]
    return minhash.merge(*parts, MH)


@_query(
    f"{O.sketches(O.BY_SOURCE, K, MH.size)} select id, count(*)::bigint as sketch_size, sum(multiplicity)::bigint as multiplicity_sum, round(avg(multiplicity), 9) as mean_multiplicity, "
    "round(18446744073709551616::double * count(*) / max(h)::double, 3) as cardinality from sk group by id"
)
def minhash_stats(spark, sf):
    found = minhash.stats(minhash.sketch(by_source(spark, sf), MH))
    return found.withColumns({"mean_multiplicity": F.round("mean_multiplicity", 9), "cardinality": F.round("cardinality", 3)})


def kept_sketch(spark, sf):
    """Sketches that several joins read, made once."""
    return stored(minhash_sketch(spark, sf), "minhash")


@_query(f"{O.sketches(O.SEQS, K, MH.size)} select a.id as i, b.id as j, count(*)::bigint as shared from sk a join sk b using (h) where a.id < b.id group by a.id, b.id")
def minhash_candidate_pairs(spark, sf):
    return compare.candidate_pairs(kept_sketch(spark, sf))


@_query(f"{O.measures(O.SEQS, K, MH.size)} select i, j, round(jaccard, 9) as jaccard from measured")
def minhash_jaccard(spark, sf):
    return compare.minhash_measures(kept_sketch(spark, sf), MH).select("i", "j", *places("jaccard"))


@_query(f"{O.measures(O.SEQS, K, MH.size)} select i, j, round(containment, 9) as containment from measured")
def minhash_containment(spark, sf):
    return compare.minhash_measures(kept_sketch(spark, sf), MH).select("i", "j", *places("containment"))


@_query(f"{O.measures(O.SEQS, K, MH.size)} select i, j, round(jaccard, 9) as jaccard, round(distance, 9) as distance from measured")
def minhash_distance(spark, sf):
    return compare.minhash_measures(kept_sketch(spark, sf), MH).select("i", "j", *places("jaccard", "distance"))


@_query(f"{O.measures(O.SEQS, K, MH.size)} select i, j, round(distance, 9) as distance from measured order by round(distance, 9), i, j limit 25")
def closest_pair_topk(spark, sf):
    return compare.closest(minhash_distance(spark, sf).select("i", "j", "distance"), 25)


@_query(
    f"with {O.SEQS}, {O.kmers(K)}, {O.CANONICAL}, sets as (select distinct id, kmer from canon), n as (select id, count(*) as n from sets group by id), "
    "c as (select a.id as i, b.id as j, count(*) as shared from sets a join sets b using (kmer) where a.id < b.id group by a.id, b.id) "
    "select i, j, round(shared / (a.n + b.n - shared), 9) as jaccard from c join n a on a.id = i join n b on b.id = j"
)
def exact_jaccard(spark, sf):
    sets = stored(km.packed_counts(dna(spark, sf), K, by_id=True).select("id", F.col("packed").alias("hash")), "kmer-sets")
    return meetings.met(sets, ("jaccard",)).select("i", "j", *places("jaccard"))


def _text_sketch() -> str:
    """A hash of k bytes of UTF-8 for each start; hexadecimal text stands for bytes, as DuckDB has no substrings of them that count bytes."""
    windows = f"kmers as (select id, pos, substr(seq, 2 * pos - 1, {2 * TEXT.k}) as kmer from (select id, seq, unnest(range(1, length(seq) // 2 - {TEXT.k - 2})) as pos from seqs where length(seq) >= {2 * TEXT.k}))"
    return (
        "with seqs as (select doc_id as id, hex(encode(translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'))) as seq from documents), "
        f"{windows}, {O.murmur('kmers', TEXT.k, as_hex=True)}, kh as (select id, h from kmers join hashes using (kmer)), "
        f"sk as (select id, h, n as multiplicity from (select id, h, n, row_number() over (partition by id order by h) as r from (select id, h, count(*) as n from kh group by id, h)) where r <= {TEXT.size}) "
        f"select id, {O.SIGNED.format('h')} as hash, multiplicity::bigint as multiplicity from sk"
    )


@_query(_text_sketch())
def minhash_text(spark, sf):
    """Sketches of ordinary strings, whole texts: one strand, windows of bytes of UTF-8 with a-z upper-cased."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return minhash.sketch(docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("seq")), TEXT)


@_query(f"{O.sketches(O.BY_SOURCE, K, MH.size)} select id, {O.SIGNED.format('h')} as hash, multiplicity::bigint as multiplicity, {MH.k} as k, {MH.size} as size, {MH.seed} as seed from sk")
def minhash_saved(spark, sf):
    """A sketch that was saved and loaded, with the parameters that came back with it."""
    path = table_path(spark, "saved-sketch")
    save(minhash.sketch(by_source(spark, sf), MH), path)
    again = load(spark, path)
    same_params(again, given=MH)
    p = params_of(again)
    return again.select("*", *[F.lit(getattr(p, c)).alias(c) for c in ("k", "size", "seed")])


_LENGTHS = "lens as (select id, sum(length(seq))::double as n from seqs group by id)"
_RATE = f"(a.n / (a.n + {4.0**K!r})) * (b.n / (b.n + {4.0**K!r})) / ((a.n / (a.n + {4.0**K!r})) + (b.n / (b.n + {4.0**K!r})) - (a.n / (a.n + {4.0**K!r})) * (b.n / (b.n + {4.0**K!r})))"


@_query(
    f"{O.measures(O.BY_SOURCE, K, MH.size)}, {_LENGTHS}, cells as (select i, j, shared, {_RATE} as r from measured join lens a on a.id = i join lens b on b.id = j) "
    f"select i, j, shared, round(log10(list_sum(list_transform(range(shared, {MH.size} + 1), lambda t: exp(lgamma({MH.size} + 1.0) - lgamma(t + 1.0) - lgamma({MH.size} - t + 1.0) + t * ln(r) + ({MH.size} - t) * ln(1 - r))))), 6) as log_p from cells"
)
def minhash_p_value(spark, sf):
    """log10 of the probability that random sequences as long share as many hashes."""
    every = stored(by_source(spark, sf), "sequences")
    pairs = compare.candidate_pairs(stored(minhash.sketch(every, MH), "minhash"))
    lengths = minhash.total_length(every)
    both = pairs.join(lengths.select(F.col("id").alias("i"), F.col("total_length").alias("ni")), "i").join(lengths.select(F.col("id").alias("j"), F.col("total_length").alias("nj")), "j")
    p = minhash.p_value(F.col("shared"), F.lit(MH.size), F.col("ni").cast("double"), F.col("nj").cast("double"), K)
    return both.select("i", "j", "shared", F.round(F.log10(p), 6).alias("log_p"))


# HyperLogLog


@_query(f"{O.registers(O.SEQS, HL.k, HL.p)} select * from regs")
def hll_registers(spark, sf):
    return hll.registers(dna(spark, sf), HL)


@_query(f"{O.registers(O.BY_SOURCE, HL.k, HL.p)} select * from regs")
def hll_merge(spark, sf):
    every = by_source(spark, sf)
    return hll.merge(*[hll.registers(every.where(c), HL) for c in ("lang = 'en'", "lang is null or lang <> 'en'")])


@_query(
    f"{O.registers(O.BY_SOURCE, HL.k, HL.p)} select id, rank, count(*)::bigint as n from regs group by id, rank "
    f"union all select id, 0, {1 << HL.p} - count(*) from regs group by id having count(*) < {1 << HL.p}"
)
def hll_histogram(spark, sf):
    counts = hll.histogram(hll.registers(by_source(spark, sf), HL), HL.p)
    return counts.select("id", F.posexplode("counts").alias("rank", "n")).where("n > 0")


@_query(
    f"{O.registers(O.BY_SOURCE, HL.k, HL.p)}, sums as (select id, sum(pow(2.0, -rank)) + ({1 << HL.p} - count(*)) as s, {1 << HL.p} - count(*) as zeros from regs group by id) "
    f"select id, round({O.original(HL.p)}, 6) as estimate from sums"
)
def hll_original_estimate(spark, sf):
    counts = hll.histogram(hll.registers(by_source(spark, sf), HL), HL.p)
    return counts.select("id", F.round(hll.estimate(F.col("counts"), HL.p, "original"), 6).alias("estimate"))


_M, _TOP = 1 << HL.p, 64 - HL.p + 1
_COUNTS = f"rank_counts as (select id, rank, count(*) as n from regs group by id, rank), counted as (select id, {O.counts_list(_TOP, _M)} as c from rank_counts group by id)"


@_query(f"{O.registers(O.BY_SOURCE, HL.k, HL.p)}, {_COUNTS} select id, round({O.improved(_M)}, 6) as estimate from counted")
def hll_improved_estimate(spark, sf):
    counts = hll.histogram(hll.registers(by_source(spark, sf), HL), HL.p)
    return counts.select("id", F.round(hll.estimate(F.col("counts"), HL.p, "improved"), 6).alias("estimate"))


@_query(f"{O.registers(O.BY_SOURCE, HL.k, HL.p)}, {_COUNTS}, {O.likely('sizes', 'counted', 'id', _M)} select id, round(x, 6) as estimate from sizes")
def hll_mle_estimate(spark, sf):
    counts = hll.histogram(hll.registers(by_source(spark, sf), HL), HL.p)
    return counts.select("id", F.round(hll.estimate(F.col("counts"), HL.p), 6).alias("estimate"))


@_query(f"{O.registers(O.BY_SOURCE, HL.k, HL.p)}, {O.joint(HL.p)} select * from hist")
def hll_joint_histogram(spark, sf):
    regs = hll.registers(by_source(spark, sf), HL)
    return hll.joint_histogram(regs, compare.all_pairs(regs.select("id")), HL.p)


@_query(f"{O.registers(O.BY_SOURCE, HL.k, HL.p)}, {O.joint_jaccard(HL.p)} select i, j, round(only_i, 6) as only_i, round(only_j, 6) as only_j, round(both_, 6) as both, round(jaccard, 9) as jaccard from hj")
def hll_jaccard(spark, sf):
    regs = stored(hll.registers(by_source(spark, sf), HL), "registers")
    found = hll.jaccard(regs, compare.all_pairs(regs.select("id")), HL.p)
    return found.select("i", "j", *[F.round(c, 6).alias(c) for c in ("only_i", "only_j", "both")], *places("jaccard"))


@_query(
    f"{O.registers(O.BY_SOURCE, HL.k, HL.p)}, {O.joint(HL.p)}, {O.pair_kinds(HL.p, False)}, sizes as (select i, j, kind, {O.improved(_M)} as x from kinds), "
    "wide as (select i, j, max(x) filter (kind = 'a') as a, max(x) filter (kind = 'b') as b, max(x) filter (kind = 'whole') as u from sizes group by i, j) "
    "select i, j, round(greatest(0, (a + b - u) / u), 9) as jaccard from wide"
)
def hll_union_jaccard(spark, sf):
    regs = stored(hll.registers(by_source(spark, sf), HL), "registers")
    return hll.jaccard_by_union(regs, compare.all_pairs(regs.select("id")), HL.p).select("i", "j", *places("jaccard"))


# Weighted MinHash


@_query(O.minimizers(O.SEQS, WM.k, WM.window) + O.MINIMIZERS.format(WM.window - 1))
def minimizers(spark, sf):
    return weighted.minimizers(dna(spark, sf), WM).select("id", "minimizer")


@_query(O.minimizers(O.SEQS, EVEN.k, EVEN.window) + O.MINIMIZERS.format(EVEN.window - 1))
def minimizers_even_k(spark, sf):
    """With k even there are k-mers that equal their reverse complement; they are skipped."""
    return weighted.minimizers(dna(spark, sf), EVEN).select("id", "minimizer")


@_query(f"{O.spectrum(O.BY_SOURCE, WM.k, WM.window)} select * from spec")
def wmh_spectrum(spark, sf):
    return weighted.spectrum(weighted.minimizers(by_source(spark, sf), WM))


@_query(f"{O.spectrum(O.BY_SOURCE, WM.k, WM.window)}, {O.count_min()} select * from est")
def cms_estimate(spark, sf):
    return weighted.estimates(wmh_spectrum(spark, sf))


_WM = f"{O.spectrum(O.BY_SOURCE, WM.k, WM.window)}, {O.count_min()}, {O.weighted_sketch(WM.size, WM.seed)}"


@_query(f"{_WM} select id, slot, bin, round(weight, 9) as weight from wm")
def wmh_sketch(spark, sf):
    return weighted.sketch(cms_estimate(spark, sf), WM).select("id", "slot", "bin", *places("weight"))


@_query(f"{_WM}, {O.weighted_pairs()} select i, j, round(weighted_jaccard, 9) as weighted_jaccard from wj")
def wmh_jaccard(spark, sf):
    sketches = stored(weighted.sketch(cms_estimate(spark, sf), WM), "weighted")
    return weighted.jaccard(sketches, compare.all_pairs(sketches.select("id"))).select("i", "j", *places("weighted_jaccard"))


# Order MinHash


@_query(f"{O.order_blocks(K, OM.m, OM.seed)} select id, block::int as block, kmers from blocks")
def omh_sketch(spark, sf):
    return order.sketch(dna(spark, sf), OM).where("data is not null").select("id", F.posexplode("data").alias("block", "kmers"))


@_query(
    f"{O.order_blocks(K, OM.m, OM.seed)}, c as (select a.id as i, b.id as j, count(*) as same from blocks a join blocks b using (block, kmers) where a.id < b.id group by a.id, b.id) "
    f"select i, j, round(same / {OM.m}, 9) as similarity from c"
)
def omh_similarity(spark, sf):
    """Of pairs that share a block."""
    sketches = stored(order.sketch(dna(spark, sf), OM), "order")
    blocks = sketches.where("data is not null").select("id", F.posexplode("data").alias("block", "kmers"))
    pairs = compare.candidate_pairs(blocks.select("id", F.struct("block", "kmers").alias("hash")))
    return pairs.select("i", "j", F.round(F.col("shared") / OM.m, 9).alias("similarity"))


_BACK = O.order_blocks(ITEM_OM.k, ITEM_OM.m, ITEM_OM.seed, O.BY_ITEM)
_STRANDS = (
    f"fwd as ({_BACK} select * from blocks), "
    f"bwd as ({O.order_blocks(ITEM_OM.k, ITEM_OM.m, ITEM_OM.seed, O.reversed_strand(O.BY_ITEM))} select * from blocks), "
    "names as (select distinct id from fwd), idpairs as (select a.id as i, b.id as j from names a join names b on a.id < b.id), "
)


def _share(x: str, y: str, name: str, same: str = "a.kmers = b.kmers") -> str:
    return f"{name} as (select i, j, count(*) filter ({same}) / {ITEM_OM.m} as s from idpairs join {x} a on a.id = i join {y} b on b.id = j and b.block = a.block group by i, j)"


@_query(f"with {_STRANDS} {_share('fwd', 'fwd', 'own')}, {_share('bwd', 'fwd', 'back')} select i, j, round(greatest(own.s, back.s), 9) as similarity from own join back using (i, j)")
def omh_both_strands(spark, sf):
    """Of all benchmark items; the first one's reverse strand is compared as well."""
    sketches = stored(order.sketch(items(spark, sf), ITEM_OM), "order")
    ids = sketches.where("data is not null").select("id")
    return order.similarity(sketches, compare.all_pairs(ids)).select("i", "j", *places("similarity"))


_TURNED = f"(a.kmers = b.kmers or substr(a.kmers, {ITEM_OM.k} + 1) || substr(a.kmers, 1, {ITEM_OM.k}) = b.kmers)"


@_query(f"with {_STRANDS} {_share('fwd', 'fwd', 'own', _TURNED)}, {_share('bwd', 'fwd', 'back', _TURNED)} select i, j, round(greatest(own.s, back.s), 9) as similarity from own join back using (i, j)")
def omh_circular(spark, sf):
    """Blocks match if one is a rotation of the other by whole k-mers."""
    sketches = stored(order.sketch(items(spark, sf), ITEM_OM), "order")
    ids = sketches.where("data is not null").select("id")
    return order.similarity(sketches, compare.all_pairs(ids), circular=True).select("i", "j", *places("similarity"))


@_query(
    f"with {_STRANDS} lists as (select f.id, f.l as fl, b.l as bl from (select id, list(kmers order by block) as l from fwd group by id) f join (select id, list(kmers order by block) as l from bwd group by id) b using (id)) "
    "select i, j, a.fl = b.fl and a.bl = b.bl as equal from idpairs join lists a on a.id = i join lists b on b.id = j"
)
def omh_equality(spark, sf):
    sketches = stored(order.sketch(items(spark, sf), ITEM_OM), "order")
    return order.equal(sketches, compare.all_pairs(sketches.where("data is not null").select("id")))


# Comparisons


def _matrix() -> str:
    """Each distance in a common table of its own, with its own sequences and parameters."""
    mh = f"{O.measures(O.BY_ITEM, ITEM_MH.k, ITEM_MH.size)} select i, j, distance as d from measured union all select i, j, d from (select a.id as i, b.id as j, 1.0 as d from (select distinct id from sk) a join (select distinct id from sk) b on a.id < b.id) x where not exists (select 1 from measured m where m.i = x.i and m.j = x.j)"
    wm = f"{O.spectrum(O.BY_ITEM, ITEM_WM.k, ITEM_WM.window)}, {O.count_min()}, {O.weighted_sketch(ITEM_WM.size, ITEM_WM.seed)}, {O.weighted_pairs()} select i, j, 1 - weighted_jaccard as d from wj"
    om = f"{O.order_blocks(5, 50, 32, O.BY_ITEM)}, names as (select distinct id from blocks) select x.id as i, y.id as j, 1 - count(*) filter (a.kmers = b.kmers) / 50 as d from names x join names y on x.id < y.id join blocks a on a.id = x.id join blocks b on b.id = y.id and b.block = a.block group by x.id, y.id"
    hl = f"{O.registers(O.BY_ITEM, ITEM_HL.k, ITEM_HL.p)}, {O.joint_jaccard(ITEM_HL.p)} select i, j, 1 - jaccard as d from hj"
    ids = "ids as (select distinct item_id as id from benchmark where item_id is not null), every as (select a.id as i, b.id as j from ids a join ids b on a.id < b.id)"
    return (
        f"with {ids}, wm_ as ({wm}), mh_ as ({mh}), om_ as ({om}), hl_ as ({hl}) select i, j, round(wm_.d, 6) as weighted, round(mh_.d, 6) as minhash, round(om_.d, 6) as \"order\", round(hl_.d, 6) as hll "
        "from every left join wm_ using (i, j) left join mh_ using (i, j) left join om_ using (i, j) left join hl_ using (i, j)"
    )


@_query(_matrix())
def all_pairs_matrix(spark, sf):
    """Four distances of all pairs of benchmark items."""
    every = stored(items(spark, sf), "items")
    found = compare.matrix(every, stored(compare.all_pairs(every), "pairs"), ITEM_MH, ITEM_WM, OrderParams(k=5, l=2, m=50), ITEM_HL)
    return found.select("i", "j", *[F.round(c, 6).alias(c) for c in ("weighted", "minhash", "order", "hll")])


@_query(
    f"{O.measures(O.BY_SOURCE, K, MH.size)}, ids as (select distinct id from seqs where id is not null), cells as (select b.id, a.id as other, printf('%.6f', coalesce(distance, 1.0)) as d from ids b join ids a on a.id < b.id left join measured on i = a.id and j = b.id), "
    "told as (select id, string_agg(d, ' ' order by other) as l from cells group by id) "
    "select -1::bigint as id, count(*)::varchar as line from ids union all select id, id::varchar || coalesce(' ' || l, '') from ids left join told using (id)"
)
def phylip(spark, sf):
    """A lower-triangular matrix of the mutation distances of the sources; the first line has the id -1 here."""
    every = stored(by_source(spark, sf), "sequences")
    found = stored(minhash.sketch(every, MH), "minhash")
    return compare.phylip(every, compare.minhash_measures(found, MH)).select(F.coalesce("id", F.lit(-1)).alias("id"), "line")


# Files


@_query("select doc_id::varchar as name, lang || ' >' || source as comment, regexp_replace(coalesce(text, ''), '[^ACGTNacgtn]', '', 'g') as seq from documents where doc_id is not null")
def fasta_round_trip(spark, sf):
    """Sequences written as FASTA and read again, split at records; headers hold the mark that begins a record."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null")
    seq = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTNacgtn]", "")
    path = table_path(spark, "fasta")
    fastx.write_fasta(docs.select(F.col("doc_id").cast("string").alias("name"), F.concat("lang", F.lit(" >"), "source").alias("comment"), seq.alias("seq")), path)
    return fastx.read_fasta_splits(spark, path)


@_query("select doc_id::varchar as name, source as comment, regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g') as seq, repeat('@', length(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g'))) as qual from documents where doc_id is not null")
def fastq_round_trip(spark, sf):
    """Sequences written as compressed FASTQ and read again; qualities are marks that begin a header elsewhere."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null")
    seq = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTacgt]", "")
    path = table_path(spark, "fastq")
    made = docs.select(F.col("doc_id").cast("string").alias("name"), F.col("source").alias("comment"), seq.alias("seq"))
    fastx.write_fastq(made.withColumn("qual", F.repeat(F.lit("@"), F.length("seq"))), path, "gzip")
    return fastx.read(spark, path).select("name", "comment", "seq", F.coalesce("qual", F.lit("")).alias("qual"))


# Streams


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """by_source, as a stream of the same files."""
    kind = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = spark.readStream.schema(kind).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/documents.parquet*")
    return docs.select(F.substring("source", 4, 20).cast("long").alias("id"), km.acgt_only(F.col("text")).alias("seq"))


@_query(f"{O.sketches(O.BY_SOURCE, K, MH.size)} select id, {O.SIGNED.format('h')} as hash, multiplicity::bigint as multiplicity from sk")
def streaming_minhash(spark, sf):
    found = streams.minhash_sketches(streamed(spark, sf), MH)
    rows = streams.latest(streams.collected(found, table_path(spark, "stream"), table_path(spark, "stream-state")))
    return rows.select("id", F.inline(F.arrays_zip(F.col("hashes").alias("hash"), F.col("multiplicities").alias("multiplicity"))))


@_query(f"{O.registers(O.BY_SOURCE, HL.k, HL.p)} select * from regs")
def streaming_hll(spark, sf):
    rows = streams.collected(streams.hll_registers(streamed(spark, sf), HL), table_path(spark, "stream"), table_path(spark, "stream-state"))
    return rows.groupBy("id", "idx").agg(F.max("rank").alias("rank"))
