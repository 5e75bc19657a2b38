"""From raw documents to packed sequences: five stages, each on all that the stage before it kept.

Each stage takes (spark, docs, sf_dir), with docs as the stage before wrote them, and returns a
DataFrame. All but the last return the columns of `documents`; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import decontaminate, line_dedup, near_dedup, packing, quality
from sketchloom.llm.shared import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model keeps; it is fitted on those that `labels` grades."""
    model = quality.trained(spark, sf_dir, docs)
    return quality.score(docs.select(*COLUMNS), model).where("kept").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least 10 of them have."""
    done = line_dedup.drop_common_lines(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return near_dedup.drop_near_duplicates(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no eight words of a benchmark item occur in a row."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; see packing.pack."""
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", classify),
    ("line dedup", drop_lines),
    ("near dedup", drop_near),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Classifier and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
