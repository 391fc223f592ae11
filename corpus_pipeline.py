"""The corpus pipeline: toxic documents go, documents of poor quality go, lines
that a source repeats go, one document of each group of near duplicates stays,
and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and
returns the columns of ``documents``; the last returns pieces of sequences.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import line_dedup, near_dup, packing, quality, toxicity
from lamina.llm.common import carrying, stored
from lamina.session import ship

#: Documents at or above this probability are rejected.
TOXIC = 0.7


def stage(fn):
    """A stage runs wherever Spark was started: the executors get this package first."""
    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, docs, sf_dir)

    return run


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from labelled rows of the training fold that are among ``docs``."""
    labels = toxicity.training_rows(spark.read.parquet(f"{sf_dir}/labels.parquet"))

    @carrying
    def kept(docs: DataFrame) -> DataFrame:
        scored = toxicity.with_score(docs, toxicity.train(docs, labels), "_toxic")
        return scored.where(f"_toxic < {TOXIC}").select(*docs.columns)

    return kept(docs)


@stage
def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs)


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The source of a document is its host."""
    return line_dedup.dedup_documents(docs, "source")


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicated(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_poor), ("line dedup", drop_lines), ("MinHash near-dedup", drop_copies), ("packing", pack)]

#: Tokenizers, compressors and sketches have no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stored(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
