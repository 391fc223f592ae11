"""File sources: the line formats the corpus and graph builds start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of plain, gzip or bzip2 files: ``ord`` (from 0, in the order of paths, then of places in the file), ``line``, ``file``.

    A line's number is the number of lines in all splits before its own, and its place in the split. Splits are counted in a
    pass of their own that reads no more than they hold; one row per split is what moves."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))  # ids of a split's lines follow each other
    splits = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("file", "block", (F.coalesce(F.sum("n").over(w), F.lit(0)) - F.col("first")).alias("base"))
    return raw.join(F.broadcast(bases), ["file", "block"]).select((F.col("base") + F.col("id")).alias("ord"), "line", "file")


def parse_triple_lines(lines: DataFrame) -> DataFrame:
    """Exactly five tab-separated fields; empty ones become null."""
    p = F.split("line", "\t", -1)
    null = lambda c: F.when(c != "", c)
    return lines.where(F.size(p) == 5).select(
        p[0].alias("s"), p[1].alias("p"), null(p[2]).alias("o"), null(p[3]).alias("v"), p[4].alias("t"))


def triples_tsv(spark: SparkSession, path: str) -> DataFrame:
    return parse_triple_lines(spark.read.text(path).withColumnRenamed("value", "line"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; bad lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def page_views(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of hourly page-view files; their order doesn't matter, so they are not counted."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
