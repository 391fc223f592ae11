"""Table sinks for the stores the engine keeps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import ensure_checkpoint_dir


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new folder for one job's table, below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def append_vectors(df: DataFrame, path: str, dim: int) -> None:
    """Append rows whose vector has the store's dimension; the check runs in
    the same pass as the write."""
    ok = df.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(
        F.raise_error(F.concat(F.lit("vector of dimension "), F.size("embedding").cast("string"), F.lit(f", store has {dim}")))))
    ok.write.mode("append").parquet(path)


def write_graph(triples: DataFrame, path: str) -> None:
    """Triples partitioned by predicate, so that P31/P279 scans read only theirs."""
    triples.write.mode("overwrite").partitionBy("p").parquet(path)


def write_lines(lines: DataFrame, path: str, codec: str = "none", order: str | None = None) -> None:
    """``lines`` (line) as text files; with ``order`` the files, by name, hold them in the order of that column."""
    if order:
        lines = lines.repartitionByRange(order).sortWithinPartitions(order)
    lines.select("line").write.option("compression", codec).text(path)


def whole_folders(spark: SparkSession, folder: str, marker: str = "_SUCCESS") -> list[str]:
    """Folders right below ``folder`` that hold ``marker`` ("." for all), in order of their names, through Spark's own file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in store.listStatus(path)] if store.exists(path) else []
    return sorted(p.toString() for p in found if store.exists(hadoop.Path(p, marker)))
