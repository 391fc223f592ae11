"""Evaluation and health reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.ranking import first_per_key, ranked
from lamina.session import cut


def order_statistics(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Median and the [0.9 n] value per key, exact, without gathering a key:
    rows get their place from a distributed sort and only the places that
    matter are kept."""
    r = cut(ranked(df.select(*keys, value, tie), [F.asc(value), F.asc(tie)], "_i", keys, start=0))
    n = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    lo, hi = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    p90 = F.least(F.floor(F.col("_n") * 0.9), F.col("_n") - 1)
    j = r.join(n, keys)
    at = lambda pos: F.max(F.when(F.col("_i") == pos, F.col(value)))
    few = j.where((F.col("_i") == lo) | (F.col("_i") == hi) | (F.col("_i") == p90))
    return few.groupBy(*keys).agg(at(lo).alias("_lo"), at(hi).alias("_hi"), at(p90).alias("p90")).select(
        *keys, ((F.col("_lo") + F.col("_hi")) / 2).alias("median"), "p90")


def eval_report(trace: DataFrame, keys: list[str]) -> DataFrame:
    done = trace.where(F.col("ms") != 0)
    base = trace.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"), F.round(F.count_if("ok") / F.count(F.lit(1)), 4).alias("accuracy"),
        F.count_if("timeout").alias("timeouts"))
    cost = done.groupBy(*keys).agg(F.round(F.avg("ms"), 4).alias("mean_ms"), F.max("ms").alias("max_ms"), F.round(F.avg("hops"), 4).alias("hops"),
                                   F.round(F.avg("calls"), 4).alias("calls"))
    return base.join(cost, keys, "left").join(order_statistics(done, keys, "ms", "event_id"), keys, "left")


def eval_rollup(trace: DataFrame) -> DataFrame:
    """Accuracy overall, per source and per level of an arm, in one pass."""
    trace.createOrReplaceTempView("_trace")
    return trace.sparkSession.sql("""
        SELECT arm, src, level, count(*) AS n, count_if(ok) AS n_ok, round(count_if(ok) / count(*), 4) AS accuracy
        FROM _trace GROUP BY GROUPING SETS ((arm), (arm, src), (arm, src, level))""")


def fixed_and_broken(trace: DataFrame, baseline: str) -> DataFrame:
    """Cases an arm repaired or lost against the baseline arm."""
    one = first_per_key(trace.select("cid", "arm", "event_id", "ok"), ["cid", "arm"], ["event_id"])
    base = one.where(F.col("arm") == baseline).select("cid", F.col("ok").alias("base_ok"))
    j = one.where(F.col("arm") != baseline).join(base, "cid", "left").withColumn("base_ok", F.coalesce("base_ok", F.lit(False)))
    return j.where(F.col("ok") != F.col("base_ok")).select("cid", "arm", F.when(F.col("ok"), "fixed").otherwise("broke").alias("change"))


def failed_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``case_id`` that stopped failing (gone) or started to (new)."""
    return before.subtract(after).withColumn("change", F.lit("gone")).unionByName(
        after.subtract(before).withColumn("change", F.lit("new")))


def progress_counts(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Counts of test progress characters in ``....F [ 12%]`` lines."""
    chars = F.regexp_extract(line, r"^([.FEsxX]+)\s+\[\s*\d+%\]", 1)
    n = lambda p: F.sum(F.regexp_count(chars, F.lit(p))).cast("long")
    g = lines.groupBy(*keys).agg(n("[.]").alias("passed"), n("F").alias("failed"), n("E").alias("error"), n("s").alias("skipped"), n("[xX]").alias("xfail"))
    total = F.col("passed") + F.col("failed") + F.col("error")
    return g.withColumn("pass_rate", F.round(F.when(total > 0, F.col("passed") / total), 4))


def table_health(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows, distinct keys' span and null keys of each table."""
    parts = [t.agg(F.count(F.lit(1)).alias("rows"), F.min(k).cast("long").alias("min_key"), F.max(k).cast("long").alias("max_key"),
                   F.count_if(F.col(k).isNull()).alias("null_keys")).select(F.lit(n).alias("name"), "*") for n, (t, k) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
