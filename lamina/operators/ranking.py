"""Ranking that stays distributed, whatever the shape of the keys.

``top_k`` relies on the group limit Spark plans below the shuffle for
``row_number() <= k``. ``ranked`` numbers rows inside a key of any size: it
range-partitions on (key, order), so one hot key spreads over many tasks, and
turns local positions into global ones with one count per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lamina.session import cut


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """At most ``k`` rows per key, in ``order``; ``rank`` names the 1-based position."""
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The smallest row of each key, as an aggregate so that copies of a hot
    key meet in a map-side combine instead of one window task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*order, *rest)).alias("_first")
    out = df.groupBy(*keys).agg(packed)
    return out.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def ranked(df: DataFrame, order: list[Column], rank: str = "rank", keys: list[str] | None = None,
           start: int = 1) -> DataFrame:
    """Number every row by ``order`` (inside ``keys`` when given) without a
    single-partition window. ``order`` must be total for a stable answer."""
    keys = keys or []
    cols = [F.col(k) for k in keys] + order
    local = (
        df.repartitionByRange(*cols)  # no fixed number: AQE may merge neighbouring ranges, which keeps their order
        .sortWithinPartitions(*cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    local = cut(local)  # positions must come from one evaluation of the range split
    # one row per partition: bounded by the partition count, not by the data
    sizes = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_pid",
        (F.coalesce(F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("_off"),
    )
    pos = local.join(F.broadcast(offsets), "_pid").withColumn("_g", F.col("_off") + F.col("_i"))
    if keys:
        firsts = local.join(F.broadcast(offsets), "_pid").groupBy(*keys).agg(
            F.min(F.col("_off") + F.col("_i")).alias("_g0"))
        cond = [F.col(f"p.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
        joined = pos.alias("p").join(firsts.alias("f"), cond)
        return joined.select(*[F.col(f"p.{c}") for c in df.columns],
                             (F.col("p._g") - F.col("f._g0") + start).cast("long").alias(rank))
    return pos.select(*df.columns, (F.col("_g") + start).cast("long").alias(rank))


def neighbour(df: DataFrame, keys: list[str], order: list[Column], take: dict[str, str], offset: int = 1) -> DataFrame:
    """Values of the row ``offset`` positions ahead (negative: behind) inside
    the key; a join on (key, position) so that a hot key keeps many tasks."""
    r = ranked(df, order, "_pos", keys)
    other = r.select(*keys, (F.col("_pos") - offset).alias("_pos"), *[F.col(s).alias(t) for t, s in take.items()])
    return r.join(other, [*keys, "_pos"], "left").drop("_pos")
