"""Conversation memory and per-session order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina import fixed as X
from lamina.operators.ranking import neighbour, top_k


def memory_window(messages: DataFrame, turns: int = X.MAX_TURNS) -> DataFrame:
    """The last 2·turns messages of each conversation."""
    return top_k(messages, ["conv_id"], [F.desc("turn")], 2 * turns, rank="back")


def recent_summary(messages: DataFrame, turns: int = X.RECENT_TURNS) -> DataFrame:
    last = memory_window(messages, turns)
    g = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")))).alias("l"))
    return g.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("summary"))


def surviving_sessions(events: DataFrame, key: str, ts: str, limit: int = X.MAX_SESSIONS) -> DataFrame:
    """First-in first-out: the newest ``limit`` sessions by first appearance."""
    first = events.groupBy(key).agg(F.min(ts).alias("first_seen"))
    return first.orderBy(F.desc("first_seen"), F.desc(key)).limit(limit)


def step_elapsed(events: DataFrame, key: str, order: list[Column], ts: str) -> DataFrame:
    """Milliseconds since the previous event of the same session."""
    d = neighbour(events, [key], order, {"prev_ts": ts}, offset=-1)
    return d.withColumn("elapsed_ms", F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp"))) / 1000))


def qa_pairs(messages: DataFrame) -> DataFrame:
    """A user message and the assistant message that follows it."""
    d = neighbour(messages, ["conv_id"], [F.asc("turn")], {"next_role": "role", "answer": "text"})
    return d.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).select("conv_id", "turn", F.col("text").alias("query"), "answer")
