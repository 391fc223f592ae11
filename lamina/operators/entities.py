"""Entities a question coordinates: A, B and C."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina import fixed as X
from lamina.functions.text import has_any, let, strs

_RUN = "array<string>"


def parallel_entities(query: Column, tokens: Column, limit: int = X.MAX_ENTITIES) -> Column:
    """``tokens``: array of struct(word, pos) from a tagger. Proper names joined
    by conjunctions with at most two other words between them form a run; the
    longest run of at least two names wins."""
    zero = F.struct(F.array().cast(f"array<{_RUN}>").alias("runs"), F.array().cast(_RUN).alias("cur"), F.lit(0).alias("gap"), F.lit(False).alias("linked"))

    def close(acc):
        return F.when(F.size(acc["cur"]) >= 2, F.array_append(acc["runs"], acc["cur"])).otherwise(acc["runs"])

    def step(acc, t):
        w = F.trim(t["word"])
        blank = w == ""
        ent = t["pos"].isin(*X.PROPER_POS) & (F.length(w) >= 2) & ~F.array_contains(strs(X.STOP_ENTITIES), w)
        joins = F.array_contains(strs(X.COORD_TOKENS), w)
        onward = (F.size(acc["cur"]) > 0) & acc["linked"] & (acc["gap"] <= X.MAX_GAP)
        lost = acc["gap"] + 1 > X.MAX_GAP
        runs = F.when(blank, acc["runs"]).when(ent & ~onward, close(acc)).when(~ent & ~joins & lost, close(acc)).otherwise(acc["runs"])
        cur = (F.when(blank, acc["cur"]).when(ent & onward, F.when(F.array_contains(acc["cur"], w), acc["cur"]).otherwise(F.array_append(acc["cur"], w)))
               .when(ent, F.array(w)).when(~joins & lost, F.array().cast(_RUN)).otherwise(acc["cur"]))
        gap = F.when(blank, acc["gap"]).when(ent, 0).when(joins, acc["gap"]).otherwise(acc["gap"] + 1)
        linked = F.when(blank, acc["linked"]).when(ent, False).when(joins, True).when(lost, False).otherwise(acc["linked"])
        return F.struct(runs.alias("runs"), cur.alias("cur"), gap.alias("gap"), linked.alias("linked"))

    def best(runs):
        longest = F.array_max(F.transform(runs, lambda r, i: F.struct(F.size(r).alias("n"), (-i).alias("neg"), r.alias("r"))))["r"]
        return F.when(F.size(runs) > 0, F.slice(longest, 1, limit)).otherwise(F.array().cast(_RUN))

    found = let(F.aggregate(tokens, zero, step), lambda acc: let(close(acc), best))
    return F.when(has_any(query, X.CONJUNCTIONS), found).otherwise(F.array().cast(_RUN))
