"""Raw layer scores to comparable probabilities, and their combination."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina import fixed as X
from lamina.operators.ranking import top_k


def sigmoid(x: Column) -> Column:
    up = 1.0 / (1.0 + F.exp(-F.least(x, F.lit(60.0))))
    e = F.exp(F.greatest(x, F.lit(-60.0)))
    return F.when(x >= 0, up).otherwise(e / (1.0 + e))


def _param(layer: Column, i: int) -> Column:
    out = None
    for name, p in X.PLATT.items():
        out = F.when(layer == name, p[i]) if out is None else out.when(layer == name, p[i])
    return out.otherwise(X.PLATT_FALLBACK[i])


def calibrate(layer: Column, score: Column, hop: Column | None = None,
              a: Column | None = None, b: Column | None = None) -> Column:
    s = F.coalesce(score, F.lit(0.0))
    if hop is not None:
        s = F.when((layer == "L5_kg") & (hop > 1), s * F.pow(F.lit(X.HOP_DECAY), hop - 1)).otherwise(s)
    return sigmoid((a if a is not None else _param(layer, 0)) * (s - (b if b is not None else _param(layer, 1))))


def hop_of(source: Column, via: Column) -> Column:
    """Hop number from a ``hopN`` source; an unreadable N counts as 2, zero as 1."""
    digits = F.regexp_extract(source, r"^hop\s*([+-]?\d+)\s*$", 1)
    n = F.when(digits == "", F.lit(2)).otherwise(digits.try_cast("int"))
    n = F.when(n == 0, 1).otherwise(F.coalesce(n, F.lit(2)))
    return F.when(F.startswith(source, F.lit("hop")), n).when(F.coalesce(via, F.lit("")) != "", 2).otherwise(1)


def with_calibrated(df: DataFrame, overwrite: bool = True) -> DataFrame:
    hop = hop_of(F.coalesce("source", F.lit("")), F.col("via"))
    fresh = F.round(calibrate(F.col("layer"), F.col("score"), hop), 4)
    return df.withColumn("calibrated", fresh if overwrite else F.coalesce("calibrated", fresh))


def with_overrides(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """``overrides`` (layer, a, b): one row per layer, never more than layers."""
    o = overrides.select("layer", F.col("a").alias("_a"), F.col("b").alias("_b"))
    layer = F.col("layer")
    a, b = F.coalesce("_a", _param(layer, 0)), F.coalesce("_b", _param(layer, 1))
    return df.join(o, "layer", "left").withColumn(
        "calibrated", F.round(calibrate(layer, F.col("score"), a=a, b=b), 4)).drop("_a", "_b")


def noisy_or(df: DataFrame, key: str = "query_id", p: str = "calibrated", top: int = X.NOISY_OR_TOP) -> DataFrame:
    """1 - product(1 - p) over the ``top`` best rows of each key."""
    best = top_k(df.select(key, p), [key], [F.desc(p)], top)
    folded = F.aggregate(
        F.sort_array(F.collect_list(p), asc=False), F.lit(1.0),
        lambda acc, x: acc * (1.0 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))))
    return best.groupBy(key).agg(F.round(1.0 - folded, 4).alias("confidence"))


SCORE_DIGITS = 4


def _descend(a, b, ga, gb, n):
    return max(a - X.FIT["lr"] * ga / n, X.FIT["min_a"]), b - X.FIT["lr"] * gb / n


def fit_platt(samples: DataFrame, key: str = "layer", epochs: int = X.FIT["epochs"]) -> DataFrame:
    """Full-batch gradient descent per key over (key, score, label).

    Scores are published with four digits; equal samples are folded to one
    weighted cell, so that the descent of a key runs over a number of cells that
    the digits bound, whatever the number of samples."""
    cells = samples.groupBy(key, F.round("score", SCORE_DIGITS).alias("s"), F.col("label").cast("double").alias("y")).agg(F.count(F.lit(1)).alias("w"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        s, y, w = (pdf[c].to_numpy(float) for c in ("s", "y", "w"))
        a, b, n = X.FIT["init_a"], X.FIT["init_b"], w.sum()
        for _ in range(epochs):
            d = (1.0 / (1.0 + np.exp(-np.clip(a * (s - b), -60, 60))) - y) * w
            a, b = _descend(a, b, (d * (s - b)).sum(), (d * -a).sum(), n)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "a": [round(a, 4)], "b": [round(b, 4)], "n": [int(n)]})

    return cells.groupBy(key).applyInPandas(fit, f"{key} {dict(samples.dtypes)[key]}, a double, b double, n long")
