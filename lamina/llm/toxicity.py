"""Toxicity by compression distance: each window of a text is compressed with a
zstandard dictionary of ordinary text and with one of toxic text, and the bytes
that the toxic one saves are the evidence. Its thresholds are calibrated on
labelled rows.

Dictionaries are raw content. The ordinary one holds what is frequent in texts
labelled ordinary, and ordinary words that contain parts of toxic ones, so that
only what is particular to toxic text saves bytes. The toxic one holds the same
behind words that toxic texts have far oftener and in many different contexts;
contexts are counted in a 64-bit sketch, so that copies of one toxic text, exact
or near, don't make its other words look toxic. A fixed ballast before each
window keeps the compressor from storing short windows raw.

Counts run over all labelled rows of the fold; only the chosen words and a table
of feature counts, both bounded, reach the driver. Labels, languages, sources and
ids are never inputs of a score. Texts that are null or empty have no windows
and get the score of no evidence. Without labelled toxic rows all scores are 0.
Rows with several labels count as toxic if one does. Repeated rows are scored
each; other columns are handed on.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import lower_ascii, stored

#: Words of a window; words of the dictionaries at most; ordinary words looked through for parts of toxic ones.
WINDOW, TOXIC_WORDS, ORDINARY_BYTES, ORDINARY_WORDS = 5, 1000, 8192, 100_000
LEVEL, LEAST_MATCH, CLIP = 9, 6, 12
_BALLAST = b"0123456789" * 10 + b" "
_EDGE = r"^[.,;:!?\"'()]+|[.,;:!?\"'()]+$"


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


@lru_cache(maxsize=4)
def _compressors(ordinary: bytes, toxic: bytes):
    import zstandard as zs

    def make(content: bytes):
        d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
        p = zs.ZstdCompressionParameters.from_level(LEVEL, source_size=128, dict_size=len(content), min_match=LEAST_MATCH, write_content_size=False)
        d.precompute_compress(compression_params=p)
        return zs.ZstdCompressor(dict_data=d, compression_params=p).compress

    return make(ordinary), make(toxic)


def features(model: Model, text: str | None) -> tuple[int, int, int, int, int]:
    """Of a whole text: the three largest savings in bytes, how many windows save 3 or more, and the windows' number on a scale of half powers of two."""
    plain, toxic = _compressors(model.ordinary, model.toxic)
    words = (text or "").encode().lower().split()
    saved = []
    for k in range(0, len(words), WINDOW):
        x = _BALLAST + b" " + b" ".join(words[k : k + WINDOW]) + b" "
        saved.append(len(plain(x)) - len(toxic(x)))
    top = sorted(saved, reverse=True)[:3] + [0, 0, 0]
    a, b, c = (min(max(v, 0), CLIP) for v in top[:3])
    return a, b, c, min(sum(v >= 3 for v in saved), 50), int(2 * np.log2(len(saved) + 1))


def _design(f: np.ndarray) -> np.ndarray:
    f = np.asarray(f, float).reshape(-1, 5)
    windows = f[:, 4] / 2 * np.log(2)
    return np.column_stack([f[:, 0], f[:, 1], f[:, 2], f[:, 3] / np.sqrt(np.exp(windows)), windows, np.ones(len(f))])


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logistic regression of counted rows by Newton steps, with a small ridge."""
    w, ridge = np.zeros(x.shape[1]), np.diag([0.1] * (x.shape[1] - 1) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _words(labelled: DataFrame) -> DataFrame:
    """Per word: occurrences in toxic and ordinary rows, and different contexts in toxic rows (up to 64)."""
    w = labelled.select("toxic", F.filter(F.split(lower_ascii(F.col("text")), r"[\x20\x09-\x0D]+"), lambda x: x != "").alias("w"))
    at = F.transform("w", lambda x, k: F.struct(F.regexp_replace(x, _EDGE, "").alias("word"), F.expr("1L").alias("one"), F.pmod(F.xxhash64(F.get("w", k - 1)), F.lit(64)).cast("int").alias("bit")))
    rows = w.select("toxic", F.inline(at)).where(F.length("word") >= 3)
    bits = F.when(F.col("toxic") == 1, F.expr("shiftleft(one, bit)")).otherwise(F.lit(0).cast("long"))
    return rows.groupBy("word").agg(F.sum(F.col("toxic").cast("long")).alias("bad"), F.count(F.lit(1)).alias("n"), F.bit_count(F.bit_or(bits)).alias("contexts"))


def _heaviest(words: DataFrame, most: int) -> list[bytes]:
    """Words by falling weight, as many classes of weight (an eighth of a power of
    two) as ``most`` words allow: tasks send nothing that isn't taken."""
    classed = words.withColumn("c", F.floor(F.log2(F.col("weight").cast("double")) * 8).cast("int"))
    least, total = 1 << 30, 0
    for r in sorted(classed.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["c"]):
        total += r["n"]
        if total > most and least < 1 << 30:
            break
        least = r["c"]
    rows = classed.where(F.col("c") >= least).select("word", "weight").collect()
    return [r["word"].encode() for r in sorted(rows, key=lambda r: (-r["weight"], r["word"]))]


def _dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """``toxic`` from most to least telling, ``ordinary`` from most to least frequent."""
    parts = {x[i:j] for w in toxic for x in [b" " + w] for i in range(len(x)) for j in range(i + LEAST_MATCH, len(x) + 1)}
    longest = max(map(len, parts), default=0)
    holder: dict[bytes, bytes] = {}
    for w in ordinary:
        x = b" " + w + b" "
        for i in range(len(x)):
            for j in range(i + LEAST_MATCH, min(len(x), i + longest) + 1):
                if x[i:j] in parts:
                    holder.setdefault(x[i:j], w)
    shared = b""
    for part in sorted(holder, key=lambda p: (-len(p), p)):
        if part not in shared:
            shared += b" " + holder[part] + b" "
    frequent = b""
    for w in ordinary:
        if len(frequent) >= ORDINARY_BYTES:
            break
        frequent = b" " + w + frequent
    common = shared + frequent + b" " + _BALLAST
    return common, b"".join(b" " + w for w in reversed(toxic)) + common


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of the rows of ``docs`` that ``labels`` (doc_id, toxic) cover; None if none of them is toxic."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # a merge join whatever the size of the labels, which grow with the documents
    labelled = stored(docs.select("doc_id", "text").where("text is not null").join(marks.hint("merge"), "doc_id").select("toxic", "text"), "labelled")
    bad, rows = labelled.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    if not bad:
        return None
    words = stored(_words(labelled), "words")
    n_bad, n_all = words.agg(F.sum("bad"), F.sum("n")).first()
    weight = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (n_all - n_bad + 1))
    telling = (F.col("bad") >= max(3, 0.01 * bad)) & (F.col("contexts") >= max(3, min(8, bad // 50))) & (weight > 2.5)
    marked = words.withColumn("telling", telling).withColumn("value", F.col("bad") * weight)
    toxic = [r[0].encode() for r in marked.where("telling").orderBy(F.desc("value"), "word").limit(TOXIC_WORDS).select("word").collect()]
    plain = _heaviest(marked.where("not telling and n > bad").select("word", F.expr("(n - bad) * octet_length(word)").alias("weight")), ORDINARY_WORDS)
    ordinary, both = _dictionaries(toxic, plain)
    raw = Model(both, ordinary, ())

    @F.pandas_udf("array<int>")
    def measure(text: pd.Series) -> pd.Series:
        return text.map(lambda t: features(raw, t))

    seen = labelled.select("toxic", measure("text").alias("f")).groupBy("f", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()  # cells of small whole numbers
    x = _design(np.array([r["f"] for r in seen]))
    w = _fit(x, np.array([r["toxic"] for r in seen], float), np.array([r["n"] for r in seen], float))
    return Model(both, ordinary, tuple(w.tolist()))


def with_score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        f = np.array([features(model, t) for t in text]).reshape(-1, 5)
        return pd.Series(1 / (1 + np.exp(-np.clip(_design(f) @ np.array(model.weights), -30, 30))))

    return docs.withColumn(name, score("text"))


def training_rows(df: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    return df.where(fold_of(F.col("doc_id"), folds) != held_out)
