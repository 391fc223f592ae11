"""Question fingerprints and the gate that compares two of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina import fixed as X
from lamina.functions.text import has_any, longest_only, present, sorted_set, strs

ORDER = ("numbers", "years", "negations", "comparatives", "qualifiers", "focus", "entities", "topics")


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def slots(q: Column, topics: Column | None = None) -> Column:
    """Struct of sorted, distinct arrays. Without a tagger the topics are
    empty and entities are the ASCII words; pass ``topics`` to supply them."""
    low = F.lower(q)
    cn = F.concat(_all(q, rf"第\s*([{X.CN_DIGITS}]{{1,6}})", 1),
                  _all(q, rf"([{X.CN_DIGITS}]{{1,6}})\s*(?:{X.CN_UNITS})", 1))
    numbers = F.concat(_all(q, r"\d+(?:\.\d+)?%?"), F.array_except(cn, strs(X.CN_VAGUE)))
    prefixes = _all(q, rf"([{X.ROLE_PREFIXES}])(?=[{X.ROLE_NOUNS}])", 1)
    focus = F.filter(F.array(*[F.when(has_any(low, cues), F.lit(k)) for k, cues in X.FOCUS.items()]),
                     lambda v: v.isNotNull())
    words = F.transform(_all(q, r"[A-Za-z][A-Za-z0-9\-\.]{1,}"), F.upper)
    none = F.array().cast("array<string>")
    return F.struct(
        sorted_set(numbers).alias("numbers"),
        sorted_set(_all(q, r"(?:19|20)\d{2}")).alias("years"),
        sorted_set(longest_only(present(low, X.NEGATIONS))).alias("negations"),
        sorted_set(longest_only(present(low, X.COMPARATIVES))).alias("comparatives"),
        sorted_set(F.concat(longest_only(present(low, X.QUALIFIERS)), prefixes)).alias("qualifiers"),
        sorted_set(focus).alias("focus"),
        sorted_set(words).alias("entities"),
        sorted_set(topics if topics is not None else none).alias("topics"),
    )


def gate(a: Column, b: Column) -> Column:
    """Name of the first slot that forbids reuse, or null when compatible."""
    def differs(k):
        return a[k] != b[k]

    fa, fb = a["focus"], b["focus"]
    outside = F.size(F.array_except(F.array_union(fa, fb), strs(X.FOCUS_OPEN)))
    # empty focus is an open statement: it goes with WHO and WHICH only, and
    # those two ask for the same kind of answer
    focus_ok = (
        ((F.size(fa) == 0) & (F.size(fb) == 0))
        | F.arrays_overlap(fa, fb)
        | (outside == 0)
    )
    union = F.size(F.array_union(a["topics"], b["topics"]))
    jaccard = F.size(F.array_intersect(a["topics"], b["topics"])) / union
    out = F.when(differs("numbers"), "numbers")
    for k in ("years", "negations", "comparatives", "qualifiers"):
        out = out.when(differs(k), k)
    return (
        out.when(~focus_ok, "focus")
        .when(differs("entities"), "entities")
        .when((union > 0) & (jaccard < X.TOPIC_JACCARD_MIN), "topics")
    )
