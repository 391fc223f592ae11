"""Quality rules whose limits adapt: per language and source, limits come from
mergeable quantile sketches of the measures, and a join applies them.

The sketch of a measure is a sparse histogram with 64 to 127 cells per power of
two (values are per mille, so below 128 it is exact). Cells and counts merge by
addition in any order, so the result doesn't depend on how rows are dealt or on
what is run again, which random compaction would. Sketches of (lang, source)
merge into one per language, which serves sources with few documents.

A measure's limit is q75 + ``spread`` * (q75 - q25), at least median + ``slack`` of
the measure: what a group does as a rule passes, however odd it is elsewhere,
and small differences within a very even group pass too. Base rules hold beside.

Null or empty texts have no words and fail the base rule; null languages and
sources are groups of their own; repeated rows count each; an empty table gives
an empty result. Columns other than doc_id, text, lang and source are ignored.
All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lamina.llm.common import all_of, carrying, let, stored

WORD, SYMBOL = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"
#: Measures in per mille (higher is worse) and their least distance from the median.
SLACK = {"symbols": 30, "capitals": 150, "unspoken": 150, "echoes": 250, "same_lines": 400}
SPREAD, LEAST_ROWS = 4, 100


def _runs_covered(starts: Column, width: int) -> Column:
    """Words under runs of ``width`` words that begin at the given ascending places."""
    steps = lambda s: F.transform(s, lambda x, k: F.coalesce(F.least(F.lit(width), F.get(s, k + 1) - x), F.lit(width)))
    return F.aggregate(let(starts, steps), F.lit(0).cast("long"), lambda a, x: a + x)


def _repeated(hashes: Column) -> Column:
    """Places of values that occur more than once, ascending. Sorting brings equal values together."""
    twice = lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    pairs = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    return F.sort_array(F.transform(let(pairs, twice), lambda x: x["k"]))


def measured(docs: DataFrame) -> DataFrame:
    """Base counts and per-mille measures of every whole text."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", "lang", "source", text.alias("t"))
    d = d.select("doc_id", "lang", "source", "t", F.regexp_extract_all("t", F.lit(WORD), 0).alias("w"),
                 F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"))
    hashes = F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda k: F.xxhash64(F.slice("w", k, 8)))
    d = d.withColumn("h", F.when(F.size("w") >= 9, hashes))
    alone = F.col("h").isNull() | (F.size(F.array_distinct("h")) == F.size("h"))
    d = d.withColumn("n_repeat_words", F.when(alone, F.lit(0).cast("long")).otherwise(_runs_covered(_repeated(F.col("h")), 8)))
    letters = F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")
    d = d.select(
        "doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"), F.length(letters).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]+(?![^\x20\x09-\x0D])")).cast("long").alias("n_unspoken"))
    share = lambda a, b: F.expr(f"{a} * 1000 div greatest({b}, 1)")
    return d.select(
        *[c for c in d.columns if c not in ("n_capitals", "n_distinct", "n_lines", "n_unspoken")],
        share("n_symbols", "word_chars").alias("symbols"), share("n_capitals", "word_chars").alias("capitals"), share("n_unspoken", "n_words").alias("unspoken"),
        share("(n_words - n_distinct)", "n_words").alias("echoes"), share("n_dup_lines", "n_lines").alias("same_lines"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"))


def cell(value: Column) -> Column:
    """The histogram cell of a whole number: its seven leading bits and how many follow."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return (shift * 1024 + F.call_function("shiftright", value, shift)).cast("long")


def cell_value(c: Column) -> Column:
    return F.call_function("shiftleft", F.pmod(c, F.lit(1024)), (F.floor(c / 1024)).cast("int")).cast("long")


def sketches(measures: DataFrame) -> DataFrame:
    """Cells per (lang, source, measure): a mergeable quantile sketch. Partial counts combine before the shuffle."""
    names = list(SLACK)
    pairs = F.array(*[F.struct(F.lit(n).alias("measure"), cell(F.col(n)).alias("cell")) for n in names])
    return measures.select("lang", "source", F.inline(pairs)).groupBy("lang", "source", "measure", "cell").agg(F.count(F.lit(1)).alias("n"))


def limits(cells: DataFrame, keys: list[str], spread: int = SPREAD) -> DataFrame:
    """From sketches merged over ``keys``: rows and the limit of each measure. A
    group has at most a few hundred cells, whatever its number of rows."""
    merged = cells.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))
    group = [*keys, "measure"]
    w = W.partitionBy(*group).orderBy("cell")
    ranked = merged.withColumn("upto", F.sum("n").over(w)).withColumn("rows", F.sum("n").over(W.partitionBy(*group)))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * q, cell_value(F.col("cell"))))
    q = ranked.groupBy(*group).agg(F.first("rows").alias("rows"), at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"))
    slack = F.element_at(F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv]), F.col("measure"))
    q = q.withColumn("limit", F.greatest(F.col("q3") + spread * (F.col("q3") - F.col("q1")), F.col("q2") + slack).cast("long"))
    return q.groupBy(*keys).agg(F.max("rows").alias("rows"), *[F.max(F.when(F.col("measure") == m, F.col("limit"))).alias(f"max_{m}") for m in SLACK])


def judged(docs: DataFrame, spread: int = SPREAD, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The base counts, ``base_failed`` and ``kept`` of every document."""
    m = stored(measured(docs), "measures")  # numbers only; read for the sketches and again for the verdict
    cells = sketches(m)
    own, by_lang = limits(cells, ["lang", "source"], spread), limits(cells, ["lang"], spread)
    of = [F.when(F.col("o.rows") >= least_rows, F.col(f"o.max_{x}")).otherwise(F.col(f"l.max_{x}")).alias(f"max_{x}") for x in SLACK]
    groups = own.alias("o").join(by_lang.alias("l"), F.expr("o.lang <=> l.lang")).select(F.col("o.lang").alias("g_lang"), F.col("o.source").alias("g_source"), *of)
    within = all_of([F.col(x) <= F.col(f"max_{x}") for x in SLACK])
    joined = m.join(groups, F.expr("lang <=> g_lang and source <=> g_source"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & within).alias("kept"))


@carrying
def filtered(docs: DataFrame, spread: int = SPREAD, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text", "lang", "source"))
    verdict = judged(keyed.select(F.col("_key").alias("doc_id"), "text", "lang", "source"), spread, least_rows)
    gone = verdict.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return keyed.join(gone, F.col("_key") == F.col("_gone"), "left_anti").select(*docs.columns)
