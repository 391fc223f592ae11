"""Keyword form of a question, on whitespace tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina import fixed as X
from lamina.functions.text import U, has_any, let, strip, strs

_DROP = tuple(dict.fromkeys(X.SHORTEN_STOPWORDS + X.SHORTEN_NEGATIONS + X.SHORTEN_CONTRAST))
_PUNCT = "^[" + re.escape(X.SHORTEN_PUNCT) + "]+$"


def tokens(c: Column) -> Column:
    return F.filter(F.split(strip(c), U + r"\s+"), lambda t: t != "")


def keywords(toks: Column) -> Column:
    return F.filter(toks, lambda t: ~t.rlike(_PUNCT) & ~F.array_contains(strs(_DROP), F.lower(t)))


def _glue(a: Column, w: Column) -> Column:
    ascii_both = a.rlike(r"[\x00-\x7f]$") & w.rlike(r"^[\x00-\x7f]")
    return F.when(a == "", w).when(ascii_both, F.concat(a, F.lit(" "), w)).otherwise(F.concat(a, w))


def clauses(q: Column) -> Column:
    """Split at punctuation, then before words of contrast."""
    parts = F.filter(F.transform(F.split(q, X.CLAUSE_SPLIT), strip), lambda c: c != "")

    def by_contrast(c):
        zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

        def step(acc, w):
            turn = F.array_contains(strs(X.SHORTEN_CONTRAST), F.lower(w)) & (acc["cur"] != "")
            return F.struct(F.when(turn, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
                            F.when(turn, "").otherwise(_glue(acc["cur"], w)).alias("cur"))

        return let(F.aggregate(tokens(c), zero, step),
                   lambda r: F.when(r["cur"] != "", F.array_append(r["done"], r["cur"])).otherwise(r["done"]))

    return let(F.flatten(F.transform(parts, by_contrast)), lambda a: F.when(F.size(a) > 0, a).otherwise(F.array(q)))


def _first_seen(words: Column) -> Column:
    return let(words, lambda ws: let(F.transform(ws, F.lower), lambda ls: F.filter(ws, lambda w, i: F.array_position(ls, F.get(ls, i)) == i + 1)))


def shorten(query: Column, n: int = X.SHORTEN_MAX) -> Column:
    q = strip(query)
    neg_cue = lambda c: has_any(F.lower(c), X.SHORTEN_NEGATIONS)
    gather = lambda cs, neg: _first_seen(F.flatten(F.transform(F.filter(cs, lambda c: neg_cue(c) if neg else ~neg_cue(c)), lambda c: keywords(tokens(c)))))

    def assemble(pos, neg):
        low = F.transform(neg, F.lower)
        kept = F.filter(pos, lambda w: ~F.array_contains(low, F.lower(w)))
        parts = F.concat(F.slice(kept, 1, n), F.transform(neg, lambda w: F.concat(F.lit("-"), w)))
        return F.when((F.size(kept) == 0) & (F.size(neg) == 0), q).otherwise(F.array_join(parts, " "))

    return let(clauses(q), lambda cs: let(gather(cs, False), lambda p: let(gather(cs, True), lambda g: assemble(p, g))))


def core_terms(c: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(keywords(tokens(F.coalesce(c, F.lit("")))), lambda w: F.length(w) > 1), F.lower))


def drift(query: Column, rewritten: Column, history: Column) -> Column:
    """struct(severe, suspicious): the rewrite shares no word with the question;
    words it took from the conversation instead."""
    s = F.struct(core_terms(query).alias("q"), core_terms(rewritten).alias("r"), core_terms(history).alias("h"))

    def verdict(t):
        empty = (F.size(t["q"]) == 0) | (F.size(t["r"]) == 0)
        none = F.array().cast("array<string>")
        return F.struct(F.when(empty, False).otherwise(F.size(F.array_intersect(t["r"], t["q"])) == 0).alias("severe"),
                        F.when(empty, none).otherwise(F.array_sort(F.array_except(F.array_intersect(t["r"], t["h"]), t["q"]))).alias("suspicious"))

    return let(s, verdict)
