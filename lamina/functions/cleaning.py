"""Line-level cleaning of web snippets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina import fixed as X
from lamina.functions.text import U, let, strip, strs


def pattern(p: str) -> str:
    """Word characters as letters, digits and underscore in any script; every
    use in these patterns stands inside a character class."""
    return p.replace(r"\w", r"\p{L}\p{N}_").replace(r"\d", r"\p{Nd}")


def _m(s: Column, p: str, flags: str = "") -> Column:
    return s.rlike(U + (f"(?{flags})" if flags else "") + pattern(p))


def noise(s: Column) -> Column:
    """``s`` is a stripped line. Headings are never noise."""
    marked = _m(s, X.SENTENCE_MARK)
    toks = F.filter(F.split(s, r"[\s|/、,，]+"), lambda t: t != "")
    cells = F.filter(F.transform(F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|"), strip), lambda c: c != "")
    rules = [
        _m(s, X.TABLE_SKELETON), _m(s, X.SYMBOLS_ONLY), _m(s, X.BARE_NUMBER),
        _m(s, X.DIGIT_RUN) & _m(s, X.DIGIT_LINE),
        _m(s, X.ATTRIBUTION, "i"), _m(s, X.PRICE_CTA), _m(s, X.RATING_BLOCK, "i"), _m(s, X.IMAGE_ASSET, "i"),
        s.isin(*X.UI_TAGS),
        _m(s, X.NAV_ARROW) & ~_m(s, X.SENTENCE_END),
        (F.size(toks) > 0) & F.forall(toks, lambda t: F.array_contains(strs(X.UI_WORDS), F.lower(t))),
        F.startswith(s, F.lit("|")) & (F.size(cells) > 0) & F.forall(cells, lambda c: F.length(c) < 12) & ~marked,
        (F.length(s) < X.SHORT_LABEL) & ~marked,
        ~_m(s, X.HAS_CJK) & ~_m(s, X.HAS_WORD),
    ]
    return F.when(s == "", True).when(F.startswith(s, F.lit("#")), False).otherwise(reduce(lambda a, b: a | b, rules))


def lines(text: Column) -> Column:
    return F.transform(F.split(F.replace(text, F.lit("[...]"), F.lit("\n")), "\n"), strip)


def clean_snippet(text: Column) -> Column:
    """Drop noise and repeated lines; short texts and texts that would lose
    more than 70 % are left alone."""
    def distinct(kept):
        keys = F.transform(kept, lambda x: F.regexp_replace(x, U + r"\s+", ""))
        return let(keys, lambda ks: F.filter(kept, lambda x, i: F.array_position(ks, F.get(ks, i)) == i + 1))

    out = F.array_join(let(F.filter(lines(text), lambda s: ~noise(s)), distinct), "\n")
    return F.when(F.length(text) < X.MIN_LEN_TO_CLEAN, text).otherwise(
        let(out, lambda o: F.when((o == "") | (F.length(o) < F.length(text) * X.MIN_KEEP_RATIO), text).otherwise(o)))
