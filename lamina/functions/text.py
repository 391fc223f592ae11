"""Column helpers for text rules. Everything here stays inside the JVM except
Unicode NFKC, which Spark has no built-in for."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

U = "(?U)"  # Java: make \w \d \s \b follow Unicode, as the rules expect
#: The characters of ``U + r"\s"``. Taking them off the ends reads a text once; a pattern would try every space inside it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strs(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def any_of(words) -> str:
    """Alternation that matches any of the literal words."""
    return "|".join(re.escape(w) for w in words)


def has_any(c: Column, words) -> Column:
    return c.rlike(any_of(words))


def present(c: Column, words) -> Column:
    """Those of ``words`` that occur in ``c`` as a substring."""
    return F.filter(strs(words), lambda w: F.contains(c, w))


def let(value: Column, body) -> Column:
    """Bind a value for use inside a lambda, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def longest_only(a: Column) -> Column:
    """Drop words contained in another, longer word of the same array."""
    return let(a, lambda ws: F.filter(ws, lambda t: ~F.exists(ws, lambda o: (o != t) & F.contains(o, t))))


def sorted_set(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def tail(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.substring(c, -n, n)).otherwise(c)


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(c: Column, ascii_only: bool = False) -> Column:
    """NFKC is the identity on ASCII, so only a caller with other text pays
    for the Arrow round trip."""
    return c if ascii_only else _nfkc(c)


def char_bigrams(c: Column) -> Column:
    """Distinct two-character windows of the text without whitespace."""
    def windows(s):
        n = F.length(s)
        return F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(s)).otherwise(
            F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(s, i, F.lit(2)))))

    return let(F.regexp_replace(c, U + r"\s+", ""), windows)


def join_lines(a: Column) -> Column:
    return F.array_join(a, "\n")


def once(df, name: str, expr: Column):
    """Add a column that is computed exactly once per row. A plain projection
    is copied into every later filter that mentions it; a generator is not."""
    return df.withColumn(name, F.explode(F.array(expr)))
