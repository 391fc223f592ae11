"""Extra columns whose names the operators use themselves."""

import fixtures
import pytest
from pyspark.sql import functions as F

from lamina.llm import line_dedup, near_dup, quality

NAMES = ["_key", "_gone", "_s", "_salt", "_lines", "_rest", "_host", "_dropped", "kept_lines", "_toxic", "a.b", "carried_0", "block", "host"]


@pytest.mark.parametrize("step", [quality.filtered, near_dup.deduplicated, lambda d: line_dedup.dedup_documents(d, "source")])
def test_extra_columns_come_through(spark, step):
    plain = fixtures.documents(spark).drop("key", "n", "part", "word")
    wide = plain.select("*", *[F.concat(F.lit(n), F.lit(" of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in NAMES])
    rows = step(wide).collect()
    assert step(wide).columns == wide.columns
    for r in rows:
        assert [r[n] for n in NAMES] == [f"{n} of {'none' if r['doc_id'] is None else r['doc_id']}" for n in NAMES]
    key = lambda x: (x is not None, x)
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=lambda r: tuple(map(key, r))) == sorted(((r.doc_id, r.text) for r in step(plain).collect()), key=lambda r: tuple(map(key, r)))
