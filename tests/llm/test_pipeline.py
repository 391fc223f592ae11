from functools import partial

import duckdb
import pytest
from test_near_dup import ONE_BAND, sharing_one_band

import __spark_entry__ as E
import corpus_pipeline
from check import rows_of
from lamina.llm import near_dup

SF = "/root/testdata/sf0.001"


def test_stages_hand_on_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    from lamina.llm.common import stored

    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stored(step(spark, docs, SF), "stage")
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now <= before, name
        assert "line" not in name or now == before
        before = now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == before


def test_an_empty_table_passes_through(spark, none):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_copies_in_a_large_bucket_go(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "signatures", sharing_one_band)
    monkeypatch.setattr(near_dup, "deduplicated", partial(near_dup.deduplicated, block=2, crowd=3))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in ONE_BAND], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    assert {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, SF).collect()} == set(range(8))


@pytest.mark.parametrize("name", ["op2_quality_rules", "op9_warc", "op10_line_dedup"])
def test_check_sql(spark, name):
    if name not in E.oracle_sql():
        pytest.skip("no check SQL")
    db = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = E.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = db.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(cols, cur.fetchall())
