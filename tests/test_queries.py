"""Registered queries against their check SQL on the smallest data. All of
them with LAMINA_ALL=1, otherwise one or more of every family."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from check import rows_of
from lamina.plans import catalog
from lamina.plans.inputs import TABLES

SF = "/root/testdata/sf0.001"
CORE = ("vector_topk noisy_or rrf_fuse quota_fuse mmr near_dup_drop term_coverage l3_history_search cacheability slot_gate kg_link kg_bfs kg_context "
        "mention_ngram kg_entities chunk_text clean_snippet sanitize_evidence evidence_block citations_validate followups_parse shorten_query cache_exact "
        "cache_fuzzy qa_pairs step_elapsed eval_report eval_rollup title_rank chunk_order stream_archive stream_filter layered_retrieve name_index_phrases kg_store_hop kg_repair").split()
NAMES = sorted(E.oracle_sql()) if os.environ.get("LAMINA_ALL") else CORE


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = E.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = db.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(cols, cur.fetchall())


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_every_query_has_a_check_or_is_listed():
    rows_only = set(catalog.QUERIES) - set(catalog.ORACLES)
    assert rows_only == {"ivf_topk", "fit_platt", "rerank_cascade", "kg_bfs_capped", "citation_spans", "render_sources",
                         "format_tool_result", "result_json", "slim_sources", "iterative_retrieve", "parallel_entities", "vector_append", "layered_passages", "graph_topk", "graph_recall", "history_growth"}
