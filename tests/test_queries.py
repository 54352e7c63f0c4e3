"""Registered queries against their SQL on the smallest tables."""

import os
from datetime import datetime, timedelta

import duckdb
import pytest

from check import TABLES, compare
from tidemark.plans import load_all

FOLDER = "/root/testdata/sf0.001"
REGISTRY = load_all()
CHECKED = (
    "sma", "macd", "trailing_liquidity", "j_asof_price", "pit_latest", "revenue_asof", "survivorship", "cs_rank",
    "composite_fraction", "src_facts", "src_form4", "dir_sync", "screen", "prev_filing", "quarter_cell", "bt_nav",
    "perf_summary", "scenarios", "relative_val", "own_top", "mention", "story_cluster", "alert_emit", "search_hybrid",
    "segment_metrics", "regime", "st_bars",
)


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, db, name):
    found = REGISTRY[name].run(spark, FOLDER).toArrow()
    assert compare(found, db.sql(REGISTRY[name].sql).to_arrow_table()) is None


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns


def test_news_page_lists_named_companies_and_counts_the_rest(spark, tmp_path):
    docs = [(d, f"title {d}\nmore", "en", f"s{d}", 9) for d in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    events = [(k, datetime(2024, 1, 1) + timedelta(minutes=k), 100 + k % 7, "click", 1.0, "{}") for k in range(23)]
    kind = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(events, kind).write.parquet(f"{tmp_path}/events.parquet")
    found = REGISTRY["news"].run(spark, str(tmp_path)).collect()
    assert [(r["news_id"], r["company"], r["hidden"]) for r in found] == [(k, 100 + k % 7, 4) for k in range(22, -1, -1) if k % 5 != 4]
