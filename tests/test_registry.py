"""The registered queries: names, twins, plan properties, and a sample of them against SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, canonical
from workload import ORACLE, QUERIES

SAMPLE = ["A02_entropy", "A06_js_distance", "A14_period_rollup", "A30_prompt_metrics", "L05_notifications", "W06_pack_blocks", "S09_prompt_set_ingestion"]


def test_twins_cover_all_queries():
    assert set(ORACLE) == set(QUERIES)
    assert set(ORACLE) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, sf, name):
    duck = duckdb.connect()
    for table in TABLES.split():
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    result = duck.execute(entry.oracle_sql()[name])
    names, expected = [c[0] for c in result.description], result.fetchall()
    df = entry.queries()[name](spark, sf)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, expected)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["A05_kl_divergence", "A18_diversity", "T01_top_tokens", "U01_alert_union"])
def test_plans_stay_in_the_jvm(spark, sf, name, capsys):
    entry.queries()[name](spark, sf).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
