"""Registered queries next to their oracle on the smallest tables. TIEOUT_ALL=1 runs every one."""

import os

import duckdb
import pytest

import __spark_entry__ as reg
from tieout.sources.views import BASE_TABLES
from tools.check import canon

SF = "/root/testdata/sf0.001"
CORE = ["reconcile", "reconcile_interim", "recon_metrics", "account_total", "trend_summary", "significant_movements", "material_variance",
        "composition_insight", "bridge", "waterfall", "ltm", "clauses", "extract_amounts", "ground_amounts", "arbiter", "failure_runs",
        "stage_stats", "fn_parse_date", "normalize_schedules", "implicit_breakdown", "indent_hierarchy", "stream_breaker", "duplicate_lines", "field_diff"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for b in BASE_TABLES:
        con.execute(f"CREATE VIEW {b} AS SELECT * FROM '{SF}/{b}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(reg.oracle_sql()) if os.environ.get("TIEOUT_ALL") else CORE)
def test_matches_oracle(spark, duck, name):
    df = reg.queries()[name](spark, SF)
    cur = duck.execute(reg.oracle_sql()[name])
    want = canon([d[0] for d in cur.description], cur.fetchall())
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_oracle_has_a_query():
    assert set(reg.oracle_sql()) <= set(reg.queries())
