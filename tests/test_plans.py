"""Plans the jobs are written for, and the registry's contract."""

import pytest

from growthlens import catalog
from growthlens.catalog.base import Inputs
from growthlens.functions import fixed
from growthlens.operators import copyq, search

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_oracle_has_a_query():
    q, o = catalog.queries(), catalog.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150


def test_search_scan_is_pruned(spark):
    p = plan(search.search_report(Inputs(spark, SMALL).v_search, ["device"]))
    schema = p.split("ReadSchema: struct<")[1].split(">")[0]
    assert "l_extendedprice" not in schema and "l_orderkey" not in schema


def test_copy_lines_shuffle_nothing(spark):
    p = plan(copyq.lint_hits(copyq.copy_lines(Inputs(spark, SMALL).v_copy)))
    assert "Exchange" not in p and "Python" not in p


@pytest.mark.parametrize("name", ["inbound_degree", "lint_hits", "sessions", "spike_after_post", "position_buckets", "patterns"])
def test_no_cross_joins(spark, name):
    p = plan(catalog.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_credits_add_up(spark):
    from growthlens.operators import leads

    seg = leads.touch_segments(Inputs(spark, SMALL).v_touch)
    paid = leads.conversion_paths(seg).filter("touches > 0").agg({"value": "sum"}).first()[0]
    assert leads.attribution_linear(seg).agg({"revenue": "sum"}).first()[0] == paid


def test_every_issue_code_has_a_severity(spark):
    codes = {r.code for r in catalog.queries()["issue_counts"](spark, SMALL).collect()}
    assert codes and codes <= set(fixed.ISSUE_SEVERITY)


@pytest.mark.parametrize("name", ["site_audit", "search_by_device_country", "engine_summary", "sessions", "journeys", "lint_summary", "performance_score", "backfill_schedule"])
def test_matches_sql(spark, name):
    import duckdb

    from growthlens.catalog.views import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = catalog.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    res = con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[name]})")
    norm = lambda v: "NULL" if v is None else f"{v:.12g}" if isinstance(v, float) else str(v)
    ours = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert ours == sorted(tuple(norm(v) for v in r) for r in res.fetchall())
