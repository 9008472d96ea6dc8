import check
import pytest

import __spark_entry__ as entry
from runloom.plans import catalog
from runloom.plans.registry import with_tables

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
# One or two of each family; tools/check.py compares all of them.
SAMPLE = ["oee_by_line", "change_real_vs_theory", "run_fact_strict", "lag_features", "asof_forward", "interval_full_outer_join",
          "measure_breakdown", "cause_query", "callout_severity", "post_mortem_summary", "week_gap_recs", "recent_sku_line", "coverage",
          "feasibility", "blocked_slots", "priority_candidates"]


@pytest.fixture(scope="module")
def con(sf):
    return check.duck(sf)


def test_every_query_has_sql_but_the_iterative_one():
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"gbt_quantile_band"}
    assert not set(ORACLE) - set(QUERIES)


@pytest.mark.parametrize("key", SAMPLE)
def test_query_equals_sql(spark, con, sf, key):
    msg, _, _ = check.compare(spark, con, sf, key, QUERIES[key], ORACLE[key])
    assert msg.startswith("ok"), msg


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 3


def test_cte_prefix_only_holds_what_is_read():
    sql = with_tables("SELECT count(*) FROM cleaning")
    assert "cleaning AS" in sql and "lines AS" not in sql


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_filter_reaches_the_scan(spark, sf):
    text = plan_of(QUERIES["dashboard_scope"](spark, sf))
    assert "PushedFilters" in text and "GreaterThanOrEqual(l_shipdate" in text


@pytest.mark.parametrize("key", ["oee_by_line", "changeovers", "plan_vs_agreed", "kpi_block", "interval_full_outer_join", "cross_candidates"])
def test_no_pair_products(spark, sf, key):
    text = plan_of(QUERIES[key](spark, sf))
    assert "CartesianProduct" not in text


def test_wide_hours_are_unfolded_from_one_scan(spark, sf):
    assert plan_of(QUERIES["loss_totals"](spark, sf)).count("FileScan parquet") == 1
    assert plan_of(QUERIES["dimension_impact"](spark, sf)).count("FileScan parquet") == 1
