"""Every registered query against its DuckDB oracle on the same tables."""

import pytest
from conftest import SMALL
from oracle import compare

from severa.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLES:
        assert not compare(df, ORACLES[name], SMALL)
    else:
        assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_native_plans_hold_no_python(spark):
    python = {"prj21_search_names", "fn05_name_similarity", "win12_coverage_mask", "ml29_clusters", "src05_html_tables", "str06_rate_limiter"}
    for name in sorted(ORACLES.keys() - python):
        if name.startswith(("agg", "prj", "flt", "top", "jn", "win")):
            plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
            assert not any(x in plan for x in ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "CartesianProduct")), name
