"""Every registered query against its SQL on the smallest tables; those without SQL have to run."""

from __future__ import annotations

import pytest

from objectlake.plans import queries as core
from tests.conftest import SF_DIR


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_rows_as_sql(same_as_sql, name):
    same_as_sql(name)


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, name):
    df = core.queries()[name](spark, SF_DIR)
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filter_and_columns_reach_the_scan(spark):
    plan = core.queries()["predicate_and"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualNullSafe(lang,en)]" in plan
    assert "source" not in plan.split("ReadSchema")[1]
