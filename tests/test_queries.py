"""Every query over the smallest tables against its SQL twin; those without one must give rows."""

from __future__ import annotations

import oracle
import pytest
from lodestream.plans import adapters, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, db, name):
    found = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        assert oracle.difference(found, db, registry.ORACLE_SQL[name]) is None
    else:
        assert found.count() > 0


@pytest.mark.parametrize("name", ["recommendation_plan", "score_by_category", "score_overall", "baseline_statuses"])
def test_findings_are_dealt_by_rows(spark, db, monkeypatch, name):
    """More rows make more tasks, and the results stay."""
    monkeypatch.setattr(adapters, "DEALT_ROWS", 500)
    found = registry.QUERIES[name](spark, SF)
    assert "Exchange hashpartitioning(l_orderkey" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 12), REPARTITION_BY_NUM" in plan
    assert oracle.difference(found, db, registry.ORACLE_SQL[name]) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
