from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "hybrid_search" in entry.queries()


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns[:3] == ["query_id", "rank", "score"]
    assert out.count() > 0


def test_pages_are_parsed_once(spark):
    """The queries that count extracts and chunks read stored ones."""
    from lanternflow.plans import content

    for name in ("pipeline_counts", "pipeline_totals"):
        plan = content.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" not in plan and "/extracts-" in plan
