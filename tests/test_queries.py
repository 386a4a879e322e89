"""Every registered query against its SQL (or for rows only) on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SLOW_MODELS = {n for n in QUERIES if n.startswith("classify_")}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    problems = compare(QUERIES[name](spark, sf), ORACLES[name], con)
    assert [p for p in problems if p != "no rows"] == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW_MODELS))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(SLOW_MODELS))
def test_classifiers_judge_every_test_row(spark, sf, name):
    """The labels of these vectors say nothing about them, so accuracy is tested on other data (test_operators, test_models)."""
    rows = QUERIES[name](spark, sf).collect()
    assert sorted(r.sample_id for r in rows) == [i for i in range(max(r.sample_id for r in rows) + 1) if i % 5 == 0]
    assert {r.pred for r in rows} <= {r.truth for r in rows} | set(range(10))


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
