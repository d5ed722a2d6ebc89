"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from labelloom.suite import QUERIES, SQL
from tests import oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    frames = []

    def function(spark, sf_dir):
        frames.append(QUERIES[name](spark, sf_dir))
        return frames[0]

    message, _, rows = oracle.compare(spark, con, name, function, SQL.get(name), sf_dir)
    assert message is None
    plan = frames[0]._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert unwanted not in plan
    assert rows > 0 or name == "rejected_rows"


def test_sql_only_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    # Floating-point sums of a training run have no SQL; test_plans holds them against numpy.
    assert set(QUERIES) - set(SQL) == {"training_epochs"}


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["text_clean", "label", "is_abstract"] and result.count() > 0
