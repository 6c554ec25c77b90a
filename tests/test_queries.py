"""Every registered query of the engine's own operators against its SQL, and those without SQL for their rows."""

import pytest

from brindle.plans import queries as plans

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, spark, sf, same):
    same(QUERIES[name](spark, sf), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = QUERIES["autopause"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "value" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_searches_read_the_stored_index(spark, sf):
    """A prefix reaches the scan of the sorted postings, and no text is read to match."""
    from brindle.functions import text as T
    from brindle.operators import search as S

    postings, n = plans._index(spark, sf)
    plan = S.match(postings, T.parse_query('"in the" th'), n)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,th)" in plan and "EqualTo(token,in)" in plan and "content_text" not in plan
    assert plans._index(spark, sf)[0].inputFiles() == postings.inputFiles()
    tokens = [r["token"] for r in postings.select("token").collect()]
    assert len(set(tokens)) < len(tokens)
