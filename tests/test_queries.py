"""Each registered query of the engine against its SQL; those without SQL must run and have rows."""

import pytest
from oracle import DATA, check

from sparkloom.plans import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.ORACLES:
        check(spark, queries.QUERIES[name], queries.ORACLES[name])
    else:
        assert queries.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["api_endpoints", "graphql_operations", "captcha_flows"])
def test_order_of_rows_does_not_matter(spark, name, monkeypatch):
    from oracle import rows_of

    plain = queries.QUERIES[name](spark, DATA)
    whole = queries.view
    monkeypatch.setattr(queries, "view", lambda *a: whole(*a).orderBy("run_id").repartition(7))
    again = queries.QUERIES[name](spark, DATA)
    assert rows_of(plain.columns, plain.collect()) == rows_of(again.columns, again.collect())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
