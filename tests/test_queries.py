"""Every registered query of the library against its SQL."""

import pytest
from conftest import DATA, same_rows

from tallyveil.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df())


def test_noised_summary(spark):
    exact = {r.bucket: r.metric for r in QUERIES["histogram_summary"](spark, DATA).collect()}
    out = QUERIES["noised_summary"](spark, DATA)
    once, twice = ({r.bucket: r.metric for r in out.collect()} for _ in range(2))
    assert once == twice and set(once) == set(exact)
    assert any(once[b] != exact[b] for b in exact)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.queries()["histogram_summary"](spark, DATA).count() > 0
