"""Every query against its SQL twin; queries without one give rows of a stable schema."""

import pytest
from comparing import same
from conftest import SMALL

from tracklume.plans import reference, reference_extra, reference_more, reference_new, reference_scale  # noqa: F401


@pytest.mark.parametrize("name", sorted(reference.ORACLES))
def test_matches_sql(spark, duck, name):
    same(reference.QUERIES[name](spark, SMALL).toPandas(), duck.sql(reference.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(reference.QUERIES) - set(reference.ORACLES)))
def test_gives_rows(spark, name):
    from tracklume.plans.session import ship

    df = reference.QUERIES[name](ship(spark), SMALL)
    assert df.count() > 0


def test_partitioning_does_not_matter(spark):
    from tracklume.operators.select import reservoir
    from tracklume.plans.views import candidates

    c = candidates(spark, SMALL)
    a = reservoir(c.repartition(1), cap=3).toPandas()
    b = reservoir(c.repartition(7), cap=3).toPandas()
    same(a, b)


def test_registry():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and set(reference.QUERIES) <= names
