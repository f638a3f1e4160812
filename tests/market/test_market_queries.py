"""Every registered market query against its SQL form on the same files."""

import pytest

from barloom.plans import market
from barloom.plans.compare import difference, oracle_frame


@pytest.mark.parametrize("name", sorted(market.QUERIES))
def test_query(spark, sf_dir, name):
    frame = market.QUERIES[name](spark, sf_dir).toPandas()
    if name in market.ORACLE:
        assert difference(frame, oracle_frame(market.ORACLE[name], sf_dir)) == ""


def test_entry_names(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert market.flagship(spark, sf_dir).count() == 2
