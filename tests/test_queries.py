"""Every registered query of the reference's operators against its SQL, or for rows where it has none."""

import pytest
from compare import differences, duck

from lodestrand import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, con, name):
    assert differences(spark, con, plans.QUERIES[name], plans.SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_gives_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "item_id", "rank", "score", "sources", "evidence"]
    assert set(e.oracle_sql()) <= set(e.queries())
