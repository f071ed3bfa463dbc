import pytest

from lumenfold.plans import changes, registry  # noqa: F401

from .compare import connect, same

SF = "/root/testdata/sf0.01"
#: Queries whose result is rightly empty there.
EMPTY = {"text_malformed"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(name, spark, con):
    assert bool(same(registry.QUERIES[name](spark, SF), con, registry.ORACLE_SQL[name])) == (name not in EMPTY)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_without_sql(name, spark):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 60
    assert set(e.oracle_sql()) <= set(e.queries())
