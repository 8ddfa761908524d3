import pytest

from trawl.plans import catalog, storage  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(same, name):
    same(catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry_has_no_training_names_but_from_their_package():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
