"""Every query of the core against its SQL over the smallest test tables."""

import pytest

from conftest import rows
from linesieve.plans import catalog

SQL = catalog.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(catalog.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir)
    if name in SQL:
        assert rows(got) == rows(duck.sql(SQL[name]).df())
    else:
        assert got.count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_does_not_need_the_training_data_subpackage():
    import pathlib

    root = pathlib.Path(catalog.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
