"""Every core query against its SQL on the smallest tables."""

import importlib.util
import os

import pytest

from siltstone.catalog import ORACLES, QUERIES
from tests.compare import connection, difference

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


#: What the tables of scale 0.001 have no rows for; at 0.01 every query has some.
MAY_BE_EMPTY = {"facet_deprecated", "facet_strict_target"} if SF.endswith("0.001") else set()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None
    assert name in MAY_BE_EMPTY or con.execute(ORACLES[name]).fetchone() is not None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and not df.isEmpty()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    try:
        extra = importlib.util.find_spec("siltstone.llm.registry") is not None
    except ModuleNotFoundError:
        extra = False
    assert ("p1_found" in __spark_entry__.queries()) == extra


def test_the_core_does_not_import_the_training_subpackage():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "siltstone"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "siltstone.llm" not in f.read_text()
