"""Every registered query at the smallest scale: against its SQL, or rows only."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import oracle

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    assert oracle.difference(got, con.execute(sql).df()) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["vol_id", "label", "dice"] and df.count() > 0


def test_registry_has_no_orphan_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
