"""Every registered query against its SQL oracle on the smallest data."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_module  # noqa: E402
from snapgate.queries import ORACLES, QUERIES  # noqa: E402
from tools.check_oracle import compare, open_tables  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    if not Path(FOLDER).exists():
        pytest.skip("test tables are not here")
    return open_tables(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, FOLDER)
    if name not in ORACLES:
        assert df.count() > 0
        return
    assert compare(df, tables, ORACLES[name]) == []


def test_entry(spark):
    assert entry_module.entry(spark).count() == 9


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_offers_every_query():
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLES) <= set(entry_module.oracle_sql())
