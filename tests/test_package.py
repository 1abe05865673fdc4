"""Rules for the package as a whole."""

import pathlib
import re

import pytest

import __spark_entry__ as entry
from check import compare, duck

ROOT = pathlib.Path(__file__).resolve().parent.parent
SMOKE = "/root/testdata/sf0.001"
FORBIDDEN = r"toPandas|localCheckpoint|toLocalIterator|crossJoin|\.rdd\b|\bpickle\b"


@pytest.mark.parametrize("path", sorted((ROOT / "tessella").rglob("*.py")), ids=lambda p: p.name)
def test_rows_stay_on_the_executors(path):
    assert not re.findall(FORBIDDEN, path.read_text())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SMOKE)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    verdict, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SMOKE)
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["position", "column", "type"] and df.count() == 20
