"""Every registered query beside its oracle at the smallest scale.

The operators for training corpora have their own tests, in tests/llm.
"""

import pytest

import __spark_entry__ as entry
from check import compare, oracle_connection
from fcverify import catalog

SF = "/root/testdata/sf0.001"
NAMES = list(catalog.ORACLES)


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, oracle, name):
    assert compare(entry.queries()[name](spark, SF), oracle, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["icao", "n", "hits", "misses", "false_alarms", "correct_neg", "POD", "FAR", "CSI", "bias", "HSS"]


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
