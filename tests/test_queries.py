"""Every registered query against its SQL, on the smallest tables."""

import importlib.util
import os

import compare
import pytest

from inkbar.plans.oracles import ORACLES
from inkbar.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
_path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
_spec = importlib.util.spec_from_file_location("spark_entry", _path)
entry = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(entry)


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


def test_every_query_has_its_statement():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = compare.spark_result(entry.queries()[name](spark, SF))
    assert got == compare.duck_result(duck, entry.oracle_sql()[name])
