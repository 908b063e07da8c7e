"""Queries of this package that SQL can express, against DuckDB on the smallest test tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from oracle import agree, views

from strata.llm import entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_query(spark, name):
    agree(entry.QUERIES[name](spark, FOLDER), views(FOLDER), entry.ORACLE_SQL[name])
