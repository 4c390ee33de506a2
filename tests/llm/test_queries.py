"""Queries against their SQL, and whatever must hold for all of them."""

import re

import pytest
from check import compare

from faultline.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, small, key):
    assert compare(QUERIES[key](spark, small), ORACLES[key], small) is None


def test_every_dealt_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("key", ["op4_html_extraction", "op6_licences", "op10_sharding"])
def test_a_row_for_every_row(spark, small, key):
    source = "pages" if key.startswith("op4") else "documents"
    assert QUERIES[key](spark, small).count() == spark.read.parquet(f"{small}/{source}.parquet").count()
