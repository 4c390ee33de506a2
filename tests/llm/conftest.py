import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from faultline.session import prepare  # noqa: E402

SMALL = "/root/testdata/sf0.001"
T0 = datetime(2025, 1, 1)  # as in ../conftest.py: in a run over both folders, `conftest` is this module
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or longer rows."""
    prepare(spark)

    def build(rows, schema=DOCS):
        width = len(schema.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return build


@pytest.fixture(scope="session")
def corpus(spark, small):
    """(doc_id, text) rows of the smallest documents table."""
    return [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
