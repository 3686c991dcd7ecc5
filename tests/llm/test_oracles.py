"""The corpus queries that have SQL, beside it."""
import pytest

from check import compare, connect
from voxtable.llm import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    status, message, *_ = compare(spark, duck, FOLDER, name)
    assert status == "ok", message
