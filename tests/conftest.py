import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]


@pytest.fixture(scope="session")
def spark():
    from check import session
    s = session()
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """rows("a bigint, b string", (1, "x"), ...) -> DataFrame"""
    return lambda schema, *data: spark.createDataFrame(list(data), schema)


@pytest.fixture(scope="session")
def words(spark):
    """Words from (text, start_s, end_s) triples of clip 1."""
    def make(*triples, clip=1):
        return spark.createDataFrame([(clip, i, t, round(a * 1e6), round(b * 1e6)) for i, (t, a, b) in enumerate(triples)],
                                     "clip_id bigint, i int, text string, start_us bigint, end_us bigint")
    return make
