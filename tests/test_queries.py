"""Registered queries against their SQL on the smallest data. VOXTABLE_ALL=1 runs every one of them."""
import os

import pytest

import __spark_entry__ as entry
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"
SOME = ("sentence_segments restated_sentences caption_chunks retake_candidates word_edges planned_keeps cut_points camera_plan "
        "varied_structure camera_pieces asr_words_precise request_stats").split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("VOXTABLE_ALL") else SOME


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    status, message, *_ = compare(spark, duck, FOLDER, name)
    assert status == "ok", message


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
