import os

import pytest
from oracle import compare

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_agrees_with_its_sql(spark, name):
    assert compare(spark, name, FOLDER) is None


def test_entry_gives_two_hits_per_item(spark):
    found = entry.entry(spark)
    assert found.columns == ["item_id", "rank", "doc_id", "chunk_no", "score"]
    assert found.count() == 80


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
