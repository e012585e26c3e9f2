"""Sides of a join that grow with the input are never sent to the driver."""

import pytest

from palimpsest.plans import catalogue

SETTINGS = {"spark.sql.maxBroadcastTableSize": "1000"}


@pytest.fixture
def no_broadcast(spark):
    """A session in which a broadcast of more than 1,000 bytes is an error."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k in SETTINGS:
        spark.conf.unset(k)


@pytest.mark.parametrize("name", ["sheet_difference_summary", "sheet_differences", "sheet_top_snippets", "sheet_text_report", "sheet_ratios", "sheet_report", "sheet_summary", "sheet_reasons", "sheet_sentences", "sheet_recap"])
def test_rows_are_not_broadcast(no_broadcast, name):
    assert catalogue.QUERIES[name](no_broadcast, "/root/testdata/sf0.001").collect()
