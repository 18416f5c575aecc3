"""Every registered query against its SQL, on the smallest driver tables."""

from __future__ import annotations

import check_oracle
import pytest

import __spark_entry__ as entry

from versespan.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    return check_oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    ok, note = check_oracle.compare(spark, duck, name, sf_dir)
    assert ok, note


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.limit(1).count() == 1 and "request_id" in df.columns
