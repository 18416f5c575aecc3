"""The first verses of an address, read from the chapters that hold them."""

from __future__ import annotations

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from versespan.operators import export, lookup, search


@pytest.fixture
def corpus(spark, tmp_path):
    """Two sources of one book, twelve chapters of five verses."""
    verses = spark.range(240).selectExpr(
        "int(id % 12 + 1) chapter", "int(floor(id / 12) % 10 + 1) verse", "floor(id / 120) s").selectExpr(
        "concat('la/', s, '/500/', chapter, '/', verse) id", "'la' language", "concat('S', s) source",
        "'J' book", "'John' book_name", "concat('J ', chapter, ',', verse) address",
        "int(s) source_number", "500 book_number", "chapter", "verse", "'t' text")
    verses.repartitionByRange("source", "chapter").write.partitionBy("language").parquet(
        str(tmp_path / "verses"))
    stored = spark.read.parquet(str(tmp_path / "verses")).select(*verses.columns)
    books = spark.createDataFrame([("la", 0, 500, "J"), ("la", 1, 500, "J")],
                                  "language string, source_number int, book_number int, short_name string")
    lookup.stored_directory(stored).write.parquet(str(tmp_path / "chapters"))
    return stored, books, spark.read.parquet(str(tmp_path / "chapters"))


ASKED = "request_id int, address string, source string"


@pytest.mark.parametrize("k", [1, 10, 11, 25, 1000])
def test_the_same_verses_as_without_counts(frame, corpus, k):
    verses, books, chapters = corpus
    asked = frame(ASKED, (1, "J", "S0"), (2, "J", None), (3, "J 3", None), (4, "J 5,2-4.9", "S1"),
                  (5, "X", None), (6, "J 99", "S0"), (7, "J", "none"), (1, "J", "S0"))
    plain = search.browse(asked, verses, books, k, chapters.drop("n")).rows
    counted = search.browse(asked, verses, books, k, chapters).rows
    assert rows(counted, "request_id", "rank") == rows(plain, "request_id", "rank")
    assert sorted({(r["request_id"], r["id"]) for r in counted.collect()}) == sorted(
        {(r["request_id"], r["id"]) for r in plain.collect()})


def _scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [re.sub(r"#\d+", "", line) for line in plan.splitlines() if "Filter" in line]


def test_only_the_first_chapters_are_read(frame, corpus):
    verses, books, chapters = corpus
    found = search.browse(frame(ASKED, (1, "J", "S0")), verses, books, 15, chapters).rows
    assert any("chapter IN (1,2)" in s for s in _scans(found))
    assert found.count() == 15 and found.agg(F.max("chapter")).first()[0] == 2


def test_export_reads_the_chapters_it_names(frame, corpus):
    verses, _, chapters = corpus
    found = export.export_rows(frame(ASKED, (1, "J 3,1-2", "S1"), (2, "J 4", "S1")), verses, chapters).rows
    assert found.count() == 12
    assert any("chapter IN (3,4)" in s for s in _scans(found))
