"""Hot keys: a third of the rows on one key, joins shuffled and split, results unchanged."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from versespan import schemas
from versespan.operators import commentaries, joins, lookup, references, search, stories


@pytest.fixture
def skewed(spark):
    """Shuffled joins only, with a split threshold small enough to matter here."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield spark
    for name in settings:
        spark.conf.unset(name)


@pytest.fixture
def hot_requests(spark):
    """Every third request asks for the same verses."""
    n = F.col("id")
    return spark.range(3000).select(
        n.cast("int").alias("request_id"),
        F.when(n % 3 == 0, "B7 1,1-3").otherwise(F.concat(
            F.lit("B"), (n % 40).cast("string"), F.lit(" "), (1 + n % 4).cast("string"),
            F.lit(",2."), (3 + n % 5).cast("string"))).alias("address"),
        F.when(n % 7 == 0, F.lit(None)).otherwise(F.concat(
            F.lit("S"), (n % 3).cast("string"))).alias("source"))


@pytest.fixture
def corpus(spark):
    """Three sources; one book holds a third of the verses."""
    n = F.col("id")
    book = F.when(n % 3 == 0, 7).otherwise(n % 40).cast("int")
    places = spark.range(6000).select(
        (n % 3).cast("int").alias("source_number"), book.alias("book_number"),
        (1 + F.floor(n / 3) % 4).cast("int").alias("chapter"),
        (1 + F.floor(n / 12) % 9).cast("int").alias("verse")).distinct()
    name = F.concat(F.lit("B"), F.col("book_number").cast("string"))
    return places.select(
        F.concat_ws("/", F.lit("l"), "source_number", "book_number", "chapter", "verse")
        .alias("id"), F.lit("l").alias("language"),
        F.concat(F.lit("S"), F.col("source_number").cast("string")).alias("source"),
        name.alias("book"), name.alias("book_name"), F.lit("a").alias("address"),
        "source_number", "book_number", "chapter", "verse", F.lit("t").alias("text"))


@pytest.fixture
def books(corpus):
    return corpus.select("language", "source_number", "book_number",
                         F.col("book").alias("short_name")).distinct()


def test_fetch_verses(skewed, corpus, books, hot_requests):
    def answer(limit):
        found = lookup.fetch_verses(hot_requests, corpus, books, broadcast_rows=limit).rows
        return found.groupBy("request_id").agg(F.count("*"), F.sum(F.crc32("id")))

    few = hot_requests.select("address", "source").distinct().count()
    assert few < hot_requests.count()       # the middle limit asks each question once
    assert rows(answer(0)) == rows(answer(few)) == rows(answer(10**6))


def test_a_hot_chapter_is_split(skewed, spark):
    n = F.col("id")
    verses = spark.range(0, 60000, 1, 16).select(
        n.cast("string").alias("id"), F.lit("l").alias("language"), F.lit("S").alias("source"),
        F.when(n % 3 == 0, 7).otherwise(n % 400).cast("int").alias("book_number"),
        F.when(n % 3 == 0, 1).otherwise(1 + n % 7).cast("int").alias("chapter"),
        (n % 999).cast("int").alias("verse"))
    books = spark.range(400).select(n.cast("int").alias("book_number"), F.concat(
        F.lit("B"), n.cast("string")).alias("short_name"))
    asked = spark.range(900).select(n.alias("request_id"), F.concat(
        F.lit("B"), (n % 400).cast("string"), F.lit(" 1,5")).alias("address"),
        F.lit("S").alias("source"))
    found = lookup.fetch_verses(asked, verses, books, broadcast_rows=0).rows
    found.collect()
    assert "SortMergeJoin(skew=true)" in found._jdf.queryExecution().executedPlan().toString()


def test_commentaries(skewed, corpus, hot_requests):
    ids = hot_requests.select("request_id", F.when(
        F.col("request_id") % 3 == 0, "l/0/7/1/2").otherwise(F.concat(
            F.lit("l/0/7/"), (F.col("request_id") % 5).cast("string"), F.lit("/3")))
        .alias("verse_id"))
    notes = corpus.select(
        "language", "source_number", "book_number",
        F.col("chapter").alias("chapter_number_from"), F.col("verse").alias("verse_number_from"),
        (F.col("chapter") + F.col("verse") % 3).cast("int").alias("chapter_number_to"),
        (F.col("verse") + 2).alias("verse_number_to"), F.col("id").alias("marker"), "text")

    def answer(limit):
        return commentaries.fetch_commentaries(ids, notes, limit).rows.groupBy(
            "request_id").agg(F.count("*"), F.sum(F.crc32("marker")))

    assert rows(answer(0)) == rows(answer(100)) == rows(answer(10**6)) != []


def test_references_by_verse(skewed, spark, books, hot_requests):
    n = F.col("id")
    refs = spark.range(4000).select(
        F.when(n % 3 == 0, 7).otherwise(n % 40).cast("int").alias("book_number"),
        (1 + n % 4).cast("int").alias("chapter"), (1 + n % 9).cast("int").alias("verse"),
        (n % 40).cast("int").alias("b1"), F.lit(1).alias("c1"), (n % 50).cast("int").alias("v1"),
        *[F.lit(None).cast("int").alias(c) for c in ("b2", "c2", "v2")],
        n.cast("int").alias("rate"))
    ids = hot_requests.select("request_id", F.when(
        F.col("request_id") % 3 == 0, "l/0/7/1/1").otherwise(F.concat(
            F.lit("l/0/7/"), (F.col("request_id") % 5).cast("string"), F.lit("/3")))
        .alias("verse_id"))

    def answer(limit):
        return references.cross_references(ids, refs, books, limit).rows

    assert rows(answer(0)) == rows(answer(100)) == rows(answer(10**6)) != []


def test_stories_by_address(skewed, spark, hot_requests):
    rendered = spark.range(400).selectExpr(
        "concat('S', id % 3) source", "concat('B', if(id % 3 = 0, 7, id % 40)) book",
        "concat('t', id) title", "'x' address", "1000 * (1 + id % 4) + id % 3 a",
        "1000 * (1 + id % 4) + 2 + id % 5 b")
    asked = hot_requests.withColumn("source", F.coalesce("source", F.lit("S1")))

    def answer(limit):
        found = stories.fetch_stories(asked, rendered, limit).rows
        return found.groupBy("request_id", "title").count()

    few = asked.select("address", "source").distinct().count()
    assert rows(answer(0)) == rows(answer(few)) == rows(answer(10**6)) != []


def test_references(skewed, spark, books, hot_requests):
    n = F.col("id")
    refs = spark.range(4000).select(
        F.when(n % 3 == 0, 7).otherwise(n % 40).cast("int").alias("book_number"),
        (1 + n % 4).cast("int").alias("chapter"), (1 + n % 9).cast("int").alias("verse"),
        (n % 40).cast("int").alias("b1"), F.lit(1).alias("c1"), (n % 50).cast("int").alias("v1"),
        *[F.lit(None).cast("int").alias(c) for c in ("b2", "c2", "v2")],
        n.cast("int").alias("rate"))
    sources = books.select("language", "source_number", F.concat(
        F.lit("S"), F.col("source_number").cast("string")).alias("name")).distinct()

    def answer(limit):
        return references.cross_references_by_address(
            hot_requests, refs, books, sources, limit).rows

    assert rows(answer(0)) == rows(answer(10**6)) != []


def test_stories_with_hot_book_and_copies(skewed, spark):
    headings = spark.range(900).selectExpr(
        "'l' language", "1 source_number", "cast(if(id % 3 = 0, 7, id % 5) as int) book_number",
        "cast(1 + id % 30 as int) chapter", "cast(1 + id div 30 as int) verse",
        "concat('t', id % 4) title")
    many = headings.unionByName(headings.filter("chapter = 2"))
    books = headings.select("language", "source_number", "book_number", F.concat(
        F.lit("B"), F.col("book_number").cast("string")).alias("short_name")).distinct()
    sources = spark.sql("select 'l' language, 1 source_number, 'S' name")
    got = stories.render_stories(many, books, sources)

    expected = []
    groups: dict = {}
    for r in many.collect():
        groups.setdefault(r["book_number"], []).append((r["chapter"], r["verse"], r["title"]))
    for book, listed in groups.items():
        listed.sort()
        for (c, v, title), (nc, nv, _) in zip(listed, listed[1:]):
            if nc == c and nv == v + 1:
                continue
            last = c if nc == c else (nc - 1 if nv == 1 else nc)
            for chapter in range(c, last + 1):
                begin = v if chapter == c else 1
                end = None
                if nc == c or (chapter == last and nv != 1):
                    end = nv - 1
                upper = 999 if end is None else (1 if end == 0 else end)
                expected.append((f"B{book}", title, 1000 * chapter + begin,
                                 1000 * chapter + upper))
    assert rows(got, "book", "title", "a", "b") == sorted(expected, key=repr)


def test_top_k_with_one_hot_request(skewed, spark):
    scored = spark.range(9000).selectExpr(
        "cast(if(id % 3 > 0, 1, id % 10) as int) request_id", "(id * 7919) % 1000 distance",
        "cast(id as string) id")
    got = joins.top_per_request(scored, "request_id", search._nearest_first(), 5, F.col("id"))
    everything: dict = {}
    for r in scored.collect():
        everything.setdefault(r["request_id"], []).append((r["distance"], r["id"]))
    expected = [(k, rank, i) for k, v in everything.items()
                for rank, (_, i) in enumerate(sorted(v)[:5], 1)]
    assert rows(got, "request_id", "rank", "id") == sorted(expected, key=repr)


def test_schema_of_corpus_is_canonical(corpus):
    assert corpus.columns == schemas.VERSES.names
