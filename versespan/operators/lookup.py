"""Address requests against the verse table."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versespan.functions import address as A
from versespan.functions import text as X
from versespan.operators.joins import (
    BROADCAST_ROWS, PRUNED_VALUES, Checked, answer_once, computed, explode_range, measured, pruned,
)


def parse_requests(requests: DataFrame, column: str = "address") -> Checked:
    """Requests with ``book, chapter, parts``; blank addresses give no row."""
    parsed = computed(requests, A.parse_address(F.col(column)), "_a")
    good = parsed.filter(F.col("_a.book").isNotNull() & F.col("_a.error").isNull())
    rows = good.select(*requests.columns, F.col("_a.book").alias("book"),
                       F.col("_a.chapter").alias("chapter"), F.col("_a.parts").alias("parts"))
    rejects = parsed.filter(F.col("_a.error").isNotNull()).select(
        "request_id", F.col("_a.error").alias("reason"))
    return Checked(rows, rejects)


def _parse_once(requests: DataFrame) -> Checked:
    """``parse_requests``, reading each different address once where few of them repeat; these
    are estimated first, so that others are not gathered to find that out."""
    addresses = requests.select("address")
    if addresses.agg(F.approx_count_distinct("address")).first()[0] > 1.2 * BROADCAST_ROWS:
        return parse_requests(requests)
    few, values = measured(addresses.distinct())
    if values is None:
        return parse_requests(requests)
    rows, rejects = parse_requests(few.select(F.col("address").alias("request_id"), "address"))
    fields = ["book", "chapter", "parts"]
    return Checked(
        requests.join(F.broadcast(rows.select("address", *fields)), "address").select(
            *requests.columns, *fields),
        requests.join(F.broadcast(rejects.withColumnRenamed("request_id", "address")),
                      "address").select("request_id", "reason"))


def parse_addresses(requests: DataFrame) -> Checked:
    """One row per ``(request_id, book, chapter, verse)`` named by an address."""
    rows, rejects = _parse_once(requests)
    anything = F.array(F.struct(F.lit(None).cast("int").alias("lo"),
                                F.lit(None).cast("int").alias("hi")))
    ranges = rows.withColumn("_r", F.explode(F.coalesce("parts", anything)))
    verses = explode_range(ranges, F.col("_r.lo"), F.col("_r.hi"), "verse")
    return Checked(verses.select("request_id", "book", "chapter", F.col("verse").cast("int")
                                 .alias("verse")), rejects)


def book_numbers(books: DataFrame) -> DataFrame:
    """Distinct (short name, book number) over all languages."""
    return books.select(F.col("short_name").alias("book"), "book_number").distinct()


def chapter_directory(verses: DataFrame) -> DataFrame:
    """The chapters each source has: a small table that turns wildcards into keys."""
    return verses.select("source", "book_number", "chapter").distinct()


def stored_directory(verses: DataFrame) -> DataFrame:
    """The same with the language each source's chapter is stored under, the book's name, and
    how many verses it has."""
    return verses.groupBy("language", "source", "book", "book_number", "chapter").agg(
        F.count("*").alias("n"))


def first_chapters(wanted: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """Of the chapters each request names, those that can hold one of its first ``k`` verses in
    canonical order.

    Verse counts are added up in the order of the chapters, so the chapters are known before a
    verse is read. Rows that name verses of a chapter (``parts``) are left as they are.
    """
    key = ["source", "book_number", "chapter"]
    sizes = counts.groupBy(*key).agg(F.sum("n").alias("n"))
    whole = wanted.filter(F.col("parts").isNull())
    place = ["request_id", "book_number", "chapter"]
    totals = whole.join(sizes, key, "left").groupBy(*place).agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    before = F.sum("n").over(Window.partitionBy("request_id").orderBy(
        "book_number", "chapter").rowsBetween(Window.unboundedPreceding, -1))
    kept = totals.withColumn("_before", F.coalesce(before, F.lit(0))).filter(
        F.col("_before") < k).select(*place)
    return wanted.filter(F.col("parts").isNotNull()).unionByName(
        whole.join(kept, place, "left_semi").select(*wanted.columns))


ID_PARTS = ["language", "source_number", "book_number", "chapter", "verse"]


def with_ids(verses: DataFrame, ids: DataFrame, keyed: bool = False) -> DataFrame:
    """Verses joined with rows that carry their ``id``.

    ``keyed`` says that ids are made of the verse's own columns, as in a stored corpus: few
    ids then prune what is read.
    """
    small, values = measured(ids)
    if keyed and values is not None:
        listed = ids.sparkSession.createDataFrame(
            [(i,) for i in pc.unique(values.column("id")).to_pylist()], "verse_id string")
        parts = split_ids(listed.withColumn("request_id", F.lit(0))).rows
        verses = pruned(verses, measured(parts.select(*ID_PARTS)).values, ID_PARTS)
    return verses.join(small, "id")


def wanted_chapters(requests: DataFrame, books: DataFrame, verses: DataFrame,
                    chapters: DataFrame | None = None) -> Checked:
    """Requests as fully keyed rows ``(request_id, source, book_number, chapter, parts)``.

    A request that leaves out the source or the chapter is expanded over the chapters
    that exist, so every request then meets the verses through one equi-join on a fine
    key instead of an OR over NULLs on one coarse, possibly hot, key. The directory is
    offered under each key a request may lack a part of; fully keyed requests match none
    of them and pass through.
    """
    parsed, rejects = parse_requests(requests.select("request_id", "address", "source"))
    keyed = parsed.join(book_numbers(books), "book").select(
        "request_id", "source", "book_number", "chapter", "parts",
        F.col("source").isNull().alias("_any"), F.coalesce("source", F.lit("")).alias("_source"),
        F.coalesce("chapter", F.lit(-1)).alias("_chapter"))
    any_source, any_chapter = (F.lit(True), F.lit("")), F.lit(-1)
    keys = [(F.lit(False), F.col("source"), any_chapter), (*any_source, F.col("chapter")),
            (*any_source, any_chapter)]
    have = (chapters if chapters is not None else chapter_directory(verses)).select(
        "source", "book_number", "chapter").distinct().select(
        F.col("source").alias("_s"), "book_number", F.col("chapter").alias("_c"),
        F.inline(F.array(*[F.struct(o.alias("_any"), s.alias("_source"), c.alias("_chapter"))
                           for o, s, c in keys])))
    rows = keyed.join(have, ["book_number", "_any", "_source", "_chapter"], "left").select(
        "request_id", F.coalesce("source", "_s").alias("source"), "book_number",
        F.coalesce("chapter", "_c").alias("chapter"), "parts").filter(
        F.col("source").isNotNull() & F.col("chapter").isNotNull())
    return Checked(rows, rejects)


def in_languages(verses: DataFrame, values, chapters: DataFrame | None) -> DataFrame:
    """``verses`` in the languages of the sources asked for, if the directory names them."""
    if values is None or chapters is None or "language" not in chapters.columns:
        return verses
    named = pruned(chapters, values, ["source"]).select("language").distinct()
    languages = named.limit(PRUNED_VALUES + 1).collect()
    if len(languages) > PRUNED_VALUES:
        return verses
    return verses.filter(F.col("language").isin([r["language"] for r in languages]))


def counted(chapters: DataFrame | None) -> bool:
    """Whether a directory counts the verses of its chapters."""
    return chapters is not None and "n" in chapters.columns


def fetch_verses(requests: DataFrame, verses: DataFrame, books: DataFrame,
                 chapters: DataFrame | None = None,
                 broadcast_rows: int = BROADCAST_ROWS, first: int | None = None) -> Checked:
    """Verses of each request ``(request_id, address, source or NULL)``.

    If only the ``first`` verses in canonical order are wanted, and ``chapters`` counts verses
    (``n``), chapters that can hold none of them are not read. A request finds each verse once. The verse table is read once and, while the requests
    or at least the different questions among them are few, never shuffled.
    """
    def answer(asked: DataFrame) -> DataFrame:
        wanted, stored = wanted_chapters(asked, books, verses, chapters).rows, verses
        if first is not None and counted(chapters):
            wanted = first_chapters(wanted, chapters, first)
        if broadcast_rows:
            wanted, values = measured(wanted, broadcast_rows)
            stored = in_languages(pruned(verses, values, ["source", "book_number", "chapter"]),
                                  values, chapters)
        found = stored.join(wanted, ["source", "book_number", "chapter"]).filter(
            A.contains_verse(F.col("parts"), F.col("verse")))
        return found.select("request_id", *[F.col(c) for c in verses.columns])

    asked = requests.select("request_id", "address", "source")
    return Checked(answer_once(asked, ["address", "source"], answer, broadcast_rows),
                   parse_requests(asked).rejects)


def canonical_order() -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in
            ("book_number", "chapter", "verse", "language", "source", "id")]


def in_canonical_order(df: DataFrame) -> DataFrame:
    """Presentation order; a range shuffle, so ask for it only when rows are shown."""
    return df.orderBy("request_id", *canonical_order())


# The order each table is presented in.
PRESENTED = {
    "books": ["language", "book_number"],
    "sources": ["id"],
    "stories": ["language", "source_number", "book_number", "chapter", "verse"],
    "dictionary": ["language", "source_number"],
}


def in_table_order(df: DataFrame, table: str) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in PRESENTED[table]])


def split_ids(requests: DataFrame) -> Checked:
    """Requests ``(request_id, verse_id)`` with the parts of the id as columns."""
    parsed = computed(requests, A.split_verse_id(F.col("verse_id")), "_v")
    fields = ("language", "source_number", "book_number", "chapter", "verse")
    rows = parsed.filter(F.col("_v.error").isNull()).select(
        *requests.columns, *[F.col(f"_v.{f}").alias(f) for f in fields])
    rejects = parsed.filter(F.col("_v.error").isNotNull()).select(
        "request_id", F.col("_v.error").alias("reason"))
    return Checked(rows, rejects)


def verse_metadata(requests: DataFrame, verses: DataFrame, keyed: bool = False) -> DataFrame:
    """Tag values of requested verses as a map; for ``keyed`` see ``with_ids``."""
    ids = requests.select("request_id", F.col("verse_id").alias("id"))
    return with_ids(verses, ids, keyed).select(
        "request_id", F.col("id").alias("verse_id"),
        X.collect_tags(F.col("text")).alias("metadata"))


def list_sources(sources: DataFrame, query: Column | None = None) -> DataFrame:
    """Sources for a picker, filtered by a case-insensitive substring when one is given."""
    rows = sources.select(
        F.coalesce("language", F.lit("unknown")).alias("language"), "name",
        F.coalesce("description_short", F.lit("")).alias("description_short"))
    if query is None:
        return rows
    hay = F.lower(F.concat_ws(" ", "name", "description_short"))
    return rows.filter((query == "") | F.contains(hay, F.lower(query)))


def sources_by_language(sources: DataFrame) -> DataFrame:
    """Sorted source names per language."""
    return sources.groupBy("language").agg(
        F.sort_array(F.collect_list("name")).alias("names"))


def decode_verses(rows: DataFrame) -> DataFrame:
    """Client records: the id falls back to ``id`` and then to ``source:address``."""
    ids = [F.col(c) for c in ("verse_id", "id") if c in rows.columns]
    fallback = F.concat(F.col("source"), F.lit(":"), F.col("address"))
    return rows.select("book_number", "chapter", "verse",
                       F.coalesce(*ids, fallback).alias("verse_id"),
                       "language", "source", "address", "text")


def flag_psalms(found: DataFrame, psalms: int = 230) -> DataFrame:
    """Whether any verse of a request belongs to the book of psalms."""
    return found.groupBy("request_id").agg(
        F.bool_or(F.col("book_number") == psalms).alias("is_psalms"))
