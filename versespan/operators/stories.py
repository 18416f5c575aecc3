"""Story headings turned into per-chapter ranges, and their lookup by address."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versespan.functions import address as A
from versespan.operators.intervals import covering, interval_index
from versespan.operators.joins import (
    BROADCAST_ROWS, Checked, answer_once, explode_range, measured, next_position, repeat_rows,
    small_side,
)
from versespan.operators.lookup import parse_requests
from versespan.operators.ranges import with_blocks

_BOOK = ["language", "source_number", "book_number"]
_LAST = 2**40              # stands for NULL while ordering: NULLs come last
_CHAPTERS_PER_STRETCH = 1024


def headings_with_next(stories: DataFrame) -> DataFrame:
    """Distinct headings, how many copies each has, and the heading that follows.

    Copies are counted before anything is ordered. Among headings at one position all but
    the last (by title) are followed by that same position.
    """
    counted = stories.filter(
        F.col("language").isNotNull() & F.col("source_number").isNotNull()
        & F.col("book_number").isNotNull()
    ).groupBy(
        *_BOOK, F.coalesce(F.col("chapter").cast("bigint"), F.lit(_LAST)).alias("chapter"),
        F.coalesce(F.col("verse").cast("bigint"), F.lit(_LAST)).alias("verse"), "title",
    ).agg(F.count("*").alias("copies")).withColumn(
        "stretch", F.floor(F.col("chapter") / _CHAPTERS_PER_STRETCH))
    places = [*_BOOK, "stretch", "chapter", "verse"]
    last_title = counted.groupBy(*places).agg(F.max("title").alias("last_title"))
    following = next_position(last_title.select(*places), _BOOK, ["stretch", "chapter", "verse"])
    joined = counted.join(last_title, places).join(following, places)

    is_last = F.col("title").eqNullSafe(F.col("last_title"))
    here = F.struct(F.col("chapter").alias("chapter"), F.col("verse").alias("verse"),
                    (F.col("copies") - is_last.cast("int")).alias("copies"))
    there = F.struct(F.col("next_chapter").alias("chapter"), F.col("next_verse").alias("verse"),
                     is_last.cast("bigint").alias("copies"))
    split = joined.withColumn("_n", F.explode(F.filter(
        F.array(here, there), lambda n: n["copies"] > 0)))

    def real(x):
        return F.nullif(x, F.lit(_LAST))

    return split.select(
        *_BOOK, "title", real(F.col("chapter")).alias("start_chapter"),
        real(F.col("verse")).alias("start_verse"),
        real(F.col("_n.chapter")).alias("next_chapter"),
        real(F.col("_n.verse")).alias("next_verse"), F.col("_n.copies").alias("copies"))


def render_stories(stories: DataFrame, books: DataFrame, sources: DataFrame,
                   keep_last: bool = False) -> DataFrame:
    """One row per chapter a story covers: ``source, book, title, address, a, b``.

    A heading directly followed by another at the next verse is dropped. So is the last
    heading of a book, because nothing follows it; ``keep_last`` keeps that one, open to
    the end of its chapter.
    """
    start, begin = F.col("start_chapter"), F.col("start_verse")
    nxt, stop = F.col("next_chapter"), F.col("next_verse")
    keep = ~((nxt == start) & (stop == begin + 1))
    if keep_last:
        keep = F.coalesce(keep, nxt.isNull() & stop.isNull())
    at_chapter_start = stop.isNull() | (stop == 1)
    last = F.when(nxt > start, F.when(at_chapter_start, nxt - 1).otherwise(nxt)).otherwise(start)
    covered = headings_with_next(stories).filter(keep).withColumn("last_chapter", last).filter(
        start <= F.col("last_chapter"))
    covered = explode_range(covered, start, F.col("last_chapter"), "chapter")
    ends = (
        F.when(nxt == start, stop - 1)
        .when((nxt > start) & (F.col("chapter") == F.col("last_chapter")) & ~at_chapter_start,
              stop - 1)
    )
    ranged = covered.withColumn(
        "first", F.when(F.col("chapter") == start, begin).otherwise(F.lit(1))
    ).withColumn("last", ends)

    names = books.select(*_BOOK, F.col("short_name").alias("book"))
    titles = sources.select("language", "source_number", F.col("name").alias("source"))
    named = ranged.join(small_side(names), _BOOK).join(
        small_side(titles), ["language", "source_number"])
    upper = F.when(F.col("last").isNull(), F.lit(A.CHAPTER_END)) \
        .when(F.col("last") == 0, F.lit(1)).otherwise(F.col("last"))
    labelled = named.select(
        "source", "book", "title",
        A.story_label(F.col("book"), F.col("chapter"), F.col("first"), F.col("last"))
        .alias("address"),
        A.position(F.col("chapter"), F.col("first")).alias("a"),
        A.position(F.col("chapter"), upper).alias("b"),
        "language", "book_number", "start_chapter", "start_verse", "chapter", "copies")
    return repeat_rows(labelled, "copies")


STORY_COLUMNS = ["source", "book", "title", "address", "a", "b"]


def in_story_order(rendered: DataFrame) -> DataFrame:
    return rendered.orderBy(*[F.col(c).asc_nulls_last() for c in (
        "language", "source", "book_number", "start_chapter", "start_verse", "chapter")])


def story_index(rendered: DataFrame) -> DataFrame:
    """Rendered stories as an interval index by source and book, as a corpus stores them."""
    return interval_index(rendered.filter(F.col("a") < F.col("b")).select(
        *STORY_COLUMNS, F.col("a").alias("lo"), F.col("b").alias("hi")))


def ranges_asked(ranges: DataFrame) -> DataFrame:
    """Verse ranges ``(request_id, source, book, chapter, lo, hi)`` as the pieces an index is
    asked for, one per block."""
    pieces = with_blocks(ranges.select(
        "request_id", "source", "book", A.position(F.col("chapter"), F.col("lo")).alias("_lo"),
        A.position(F.col("chapter"), F.col("hi")).alias("_hi")), F.col("_lo"), F.col("_hi"))
    base = F.col("block") * A.POSITIONS_PER_CHAPTER
    return pieces.select(
        "request_id", "source", "book", F.col("block").cast("bigint").alias("block"),
        F.greatest("_lo", base).alias("first"),
        F.least(F.col("_hi"), base + (A.POSITIONS_PER_CHAPTER - 1)).alias("last"))


def stories_met(index: DataFrame, pieces: DataFrame, values: pa.Table | None) -> DataFrame:
    """Stories that cover verses of the pieces, a row per verse covered."""
    met = covering(index, pieces, ["source", "book"], values)
    covered = F.least("hi", "last") - F.greatest("lo", "first") + 1
    return repeat_rows(met.select("request_id", *STORY_COLUMNS, covered.alias("covered")),
                       "covered")


def fetch_stories(requests: DataFrame, rendered: DataFrame,
                  broadcast_rows: int = BROADCAST_ROWS) -> Checked:
    """Stories covering the verses of each ``(request_id, source, address)``.

    ``rendered`` holds the rendered stories, or the index ``story_index`` made of them, of
    which a request reads its blocks only. One row per covered verse, as many times as the
    address names it: address ranges stay ranges and only the overlap is written out.
    """
    index = rendered if "block" in rendered.columns else story_index(rendered)

    def answer(requested: DataFrame) -> DataFrame:
        parsed = parse_requests(requested).rows
        pieces, values = ranges_asked(parsed.filter(F.col("parts").isNotNull()).select(
            "request_id", "source", "book", "chapter", F.explode("parts").alias("_p")).select(
            "request_id", "source", "book", "chapter", "_p.lo", "_p.hi")), None
        if broadcast_rows:
            pieces, values = measured(pieces, broadcast_rows)
        return stories_met(index, pieces, values)

    asked = requests.select("request_id", "source", "address")
    return Checked(answer_once(asked, ["source", "address"], answer, broadcast_rows),
                   parse_requests(asked).rejects)
