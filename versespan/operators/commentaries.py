"""Commentaries whose verse interval covers a requested verse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versespan.functions import address as A
from versespan.functions import text as X
from versespan.operators.intervals import covering, interval_index
from versespan.operators.joins import BROADCAST_ROWS, Checked, answer_once, measured, small_side
from versespan.operators.lookup import split_ids
from versespan.operators.ranges import clip_to, with_blocks

_BOOK = ["language", "source_number", "book_number"]


_SHOWN = ["marker", "text", "chapter_from", "verse_from"]


def _spans(commentaries: DataFrame) -> DataFrame:
    return commentaries.select(
        *_BOOK, F.col("chapter_number_from").alias("chapter_from"),
        F.col("verse_number_from").alias("verse_from"), "marker", "text",
        A.position(F.col("chapter_number_from"), F.col("verse_number_from")).alias("lo"),
        A.position(F.col("chapter_number_to"), F.col("verse_number_to")).alias("hi"),
    ).filter(F.col("lo") <= F.col("hi"))


def commentary_index(commentaries: DataFrame) -> DataFrame:
    """Commentaries as an interval index by book, as a corpus stores them."""
    return interval_index(_spans(commentaries).select(*_BOOK, *_SHOWN, "lo", "hi"))


def points_of(ids: DataFrame) -> DataFrame:
    """Verses ``(request_id, book, chapter, verse)`` as points an index is asked for."""
    pos = A.position(F.col("chapter"), F.col("verse"))
    return ids.select("request_id", *_BOOK, A.block(pos).cast("bigint").alias("block"),
                      pos.alias("first"), pos.alias("last"))


def fetch_commentaries(requests: DataFrame, commentaries: DataFrame,
                       broadcast_rows: int = BROADCAST_ROWS) -> Checked:
    """Marker and text for each ``(request_id, verse_id)``.

    ``commentaries`` is the table, or the index ``commentary_index`` made of it. Of an index a
    point reads its block only. Of the table, both sides meet on (book, chapter block), so no
    interval is compared with verses of another chapter; intervals are first clipped to the
    requested stretch of their book.
    """
    def from_index(asked: DataFrame) -> DataFrame:
        points, values = points_of(split_ids(asked).rows), None
        if broadcast_rows:
            points, values = measured(points, broadcast_rows)
        return covering(commentaries, points, _BOOK, values).select("request_id", *_SHOWN)

    def from_table(asked: DataFrame) -> DataFrame:
        points = points_of(split_ids(asked).rows).withColumnRenamed("first", "pos").drop("last")
        stretch = points.groupBy(*_BOOK).agg(
            F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
        if broadcast_rows:
            points = small_side(points, broadcast_rows)
            stretch = small_side(stretch, broadcast_rows)
        clipped = clip_to(_spans(commentaries), stretch, _BOOK, "lo", "hi")
        blocks = with_blocks(clipped, F.col("lo"), F.col("hi"))
        met = blocks.join(points, [*_BOOK, "block"]).filter(
            F.col("pos").between(F.col("lo"), F.col("hi")))
        return met.select("request_id", *_SHOWN)

    asked = requests.select("request_id", "verse_id")
    answer = from_index if "block" in commentaries.columns else from_table
    return Checked(answer_once(asked, ["verse_id"], answer, broadcast_rows),
                   split_ids(asked).rejects)


def in_commentary_order(df: DataFrame) -> DataFrame:
    return df.orderBy("request_id", F.col("chapter_from").asc_nulls_last(),
                      F.col("verse_from").asc_nulls_last(), F.col("marker").asc_nulls_last())


def commentary_links(commentaries: DataFrame, source: str = "source") -> DataFrame:
    """One row per address link of a commentary text, in order."""
    keep = [c for c in commentaries.columns if c not in ("text", source)]
    return commentaries.select(
        *keep, F.col(source).alias("source"),
        F.posexplode(X.link_addresses(F.col("text"))).alias("pos", "address"))
