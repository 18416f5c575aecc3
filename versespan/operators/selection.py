"""Everything a selection of verses brings up, in one job."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versespan.functions import address as A
from versespan.operators.commentaries import commentary_index, points_of
from versespan.operators.dictionary import entries_of
from versespan.operators.intervals import covering
from versespan.operators.joins import BROADCAST_ROWS, computed, measured, pruned
from versespan.operators.lookup import ID_PARTS
from versespan.operators.references import references_at
from versespan.operators.stories import ranges_asked, stories_met, story_index
from versespan.session import materialize


class Bundle(NamedTuple):
    references: DataFrame
    dictionary: DataFrame
    commentaries: DataFrame
    stories: DataFrame


_FRAME = ["lookup", "request_id", "source", "id", "book", "chapter", "lo", "hi"]


def selection_requests(selected: DataFrame) -> DataFrame:
    """What a selection asks of each lookup, as one frame tagged by ``lookup``.

    A row is a range of verses ``lo`` to ``hi`` of a chapter. For ``reference`` there is one for
    each verse number of a selection, in the book and chapter its first verse's address names.
    The other lookups are asked where exactly one verse is selected: ``verse`` by its id (with
    the id's parts), ``story`` by its address.
    """
    first = F.struct("book_number", "chapter", "verse", "language", "source", "id", "address")
    numbers = selected.groupBy("request_id", "verse").agg(
        F.min(first).alias("_first"), F.min("source").alias("source"), F.min("id").alias("_least"),
        F.max("id").alias("_most"), F.min("address").alias("_address"))
    own = numbers.groupBy("request_id").agg(
        F.min("_first").alias("_first"), F.min("source").alias("source"),
        F.min("_least").alias("id"), F.max("_most").alias("_most"),
        F.min("_address").alias("_address"))
    own = computed(own, A.parse_address(F.col("_first.address")), "_a")
    alone = own.filter(F.col("id") == F.col("_most"))

    named = own.filter(F.col("_a.error").isNull() & F.col("_a.parts").isNotNull()).select(
        "request_id", "source", F.col("_a.book").alias("book"), F.col("_a.chapter").alias("chapter"))
    references = numbers.select("request_id", "verse").hint("merge").join(named, "request_id").select(
        F.lit("reference").alias("lookup"), "request_id", "source",
        F.lit(None).cast("string").alias("id"), "book", "chapter", F.col("verse").alias("lo"),
        F.col("verse").alias("hi"))
    verses = alone.select(
        F.lit("verse").alias("lookup"), "request_id", "source", "id",
        *[F.lit(None).cast(kind).alias(name) for name, kind in (
            ("book", "string"), ("chapter", "int"), ("lo", "int"), ("hi", "int"))])
    told = computed(alone.drop("_a"), A.parse_address(F.col("_address")), "_a").filter(
        F.col("_a.error").isNull()).select(
        F.lit("story").alias("lookup"), "request_id", "source", "id",
        F.col("_a.book").alias("book"), F.col("_a.chapter").alias("chapter"),
        F.explode("_a.parts").alias("_p")).select(*_FRAME[:6], "_p.lo", "_p.hi")
    asked = references.unionByName(verses).unionByName(told)
    parts = computed(asked, A.split_verse_id(F.col("id")), "_v")
    return parts.select(*_FRAME, *[F.col(f"_v.{p}").alias(f"id_{p}") for p in ID_PARTS])


def selection_bundle(selected: DataFrame, *, verses: DataFrame, books: DataFrame,
                     sources: DataFrame, refs: DataFrame, rendered: DataFrame,
                     commentaries: DataFrame, dictionary: DataFrame, keyed: bool = False,
                     broadcast_rows: int = BROADCAST_ROWS) -> Bundle:
    """Lookups for each selection ``(request_id, source, + verse columns)``.

    Cross references come up for every selection, by its verses in its first verse's chapter.
    Dictionary, commentaries and stories come up where exactly one verse is selected. All
    lookups share one frame of requests, which is measured once: a small one is kept, broadcast
    and prunes what is read; a large one is written, and its joins are left to Spark. What the
    frame is made of is measured too, as a few rows need no shuffle.
    ``commentaries`` and ``rendered`` are the tables or their stored indexes; ``keyed`` says
    that verse ids are made of the verse's own columns.
    """
    selected = selected.select("request_id", "book_number", "chapter", "verse", "language", "source",
                               "id", "address")
    if broadcast_rows:                        # few rows are put together in one task
        few = measured(selected, broadcast_rows).rows
        selected = selected if few is selected else few.coalesce(1)
    frame = selection_requests(selected)
    asked, values = measured(frame, broadcast_rows) if broadcast_rows else (frame, None)
    if asked is frame:
        asked = materialize(frame, "selected")

    def rows(lookup: str) -> tuple[DataFrame, pa.Table | None]:
        few = None if values is None else values.filter(pc.equal(values.column("lookup"), lookup))
        mine = asked.filter(F.col("lookup") == lookup)
        return (mine if values is None else F.broadcast(mine)), few

    places, few = rows("reference")
    places = places.withColumnRenamed("lo", "verse")
    if few is not None:
        refs = pruned(refs, few.rename_columns(
            ["verse" if c == "lo" else c for c in few.column_names]), ["chapter", "verse"])
    found = references_at(places.select("request_id", "source", "book", "chapter", "verse"), refs,
                          books, sources)

    single, few = rows("verse")
    parts = single.filter(F.col("id_language").isNotNull()).select(
        "request_id", "id", *[F.col(f"id_{p}").alias(p) for p in ID_PARTS])
    known = None
    if few is not None:
        known = few.select(["id", *[f"id_{p}" for p in ID_PARTS]]).rename_columns(["id", *ID_PARTS])
        verses = pruned(verses, known, ID_PARTS if keyed else ["id"])
    ids = single.select("request_id", "id")
    texts = verses.select("id", "text").join(ids.select("id").distinct(), "id", "left_semi")
    index = commentaries if "block" in commentaries.columns else commentary_index(commentaries)
    notes = covering(index, points_of(parts), ID_PARTS[:3], _points(known)).select(
        "request_id", "marker", "text", "chapter_from", "verse_from")

    ranges, few = rows("story")
    told = rendered if "block" in rendered.columns else story_index(rendered)
    return Bundle(found, entries_of(texts, ids, dictionary).rows, notes,
                  stories_met(told, ranges_asked(ranges), _blocks(few)))


def _points(known: pa.Table | None) -> pa.Table | None:
    """What an index is asked for, as values: the points of verse ids."""
    if known is None:
        return None
    known = known.filter(pc.and_(pc.is_valid(known.column("chapter")),
                                 pc.is_valid(known.column("verse"))))
    chapter, verse = (known.column(c).cast(pa.int64()) for c in ("chapter", "verse"))
    place = pc.add(pc.multiply(chapter, A.POSITIONS_PER_CHAPTER), verse)
    return _with_ends(known.select(ID_PARTS[:3]), place, place)


def _blocks(few: pa.Table | None) -> pa.Table | None:
    """The same for ranges of a chapter that stay within one block; None if one does not."""
    if few is None:
        return None
    chapter, lo, hi = (few.column(c).cast(pa.int64()) for c in ("chapter", "lo", "hi"))
    first, last = (pc.add(pc.multiply(chapter, A.POSITIONS_PER_CHAPTER), x) for x in (lo, hi))
    return _with_ends(few.select(["source", "book"]), first, last)


def _with_ends(keys: pa.Table, first: pa.ChunkedArray, last: pa.ChunkedArray) -> pa.Table | None:
    blocks = [pc.floor(pc.divide(x.cast(pa.float64()), float(A.POSITIONS_PER_CHAPTER))).cast(pa.int64())
              for x in (first, last)]
    if pc.any(pc.not_equal(*blocks)).as_py():
        return None
    return keys.append_column("block", blocks[0]).append_column("first", first).append_column(
        "last", last)
