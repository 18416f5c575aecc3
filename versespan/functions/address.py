"""Identifiers, addresses and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from versespan.functions.core import BROWSER_SPACE, SPACE, blank_to_null, let

CHAPTER_END = 999          # "to the end of the chapter"
POSITIONS_PER_CHAPTER = 1000

_NOT_SPACE = SPACE.replace("[", "[^", 1)
_VERSES = rf"(?s)^(.+){SPACE}+(\d+)[,:]{SPACE}*([\d.\-]+)\z"
_CHAPTER = rf"(?s)^(.+){SPACE}+(\d+)\z"
_PIN = rf"~({_NOT_SPACE}+(?:{SPACE}+\d+(?:[,:][\d\-.]+)?)?)"


def source_id(language: Column, source_number: Column) -> Column:
    return F.concat(language, F.lit("/"), source_number.cast("string"))


def book_id(language: Column, source_number: Column, book: Column) -> Column:
    return F.concat(source_id(language, source_number), F.lit("/"), book.cast("string"))


def verse_id(language: Column, source_number: Column, book: Column, chapter: Column,
             verse: Column) -> Column:
    return F.concat(book_id(language, source_number, book), F.lit("/"),
                    chapter.cast("string"), F.lit("/"), verse.cast("string"))


def address(book: Column, chapter: Column, verse: Column) -> Column:
    return F.concat(book, F.lit(" "), chapter.cast("string"), F.lit(","), verse.cast("string"))


def position(chapter: Column, verse: Column) -> Column:
    return chapter.cast("bigint") * POSITIONS_PER_CHAPTER + verse.cast("bigint")


def block(pos: Column) -> Column:
    """The chapter-sized block a position falls in; the equi-join key of range joins."""
    return F.floor(pos / POSITIONS_PER_CHAPTER)


def address_prefix(x: Column) -> Column:
    return F.regexp_extract(x, r"(?s)^(.*,)", 1)


def parse_address(x: Column) -> Column:
    """``struct<book, chapter, parts, error>``; NULL book means there is no address.

    ``parts`` holds the verse ranges of a verse-level address as ``struct<lo, hi>`` and is
    NULL for a chapter or a whole book. A descending range ends the list. A part that is
    not a number makes the whole address an error, unless a descending one came first.
    """

    def part(p: Column) -> Column:
        lo = F.split_part(p, F.lit("-"), F.lit(1)).try_cast("int")
        second = F.split_part(p, F.lit("-"), F.lit(2))
        hi = F.when(~p.contains("-"), lo).when(second == "", F.lit(CHAPTER_END)) \
            .otherwise(second.try_cast("int"))
        return let(F.struct(lo.alias("lo"), hi.alias("hi")), lambda r: F.struct(
            r["lo"].alias("lo"), r["hi"].alias("hi"),
            F.when(r["lo"].isNull() | r["hi"].isNull(), "bad")
            .when(r["hi"] < r["lo"], "stop").otherwise("keep").alias("state")))

    def verses(f: list[Column]) -> Column:
        book, chapter = F.trim(f[0]), f[1].try_cast("int")

        def cut(ps: Column) -> Column:
            end = F.array_position(F.transform(ps, lambda p: p["state"] != "keep"), True)

            def result(e: Column) -> Column:
                kept = F.when(e == 0, ps).otherwise(
                    F.slice(ps, F.lit(1), F.greatest(e - 1, F.lit(0)).cast("int")))
                bad = (e > 0) & (F.get(ps, (e - 1).cast("int"))["state"] == "bad")
                return F.struct(
                    book.alias("book"), chapter.alias("chapter"),
                    F.transform(kept, lambda p: F.struct(
                        p["lo"].alias("lo"), p["hi"].alias("hi"))).alias("parts"),
                    F.when(chapter.isNull(), "chapter is not a number")
                    .when(bad, "verse is not a number").alias("error"))

            return let(end, result)

        return let(F.transform(F.split(f[2], r"\."), part), cut)

    def whole(book: Column, chapter: Column, error: Column) -> Column:
        no_parts = F.lit(None).cast("array<struct<lo:int,hi:int>>")
        return F.struct(F.trim(F.regexp_replace(book, SPACE + "+", " ")).alias("book"),
                        chapter.alias("chapter"), no_parts.alias("parts"),
                        error.alias("error"))

    def by_shape(fields: Column) -> Column:
        f = [F.get(fields, F.lit(i)) for i in range(3)]
        chapter, none = f[1].try_cast("int"), F.lit(None)
        return (
            F.when(F.size(fields) == 3, verses(f))
            .when(F.size(fields) == 2, whole(f[0], chapter, F.when(
                chapter.isNull(), "chapter is not a number")))
            .when(f[0] != "", whole(f[0], none.cast("int"), none.cast("string")))
        )

    return let(_fields(F.trim(x)), by_shape)


def _fields(x: Column) -> Column:
    """Book, chapter and verse list of an address, as far as it has them.

    Each pattern is matched once, its groups set apart by a control character.
    """
    mark = "\u0001"

    def chapter(t: Column) -> Column:
        return F.when(t.contains(mark), t).otherwise(
            F.regexp_replace(t, _CHAPTER, f"$1{mark}$2"))

    marked = F.regexp_replace(F.translate(x, mark, "\ufffd"), _VERSES, f"$1{mark}$2{mark}$3")
    return F.split(let(marked, chapter), mark)


def contains_verse(parts: Column, verse: Column) -> Column:
    """A NULL list of parts covers every verse."""
    return parts.isNull() | F.exists(parts, lambda p: verse.between(p["lo"], p["hi"]))


def export_parts(x: Column) -> Column:
    """The print export's own grammar: comma only, and an open range has no upper end."""

    def parsed(t: Column) -> Column:
        book = F.regexp_replace(t, rf"(?s){SPACE}*[0-9].*", "")
        chapter = F.when(
            t.contains(","), F.regexp_extract(t, rf"(?s)^.*{SPACE}+([0-9]+),", 1)
        ).when(t.rlike("[0-9]"), F.regexp_replace(t, rf"(?s)^.*{SPACE}+", ""))

        def rng(p: Column) -> Column:
            lo = F.split_part(p, F.lit("-"), F.lit(1)).try_cast("int")
            second = F.split_part(p, F.lit("-"), F.lit(2))
            return F.struct(lo.alias("lo"), F.when(~p.contains("-"), lo).when(
                second == "", F.lit(2**31 - 1)).otherwise(second.try_cast("int")).alias("hi"))

        parts = F.when(t.contains(","), F.transform(
            F.split(F.regexp_replace(t, "(?s)^.*,", ""), r"\."), rng))
        wanted = F.when(t.rlike("[0-9]|,"), chapter)
        number = wanted.try_cast("int")
        bad = (wanted.isNotNull() & number.isNull()) | F.coalesce(
            F.exists(parts, lambda p: p["lo"].isNull() | p["hi"].isNull()), F.lit(False))
        return F.struct(book.alias("book"), number.alias("chapter"), parts.alias("parts"),
                        F.when(bad, "address is not a book, chapter or verse list").alias("error"))

    return let(x, parsed)


def parse_search_phrase(x: Column) -> Column:
    """``struct<source, address, phrase>`` of a search-box string."""
    pin_source = rf"@({_NOT_SPACE}+)"
    rest = F.regexp_replace(x, rf"@{_NOT_SPACE}+{SPACE}*", "")
    rest = F.regexp_replace(rest, _PIN, "")
    return F.struct(
        blank_to_null(F.regexp_extract(x, pin_source, 1)).alias("source"),
        blank_to_null(F.regexp_extract(x, _PIN, 1)).alias("address"),
        blank_to_null(F.trim(rest)).alias("phrase"),
    )


def split_verse_id(x: Column) -> Column:
    """``struct<language, source_number, book_number, chapter, verse, error>``."""
    names = ("language", "source_number", "book_number", "chapter", "verse")

    def build(parts: Column) -> Column:
        text = [F.get(parts, F.lit(i)) for i in range(5)]
        values = [text[0]] + [t.try_cast("int") for t in text[1:]]
        blank = F.lit(False)
        for t in text:
            blank = blank | (F.coalesce(t, F.lit("")) == "")
        broken = F.lit(False)
        for v in values[1:]:
            broken = broken | v.isNull()
        error = F.when(blank, "expected language/source/book/chapter/verse") \
            .when(broken, "a part of the id is not a number")
        return F.struct(*[v.alias(n) for v, n in zip(values, names)], error.alias("error"))

    return let(F.split(F.coalesce(x, F.lit("")), "/"), build)


def reference_label(name1: Column, c1: Column, v1: Column, name2: Column, c2: Column,
                    v2: Column, b1: Column, b2: Column) -> Column:
    """Label of a cross-reference target; a missing name prints as nothing."""
    n1, n2 = F.coalesce(name1, F.lit("")), F.coalesce(name2, F.lit(""))
    start = address(n1, c1, v1)
    full = b2.isNotNull() & c2.isNotNull() & v2.isNotNull()
    label = (
        F.when(full & (b1 == b2) & (c1 == c2), F.concat(start, F.lit("-"), v2.cast("string")))
        .when(full, F.concat(start, F.lit("-"), address(n2, c2, v2)))
        .otherwise(start)
    )
    return F.trim(label)


def story_label(book: Column, chapter: Column, first: Column, last: Column) -> Column:
    """Label of one chapter's share of a story; a NULL number prints as nothing."""
    def shown(x: Column) -> Column:
        return F.coalesce(x.cast("string"), F.lit(""))

    head = F.concat(shown(book), F.lit(" "), shown(chapter), F.lit(","))
    return (
        F.when(last.isNull(), F.concat(head, shown(first), F.lit("-")))
        .when(last == first, F.concat(head, shown(first)))
        .when(last == 0, F.concat(head, F.lit("1")))
        .otherwise(F.concat(head, shown(first), F.lit("-"), shown(last)))
    )


def range_label(book: Column, c1: Column, v1: Column, c2: Column, v2: Column) -> Column:
    """Running-head label of a page: en dash in a chapter, spaced en dash across chapters."""
    start = address(book, c1, v1)
    return (
        F.when((c1 == c2) & (v1 == v2), start)
        .when(c1 == c2, F.concat(start, F.lit("\u2013"), v2.cast("string")))
        .otherwise(F.concat(start, F.lit("\u2009\u2013\u2009"), c2.cast("string"), F.lit(","),
                            v2.cast("string")))
    )


def split_batch(x: Column) -> Column:
    """Addresses of a ``;``-separated input, trimmed, blanks dropped, order kept."""
    return F.filter(F.transform(F.split(x, ";"), lambda p: F.regexp_replace(
        p, rf"^{BROWSER_SPACE}+|{BROWSER_SPACE}+\z", "")), lambda p: p != "")
