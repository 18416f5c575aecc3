"""Canonical table layouts."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _I = T.StringType(), T.IntegerType()

SOURCES = _table(
    ("id", _S), ("language", _S), ("source_number", _I), ("name", _S),
    ("description_short", _S), ("description_long", _S), ("origin", _S),
    ("chapter_string", _S), ("chapter_string_ps", _S),
)
BOOKS = _table(
    ("id", _S), ("language", _S), ("source_number", _I), ("book_number", _I),
    ("short_name", _S), ("long_name", _S),
)
VERSES = _table(
    ("id", _S), ("language", _S), ("source", _S), ("book", _S), ("book_name", _S),
    ("address", _S), ("source_number", _I), ("book_number", _I), ("chapter", _I),
    ("verse", _I), ("text", _S),
)
STORIES = _table(
    ("language", _S), ("source_number", _I), ("book_number", _I), ("chapter", _I),
    ("verse", _I), ("title", _S),
)
COMMENTARIES = _table(
    ("language", _S), ("source_number", _I), ("book_number", _I),
    ("chapter_number_from", _I), ("verse_number_from", _I),
    ("chapter_number_to", _I), ("verse_number_to", _I), ("is_preceding", _I),
    ("marker", _S), ("text", _S),
)
DICTIONARY = _table(
    ("language", _S), ("source_number", _I), ("topic", _S), ("definition", _S),
    ("lexeme", _S), ("transliteration", _S), ("pronunciation", _S),
    ("short_definition", _S),
)
REFS_RAW = _table(("vfrom", _S), ("vto", _S), ("votes", _S))
REFS = _table(
    *[(n, _I) for n in ("book_number", "chapter", "verse", "b1", "c1", "v1",
                        "b2", "c2", "v2", "rate")]
)
EMBEDDINGS = _table(("id", _S), ("embedding", T.ArrayType(T.FloatType())))
SHEETS = _table(("id", _S), ("data", _S), ("created_at", T.TimestampType()))

SHEET_ITEM = _table(("kind", _S), ("address", _S), ("source", _S), ("content", _S))
SHEET_ITEMS = T.ArrayType(SHEET_ITEM)

TABLES = {
    "sources": SOURCES,
    "books": BOOKS,
    "verses": VERSES,
    "stories": STORIES,
    "commentaries": COMMENTARIES,
    "dictionary": DICTIONARY,
}

# Columns a target row must carry, and the one declared row key.
NOT_NULL = {
    "sources": ["id", "language", "source_number"],
    "books": ["id", "language", "source_number", "book_number"],
    "verses": ["id", "language", "source", "book", "book_name", "address",
               "source_number", "book_number", "chapter", "verse"],
    "stories": ["language"],
    "commentaries": ["language", "text"],
    "dictionary": ["language", "source_number", "topic"],
}
ROW_KEY = {"dictionary": ["language", "source_number", "topic"]}
