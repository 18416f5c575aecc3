"""Many source files with drifting layouts, merged into one corpus.

A source file holds some of the tables ``info, books, verses, stories, commentaries,
dictionary``. They are stored by table, and each table is read from all files at once, every
row tagged with the file it belongs to.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versespan import schemas
from versespan.functions import address as A
from versespan.functions.core import blank_to_null
from versespan.operators.joins import Checked, small_side

INFO_NAMES = ("description", "detailed_info", "origin", "chapter_string", "chapter_string_ps")


def file_name(path):
    """Base name up to the first dot: ``X.commentaries.parquet`` belongs to ``X``."""
    return F.regexp_extract(path, r"([^/.]*)[^/]*\z", 1)


def read_sources(spark: SparkSession, root: str, table: str, fmt: str = "parquet",
                 **options: str) -> DataFrame:
    """All files of one table below ``root``: ``<root>/<language>/<table>/<name>[.more].<fmt>``.

    Files may differ in columns. Each row carries ``path`` (``<language>/<name>[.more].``,
    the same for all tables of one source file), ``language`` and ``source_name``. The
    extension is cut after its dot, so a file sorts before its companions.
    """
    reader = spark.read.format(fmt).option("mergeSchema", "true").options(**options)
    rows = reader.load(f"{root}/*/{table}")
    where = F.col("_metadata.file_path")
    language = F.regexp_extract(where, rf"([^/]+)/{table}/[^/]+\z", 1)
    path = F.concat(language, F.lit("/"), F.regexp_extract(
        where, r"([^/]+\.)[^/.]*\z", 1))
    return rows.select("*", path.alias("path"), language.alias("language")).withColumn(
        "source_name", file_name(F.col("path")))


def align_schema(df: DataFrame, wanted: dict[str, str],
                 alternatives: dict[str, list[str]] | None = None) -> DataFrame:
    """Exactly the ``wanted`` columns; a missing one is NULL or taken from an alternative."""
    have = set(df.columns)

    def pick(name: str, kind: str):
        for candidate in [name, *(alternatives or {}).get(name, [])]:
            if candidate in have:
                return F.col(candidate).try_cast(kind).alias(name)
        return F.lit(None).cast(kind).alias(name)

    return df.select(*[pick(n, k) for n, k in wanted.items()])


def union_aligned(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def assign_source_numbers(files: DataFrame) -> DataFrame:
    """Number the names of each language by the first path (in byte order) they appear in.

    Files of one name share its number. Paths are reduced to one row per name first.
    """
    first = files.groupBy("language", "name").agg(F.min("path").alias("first_path"))
    order = Window.partitionBy("language").orderBy("first_path")
    return first.withColumn("source_number", F.row_number().over(order))


def pivot_info(info: DataFrame, keys: list[str]) -> DataFrame:
    """(name, value) rows to one column per known name."""
    return info.groupBy(*keys).pivot("name", list(INFO_NAMES)).agg(F.min("value"))


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, as a unique constraint that ignores later rows keeps it."""
    rest = [c for c in df.columns if c not in (*key, *order)]
    picked = df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return picked.select(*key, *[F.col(f"_r.{c}").alias(c) for c in (*order, *rest)])


def split_by_language(info: DataFrame, files: DataFrame) -> Checked:
    """Files ``(path, name)`` with the language their info names; files naming none are
    rejected. Quotes in names become underscores."""
    languages = info.filter(F.col("name") == "language").groupBy("path").agg(
        F.min("value").alias("language"))
    tagged = files.drop("language").join(languages, "path", "left").withColumn(
        "name", F.translate("name", "'", "_"))
    blank = F.coalesce("language", F.lit("")) == ""
    return Checked(tagged.filter(~blank), tagged.filter(blank).select(
        "path", F.lit("no language").alias("reason")))


def keep_story_rows(stories: DataFrame) -> DataFrame:
    """Headings without a book, or whose book number starts with two digits."""
    book = F.col("book_number").cast("string")
    return stories.filter(book.isNull() | F.trim(book).rlike("^[0-9][0-9]"))


_KEYS = {"path": "string", "language": "string"}


def merge_corpus(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The six corpus tables from per-file tables (each with path, language, source_name).

    Numbering the sources is the only step that looks across files; everything else is a
    projection, or a join with the books of the same file.
    """
    listed = [t.select("language", "path", F.col("source_name").alias("name"))
              for t in tables.values()]
    files = union_aligned(listed).distinct()
    numbered = assign_source_numbers(files)
    numbers = small_side(files.join(numbered.drop("first_path"), ["language", "name"]).select(
        "path", F.col("name").alias("source"), "source_number"))

    info = tables.get("info")
    sources = numbered.withColumnRenamed("first_path", "path")
    if info is not None:
        sources = sources.join(pivot_info(info, ["path"]), "path", "left")
    else:
        sources = union_aligned([sources, sources.limit(0).select(
            "path", *[F.lit(None).cast("string").alias(n) for n in INFO_NAMES])])
    out = {"sources": sources.select(
        A.source_id(F.col("language"), F.col("source_number")).alias("id"),
        "language", "source_number", "name", F.col("description").alias("description_short"),
        F.col("detailed_info").alias("description_long"), "origin", "chapter_string",
        "chapter_string_ps")}

    def aligned(table: str, columns: dict[str, str], alternatives=None) -> DataFrame | None:
        if table not in tables:
            return None
        return align_schema(tables[table], {**_KEYS, **columns}, alternatives).join(
            numbers, "path")

    books = aligned("books", {"book_number": "int", "short_name": "string",
                              "long_name": "string"})
    if books is not None:
        books = books.withColumn("long_name", F.coalesce("long_name", "short_name"))
        out["books"] = books.filter(F.col("book_number").isNotNull()).select(
            A.book_id(F.col("language"), F.col("source_number"), F.col("book_number")).alias("id"),
            "language", "source_number", "book_number", "short_name", "long_name")
    verses = aligned("verses", {"book_number": "int", "chapter": "int", "verse": "int",
                                "text": "string"})
    if verses is not None and books is not None:
        names = small_side(books.select("path", "book_number", "short_name", "long_name"))
        out["verses"] = verses.join(names, ["path", "book_number"]).select(
            A.verse_id(F.col("language"), F.col("source_number"), F.col("book_number"),
                       F.col("chapter"), F.col("verse")).alias("id"),
            "language", "source", F.col("short_name").alias("book"),
            F.col("long_name").alias("book_name"),
            A.address(F.col("short_name"), F.col("chapter"), F.col("verse")).alias("address"),
            "source_number", "book_number", "chapter", "verse", "text")
    stories = aligned("stories", {"book_number": "string", "chapter": "int", "verse": "int",
                                  "title": "string"}, {"title": ["text"]})
    if stories is not None:
        out["stories"] = keep_story_rows(stories).select(
            "language", "source_number",
            F.regexp_extract(F.trim("book_number"), "^[0-9]+", 0).try_cast("int")
            .alias("book_number"), "chapter", "verse", "title")
    commentaries = aligned("commentaries", {
        f.name: f.dataType.simpleString() for f in schemas.COMMENTARIES
        if f.name not in ("language", "source_number")})
    if commentaries is not None:
        out["commentaries"] = commentaries.withColumn(
            "text", F.coalesce("text", F.lit(""))).select(*schemas.COMMENTARIES.names)
    dictionary = aligned("dictionary", {
        f.name: f.dataType.simpleString() for f in schemas.DICTIONARY
        if f.name not in ("language", "source_number")})
    if dictionary is not None:
        out["dictionary"] = dictionary.select(*schemas.DICTIONARY.names)
    return out


def union_languages(corpora: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Corpora of several languages as one; all rows are kept."""
    names = dict.fromkeys(n for c in corpora for n in c)
    return {n: reduce(DataFrame.unionByName, [c[n] for c in corpora if n in c]) for n in names}


def read_cross_refs(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated reference list; the header line is dropped, all columns are text."""
    return spark.read.schema(schemas.REFS_RAW).csv(path, sep="\t", header=True,
                                                   enforceSchema=True, quote="")


def extract_links(pages: DataFrame, column: str = "html",
                  pattern: str = r'href="_dl\.php[^"]*?a=([^&"]+)&[^"]*"') -> DataFrame:
    """Values of a link parameter in page order, one row per link; order by ``name`` for
    the sorted list."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all(
        F.col(column), F.lit(pattern), F.lit(1))).alias("pos", "name")).filter(
        blank_to_null(F.col("name")).isNotNull())
