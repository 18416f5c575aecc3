"""Documents for print and Markdown, and collapsed address labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versespan.functions import address as A
from versespan.functions import text as X
from versespan.operators.joins import PART_LINES, Checked, computed, in_parts, measured, pruned
from versespan.operators.sheets import decode_sheets, pericope_verses, shown_items
from versespan.session import materialize


def export_directory(verses: DataFrame) -> DataFrame:
    """The chapters each source has in each language."""
    return verses.select("language", "source", "book", "chapter").distinct()


def export_rows(requests: DataFrame, verses: DataFrame,
                chapters: DataFrame | None = None) -> Checked:
    """Verses of each ``(request_id, address, source)`` in the print export's grammar.

    A source stored under several languages is read from the first. Whole books are
    expanded over the chapters that exist, so all requests meet the verses in one join on
    (language, source, book, chapter); few of these reach the scan as literals.
    """
    parsed = computed(requests.select("request_id", "address", "source"),
                      A.export_parts(F.col("address")), "_a")
    wanted = parsed.filter(F.col("_a.error").isNull()).select(
        "request_id", F.col("address").alias("requested"), "source",
        F.col("_a.book").alias("book"), F.col("_a.chapter").alias("_c"),
        F.col("_a.parts").alias("_p"))
    columns = ["source", "book", "book_name", "chapter", "verse", "text"]
    have = export_directory(verses if chapters is None else chapters)
    stored = have.groupBy("source").agg(F.min("language").alias("language"))
    keys = ["language", "source", "book"]
    chosen = wanted.join(stored, "source").withColumn("_key", F.coalesce("_c", F.lit(-1)))
    there = have.select(*keys, "chapter", F.explode(F.array(
        F.col("chapter"), F.lit(-1))).alias("_key"))
    places, values = measured(chosen.join(there, [*keys, "_key"]).select(
        "request_id", "requested", *keys, "chapter", "_p"))
    stored = pruned(verses.select("language", *columns), values, [*keys, "chapter"])
    rows = stored.join(places, [*keys, "chapter"]).filter(
        A.contains_verse(F.col("_p"), F.col("verse"))).select(
        "request_id", "requested", *columns)
    rejects = parsed.filter(F.col("_a.error").isNotNull()).select(
        "request_id", F.col("_a.error").alias("reason"))
    return Checked(rows, rejects)


_EDGE = 2**62               # before and after every chapter number


def _verse_json(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_json", F.to_json(F.struct("verse", "text"),
                                              {"ignoreNullFields": "false"}))


def export_chapters(rows: DataFrame) -> DataFrame:
    """Verses as JSON lists, a row per (request, chapter, ``part``): ``verses`` of as many
    verse numbers as a part holds. ``rows`` are looked up once and written out."""
    rows = materialize(rows, "export")
    key = ["request_id", "requested", "source", "book", "chapter"]
    names = rows.groupBy(*key).agg(F.min("book_name").alias("book_name"))
    lists = in_parts(_verse_json(rows), key, ["verse"], ["text"], "_json", ",")
    return lists.withColumn("verses", F.concat(F.lit("["), "text", F.lit("]"))).drop("text").join(
        names, key)


def export_documents(rows: DataFrame) -> DataFrame:
    """JSON documents as ordered parts ``request_id, part, text``, chapters in numeric order.

    The parts of a request, one after another, are its document; see ``joined_parts``. What
    stands between the verses (header, chapter numbers, commas) has parts of its own, so the
    verses are gathered part by part only. ``rows`` are looked up once and written out, as
    verses, what stands between them, and headers are made of them.
    """
    rows = materialize(rows, "export")
    block = F.floor(F.coalesce(F.col("verse"), F.lit(-1)) / PART_LINES).cast("bigint")
    body = in_parts(_verse_json(rows), ["request_id"], ["chapter", "verse"], ["text"], "_json", ",")
    body = body.select("request_id", F.concat("part", F.array(F.lit(1).cast("bigint")))
                       .alias("part"), "text")

    places = rows.select("request_id", F.col("chapter").cast("bigint").alias("chapter"),
                         block.alias("block")).distinct()
    first_block = places.groupBy("request_id", "chapter").agg(F.min("block").alias("_first"))
    first_chapter = first_block.groupBy("request_id").agg(F.min("chapter").alias("_begin"))
    opening = F.concat(F.when(F.col("chapter") == F.col("_begin"), '"').otherwise('],"'),
                       F.col("chapter").cast("string"), F.lit('":['))
    between = places.join(first_block, ["request_id", "chapter"]).join(
        first_chapter, "request_id").select(
        "request_id", F.array("chapter", "block", F.lit(0).cast("bigint")).alias("part"),
        F.when(F.col("block") == F.col("_first"), opening).otherwise(",").alias("text"))

    heads = rows.groupBy("request_id").agg(
        F.min("source").alias("source"), F.min("book").alias("book"),
        F.min_by("book_name", F.struct("chapter", "book_name")).alias("book_name"),
        F.min("requested").alias("address"))
    header = F.to_json(F.struct("source", "book", "book_name", "address"),
                       {"ignoreNullFields": "false"})
    ends = F.array(*[F.struct(
        F.array(F.lit(edge).cast("bigint"), *[F.lit(0).cast("bigint")] * 2).alias("part"),
        text.alias("text")) for edge, text in (
            (-_EDGE, F.concat(F.regexp_replace(header, r"\}\z", ""), F.lit(',"chapters":{'))),
            (_EDGE, F.lit("]}}")))])
    edges = heads.select("request_id", F.inline(ends))
    return body.unionByName(between).unionByName(edges)


def markdown_lines(sheets: DataFrame, verses: DataFrame, books: DataFrame,
                   chapters: DataFrame | None = None) -> DataFrame:
    """Ordered lines below the title of each sheet's Markdown.

    Notes and pericope headings come from the sheets alone, verse lines from one lookup.
    Each line carries the separator in front of it; the first of an untitled sheet has none.
    """
    items = shown_items(sheets)
    opening = F.when(F.col("kind") == "note", X.strip_sm_tags(F.col("content"))).otherwise(
        F.concat(F.lit("###### "), "address", F.lit(" ("), "source", F.lit(")")))
    place = ["sheet_id", "pos", "book_number", "chapter", "verse", "verse_id"]
    none = F.lit(None)
    first = items.groupBy("sheet_id").agg(F.min("pos").alias("_first"))
    gap = F.when((F.col("title") == "") & (F.col("pos") == F.col("_first")), "").otherwise("\n\n")
    blocks = items.join(first, "sheet_id").select(
        "sheet_id", "pos", none.cast("int").alias("book_number"),
        none.cast("int").alias("chapter"), none.cast("int").alias("verse"),
        none.cast("string").alias("verse_id"), F.concat(gap, opening).alias("text"))
    hits = pericope_verses(items, verses, books, chapters).rows
    clean = X.html_to_text(X.strip_sm_tags(F.col("text")))
    number = F.concat(F.lit("\n- <sup>"), F.col("verse").cast("string"), F.lit("</sup>"))
    lines = hits.select(*place, F.when(clean == "", number).otherwise(
        F.concat(number, F.lit(" "), clean)).alias("text"))
    return blocks.unionByName(lines)


def sheet_markdown(sheets: DataFrame, verses: DataFrame, books: DataFrame,
                   chapters: DataFrame | None = None) -> DataFrame:
    """Markdown of each sheet as ordered parts ``sheet_id, title, part, text``: the title (empty
    text if there is none), then notes and pericopes in order."""
    titles = decode_sheets(sheets).select(F.col("id").alias("sheet_id"), "title")
    before = F.array(*[F.lit(-1).cast("bigint")] * 4)
    top = titles.select("sheet_id", "title", before.alias("part"), F.when(
        F.col("title") == "", "").otherwise(F.concat(F.lit("# "), "title")).alias("text"))
    body = in_parts(markdown_lines(sheets, verses, books, chapters), ["sheet_id"],
                    ["pos", "book_number", "chapter", "verse"], ["verse_id"])
    return top.unionByName(body.join(titles, "sheet_id").select(*top.columns))


def _store(parts: DataFrame, path: str) -> None:
    """Store ``file_name, part, text``, the parts of a file one after another."""
    parts.select("file_name", "part", "text").repartitionByRange("file_name", "part") \
        .sortWithinPartitions("file_name", "part").write.mode("overwrite").parquet(path)


def write_documents(parts: DataFrame, requests: DataFrame, path: str) -> None:
    """Store the parts of JSON documents under their file-safe names."""
    names = requests.select("request_id", X.file_safe(
        F.col("address"), F.col("source")).alias("file_name"))
    _store(parts.join(names, "request_id"), path)


def write_markdown(parts: DataFrame, path: str, stem: str = "sheet") -> None:
    """Store the parts of Markdown documents under their file names."""
    _store(parts.withColumn("file_name", X.export_name(
        F.col("title"), F.col("sheet_id"), stem)), path)


def page_labels(rows: DataFrame) -> DataFrame:
    """Running-head label of each request's printed verses."""
    place = F.struct("chapter", "verse")
    ends = rows.filter(X.print_clean(F.col("text")) != "").groupBy("request_id", "book").agg(
        F.min(place).alias("_lo"), F.max(place).alias("_hi"))
    return ends.select("request_id", A.range_label(
        F.col("book"), F.col("_lo.chapter"), F.col("_lo.verse"),
        F.col("_hi.chapter"), F.col("_hi.verse")).alias("label"))


def collapse_ranges(selected: DataFrame) -> DataFrame:
    """Address text of each request's selected verses, such as ``J 3,16-18.20``, as ordered
    parts ``request_id, part, text``.

    ``selected`` has ``request_id, book_number, chapter, verse, language, source, id,
    address``. A run is broken wherever a verse is not its predecessor plus one; chapters
    do not matter. Runs are found inside chapters first, from the rows at their ends, and only
    runs cross to the request level, and of those only one per chapter is ever ordered
    across chapters.
    """
    chapter = ["request_id", "book_number", "chapter"]
    within = Window.partitionBy(*chapter).orderBy("verse", "language", "source", "id")
    across = Window.partitionBy("request_id").orderBy("book_number", "chapter")
    verse = F.col("verse")
    after = verse.cast("bigint") + 1
    starts = F.coalesce(verse != F.lag(after).over(within), F.lit(True))
    ends = F.coalesce(after != F.lead("verse").over(within), F.lit(True))
    edges = selected.withColumn("_starts", starts).withColumn("_ends", ends).filter(
        "_starts or _ends")
    runs = edges.withColumn("_run", F.sum(F.col("_starts").cast("int")).over(within)).withColumn(
        "hi", F.when(F.col("_ends"), verse).otherwise(F.lead("verse").over(within))).filter(
        "_starts").select(*chapter, "_run", verse.alias("lo"), "hi",
                          F.when(F.col("_run") == 1, F.col("address")).alias("_address"))

    # The first run of a chapter goes on with the last one of the chapter before if their
    # numbers meet; a chapter that is all one such run passes on the run it belongs to.
    ends = runs.groupBy(*chapter).agg(
        F.max("_run").alias("_runs"), F.min_by("lo", "_run").alias("_lo"),
        F.max_by("hi", "_run").alias("_hi")).withColumn("_goes_on", F.coalesce(
            F.col("_lo") == F.lag("_hi").over(across) + 1, F.lit(False)))
    last_start = F.when(~F.col("_goes_on") | (F.col("_runs") > 1), F.struct(
        "book_number", "chapter", F.col("_runs").alias("_run")))
    carried = ends.select(*chapter, "_goes_on", F.last(last_start, ignorenulls=True).over(
        across.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    place = F.struct("book_number", "chapter", "_run")
    known = runs.filter(" and ".join(f"{c} is not null" for c in chapter))
    islands = known.join(carried.filter("_goes_on").withColumn("_run", F.lit(1).cast("bigint")).drop(
        "_goes_on"), [*chapter, "_run"], "left").withColumn(
        "_island", F.coalesce("_carry", place)).groupBy("request_id", "_island").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.max(F.when(F.col("_carry").isNull(), F.col("_address"))).alias("_address"))

    shown = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(
        F.concat(F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string")))
    lines = islands.select("request_id", "_island.book_number", "_island.chapter",
                           F.col("_island._run").alias("run"), shown.alias("text"),
                           A.address_prefix(F.col("_address")).alias("_prefix"))
    parts = in_parts(lines, ["request_id"], ["book_number", "chapter", "run"], sep=".",
                     lead="_prefix")
    first = parts.groupBy("request_id").agg(F.min("part").alias("_first"))
    return parts.join(first, "request_id").select("request_id", "part", F.concat(
        F.when(F.col("part") == F.col("_first"), F.col("_prefix")).otherwise("."), "text")
        .alias("text"))
