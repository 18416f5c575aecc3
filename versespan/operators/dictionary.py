"""Dictionary entries for the words of requested verses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versespan.functions import entries as E
from versespan.functions import text as X
from versespan.functions.greek import greek_to_betacode
from versespan.operators.joins import BROADCAST_ROWS, Checked, computed, is_small, small_side
from versespan.operators.lookup import with_ids


def verse_words(text: Column) -> Column:
    """Distinct beta-code words of a text."""
    code = greek_to_betacode(X.text_without_format(text))
    return F.filter(F.array_distinct(F.split(code, " +")), lambda w: w != "")


def parse_entries(dictionary: DataFrame) -> Checked:
    """Fields of every entry, read once per entry instead of once per matching word.

    Rejects hold the key of entries that are not well-formed.
    """
    rows = _read(dictionary.select("language", "source_number", "topic", "definition"))
    return Checked(
        rows.filter("_ok").select("language", "source_number", "topic", "_e.*"),
        rows.filter("not _ok").select("language", "source_number", "topic",
                                      F.lit("definition is not well-formed").alias("reason")))


ENTRIES = ("language string, source_number int, topic string, well_formed boolean, word string, "
           "meaning string, parse string, forms array<string>")


def read_entries(dictionary: DataFrame) -> DataFrame:
    """Every entry with its fields, in the layout ``ENTRIES``: what a corpus stores, so that a
    lookup parses nothing. A malformed entry keeps its key and has no fields."""
    rows = _read(dictionary.select("language", "source_number", "topic", "definition"))
    return rows.select("language", "source_number", "topic", F.col("_ok").alias("well_formed"),
                       "_e.*")


def _read(entries: DataFrame) -> DataFrame:
    """Entries with ``_ok`` and the fields ``_e`` instead of their definition."""
    wrapped = entries.withColumn("_xml", E.wrap_entry(F.col("definition")))
    checked = computed(wrapped, E.is_well_formed(F.col("_xml")), "_ok")
    fields = E.entry_fields(F.when(F.col("_ok"), F.col("_xml")))
    return computed(checked, fields, "_e").drop("definition", "_xml")


def verse_dictionary(requests: DataFrame, verses: DataFrame, dictionary: DataFrame,
                     broadcast_rows: int = BROADCAST_ROWS, keyed: bool = False) -> Checked:
    """Entries for each distinct word of the verses in ``(request_id, verse_id)``.

    A word found in several dictionaries gives several rows; one found in none is kept
    with its own spelling as topic. Words whose entry is malformed are rejected.
    ``dictionary`` holds definitions, or the entries ``read_entries`` made of them. For
    ``keyed`` see ``with_ids``.
    """
    ids = requests.select("request_id", F.col("verse_id").alias("id"))
    asked = ids.select("id").distinct()
    if broadcast_rows:
        texts, ids = with_ids(verses, asked, keyed), small_side(ids, broadcast_rows)
    else:
        texts = verses.join(asked, "id", "left_semi")
    small = bool(broadcast_rows) and is_small(dictionary, broadcast_rows)
    return entries_of(texts, ids, dictionary, small)


def entries_of(texts: DataFrame, ids: DataFrame, dictionary: DataFrame,
               small: bool = False) -> Checked:
    """Entries for the words of verses ``texts`` (``id, text``) asked for by ``ids``
    (``request_id, id``); ``small`` says that the dictionary may be broadcast. A verse's words
    then stay one row until its requests have met it, and no word is shuffled."""
    parsed = read_entries(dictionary) if "definition" in dictionary.columns else dictionary
    parsed = parsed.select("topic", "well_formed", "word", "meaning", "parse", "forms")
    listed = texts.select("id", verse_words(F.col("text")).alias("_words"))
    if small:
        lists = listed.groupBy("id").agg(F.array_distinct(F.flatten(
            F.collect_set("_words"))).alias("_words"))
        words = lists.join(ids, "id").select(
            *ids.columns, F.explode("_words").alias("verse_word"))
        met = words.join(F.broadcast(parsed), words["verse_word"] == parsed["topic"], "left")
    else:
        words = listed.select("id", F.explode("_words").alias("verse_word")).distinct()
        met = words.join(parsed, words["verse_word"] == parsed["topic"], "left").join(ids, "id")
    broken = F.coalesce(~F.col("well_formed"), F.lit(False))
    rows = met.filter(~broken).select(
        "request_id", F.coalesce("topic", "verse_word").alias("topic"), "word", "meaning",
        "parse", F.coalesce("forms", F.array().cast("array<string>")).alias("forms"))
    rejects = met.filter(broken).select("request_id", F.concat(
        F.lit("definition is not well-formed: "), F.col("topic")).alias("reason"))
    return Checked(rows, rejects)
