"""User sheets as a keyed table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versespan.functions import sheet_json as S
from versespan.functions.address import parse_address, split_batch
from versespan.operators.joins import Checked, carry_forward, computed, small_side
from versespan.operators.lookup import fetch_verses

FALLBACK_SOURCE = "NVUL"     # fixed value: source of a new pericope with none above it

# What an empty sheet opens with.
DEFAULT_ITEMS = (
    ("pericope", "J 3,16-17", "NVUL"),
    ("pericope", "J 3,16-17", "NA28"),
    ("pericope", "J 3,16-17", "BT_03"),
    ("pericope", "J 3,16-17", "TRO+"),
)

RETENTION = "7 days"         # fixed value: how long an untitled sheet is kept


def check_changes(changes: DataFrame) -> Checked:
    """Changes that can be stored, and those without data, which no sheet may be."""
    empty = F.col("data").isNull()
    return Checked(changes.filter(~empty), changes.filter(empty).withColumn(
        "reason", F.lit("sheet has no data")))


def latest_changes(changes: DataFrame, order: str = "ts") -> DataFrame:
    """One row per sheet: its latest data and the times of its first and last change.

    An aggregate, not a window: a sheet edited very often is reduced before the shuffle.
    Equal times are settled by the data itself. Changes without data are left out.
    """
    return check_changes(changes).rows.filter(F.col("id").isNotNull()).groupBy("id").agg(
        F.max(F.struct(order, "data"))["data"].alias("data"),
        F.min(order).alias("first_ts"), F.max(order).alias("last_ts"))


def upsert_sheets(target: DataFrame, changes: DataFrame) -> DataFrame:
    """New snapshot: known ids take the new data and keep ``created_at``.

    ``changes`` has ``id, data, ts``; a new sheet is created at its first change. A change
    without an id becomes a new sheet under a random id and never takes part in the join;
    the id is drawn when the snapshot is written, so read it from there. Changes without
    data change nothing; ``check_changes`` lists them.
    """
    latest = latest_changes(changes).select("id", F.col("data").alias("_new"), "first_ts")
    merged = target.join(latest, "id", "full_outer").select(
        "id", F.coalesce("_new", "data").alias("data"),
        F.coalesce("created_at", "first_ts").alias("created_at"))
    fresh = check_changes(changes).rows.filter(F.col("id").isNull()).select(
        F.uuid().alias("id"), "data", F.col("ts").alias("created_at"))
    return merged.unionByName(fresh)


def fetch_sheets(sheets: DataFrame, ids: DataFrame) -> DataFrame:
    return sheets.join(small_side(ids.select("id").distinct()), "id")


class Cleanup(NamedTuple):
    kept: DataFrame
    removed: DataFrame      # one row: how many sheets went


def cleanup_sheets(sheets: DataFrame, as_of: Column) -> Cleanup:
    """Drop sheets past the retention time that have no title."""
    old = F.col("created_at") < as_of - F.expr(f"interval {RETENTION}")
    stale = old & S.has_no_title(F.col("data"))
    return Cleanup(sheets.filter(~F.coalesce(stale, F.lit(False))),
                   sheets.filter(stale).agg(F.count("*").cast("int").alias("removed")))


def decode_sheets(sheets: DataFrame) -> DataFrame:
    return computed(sheets, S.decode_sheet(F.col("data")), "_d").select(
        "id", F.col("_d.title").alias("title"), F.col("_d.items").alias("items"))


def sheet_items(sheets: DataFrame) -> DataFrame:
    """One row per item, numbered; a sheet without items opens with the default ones."""
    defaults = F.array(*[F.struct(
        F.lit(kind).alias("kind"), F.lit(address).alias("address"),
        F.lit(source).alias("source"), F.lit("").alias("content"))
        for kind, address, source in DEFAULT_ITEMS])
    decoded = decode_sheets(sheets)
    items = F.when(F.size("items") == 0, defaults).otherwise(F.col("items"))
    return decoded.select(F.col("id").alias("sheet_id"), "title",
                          F.posexplode(items).alias("pos", "item")).select(
        "sheet_id", "title", "pos", "item.*")


def shown_items(sheets: DataFrame) -> DataFrame:
    """Items a sheet opens with; a pericope lacking an address or a source, or whose
    address cannot be read, is left out."""
    items = sheet_items(sheets)
    readable = parse_address(F.col("address"))["error"].isNull()
    return items.filter((F.col("kind") == "note") | (
        (F.col("address") != "") & (F.col("source") != "") & readable))


def pericope_verses(items: DataFrame, verses: DataFrame, books: DataFrame,
                    chapters: DataFrame | None = None) -> Checked:
    """Verses of the pericopes among ``items``, keyed by ``sheet_id, pos``."""
    requests = items.filter(F.col("kind") == "pericope").select(
        F.struct("sheet_id", "pos").alias("request_id"), "address", "source")
    found, rejects = fetch_verses(requests, verses, books, chapters)
    return Checked(found.select(
        F.col("request_id.sheet_id").alias("sheet_id"), F.col("request_id.pos").alias("pos"),
        F.col("id").alias("verse_id"), "book_number", "chapter", "verse", "text"), rejects)


def hydrate_sheets(sheets: DataFrame, verses: DataFrame, books: DataFrame,
                   chapters: DataFrame | None = None) -> DataFrame:
    """Items with the verses of their pericopes.

    A note, and a pericope nothing was found for, is one row without a verse.
    """
    items = shown_items(sheets)
    hits = pericope_verses(items, verses, books, chapters).rows
    return items.join(hits, ["sheet_id", "pos"], "left")


def fill_source(items: DataFrame, group: list[str], order: str) -> DataFrame:
    """Source a new pericope would take at each place: that of the nearest one above."""
    carried = carry_forward(items, group, order, "source", "_above")
    return carried.withColumn("source_above", F.coalesce(
        "_above", F.lit(FALLBACK_SOURCE))).drop("_above")


def batch_requests(inputs: DataFrame, items: DataFrame) -> DataFrame:
    """Address requests of batch inputs typed into sheets.

    ``inputs`` has ``input_id, sheet_id, at, batch``; each takes the source of the nearest
    pericope above item ``at``. The distinct places typed at are threaded between the items
    of their sheet and the source is carried down to them.
    """
    placed = items.filter(F.col("kind") == "pericope").select(
        "sheet_id", (2 * F.col("pos").cast("bigint") + 1).alias("place"), "source")
    typed = inputs.withColumn("place", 2 * F.col("at").cast("bigint"))
    places = typed.select("sheet_id", "place").distinct().withColumn(
        "source", F.lit(None).cast("string"))
    above = fill_source(placed.unionByName(places), ["sheet_id"], "place").filter(
        F.col("place") % 2 == 0).select("sheet_id", "place", "source_above")
    return expand_batch(typed.join(above, ["sheet_id", "place"]).select(
        "input_id", F.col("source_above").alias("source"), "batch"))


def expand_batch(inputs: DataFrame) -> DataFrame:
    """Address requests of ``(input_id, batch, source)``, in the order they were typed."""
    return inputs.select("input_id", "source",
                         F.posexplode(split_batch(F.col("batch"))).alias("pos", "address"))


def saved_sheets(saves: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """The latest save of each sheet: ``sheet_id, title, saved_at, item_count``."""
    latest = saves.filter(F.coalesce("sheet_id", F.lit("")) != "").groupBy("sheet_id").agg(
        F.max(F.struct("saved_at", "data")).alias("_last"))
    rows = computed(latest.select("sheet_id", "_last.*"), S.saved_entry(
        F.col("data")), "_e").select(
        "sheet_id", F.col("_e.title").alias("title"), "saved_at",
        F.col("_e.item_count").alias("item_count"))
    if deleted is not None:
        rows = rows.join(small_side(deleted.select("sheet_id").distinct()),
                         "sheet_id", "left_anti")
    return rows


def most_recent_first(saved: DataFrame) -> DataFrame:
    return saved.orderBy(F.col("saved_at").desc_nulls_last(), "sheet_id")


def saved_count(saved: DataFrame) -> DataFrame:
    return saved.agg(F.count("*").alias("saved"))
