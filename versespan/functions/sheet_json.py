"""Sheet documents: strict decode, sanitise, encode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from versespan.functions.core import let
from versespan.schemas import SHEET_ITEMS

UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"


def is_sheet_id(x: Column) -> Column:
    return F.coalesce(x.rlike(UUID), F.lit(False))


def sanitize_items(items: Column) -> Column:
    """Drop unknown kinds and empty pericopes; blank the fields a kind does not use."""
    known = F.filter(items, lambda i: (i["kind"] == "note") | (
        (i["kind"] == "pericope") & ~((i["address"] == "") & (i["source"] == ""))))

    def blanked(i: Column) -> Column:
        note = i["kind"] == "note"
        return F.struct(
            i["kind"].alias("kind"),
            F.when(note, "").otherwise(i["address"]).alias("address"),
            F.when(note, "").otherwise(i["source"]).alias("source"),
            F.when(note, i["content"]).otherwise("").alias("content"))

    return F.transform(known, blanked)


def _field(doc: Column, name: str) -> tuple[Column, Column]:
    """An optional text field: its value (NULL when absent) and whether it is acceptable."""
    value = F.try_variant_get(doc, f"$.{name}", "variant")
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    text = F.when(kind == "STRING", F.try_variant_get(doc, f"$.{name}", "string"))
    return text, kind.isin("STRING", "VOID")


def _items(found: Column) -> Column:
    """Decoded items, or NULL when one of them is not an item."""

    def item(v: Column) -> Column:
        fields = {n: _field(v, n) for n in ("kind", "address", "source", "content")}
        fits = (F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("OBJECT")
                & fields["kind"][0].isNotNull())
        for _, ok in fields.values():
            fits = fits & ok
        return F.struct(
            fits.alias("fits"), fields["kind"][0].alias("kind"),
            *[F.coalesce(fields[n][0], F.lit("")).alias(n)
              for n in ("address", "source", "content")])

    def all_or_none(items: Column) -> Column:
        plain = F.transform(items, lambda i: F.struct(
            *[i[n].alias(n) for n in ("kind", "address", "source", "content")]))
        return F.when(F.forall(items, lambda i: i["fits"]), plain)

    return let(F.transform(found, item), all_or_none)


def decode_sheet(data: Column) -> Column:
    """``struct<title, items>`` of a sheet document.

    An object with a list of items, or a bare list (no title). Anything else, and any
    item that does not decode, gives an empty sheet.
    """
    empty = F.array().cast(SHEET_ITEMS)

    def build(doc: Column) -> Column:
        title, title_fits = _field(doc, "title")
        is_object = F.coalesce(F.schema_of_variant(doc), F.lit("")).startswith("OBJECT")
        of_object = F.when(is_object & title_fits,
                           _items(F.try_variant_get(doc, "$.items", "array<variant>")))
        of_list = F.when(~is_object, _items(F.try_variant_get(doc, "$", "array<variant>")))

        def result(pair: Column) -> Column:
            return F.struct(
                F.when(pair["o"].isNotNull(), F.coalesce(title, F.lit("")))
                .otherwise("").alias("title"),
                sanitize_items(F.coalesce(pair["o"], pair["l"], empty)).alias("items"))

        return let(F.struct(of_object.alias("o"), of_list.alias("l")), result)

    return let(F.try_parse_json(data), build)


def encode_sheet(title: Column, items: Column) -> Column:
    return F.to_json(F.struct(title.alias("title"), sanitize_items(items).alias("items")))


def title_text(data: Column) -> Column:
    return F.get_json_object(data, "$.title")


def has_no_title(data: Column) -> Column:
    return F.coalesce(F.trim(title_text(data)), F.lit("")) == ""


def saved_entry(data: Column) -> Column:
    """Title and items as the list of saved sheets keeps them; wrong types become empty."""
    def build(doc: Column) -> Column:
        items = F.try_variant_get(doc, "$.items", "array<variant>")
        return F.struct(F.coalesce(_field(doc, "title")[0], F.lit("")).alias("title"),
                        F.coalesce(F.size(items), F.lit(0)).alias("item_count"))

    return let(F.try_parse_json(data), build)
