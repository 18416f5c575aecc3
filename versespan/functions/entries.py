"""Fields of dictionary entries written as XML fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ROOT = "versespan-entry"


def wrap_entry(definition: Column) -> Column:
    return F.concat(F.lit(f"<{_ROOT}>"), definition, F.lit(f"</{_ROOT}>"))


def is_well_formed(xml: Column) -> Column:
    """``xpath`` fails the job on a malformed row, so every row is checked first."""
    parsed = F.from_xml(xml, "_broken string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    closes_root = F.regexp_count(xml, F.lit(f"</{_ROOT}")) != 1
    return F.when(xml.isNull(), True).otherwise(parsed["_broken"].isNull() & ~closes_root)


def _escaped(x: Column) -> Column:
    """Text nodes are reported in their XML spelling."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#x0d;")):
        x = F.replace(x, F.lit(char), F.lit(entity))
    return x


def _nodes(xml: Column, path: str) -> Column:
    return F.transform(F.xpath(xml, F.lit(path)), _escaped)


def entry_fields(xml: Column) -> Column:
    """``struct<word, meaning, parse, forms>`` of a well-formed wrapped entry."""
    return F.struct(
        F.trim(F.get(_nodes(xml, f"/{_ROOT}/dl[1]/dt/a/text()"), F.lit(0))).alias("word"),
        F.trim(F.array_join(_nodes(xml, '//span[@class="meaning"]//text()'), " "))
        .alias("meaning"),
        F.trim(F.get(_nodes(xml, f'/{_ROOT}/dl[1]//span[@class="parse"][1]/text()'),
                     F.lit(0))).alias("parse"),
        F.coalesce(_nodes(xml, f"/{_ROOT}/dl[1]//li/a[starts-with(@href, 'S:')]/text()"),
                   F.array().cast("array<string>")).alias("forms"),
    )
