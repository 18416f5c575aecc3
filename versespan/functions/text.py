"""Markup clean-up, tag extraction, names and labels."""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from versespan.functions.core import BROWSER_SPACE, let, squeeze

# Tag names the reading text drops, and tags whose content is metadata.
FORMAT_TAGS = ("strong", "b", "br", "div", "pb", "t")
METADATA_TAGS = ("S", "m", "f", "n", "h", "e")
PRINT_TAGS = ("f", "e", "n", "m", "S")

# Every named entity that ends in a semicolon, from the standard library's HTML table, and the
# numbers that browsers read as Windows-1252.
ENTITIES = {f"&{name}": char for name, char in html5.items() if name.endswith(";")}
WINDOWS_1252 = {str(n): char for n in range(0x80, 0xA0)
                if (char := bytes([n]).decode("cp1252", "ignore"))}


def text_without_format(x: Column) -> Column:
    """Drop formatting tags, whatever follows the name (``<table>`` counts as ``t``)."""
    return F.regexp_replace(x, "(?i)</?(?:" + "|".join(FORMAT_TAGS) + ")[^>]*>", "")


def text_without_metadata(x: Column, tags: Sequence[str] = METADATA_TAGS) -> Column:
    """Remove metadata elements from the inside out until none is left, then squeeze spaces.

    One pass removes every innermost element, so the nesting depth of a row's own tags is
    the number of passes that row needs; rows without such tags pay for none.
    """
    names = "|".join(tags)
    tag, element = f"(?i)</?(?:{names})>", f"(?i)<({names})>[^<>]*</\\1>"

    def deeper(acc: Column, found: Column) -> Column:
        now = F.greatest(F.lit(0), acc.depth + F.when(found.startswith("</"), -1).otherwise(1))
        return F.struct(now.alias("depth"), F.greatest(acc.deepest, now).alias("deepest"))

    def strip(text: Column) -> Column:
        depth = F.aggregate(
            F.regexp_extract_all(text, F.lit(tag), F.lit(0)),
            F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest")),
            deeper, lambda acc: acc.deepest)
        passes = let(depth, lambda d: F.when(d > 0, F.sequence(F.lit(1), d))
                     .otherwise(F.array().cast("array<int>")))
        return F.aggregate(passes, text,
                           lambda acc, _: F.regexp_replace(acc, element, ""))

    return squeeze(let(x, strip))


def raw_text(x: Column) -> Column:
    plain = text_without_metadata(text_without_format(x))
    return F.regexp_replace(plain, "</?(?:J|i)>", "")


def tag_pairs(x: Column) -> Column:
    """``array<struct<tag, value>>`` of the flat elements of a text, in order."""
    pattern = r"<([A-Za-z][A-Za-z0-9]*)>([^<]+)</\1>"
    cleaned = F.replace(F.replace(text_without_format(x), F.lit("<i>"), F.lit("[")),
                        F.lit("</i>"), F.lit("]"))
    return let(cleaned, lambda t: F.arrays_zip(
        F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("tag"),
        F.regexp_extract_all(t, F.lit(pattern), F.lit(2)).alias("value")))


def collect_tags(x: Column) -> Column:
    """``map<tag, array<value>>`` with the values of each tag in order of occurrence."""

    def as_map(pairs: Column) -> Column:
        tags = F.array_distinct(F.transform(pairs, lambda p: p["tag"]))
        return F.map_from_arrays(tags, F.transform(tags, lambda t: F.transform(
            F.filter(pairs, lambda p: p["tag"] == t), lambda p: p["value"])))

    return let(F.coalesce(tag_pairs(x), F.array().cast("array<struct<tag:string,value:string>>")),
               as_map)


def print_clean(x: Column) -> Column:
    """Text as the print layout shows it."""
    x = F.regexp_replace(x, r"(?U)<[a-zA-Z]+\s*/>", "")
    for name in PRINT_TAGS:
        x = F.regexp_replace(x, f"<{name}>[^<]*</{name}>", "")
    x = F.regexp_replace(x, "<[^>]+>", "")
    x = F.regexp_replace(x, r"(?U)\s+", " ")
    return F.trim(x)


def strip_tags_scan(x: Column) -> Column:
    """Keep what lies outside ``<…>``; an unclosed ``<`` drops the rest."""
    return F.replace(F.regexp_replace(x, r"<[^>]*(?:>|\z)", ""), F.lit(">"), F.lit(""))


def strip_sm_tags(x: Column) -> Column:
    """Drop ``s`` and ``m`` tags but keep their content."""
    x = F.regexp_replace(x, r"(?i)</?s\b[^>]*>", "")
    return F.regexp_replace(x, r"(?i)</?m\b[^>]*>", "")


def _decoded_entity(x: Column) -> Column:
    """The character of one ``&...;``; an unknown name stays as it is."""
    point = F.when(x.rlike("^&#[xX]"), F.conv(F.regexp_extract(x, "^&#[xX](.*);", 1), 16, 10)) \
        .otherwise(F.regexp_extract(x, "^&#(.*);", 1)).try_cast("bigint")
    no_char = (point == 0) | (point > 0x10FFFF) | point.between(0xD800, 0xDFFF)
    windows = F.from_json(F.lit(json.dumps(WINDOWS_1252)), "map<string,string>")
    char = F.coalesce(F.try_element_at(windows, point.cast("string")), F.decode(
        F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
    names = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")
    return F.when(x.startswith("&#"), F.when(no_char, "\ufffd").otherwise(char)).otherwise(
        F.coalesce(F.try_element_at(names, x), x))


def html_to_text(x: Column) -> Column:
    """Text content of a fragment with entities decoded and whitespace collapsed.

    The text is read once from left to right, so what an entity stands for is never read as
    part of another one.
    """
    x = F.coalesce(x, F.lit(""))
    x = F.regexp_replace(x, r"(?s)<!--.*?(?:-->|\z)", "")
    x = F.regexp_replace(x, r"</?[A-Za-z!?][^>]*(?:>|\z)", "")
    piece = "&(?:#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,8}|[A-Za-z][A-Za-z0-9]*);|[^&]+|&"

    def decoded(text: Column) -> Column:
        return F.when(~text.contains("&"), text).otherwise(F.array_join(F.transform(
            F.regexp_extract_all(text, F.lit(piece), F.lit(0)),
            lambda p: F.when(p.startswith("&") & (F.length(p) > 1), _decoded_entity(p))
            .otherwise(p)), ""))

    x = let(x, decoded)
    x = F.regexp_replace(x, BROWSER_SPACE + "+", " ")
    return F.trim(x)


def slugify(x: Column) -> Column:
    x = F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-")
    return F.regexp_replace(x, r"^-+|-+\z", "")


def export_name(title: Column, sheet_id: Column, stem: str = "sheet") -> Column:
    """Markdown file name from a title and an id; either may be blank."""
    slug, sid = slugify(F.coalesce(title, F.lit(""))), F.coalesce(sheet_id, F.lit(""))
    name = (
        F.when((slug == "") & (sid == ""), F.lit(stem))
        .when(slug == "", F.concat(F.lit(stem + "-"), sid))
        .when(sid == "", slug)
        .otherwise(F.concat(slug, F.lit("-"), sid))
    )
    return F.concat(name, F.lit(".md"))


def date_prefix(x: Column) -> Column:
    return F.substring(x, 1, 10)


def file_safe(address: Column, source: Column) -> Column:
    return F.translate(F.concat(address, F.lit("_"), source), " ,:.", "____")


def repair_marker(marker: Column, text: Column) -> Column:
    """The marker printed in the commentary's heading link, where there is one."""
    pattern = r'<span class="vuhead"><a[^>]*>([^<]+)</a></span>'
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(marker)


def without_thin_space(x: Column) -> Column:
    return F.replace(x, F.lit("\u2009"), F.lit(""))


_LINK = r"""(?s)<a\b((?:[^>]*?\s)?class\s*=\s*(["'])(?:[^"'>]*\s)?B(?:\s[^"'>]*)?\2[^>]*)>(.*?)</a>"""


def link_addresses(html: Column) -> Column:
    """Inner text of every address link of a commentary, in order."""
    return F.regexp_extract_all(html, F.lit(_LINK), F.lit(3))


def annotate_links(html: Column, source: Column) -> Column:
    """Add ``data-source`` and ``data-address`` to every address link."""
    attr = F.replace(F.replace(source, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    safe = F.regexp_replace(attr, r"([\\$])", r"\\$1")
    return F.regexp_replace(html, F.lit(_LINK), F.concat(
        F.lit('<a$1 data-source="'), safe, F.lit('" data-address="$3">$3</a>')))


def is_blank(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit("")) == ""


def has_alphanumeric(x: Column) -> Column:
    return F.coalesce(x.rlike(r"[\p{L}\p{N}]"), F.lit(False))

