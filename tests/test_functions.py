from __future__ import annotations

import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from versespan.functions import address as A
from versespan.functions import core, greek, vectors
from versespan.functions import entries as E
from versespan.functions import sheet_json as J
from versespan.functions import text as X


def parsed(row):
    if row is None or row["book"] is None:
        return None
    parts = None if row["parts"] is None else [(p["lo"], p["hi"]) for p in row["parts"]]
    return row["book"], row["chapter"], parts, row["error"]


@pytest.mark.parametrize("text, expected", [
    ("J 3,16-17", ("J", 3, [(16, 17)], None)),
    ("J 3:16", ("J", 3, [(16, 16)], None)),
    ("J 3,1.4-6", ("J", 3, [(1, 1), (4, 6)], None)),
    ("Ps 23", ("Ps", 23, None, None)),
    ("J", ("J", None, None, None)),
    ("  ", None),
    (None, None),
    ("J 3,16-", ("J", 3, [(16, 999)], None)),
    ("J 3,1.9-5.20", ("J", 3, [(1, 1)], None)),
    ("J 3,2.9-5..3", ("J", 3, [(2, 2)], None)),
    ("J 3,1-2-3", ("J", 3, [(1, 2)], None)),
    ("1  Kor 3,1", ("1  Kor", 3, [(1, 1)], None)),
    ("1  Kor 3", ("1 Kor", 3, None, None)),
    ("Mk 5,1-Mk 5,3", ("Mk 5,1-Mk", 5, [(3, 3)], None)),
    ("J\n3,1", ("J", 3, [(1, 1)], None)),
])
def test_parse_address(evaluate, text, expected):
    assert parsed(evaluate([text], A.parse_address)[0]) == expected


@pytest.mark.parametrize("text", ["J 3,3..5", "J 3,-5", "J 3,4.", "J 99999999999,1"])
def test_parse_address_rejects(evaluate, text):
    assert evaluate([text], A.parse_address)[0]["error"] is not None


def test_export_grammar(evaluate):
    got = [(r["book"], r["chapter"], r["parts"] and [tuple(p) for p in r["parts"]], r["error"])
           for r in evaluate(["J 3,4-", "J 3,4-5.7", "J 3", "J", "1 Kor 3"], A.export_parts)]
    assert got[:4] == [("J", 3, [(4, 2**31 - 1)], None), ("J", 3, [(4, 5), (7, 7)], None),
                       ("J", 3, None, None), ("J", None, None, None)]
    assert got[4][0] == ""      # the book is what precedes the first digit


def test_search_phrase(evaluate):
    got = [tuple(r) for r in evaluate(
        ["@NVUL ~J 3 Deus amor", "love", "~1 Kor 3", "@NVUL ~J 3,10- Deus", " "],
        A.parse_search_phrase)]
    assert got == [("NVUL", "J 3", "Deus amor"), (None, None, "love"), (None, "1", "Kor 3"),
                   ("NVUL", "J 3,10-", "Deus"), (None, None, None)]


def test_verse_id_round_trip(spark):
    row = spark.range(1).select(A.verse_id(
        F.lit("pl"), F.lit(1), F.lit(230), F.lit(3), F.lit(4)).alias("id"))
    got = row.select(A.split_verse_id(F.col("id")).alias("v")).first()["v"]
    assert tuple(got) == ("pl", 1, 230, 3, 4, None)


def test_split_verse_id_rejects(evaluate):
    errors = [r["error"] for r in evaluate(["pl//1/2/3", "pl/x/1/2/3", None], A.split_verse_id)]
    assert all(errors) and errors[1] != errors[0]


@pytest.mark.parametrize("target, label", [
    ((5, 3, 16, 5, 3, 18), "B5 3,16-18"),
    ((5, 3, 16, 6, 3, 18), "B5 3,16-B6 3,18"),
    ((5, 3, 16, None, None, None), "B5 3,16"),
    ((5, None, 16, None, None, None), None),
])
def test_reference_label(spark, target, label):
    b1, c1, v1, b2, c2, v2 = [F.lit(x).cast("int") for x in target]
    column = A.reference_label(F.lit("B5"), c1, v1, F.lit("B6"), c2, v2, b1, b2)
    assert spark.range(1).select(column).first()[0] == label


def test_reference_label_trims_missing_name(spark):
    none = F.lit(None).cast("int")
    column = A.reference_label(F.lit(None).cast("string"), F.lit(3), F.lit(4),
                               F.lit(None).cast("string"), none, none, F.lit(1), none)
    assert spark.range(1).select(column).first()[0] == "3,4"


def test_story_and_range_labels(spark):
    def story(first, last):
        return A.story_label(F.lit("B"), F.lit(2), F.lit(first), F.lit(last).cast("int"))

    row = spark.range(1).select(
        story(3, None), story(3, 3), story(1, 0), story(3, 9),
        A.range_label(F.lit("B"), F.lit(1), F.lit(2), F.lit(1), F.lit(2)),
        A.range_label(F.lit("B"), F.lit(1), F.lit(2), F.lit(1), F.lit(5)),
        A.range_label(F.lit("B"), F.lit(1), F.lit(2), F.lit(3), F.lit(5))).first()
    assert tuple(row) == ("B 2,3-", "B 2,3", "B 2,1", "B 2,3-9", "B 1,2", "B 1,2–5",
                          "B 1,2 – 3,5")


def test_batch_split(evaluate):
    assert evaluate([" Rdz 1,1-5; Ps 23;; J 3,16-17 "], A.split_batch) == [
        ["Rdz 1,1-5", "Ps 23", "J 3,16-17"]]


def test_format_and_metadata(evaluate):
    assert evaluate(["<table>x</table><pb/>y<br/>"], X.text_without_format) == ["xy"]
    assert evaluate(["a<f>n<S>1</S></f>b", None, "p  <S>a</m>\n q", "<s>1</S>z"],
                    X.text_without_metadata) == ["ab", None, "p <S>a</m> q", "z"]
    assert evaluate(["<J>a <i>b</i></J><b>c</b><m>X</m>"], X.raw_text) == ["a bc"]


def test_metadata_follows_nesting_depth(evaluate):
    deep = "x"
    for i in range(40):
        deep = f"<{'Sm'[i % 2]}>{deep}</{'Sm'[i % 2]}>"
    assert evaluate([f"</S></m>a{deep}b"], X.text_without_metadata) == ["</S></m>ab"]


def test_collect_tags(evaluate):
    got = evaluate(["λογος<S>3056</S> <m>N-NSM</m> <S>2</S>", "", None, "<i>a</i>"],
                   X.collect_tags)
    assert got == [{"S": ["3056", "2"], "m": ["N-NSM"]}, {}, {}, {}]


def test_plain_text_variants(evaluate):
    assert evaluate(["a<b>c>d<e"], X.strip_tags_scan) == ["acd"]
    assert evaluate(["<s>a</s><small>b</small><M x>c"], X.strip_sm_tags) == [
        "a<small>b</small>c"]
    assert evaluate(["a &amp;lt; &#8217;&#39; <b>x</b> &#38;lt; <!-- c --> y&nbsp; z"],
                    X.html_to_text) == ["a &lt; ’' x &lt; y z"]
    assert evaluate(["&#x201E;&#X41;&#128;&bdquo;&euro;&NotEqualTilde;&none; &#0;&#xD800;&#1114112;",
                     "&amp;amp;&&num;x41;&#38;#65;&", None], X.html_to_text) == [
        "„A€„€≂̸&none; \ufffd\ufffd\ufffd", "&amp;&#x41;&#65;&", ""]
    assert evaluate(["a <pb/> <f>n</f>  <i>z</i> "], X.print_clean) == ["a z"]


def test_names(evaluate):
    def name(sheet_id):
        return lambda x: X.export_name(x, F.lit(sheet_id))

    assert evaluate(["Ala ma Kota!", "", None], name("id")) == [
        "ala-ma-kota-id.md", "sheet-id.md", "sheet-id.md"]
    assert evaluate(["--x--", ""], name("")) == ["x.md", "sheet.md"]
    assert evaluate(["2024-01-02T03:04", "short"], X.date_prefix) == ["2024-01-02", "short"]
    assert evaluate(["J 3,16.18:2"], lambda x: X.file_safe(x, F.lit("NA.28"))) == [
        "J_3_16_18_2_NA_28"]


def test_links(evaluate):
    html = '<a class="B" href="x">J 3,16</a> <a class="BC">n</a> <a href="y" class="c B">k</a>'
    assert evaluate([html], X.link_addresses) == [["J 3,16", "k"]]
    marked = evaluate([html], lambda x: X.annotate_links(x, F.lit('A$1"')))[0]
    assert marked.startswith('<a class="B" href="x" data-source="A$1&quot;" '
                             'data-address="J 3,16">J 3,16</a> <a class="BC">n</a>')


def test_betacode(evaluate):
    assert evaluate(["Λόγος", "ᾳ", "a", None, "한", "ι"], greek.greek_to_betacode) == [
        "logos", "a", " ", None, "   ", "i"]


def test_betacode_equals_a_normaliser_on_greek_blocks(evaluate):
    chars = [chr(p) for a, b in ((0x370, 0x400), (0x1F00, 0x2000)) for p in range(a, b)
             if unicodedata.category(chr(p)) != "Cn"]

    def expected(char):
        kept = [c for c in unicodedata.normalize("NFD", char) if c not in greek.MARKS]
        return "".join(greek.LETTERS.get(c.lower(), " ") for c in kept)

    assert evaluate(chars, greek.greek_to_betacode) == [expected(c) for c in chars]


def test_lenient_int(evaluate):
    assert evaluate(["16", "-3", "16abc", "", " ", "x", " 7 "], core.lenient_int) == [
        16, -3, 16, None, None, None, 7]


def test_entry_fields(evaluate):
    entry = ('<dl><dt><a>x&amp;</a></dt><dd><span class="meaning">m <i>n</i></span>'
             '<span class="parse">P</span><ul><li><a href="S:1">f1</a></li>'
             '<li><a href="T:1">f2</a></li></ul></dd></dl>')

    def read(x):
        xml = E.wrap_entry(x)
        return E.entry_fields(F.when(E.is_well_formed(xml), xml))

    got = [tuple(r) for r in evaluate([entry, "<dl>", None, "plain"], read)]
    assert got == [("x&amp;", "m  n", "P", ["f1"]), (None, None, None, []),
                   (None, None, None, []), (None, "", None, [])]


@pytest.mark.parametrize("definition", [
    "<dl>", "a & b", "a &nbsp; b", "<a href=x>y</a>", "<b><i></b></i>", "<1a/>", "&#0;", "<x",
    "</versespan-entry><versespan-entry>", "]]>", "<?xml version='1.0'?>"])
def test_malformed_entries_are_seen(evaluate, definition):
    assert evaluate([definition], lambda x: E.is_well_formed(E.wrap_entry(x))) == [False]


def test_cosine(spark):
    row = spark.sql("select array(1f, 0f) a, array(0f, 0f) z, array(0f, 2f) b").select(
        vectors.cosine_distance(F.col("a"), F.col("a")),
        vectors.cosine_distance(F.col("a"), F.col("b")),
        vectors.cosine_distance(F.col("a"), F.col("z"))).first()
    assert row[0] == 0.0 and row[1] == 1.0 and math.isnan(row[2])


@pytest.mark.parametrize("data, title, items", [
    ('{"title":"t","items":[{"kind":"note","content":"c","address":"z"}]}', "t",
     [("note", "", "", "c")]),
    ('[{"kind":"pericope","address":"J 1","source":"N","content":"z"}]', "",
     [("pericope", "J 1", "N", "")]),
    ('{"items":3}', "", []),
    ('{"title":"t","items":[{"kind":"note"},{"content":"x"}]}', "", []),
    ('{"title":3,"items":[]}', "", []),
    ('{"title":"t","items":[{"kind":"x"},{"kind":"pericope","address":"","source":""}]}',
     "t", []),
    ('{"title":null,"items":[{"kind":"note","content":null}]}', "", [("note", "", "", "")]),
    ('{"items":[{"kind":5}]}', "", []),
    ("bad", "", []), (None, "", []), ("7", "", []),
])
def test_decode_sheet(evaluate, data, title, items):
    got = evaluate([data], J.decode_sheet)[0]
    assert (got["title"], [tuple(i) for i in got["items"]]) == (title, items)


def test_sheet_ids(evaluate):
    good = "0a000000-0000-4000-B000-000000000001"
    assert evaluate([good, good + "x", good.replace("-4", "-9"), None], J.is_sheet_id) == [
        True, False, False, False]
