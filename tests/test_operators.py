from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from versespan import schemas
from versespan.operators import commentaries as C
from versespan.operators import constraints, dictionary, errata, export, joins, lookup
from versespan.operators import errata_rules as R
from versespan.operators import references, search, selection, sheets, stories

BOOKS = "language string, source_number int, book_number int, short_name string"


@pytest.fixture
def books(frame):
    return frame(BOOKS, ("la", 1, 500, "J"), ("la", 1, 230, "Ps"), ("pl", 1, 500, "J"),
                 ("pl", 2, 500, "Jan"), ("pl", 1, 490, "Lk"))


@pytest.fixture
def verses(frame):
    out = []
    for language, source, number, book, book_number in (
            ("la", "NVUL", 1, "J", 500), ("la", "NVUL", 1, "Ps", 230),
            ("pl", "BT", 1, "J", 500), ("pl", "UB", 2, "Jan", 500)):
        for chapter in (1, 2, 3):
            for verse in (1, 2, 3, 16, 17, 18):
                out.append((f"{language}/{number}/{book_number}/{chapter}/{verse}", language,
                            source, book, book + "!", f"{book} {chapter},{verse}", number,
                            book_number, chapter, verse, f"t{chapter}.{verse}"))
    return frame(schemas.VERSES, *out)


@pytest.mark.parametrize("limit", [0, 1000])
def test_fetch_verses(frame, verses, books, limit):
    requests = frame("request_id int, address string, source string",
                     (1, "J 3,16-17", "NVUL"), (2, "J 3,16", None), (3, "Ps 2", "NVUL"),
                     (4, "Ps", None), (5, "J 3,1..2", "NVUL"), (6, "X 1", None),
                     (7, "J 1,1-3.2-18", "BT"), (8, None, None), (9, "J 2", None))
    got, rejects = lookup.fetch_verses(requests, verses, books, broadcast_rows=limit)
    counts = dict(rows(got.groupBy("request_id").count()))
    assert counts == {1: 2, 2: 3, 3: 6, 4: 18, 7: 6, 9: 18}
    assert rows(rejects) == [(5, "verse is not a number")]
    assert rows(got.filter("request_id = 2"), "source") == [("BT",), ("NVUL",), ("UB",)]
    shown = lookup.in_canonical_order(got.filter("request_id = 2")).collect()
    assert [r["language"] for r in shown] == ["la", "pl", "pl"]


def test_batch_equals_single_requests(frame, verses, books):
    asked = [(1, "J 3,16-17", "NVUL"), (2, "J", None), (3, "Ps 2", None)]
    schema = "request_id int, address string, source string"
    together = rows(lookup.fetch_verses(frame(schema, *asked), verses, books).rows)
    alone = []
    for request in asked:
        alone += rows(lookup.fetch_verses(frame(schema, request), verses, books).rows)
    assert together == sorted(alone, key=repr)


def test_no_nested_loops_or_python(frame, verses, books):
    requests = frame("request_id int, address string, source string", (1, "J", None))
    for limit in (0, 1000):
        plan = lookup.fetch_verses(requests, verses, books, broadcast_rows=limit).rows \
            ._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


@pytest.mark.parametrize("limit", [0, 1000])
def test_commentaries(frame, limit):
    notes = frame(schemas.COMMENTARIES,
                  ("pl", 1, 490, 1, 30, 2, 3, None, "a", "long"),
                  ("pl", 1, 490, 1, 30, None, None, None, "b", "open"),
                  ("pl", 1, 490, 1, 1, 900000000, 1, None, "c", "endless"),
                  ("pl", 2, 490, 1, 1, 9, 9, None, "d", "other source"))
    ids = frame("request_id int, verse_id string", (1, "pl/1/490/1/31"), (2, "pl/1/490/2/1"),
                (3, "pl/1/490/2/4"), (4, "pl/1/490/x/4"), (5, "pl/1/490/1"))
    got, rejects = C.fetch_commentaries(ids, notes, broadcast_rows=limit)
    assert rows(got, "request_id", "marker") == [(1, "a"), (1, "c"), (2, "a"), (2, "c"),
                                                 (3, "c")]
    assert [r[0] for r in rows(rejects)] == [4, 5]
    assert C.in_commentary_order(got).first()["marker"] == "c"


def _story_tables(frame, headings):
    told = frame(schemas.STORIES, *[("pl", 1, 500, c, v, t) for c, v, t in headings])
    books = frame(BOOKS, ("pl", 1, 500, "B"))
    sources = frame("language string, source_number int, name string", ("pl", 1, "S"))
    return told, books, sources


def test_render_stories(frame):
    tables = _story_tables(frame, [(1, 1, "p"), (1, 2, "q"), (1, 5, "r"), (3, 1, "s")])
    got = stories.render_stories(*tables)
    assert rows(got, "title", "address", "a", "b") == [
        ("q", "B 1,2-4", 1002, 1004), ("r", "B 1,5-", 1005, 1999), ("r", "B 2,1-", 2001, 2999)]
    kept = stories.render_stories(*tables, keep_last=True)
    assert ("s", "B 3,1-", 3001, 3999) in rows(kept, "title", "address", "a", "b")


def test_render_stories_with_nulls_and_copies(frame):
    got = stories.render_stories(*_story_tables(frame, [
        (1, 1, "a"), (1, 1, "a"), (1, 1, "b"), (2, 3, "c"), (4, None, "d"), (None, 4, "e")]))
    assert rows(got, "title", "address") == [
        ("a", "B 1,1"), ("a", "B 1,1"), ("b", "B 1,1-"), ("b", "B 2,1-2"),
        ("c", "B 2,3-"), ("c", "B 3,1-")]


def test_next_position_over_many_stretches(spark):
    places = spark.range(5000).selectExpr(
        "'g' g", "id * 7 chapter", "id % 3 verse", "floor(id * 7 / 1024) stretch")
    got = joins.next_position(places, ["g"], ["stretch", "chapter", "verse"])
    wrong = got.filter("next_chapter is null or next_chapter <> chapter + 7")
    assert rows(wrong, "chapter") == [(4999 * 7,)]


@pytest.mark.parametrize("limit", [0, 1000])
def test_fetch_stories(frame, limit):
    rendered = frame("source string, book string, title string, address string, a long, b long",
                     ("S", "B", "x", "B 1,2-4", 1002, 1004), ("S", "B", "y", "B 1,5-", 1005, 1999),
                     ("S", "B", "z", "B 1,7", 1007, 1007), ("S", "B", "w", "B 2,1-", 2001, 2999))
    asked = frame("request_id int, source string, address string", (1, "S", "B 1,3-7.4"),
                  (2, "S", "B 1"), (3, "T", "B 1,3"), (4, "S", "B 1,999-1003"))
    got = stories.fetch_stories(asked, rendered, broadcast_rows=limit).rows
    assert rows(got, "request_id", "title") == [
        (1, "x"), (1, "x"), (1, "x"), (1, "y"), (1, "y"), (1, "y"),
        (4, "w"), (4, "w"), (4, "w"), (4, "y")]


REFS = [(500, 3, 16, 490, 1, 2, None, None, None, 5), (500, 3, 16, 490, 1, 2, 490, 1, 4, None),
        (500, 3, 16, 490, 1, 2, 500, 1, 4, 7), (500, 3, 17, 490, 1, 2, None, None, None, 6)]


@pytest.mark.parametrize("limit", [0, 1000])
def test_cross_references(frame, books, limit):
    refs = frame(schemas.REFS, *REFS)
    ids = frame("request_id int, verse_id string", (1, "pl/2/500/3/16"), (2, "xx/1/500/3/17"))
    got = references.cross_references(ids, refs, books, broadcast_rows=limit).rows
    ordered = references.in_reference_order(got.filter("request_id = 1")).collect()
    assert [(r["address"], r["reference"], r["rate"]) for r in ordered] == [
        ("Jan 3,16", "Lk 1,2-4", None), ("Jan 3,16", "Lk 1,2-J 1,4", 7), ("Jan 3,16", "Lk 1,2", 5)]
    assert rows(got.filter("request_id = 2"), "address", "reference") == [(" 3,17", "1,2")]


@pytest.mark.parametrize("limit", [0, 1000])
def test_cross_references_by_address(frame, books, limit):
    refs = frame(schemas.REFS, *REFS)
    sources = frame("language string, source_number int, name string", ("pl", 1, "BT"))
    asked = frame("request_id int, address string, source string", (1, "J 3,16-17.16", "BT"),
                  (2, "J 3", "BT"), (3, "J 3,17", "none"), (4, "Jan 3,17", "BT"))
    got = references.cross_references_by_address(
        asked, refs, books, sources, broadcast_rows=limit).rows
    assert set(rows(got)) == {
        (1, "J 3,16", "Lk 1,2", 5), (1, "J 3,16", "Lk 1,2-4", None),
        (1, "J 3,16", "Lk 1,2-J 1,4", 7), (1, "J 3,17", "Lk 1,2", 6),
        (3, " 3,17", "1,2", 6), (4, "J 3,17", "Lk 1,2", 6)}
    assert got.count() == 6


def test_normalize_cross_refs(frame):
    raw = frame(schemas.REFS_RAW, ("Gen.1.1", "exo.2.3-Exo.2.5", "16"), ("Gen.1", "Zz.1.x", "z"),
                ("Gen.1.1", "Gen.1.2", " -3b"))
    names = frame("name string, number int", ("GEN", 10), ("Exo", 20))
    assert rows(references.normalize_cross_refs(raw, names)) == [
        (10, 1, 1, 10, 1, 2, None, None, None, -3), (10, 1, 1, 20, 2, 3, 20, 2, 5, 16),
        (10, 1, None, None, 1, None, None, None, None, None)]


def test_verse_dictionary(frame):
    corpus = frame("id string, text string", ("grc/1/1/1/1", "<pb/>Λόγος ἦν, λόγος κακος"),
                   ("grc/1/1/1/1", "λόγος"), ("grc/1/1/1/2", "other"))
    entry = '<dl><dt><a>L</a></dt></dl>'
    words = frame(schemas.DICTIONARY, ("grc", 1, "logos", entry, None, None, None, None),
                  ("en", 9, "logos", entry, None, None, None, None),
                  ("grc", 1, "kakos", "<dl>", None, None, None, None))
    asked = frame("request_id int, verse_id string", (1, "grc/1/1/1/1"))
    got, rejects = dictionary.verse_dictionary(asked, corpus, words)
    assert rows(got) == [(1, "hn", None, None, None, []), (1, "logos", "L", "", None, []),
                         (1, "logos", "L", "", None, [])]
    assert rows(rejects) == [(1, "definition is not well-formed: kakos")]


VECTORS = {"near": [1.0, 0.1], "far": [0.0, 1.0], "none": [0.0, 0.0], "same": [1.0, 0.1]}


@pytest.mark.parametrize("limit", [0, 100])
def test_nearest_in_source(frame, limit):
    corpus = frame("id string, source string", *[(k, "S") for k in VECTORS], ("x", "T"))
    stored = frame(schemas.EMBEDDINGS, *VECTORS.items(), ("x", [1.0, 0.0]))
    asked = frame("request_id int, source string, vector array<float>", (1, "S", [2.0, 0.2]),
                  (2, "T", [0.0, 1.0]), (3, "S", None))
    got = search.nearest_in_source(asked, corpus, stored, 4, broadcast_rows=limit)
    assert rows(got, "request_id", "rank", "id") == [
        (1, 1, "near"), (1, 2, "same"), (1, 3, "far"), (1, 4, "none"), (2, 1, "x")]


def test_embedding_failures_stay_on_their_row(frame):
    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [[] if t == "empty" else [float(len(t))] for t in texts]

    df = frame("id int, text string", (1, "abc"), (2, "bad"), (3, "  "), (4, None), (5, "empty"))
    got = rows(search.embed_texts(df.coalesce(1), "text", model), "id", "embedding", "error")
    assert got == [(1, [3.0], None), (2, None, "no"), (3, None, None), (4, None, None),
                   (5, None, "model returned no vector")]


def test_embedding_leaves_other_columns_exact(frame):
    """Long numbers beside a NULL, and what pandas has no type of its own for."""
    days = dt.date(9999, 12, 31)
    kind = "id long, day date, parts array<struct<a: long>>, text string"
    given = [(2 ** 53 + 1, days, [(2 ** 53 + 1,), None], "abc"), (None, None, None, "a"),
             (-5, days, [], None)]
    got = search.embed_texts(frame(kind, *given).coalesce(1), "text",
                             lambda texts: [[float(len(t)), 0.1] for t in texts])
    assert rows(got, "id", "day", "parts", "text") == rows(frame(kind, *given))
    assert {r["text"]: r["embedding"] and r["embedding"][0] for r in got.collect()} == {
        "abc": 3.0, "a": 1.0, None: None}


def test_search_branches(frame, verses, books):
    def model(texts):
        return [[1.0, float(len(t))] for t in texts]

    stored = search.embed_texts(verses.select("id", "text"), "text", model).select(
        "id", "embedding")
    asked = frame("request_id int, search string", (1, "@NVUL ~J 3"), (2, "@NVUL ~J 3 abc"),
                  (3, "@BT abc"), (4, "@NVUL"), (5, "~J 3,1..2"), (6, "abc"))
    got, rejects = search.search_verses(asked, verses, books, stored, model, k=4)
    counts = dict(rows(got.groupBy("request_id").count()))
    assert counts == {1: 4, 2: 4, 3: 4}
    assert [r["verse"] for r in got.filter("request_id = 1").orderBy("rank").collect()] == [
        1, 2, 3, 16]
    assert rows(rejects) == [(5, "verse is not a number")]


def _fixed(frame, *texts, stages=R.STAGES):
    df = frame("id string, language string, source_number int, text string", *texts)
    return dict(rows(errata.apply_errata(df, stages), "id", "text"))


def test_errata(frame):
    assert _fixed(
        frame,
        ("grc/47/140/5/9", "grc", 47, "a<>b0</S>"), ("grc/47/350/7/1", "grc", 47, "<Q>><G>Ισραηλ<g><X>c"),
        ("g1", "grc", 47, "<mydiv>x<div a>y"), ("g2", "grc", 47, "<individual>x"),
        ("g3", "grc", 1, "<WW>a<S>0</S><LXX1>b<small x>c</e>"), ("g4", "grc", 1, "<<a>>"),
        ("g5", "grc", 1, "κυριου <S>2962</S> <m>>"),
        ("p1", "pl", 18, "tekst (1) i (2)x"), ("p2", "pl", 17, "tekst (1)"),
        ("p3", "pl", 1, "a<CM>b<CM>c"), ("p4", "pl", 1, "a &gt; b &lt;"),
        ("p5", "pl", 1, "Raz.Dwa,Źle,x"), ("p6", "pl", 1, "a > b <i>c</i>"),
        ("pl/12/470/18/11", "pl", 12, "<Albowiem nie zginęło>"),
        ("l1", "la", 1, "a.Bc,de"), ("l2", "la", 1, "a,de"), ("e1", "en", 1, "a.Bc <<>>"),
        ("n1", "pl", 1, None),
    ) == {
        "grc/47/140/5/9": "ab", "grc/47/350/7/1": "c", "g1": "xy", "g2": "<individual>x",
        "g3": "abc", "g4": "<a>", "g5": "κυριου <S>2962</S> <m>N-GSM</m>", "p1": "tekst ix",
        "p2": "tekst (1)", "p3": "a<n>b<CM>c</n>", "p4": "a › b ‹", "p5": "Raz. Dwa, Źle,x",
        "p6": "a › b <i>c</i>", "pl/12/470/18/11": "[Albowiem nie zginęło]",
        "l1": "a. Bc, de", "l2": "a,de", "e1": "a.Bc <<>>", "n1": None,
    }


def test_errata_change_nothing_the_second_time(frame):
    texts = [("pl", "a<b>x</b> > y.Zz &gt; <i>k</i>"), ("la", "a.Bc;de"),
             ("grc", "<div class='x'>a</div><small>b</small><S>0</S>"), ("en", "<b>x</b>")]
    once = errata.apply_errata(frame(
        "id string, language string, source_number int, text string",
        *[(str(i), lang, 1, text) for i, (lang, text) in enumerate(texts)]))
    assert rows(errata.apply_errata(once)) == rows(once)


def test_errata_rules_cover_the_list():
    listed = [r for stage in R.STAGES for r in stage]
    assert sum(isinstance(r, R.RowRule) for r in listed) == 35


def test_row_rules_in_order(frame):
    text = frame("id string, text string", ("a", "x"), ("b", "x"))
    rules = frame("row_id string, seq int, find string, replacement string",
                  ("a", 2, "y", "z"), ("a", 1, "x", "y"))
    assert rows(errata.apply_row_rules(text, rules)) == [("a", "z"), ("b", "x")]


def test_missing_reference_is_added_once(frame):
    refs = errata.add_missing_reference(frame(schemas.REFS, *REFS))
    assert refs.count() == 5 and errata.add_missing_reference(refs).count() == 5


def test_markers(frame):
    link = '<span class="vuhead"><a x>12</a></span> t'
    df = frame("language string, marker string, text string", ("grc", "a", link),
               ("pl", "b c", link), ("fr", "b c", link))
    assert rows(errata.repair_markers(df), "language", "marker") == [
        ("fr", "b c"), ("grc", "12"), ("pl", "bc")]


T0, T1, T2 = (dt.datetime(2024, 1, day) for day in (1, 2, 3))


def test_upsert(frame):
    target = frame(schemas.SHEETS, ("a", "{}", T0), ("b", "{}", T0))
    changes = frame("id string, data string, ts timestamp", ("a", "1", T1), ("a", "2", T2),
                    ("c", "3", T1), ("c", "4", T2), (None, "5", T1), (None, "5", T1),
                    ("a", None, T2), ("d", None, T1), (None, None, T1))
    assert sheets.check_changes(changes).rejects.count() == 3
    got = sheets.upsert_sheets(target, changes)
    assert rows(got.filter("length(id) = 1")) == [("a", "2", T0), ("b", "{}", T0), ("c", "4", T1)]
    new = got.filter("length(id) = 36")
    assert new.count() == 2 and new.select("id").distinct().count() == 2


def test_cleanup(frame):
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 9)
    df = frame(schemas.SHEETS, ("1", "{}", old), ("2", '{"title":"  "}', old),
               ("3", '{"title":"x"}', old), ("4", "{}", new), ("5", "[]", old))
    kept, removed = sheets.cleanup_sheets(df, F.lit("2024-01-10").cast("timestamp"))
    assert rows(kept, "id") == [("3",), ("4",)] and removed.first()["removed"] == 3


@pytest.mark.parametrize("block", [2, 4096])
def test_carry_forward(frame, block):
    items = [None, "A", None, "B", None, None, None, "C", None]
    df = frame("g int, pos int, source string", *[(1, i, s) for i, s in enumerate(items)],
               (2, 0, None))
    got = joins.carry_forward(df, ["g"], "pos", "source", "above", block_size=block)
    assert [r[2] for r in rows(got, "g", "pos", "above") if r[0] == 1] == [
        None, None, "A", "A", "B", "B", "B", "B", "C"]


def test_source_above(frame):
    df = frame("g int, pos int, source string", (1, 0, None), (1, 1, "A"), (1, 2, None),
               (1, 3, "B"), (1, 4, None))
    got = sheets.fill_source(df, ["g"], "pos")
    assert rows(got, "pos", "source_above") == [(0, "NVUL"), (1, "NVUL"), (2, "A"), (3, "A"),
                                                (4, "B")]


def test_batch_input(frame):
    items = frame("sheet_id string, pos int, kind string, source string",
                  ("s", 0, "note", ""), ("s", 1, "pericope", "A"), ("s", 2, "pericope", "B"))
    inputs = frame("input_id int, sheet_id string, at int, batch string",
                   (1, "s", 0, "J 1;Ps 2"), (2, "s", 1, "J 1"), (3, "s", 2, "J 1"),
                   (4, "s", 3, " J 1 ;; "), (5, "s", 3, "J 9"), (6, "t", 0, ";"))
    assert rows(sheets.batch_requests(inputs, items)) == [
        (1, "NVUL", 0, "J 1"), (1, "NVUL", 1, "Ps 2"), (2, "NVUL", 0, "J 1"), (3, "A", 0, "J 1"),
        (4, "B", 0, "J 1"), (5, "B", 0, "J 9")]


def test_hydrate_and_markdown(frame, verses, books):
    data = ('{"title":"T","items":[{"kind":"note","content":"<s>n</s>"},'
            '{"kind":"pericope","address":"J 3,16-17","source":"NVUL"},'
            '{"kind":"pericope","address":"J 3,1..2","source":"NVUL"},'
            '{"kind":"pericope","address":"J 9,1","source":"NVUL"},'
            '{"kind":"pericope","address":"J 1","source":""}]}')
    df = frame(schemas.SHEETS, ("s", data, T0), ("e", "{}", T0))
    got = sheets.hydrate_sheets(df, verses, books)
    assert rows(got.filter("sheet_id = 's'"), "pos", "kind", "verse") == [
        (0, "note", None), (1, "pericope", 16), (1, "pericope", 17), (3, "pericope", None)]
    assert rows(got.filter("sheet_id = 'e'"), "pos", "source", "verse") == [
        (0, "NVUL", 16), (0, "NVUL", 17), (1, "NA28", None), (2, "BT_03", None),
        (3, "TRO+", None)]
    text = dict(rows(joins.joined_parts(export.sheet_markdown(df, verses, books), ["sheet_id"])))
    assert text["s"] == ("# T\n\nn\n\n###### J 3,16-17 (NVUL)\n- <sup>16</sup> t3.16\n"
                         "- <sup>17</sup> t3.17\n\n###### J 9,1 (NVUL)")
    assert text["e"].startswith("###### J 3,16-17 (NVUL)\n- <sup>16</sup> t3.16")


def test_saved_sheets(frame):
    saves = frame("sheet_id string, saved_at string, data string",
                  ("a", "2024-01-01", '{"title":"x","items":[{}]}'),
                  ("a", "2024-01-03", '{"title":5,"items":"no"}'),
                  ("b", "2024-01-02", '{"title":"y","items":[{},{}]}'), ("", "2024", "{}"),
                  ("c", "2024-01-09", "{}"))
    got = sheets.saved_sheets(saves, frame("sheet_id string", ("c",)))
    assert [tuple(r) for r in sheets.most_recent_first(got).collect()] == [
        ("a", "", "2024-01-03", 0), ("b", "y", "2024-01-02", 2)]
    assert sheets.saved_count(got).first()[0] == 2


def test_collapse_ranges(frame):
    schema = ("request_id int, book_number int, chapter int, verse int, language string, "
              "source string, id string, address string")

    def verse(request, chapter, n, source="S"):
        return (request, 1, chapter, n, "l", source, f"{source}{chapter}/{n}",
                f"J {chapter},{n}")

    df = frame(schema, *[verse(1, 3, n) for n in (16, 17, 18, 20)], verse(2, 3, 36),
               verse(2, 4, 37), verse(2, 4, 1), verse(3, 1, 5), verse(3, 2, 6), verse(3, 3, 7),
               verse(4, 1, 1, "S"), verse(4, 1, 1, "T"), verse(4, 1, 2, "S"))
    assert rows(joins.joined_parts(export.collapse_ranges(df), ["request_id"])) == [
        (1, "J 3,16-18.20"), (2, "J 3,36.1.37"), (3, "J 1,5-7"), (4, "J 1,1.1-2")]


def test_collapsed_runs_are_found_in_one_order(frame):
    """Repeated, missing and extreme numbers; no join beyond those of runs with chapters and
    of parts with their first."""
    schema = ("request_id int, book_number int, chapter int, verse int, language string, "
              "source string, id string, address string")
    most = 2**31 - 1
    df = frame(schema, *[(r, b, c, v, "l", "S", str(i), f"J {c},{v}") for i, (r, b, c, v) in enumerate([
        (1, 1, 1, 1), (1, 1, 1, 2), (1, 1, 1, 2), (1, 1, 1, 3), (1, 1, 2, 4), (1, 1, 3, 5),
        (1, 1, 3, 6), (1, 1, 3, 8), (1, 1, 4, 9), (1, 2, 1, 10), (2, 1, 1, -most - 1),
        (2, 1, 1, most - 1), (2, 1, 1, most), (3, None, 1, 1), (3, 1, 1, 7), (None, 1, 1, 1)])])
    got = export.collapse_ranges(df)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 3
    assert rows(joins.joined_parts(got, ["request_id"])) == [
        (1, "J 1,1-2.2-6.8-10"), (2, f"J 1,{-most - 1}.{most - 1}-{most}"), (3, "J 1,7")]


def test_collapse_then_parse_gives_the_verses(frame, spark):
    df = spark.range(200).selectExpr(
        "1 request_id", "1 book_number", "2 chapter", "cast(1 + (id * id) % 211 as int) verse",
        "'l' language", "'S' source").distinct().selectExpr(
        "*", "cast(verse as string) id", "concat('J 2,', verse) address")
    text = joins.joined_parts(export.collapse_ranges(df), ["request_id"], "address")
    again = lookup.parse_addresses(text).rows
    assert rows(again, "verse") == rows(df, "verse")


def test_export_documents(frame, verses):
    asked = frame("request_id int, address string, source string", (1, "J 3,17-", "NVUL"),
                  (2, "Ps", "NVUL"), (3, "Ps 2", "none"), (4, "J x1", "NVUL"))
    got, rejects = export.export_rows(asked, verses)
    assert [r[0] for r in rows(rejects)] == [4]
    docs = dict(rows(joins.joined_parts(export.export_documents(got), ["request_id"])))
    assert docs[1] == (
        '{"source":"NVUL","book":"J","book_name":"J!","address":"J 3,17-","chapters":'
        '{"3":[{"verse":17,"text":"t3.17"},{"verse":18,"text":"t3.18"}]}}')
    assert docs[2].index('"1":[') < docs[2].index('"2":[') < docs[2].index('"3":[')
    assert set(docs) == {1, 2}


def test_export_reads_the_first_language(frame, verses):
    twin = verses.filter("source = 'NVUL' and book = 'Ps'").withColumn("language", F.lit("aa"))
    asked = frame("request_id int, address string, source string", (1, "Ps 1", "NVUL"),
                  (2, "J 1", "NVUL"))
    got = export.export_rows(asked, verses.unionByName(twin)).rows
    assert rows(got.groupBy("request_id").count()) == [(1, 6)]


def test_documents_are_written(spark, frame, verses, tmp_path):
    asked = frame("request_id int, address string, source string", (1, "Ps 1,1-2", "NVUL"))
    docs = export.export_documents(export.export_rows(asked, verses).rows)
    export.write_documents(docs, asked, str(tmp_path / "json"))
    stored = spark.read.parquet(str(tmp_path / "json"))
    assert rows(stored.select("file_name").distinct()) == [("Ps_1_1-2_NVUL",)]
    assert rows(joins.joined_parts(stored, ["file_name"]), "document") == rows(
        joins.joined_parts(docs, ["request_id"]), "document")
    sheet = frame("sheet_id string, title string, part array<bigint>, text string",
                  ("id", "A b", [1], "y"), ("id", "A b", [0], "x"))
    export.write_markdown(sheet, str(tmp_path / "md"))
    assert rows(joins.joined_parts(spark.read.parquet(str(tmp_path / "md")), ["file_name"])) == [
        ("a-b-id.md", "xy")]


def test_documents_of_any_size_have_equal_text(spark, frame):
    """A document of many parts, far beyond what one part holds, equals its plain assembly."""
    import json

    rows_ = spark.range(30_000).selectExpr(
        "1 request_id", "'B' requested", "'S' source", "'B' book", "'Book' book_name",
        "cast(1 + id % 3 as int) chapter", "cast(id / 3 as int) verse",
        "concat(repeat('x', 200), id) text")
    parts = export.export_documents(rows_)
    assert parts.count() > 100 and parts.agg(F.max(F.length("text"))).first()[0] < 100_000
    whole = json.loads(joins.joined_parts(parts, ["request_id"]).first()["document"])
    assert list(whole["chapters"]) == ["1", "2", "3"]
    got = [(int(c), v["verse"], v["text"]) for c, vs in whole["chapters"].items() for v in vs]
    assert got == sorted((r["chapter"], r["verse"], r["text"]) for r in rows_.collect())
    lines = frame("k int, i int, text string", *[(1, i, f"{i};") for i in range(1000)], (2, 0, "x"))
    parts = joins.in_parts(lines, ["k"], ["i"])
    assert parts.count() == 5
    assert rows(joins.joined_parts(parts, ["k"])) == [
        (1, "".join(f"{i};" for i in range(1000))), (2, "x")]
    selected = spark.range(3000).selectExpr(
        "1 request_id", "1 book_number", "1 chapter", "cast(2 * id as int) verse", "'l' language",
        "'S' source", "cast(id as string) id", "concat('J 1,', 2 * id) address")
    text = joins.joined_parts(export.collapse_ranges(selected), ["request_id"]).first()["document"]
    assert text == "J 1," + ".".join(str(2 * i) for i in range(3000))


def test_very_wide_ranges_are_neither_arrays_nor_cut(frame):
    asked = frame("request_id int, address string", (1, "J 3,1-700000000"), (2, "J 2,5-6"),
                  (3, "J"))
    got = lookup.parse_addresses(asked).rows
    found = got.groupBy("request_id").agg(F.count("*"), F.min("verse"), F.max("verse"))
    assert rows(found) == [(1, 700000000, 1, 700000000), (2, 2, 5, 6), (3, 1, None, None)]


def test_selection_bundle(frame, verses, books):
    sources = frame("language string, source_number int, name string", ("la", 1, "NVUL"))
    notes = frame(schemas.COMMENTARIES, ("la", 1, 500, 3, 16, 3, 17, None, "m", "note"))
    words = frame(schemas.DICTIONARY, ("la", 1, "x", "<dl/>", None, None, None, None))
    rendered = frame("source string, book string, title string, address string, a long, b long",
                     ("NVUL", "J", "story", "J 3,1-", 3001, 3999))
    chosen = verses.filter("source = 'NVUL' and book = 'J' and chapter = 3").filter(
        "verse in (16, 17)")
    selected = chosen.withColumn("request_id", F.lit(1)).unionByName(
        chosen.filter("verse = 16").withColumn("request_id", F.lit(2)))
    found = selection.selection_bundle(
        selected, verses=verses, books=books, sources=sources,
        refs=frame(schemas.REFS, *REFS), rendered=rendered, commentaries=notes, dictionary=words)
    assert rows(found.references.groupBy("request_id").count()) == [(1, 4), (2, 3)]
    assert rows(found.commentaries, "request_id", "marker") == [(2, "m")]
    assert rows(found.stories, "request_id", "title") == [(2, "story")]
    assert rows(found.dictionary, "request_id").count((1,)) == 0


def test_constraints(frame):
    df = frame("k int, seq int, v string", (1, 2, "b"), (1, 1, "a"), (1, 1, "a"), (2, 1, None),
               (3, 1, "c"))
    kept, rejects = constraints.check_constraints(df, ["k", "v"], ["k"], ["seq"])
    assert rows(kept) == [(1, 1, "a"), (3, 1, "c")]
    assert rows(rejects) == [(1, 1, "a", 1, "duplicate key"), (1, 2, "b", 1, "duplicate key"),
                             (2, 1, None, 1, "missing v")]
    unkeyed = constraints.check_constraints(df, ["k", "v"])
    assert unkeyed.rows.count() == 4 and unkeyed.rejects.count() == 1


def test_repeat_rows(frame):
    df = frame("k string, n long", ("a", 0), ("b", 3), ("c", joins.COPIES_PER_CHUNK + 2))
    got = dict(rows(joins.repeat_rows(df, "n").groupBy("k").count()))
    assert got == {"b": 3, "c": joins.COPIES_PER_CHUNK + 2}


def test_source_lists(frame):
    df = frame("language string, name string, description_short string", ("pl", "B", None),
               ("pl", "A", "Old"), (None, "C", "x"))
    assert rows(lookup.sources_by_language(lookup.list_sources(df))) == [
        ("pl", ["A", "B"]), ("unknown", ["C"])]
    assert rows(lookup.list_sources(df, F.lit("a oLD")), "name") == [("A",)]
    assert lookup.list_sources(df, F.lit("")).count() == 3


def test_table_orders(frame):
    books = frame("language string, book_number int", ("pl", 2), ("la", 3), ("pl", 1))
    assert [tuple(r) for r in lookup.in_table_order(books, "books").collect()] == [
        ("la", 3), ("pl", 1), ("pl", 2)]
