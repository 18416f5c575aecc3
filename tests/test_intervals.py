"""Interval indexes, what lookups read of a stored corpus, and how many jobs planning takes."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from versespan import schemas
from versespan.operators import commentaries, intervals, joins, references, selection, stories

SPAN = "k string, name string, lo long, hi long"


def brute(spans, asked):
    return sorted(((i, name) for i, k, p in asked for k2, name, lo, hi in spans
                   if k == k2 and lo is not None and hi is not None and lo <= p <= hi), key=repr)


def met(index, frame, asked, small):
    points = frame("i int, k string, block long, first long, last long",
                   *[(i, k, p // 1000, p, p) for i, k, p in asked])
    values = None
    if small:
        points, values = joins.measured(points)
    return rows(intervals.covering(index, points, ["k"], values), "i", "name")


@pytest.mark.parametrize("small", [False, True])
def test_covering_equals_brute_force(frame, monkeypatch, small):
    monkeypatch.setattr(intervals, "BLOCKS_KEPT", 3)
    rng = random.Random(5)
    spans = [(rng.choice("ab"), f"n{i}", lo := rng.randrange(0, 9000), lo + rng.choice(
        [-1, 0, 5, 900, 2500, 7000])) for i in range(300)]
    spans += [("a", "null", None, 5), ("a", "open", 5, None), ("a", "endless", 10, 9 * 10**11)]
    asked = [(i, rng.choice("abc"), rng.randrange(0, 20000)) for i in range(200)]
    index = intervals.interval_index(frame(SPAN, *spans))
    assert met(index, frame, asked, small) == brute(spans, asked)
    widest = index.groupBy("name").count().agg(F.max("count")).first()[0]
    assert widest == 4                              # three blocks and one row for the rest


def test_hot_block_and_empty_sides(frame, spark):
    index = intervals.interval_index(spark.range(20_000).selectExpr(
        "'a' k", "string(id) name", "1000 + id % 7 lo", "1000 + id % 7 + id % 3 hi"))
    found = met(index, frame, [(1, "a", 1000), (2, "a", 1008), (3, "b", 1000)], True)
    assert len(found) == len(brute([("a", str(i), 1000 + i % 7, 1000 + i % 7 + i % 3)
                                    for i in range(20_000)], [(1, "a", 1000), (2, "a", 1008)]))
    assert met(index.limit(0), frame, [(1, "a", 1000)], True) == []
    assert met(index, frame, [], False) == met(index, frame, [], True) == []


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_points_prune_the_stored_index(frame, spark, tmp_path):
    notes = spark.range(5000).selectExpr(
        "if(id % 2 = 0, 'pl', 'la') language", "int(id % 3) source_number", "int(id % 50) book_number",
        "int(id % 40) chapter_number_from", "1 verse_number_from", "int(id % 40 + 1) chapter_number_to",
        "3 verse_number_to", "0 is_preceding", "string(id) marker", "'t' text")
    path = str(tmp_path / "index")
    intervals.store_index(commentaries.commentary_index(notes),
                          ["language", "source_number", "book_number"], "language", path)
    stored = spark.read.parquet(path)
    ids = frame("request_id int, verse_id string", (1, "pl/1/10/11/1"), (2, "pl/1/10/10/2"))
    found = commentaries.fetch_commentaries(ids, stored).rows
    assert rows(found, "request_id", "marker") == rows(
        commentaries.fetch_commentaries(ids, notes).rows, "request_id", "marker")
    plan = _plan(found)
    assert "Generate" not in plan[plan.index("Scan parquet") - 200:plan.index("Scan parquet")]
    pushed = plan[plan.index("PushedFilters"):][:600]
    assert "PartitionFilters: []" not in plan and "block" in pushed and "book_number" in pushed


def _jobs(spark, plan):
    context, group = spark.sparkContext, f"jobs-{random.random()}"
    context.setJobGroup(group, "planning")
    try:
        plan()
        return len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context._jsc.clearJobGroup()


@pytest.fixture
def tables(frame):
    sources = frame("language string, source_number int, name string", ("la", 1, "NVUL"), ("pl", 1, "BT"))
    books = frame("language string, source_number int, book_number int, short_name string",
                  ("la", 1, 500, "J"), ("pl", 1, 500, "Jan"), ("la", 1, 490, "L"))
    refs = frame(schemas.REFS, (500, 3, 16, 490, 1, 2, None, None, None, 5),
                 (500, 3, 17, 490, 1, 2, None, None, None, 6), (500, 4, 18, 490, 1, 2, None, None, None, 9),
                 (500, 3, 18, 490, 1, 2, None, None, None, 1))
    notes = frame(schemas.COMMENTARIES, ("la", 1, 500, 3, 16, 3, 17, None, "m", "note"))
    rendered = frame("source string, book string, title string, address string, a long, b long",
                     ("NVUL", "J", "story", "J 3,1-", 3001, 3999))
    verses = frame(schemas.VERSES, *[
        (f"la/1/500/{c}/{v}", "la", "NVUL", "J", "John", f"J {c},{v}", 1, 500, c, v, "λόγος x")
        for c in (3, 4) for v in range(15, 20)])
    words = frame(schemas.DICTIONARY, ("la", 1, "logos", "<dl/>", None, None, None, None))
    return dict(verses=verses, books=books, sources=sources, refs=refs, rendered=rendered,
                commentaries=notes, dictionary=words)


def _chosen(verses, *ids):
    return verses.select("*").join(verses.sparkSession.createDataFrame(
        list(ids), "request_id int, id string"), "id")


@pytest.mark.parametrize("limit", [0, joins.BROADCAST_ROWS])
def test_selection_by_place(tables, limit):
    """Verse numbers of all chapters count in the chapter of the first verse, and equal
    selections are answered each for itself."""
    picked = [(1, "la/1/500/3/16"), (1, "la/1/500/4/18"), (2, "la/1/500/3/16"), (3, "la/1/500/3/16"),
              (4, "la/1/500/4/19"), (4, "la/1/500/4/19")]
    found = selection.selection_bundle(_chosen(tables["verses"], *picked), **tables, broadcast_rows=limit)
    assert rows(found.references, "request_id", "address", "rate") == [
        (1, "J 3,16", 5), (1, "J 3,18", 1), (2, "J 3,16", 5), (3, "J 3,16", 5)]
    assert rows(found.commentaries, "request_id", "marker") == [(2, "m"), (3, "m")]
    assert rows(found.stories, "request_id", "title") == [(2, "story"), (3, "story")]
    assert {r[0] for r in rows(found.dictionary, "request_id")} == {2, 3, 4}


def test_planning_takes_few_jobs(spark, tables, tmp_path):
    stored = dict(tables)
    for name, df in (("verses", tables["verses"]), ("refs", tables["refs"]), ("books", tables["books"]),
                     ("sources", tables["sources"]), ("commentaries", commentaries.commentary_index(
                         tables["commentaries"])), ("rendered", stories.story_index(tables["rendered"]))):
        df.write.parquet(str(tmp_path / name))
        stored[name] = spark.read.parquet(str(tmp_path / name))
    selected = _chosen(stored["verses"], (1, "la/1/500/3/16"), (2, "la/1/500/3/17"))
    ids = spark.createDataFrame([(1, "la/1/500/3/16")], "request_id int, verse_id string")
    told = spark.createDataFrame([(1, "NVUL", "J 3,1-2")], "request_id int, source string, address string")
    assert _jobs(spark, lambda: selection.selection_bundle(selected, **stored)) <= 6
    assert _jobs(spark, lambda: commentaries.fetch_commentaries(ids, stored["commentaries"])) <= 2
    assert _jobs(spark, lambda: stories.fetch_stories(told, stored["rendered"])) <= 2
    assert _jobs(spark, lambda: references.cross_references(ids, stored["refs"], stored["books"])) <= 2


def test_index_of_nothing(frame):
    asked = frame("request_id int, verse_id string", (1, "pl/1/1/1/1"))
    empty = commentaries.commentary_index(frame(schemas.COMMENTARIES))
    assert rows(commentaries.fetch_commentaries(asked, empty).rows) == []
