"""What grew faster than its table on larger ones: sizes that tasks hold, send and return."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from conftest import rows

from versespan.operators import cells, dictionary, joins, lookup, references, search


def _vectors(frame, seed=3, n=90, same=4):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n // same + 1, 6)).round(3).tolist()
    verses = frame("id string, source string", *[(f"v{i:03}", f"s{i % 2}") for i in range(n)])
    stored = frame("id string, embedding array<float>",
                   *[(f"v{i:03}", vectors[i // same]) for i in range(n)])
    asked = frame("request_id int, source string, vector array<float>",
                  *[(i, f"s{i % 2}", rng.normal(size=6).tolist()) for i in range(25)])
    return verses, stored, asked


def test_equal_vectors_meet_queries_once(frame, monkeypatch):
    """Ids of equal vectors come back in order of the id, but one vector is scored for all."""
    verses, stored, asked = _vectors(frame)
    few = search.nearest_in_source(asked, verses, stored, 5)
    monkeypatch.setattr(search, "ROWS_PER_BLOCK", 4)
    monkeypatch.setattr(search, "QUERIES_PER_BLOCK", 3)
    many = search.nearest_in_source(asked, verses, stored, 5, broadcast_rows=0)
    columns = ["request_id", "id", "distance", "rank"]
    assert rows(many, *columns) == rows(few, *columns)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and "collect_list" not in plan


def test_one_id_with_two_vectors(frame):
    verses, stored, asked = _vectors(frame)
    twice = stored.unionByName(frame("id string, embedding array<float>",
                                     *[(f"v{i:03}", [float(i), 1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(9)]))
    few = search.nearest_in_source(asked, verses, twice, 200)
    many = search.nearest_in_source(asked, verses, twice, 200, broadcast_rows=0)
    assert rows(many, "request_id", "id", "distance") == rows(few, "request_id", "id", "distance")


def test_sums_of_cells_hold_one_batch():
    """A batch's sums leave before the next batch is read."""
    read = []

    def batches():
        for cell in range(3):
            read.append(cell)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["s", "s", "s"]), pa.array([2, 2, 1], pa.int32()),
                 pa.array([cell, cell, cell], pa.int64()),
                 pa.array([[3.0, 4.0], [0.0, 0.0], [2.0]], pa.list_(pa.float32()))],
                ["source", "dims", "cell", "embedding"])

    out = cells._sums(batches())
    first = [next(out), next(out)]
    assert read == [0]
    found = sorted((r["dims"], r["place"], r["total"]) for b in first for r in b.to_pylist())
    assert [f[:2] for f in found] == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    assert np.allclose([f[2] for f in found], [1.0, 1.0, 2.0, 0.6, 0.8])


def _references(frame):
    books = frame("language string, source_number int, book_number int, short_name string",
                  ("en", 1, 1, "A"), ("en", 1, 2, "B"))
    sources = frame("source_number int, language string, name string", (1, "en", "S"))
    refs = frame("book_number int, chapter int, verse int, b1 int, c1 int, v1 int, b2 int, c2 int, "
                 "v2 int, rate int",
                 *[(1 + i % 2, 1, 1 + i % 3, 1 + i % 2, 2, 1 + i % 5, None, None, None,
                    None if i % 7 == 0 else i % 4) for i in range(60)])
    asked = [(i, f"{'AB'[i % 2]} 1,1-2", "S") for i in range(30)]
    asked += [(4, "B 1,1-2", "S"), (4, "B 1,1-2", "S"), (7, "B 1,1-2", "S"), (7, "B 1,3", "none"),
              (None, "A 1,1", "S"), (None, "B 1,2", "S"), (40, "A", "S"), (41, "A 9,9", "S")]
    return frame("request_id int, address string, source string", *asked), refs, books, sources


def test_many_requests_travel_to_the_answers(spark, frame, monkeypatch):
    monkeypatch.setattr(references, "REQUESTS_PER_LIST", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = references.cross_references_by_address(*_references(frame), broadcast_rows=12).rows
        plan = found._jdf.queryExecution().executedPlan().toString()
        whole = references.cross_references_by_address(*_references(frame), broadcast_rows=0).rows
        assert rows(found) == rows(whole)
        assert "BroadcastHashJoin [question" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_answers_are_ordered_once(frame):
    """Places of requests that ask the same, more than one thing, twice the same, or nothing."""
    request = _references(frame)
    every = joins.placed(references.in_reference_order(
        references.cross_references_by_address(*request).rows))
    columns = ["place", "request_id", "rate", "reference"]
    for broadcast_rows in (50_000, 0):
        found = references.placed_references_by_address(*request, broadcast_rows=broadcast_rows)
        assert rows(found, *columns) == rows(every, *columns)
        assert rows(found, "request_id", "address") == rows(every, "request_id", "address")


def test_running_total(frame):
    df = frame("k int, n bigint", *[(i, i % 4) for i in range(50)]).repartition(5)
    got = rows(joins.running_total(df.orderBy("k"), "n", "before"))
    assert got == sorted([(i, i % 4, sum(j % 4 for j in range(i))) for i in range(50)], key=repr)


def test_repeated_addresses_are_read_once(frame, monkeypatch):
    addresses = ["A 1,2-3", "A 1,x", "A 1,2..3", "B 99999999999", "", " ", None, "C"]
    requests = frame("request_id int, address string",
                     *[(None if i % 9 == 0 else i % 20, addresses[i % 8]) for i in range(80)])
    parsed, asked = lookup.parse_requests, []
    monkeypatch.setattr(lookup, "parse_requests",
                        lambda df, *a: asked.append(df.count()) or parsed(df, *a))
    once = [rows(part) for part in lookup.parse_addresses(requests)]
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 1)              # too many different ones
    each = [rows(part) for part in lookup.parse_addresses(requests)]
    assert asked == [8, 80] and once == each and len(once[1]) == 20


def test_words_are_not_shuffled_one_by_one(spark, frame):
    """Verses that repeat an id, requests that repeat a verse; the words of a verse stay together."""
    texts = frame("id string, text string", ("a", "λόγος ἦν λόγος"), ("a", "λόγος ὁ"),
                  ("a", "λόγος ὁ"), ("b", "..."), ("c", None), (None, "ἦν"))
    ids = frame("request_id int, id string", (1, "a"), (2, "a"), (2, "a"), (3, "b"), (4, "c"),
                (None, "a"), (5, None))
    entry = "<dl><dt><a>L</a></dt></dl>"
    known = frame("language string, source_number int, topic string, definition string",
                  ("grc", 1, "logos", entry), ("grc", 2, "logos", entry), ("grc", 1, "hn", "<dl>"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        once = dictionary.entries_of(texts, ids, known, small=True)
        each = dictionary.entries_of(texts, ids, known)
        assert rows(once.rows) == rows(each.rows) and len(rows(once.rows)) == 12
        assert rows(once.rejects) == rows(each.rejects) and len(rows(once.rejects)) == 4
        plan = once.rows._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(id" in plan and "verse_word" not in "".join(
            line for line in plan.splitlines() if "hashpartitioning" in line)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
