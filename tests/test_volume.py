"""What large tables cost: rows that are shuffled or stored, and results where that is kept low."""

from __future__ import annotations

from itertools import batched

import numpy as np
import pyarrow as pa
import pytest

from conftest import rows
from versespan import schemas
from versespan.operators import cells, joins, nearest, references


def _colliding(frame):
    """References whose labels read the same in a language: names shared, missing or odd."""
    names = {"en": {1: "A", 2: "A", 3: None, 4: "B 1,2-C", 5: "C"}, "pl": {1: "A", 2: "D"}}
    books = frame("language string, source_number int, book_number int, short_name string",
                  *[(lang, 1, b, n) for lang, of in names.items() for b, n in of.items()],
                  *[("en", 2, b, "later") for b in (1, 2)])
    sources = frame("source_number int, language string, name string",
                    (1, "en", "S"), (1, "pl", "P"))
    targets = [(b1, 1, v1, b2, c2, v2) for b1 in (1, 2, 3, 4, 6, None) for v1 in (2, None)
               for b2, c2, v2 in ((None, None, None), (5, 1, 7), (b1, 1, 7), (2, None, 7),
                                  (2, 1, None), (1, 1, 7), (None, 1, 7))]
    refs = [(b, 1, v, *t, None if i % 4 == 0 else i) for i, t in enumerate(targets)
            for b in (1, 2, 3, 4, 9) for v in (1, 2, 2, None)]
    asked = [(1, "A 1,1-2", "S"), (2, "A 1,1-2", "P"), (3, "A 1,1.2", "S"), (3, "A 1,1-2", "S"),
             (4, "D 1,2", "S"), (5, "A 1,1-2", "none"), (None, "A 1,2", "S"), (6, "later 1,1", "P"),
             (6, "later 1,1", "P")]
    return names, frame("request_id int, address string, source string", *asked), \
        frame(schemas.REFS, *refs), books, sources, refs, asked


def _expected(names, refs, asked):
    numbers = {"A": {1, 2}, "D": {2}, "later": {1, 2}, "B 1,2-C": {4}, "C": {5}}
    known = {"S": "en", "P": "pl"}
    out = []
    for request, address, source in asked:
        book, verses = address.split(" 1,")
        verses = {"1-2": (1, 2), "1.2": (1, 2), "2": (2,), "1": (1,)}[verses]
        name = lambda b: names.get(known.get(source), {}).get(b) or ""
        found = {}
        for b, c, v, b1, c1, v1, b2, c2, v2, rate in refs:
            if b not in numbers[book] or c != 1 or v not in verses:
                continue
            full = None not in (b2, c2, v2)
            label = None if v1 is None else f"{name(b1)} {c1},{v1}" + (
                "" if not full else f"-{v2}" if b1 is not None and (b1, c1) == (b2, c2)
                else f"-{name(b2)} {c2},{v2}")
            key = f"{name(b)} {c},{v}", label and label.strip(" ")
            found.setdefault(key, []).append(rate)
        out += [(request, *key, sum(r for r in rates if r is not None)
                 if any(r is not None for r in rates) else None) for key, rates in found.items()]
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [0, 1000])
def test_references_that_read_the_same_are_one(frame, limit):
    names, requests, refs, books, sources, listed, asked = _colliding(frame)
    found = references.cross_references_by_address(requests, refs, books, sources, limit).rows
    assert rows(found) == _expected(names, listed, asked)
    every = joins.placed(references.in_reference_order(found))
    ordered = references.placed_references_by_address(requests, refs, books, sources, limit)
    columns = ["request_id", "address", "reference", "rate"]
    assert rows(ordered, *columns) == rows(every, *columns)
    assert rows(ordered, "place", "request_id", "rate", "reference") == rows(
        every, "place", "request_id", "rate", "reference")


def test_references_are_shuffled_as_numbers(spark, frame):
    """Not once for each question, and not with the question, names or labels."""
    _, requests, refs, books, sources, *_ = _colliding(frame)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = references._answers_by_address(requests, refs, books, sources, 1000).found
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert len(dealt) == 2 and not any(
        word in line for line in dealt for word in ("question", "reference", "language", "name"))


def test_answers_are_sorted_by_the_number_of_what_is_asked(frame, monkeypatch):
    """Its text, of any length, is not sorted and stored with each answer."""
    _, requests, refs, books, sources, *_ = _colliding(frame)
    seen, placed = [], references.placed
    monkeypatch.setattr(references, "placed", lambda df: seen.append(dict(df.dtypes)) or placed(df))
    references.placed_references_by_address(requests, refs, books, sources)
    assert [s["request_id"] for s in seen] == ["bigint"]


def _batches(listed, size):
    for part in batched(listed, size):
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in part]), pa.array(["s"] * len(part)),
             pa.array([v for _, v in part], pa.list_(pa.float32()))], ["id", "source", "embedding"])


def _full_scan(listed, queries, k):
    def distance(a, b):
        a = np.array(a, "float32").astype(float)
        scale = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
        return 1.0 - (a * b).sum() / scale if scale else np.inf

    return sorted((n, i) for n, (_, q) in enumerate(queries) for _, i in sorted(
        (distance(v, np.array(q)), i) for i, v in listed)[:k])


@pytest.mark.parametrize("k", [1, 3, 40, 500])
def test_queries_are_ranked_many_at_a_time(monkeypatch, k):
    """Vectors that single precision can not tell apart, equal ones and some without a length."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    listed = [(f"n{i:03}", (base + i % 50 * 1e-7).tolist()) for i in rng.permutation(150).tolist()]
    listed += [(f"v{i:03}", rng.normal(size=8).tolist()) for i in range(150)]
    listed += [(f"z{i}", [0.0] * 8) for i in range(4)]
    queries = [("s", (base + i * 1e-7).tolist()) for i in range(30)]
    queries += [("s", rng.normal(size=8).tolist()) for _ in range(60)]
    sorts, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda *a, **b: sorts.append(1) or lexsort(*a, **b))
    found = [pair for batch in nearest.best_of_partition(queries, k)(_batches(listed, 100))
             for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
    assert sorted(found) == _full_scan(listed, queries, k)
    assert len(sorts) < len(queries)


def test_cells_store_a_vector_once_for_its_ids(spark, frame, tmp_path):
    """Ids of one source with one vector; ids and sources may be NULL, ids may repeat."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(12, 6)).astype("float32").tolist()
    listed = [(f"v{i:04}", "ab"[i % 2], vectors[i % 12]) for i in range(1200)]
    listed += [("x", None, vectors[0]), (None, "a", vectors[0]), (None, None, vectors[1]),
               ("zero", "a", [0.0] * 6), ("minus", "a", [-0.0] * 6), ("short", "b", [1.0, 2.0])]
    cells.store_cells(frame("id string, source string, embedding array<float>", *listed),
                      str(tmp_path), 64)
    stored = spark.read.parquet(f"{tmp_path}/members")
    assert "id" not in stored.columns and stored.count() < len(listed) / 8
    kept = cells.read_cells(spark, str(tmp_path))
    assert rows(kept.members, "id", "source", "embedding") == rows(
        frame("id string, source string, embedding array<float>", *listed))
    assert kept.directory.agg({"n": "sum"}).first()[0] == len(listed)
    asked = [(i, "ab"[i % 2], rng.normal(size=6).tolist()) for i in range(6)]
    found = cells.nearest_in_cells(
        frame("request_id int, source string, vector array<float>", *asked), kept, 70).rows
    got = [(r["request_id"], r["id"]) for r in found.collect()]
    whole = []
    for request, source, vector in asked:
        part = [(i, v) for i, s, v in listed if s == source and i is not None and len(v) == 6]
        asked_as = np.array(vector, "float32").astype(float)
        whole += [(request, i) for _, i in _full_scan(part, [(source, asked_as)], 70)]
    assert len(got) == len(whole)
    assert sorted(x for x in got if x[1] is not None and x[0] % 2) == sorted(
        x for x in whole if x[0] % 2)


def test_vectors_of_one_mark_stay_apart():
    """Rows are united by their vector, whatever its mark, and only up to a number of ids."""
    n = 3 * cells.IDS_PER_ROW
    vectors = [[1.0, 2.0], [3.0, 4.0]] * n
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["s"] * 2 * n), pa.array(vectors, pa.list_(pa.float32())),
         pa.array([2] * 2 * n, pa.int32()), pa.array([0] * 2 * n, pa.int64()),
         pa.array([[str(i)] for i in range(2 * n)]), pa.array([7] * n + [8] * n, pa.int64())],
        ["source", "embedding", "dims", "cell", "ids", "mark"])
    by_vector = cells._united(batch.set_column(5, "mark", pa.array([0, 1] * n, pa.int64())))
    assert by_vector.num_rows == 6
    assert max(len(x) for x in by_vector.column("ids").to_pylist()) == cells.IDS_PER_ROW
    for united in (cells._united(batch), by_vector):
        pairs = [(i, v) for ids, v in zip(united.column("ids").to_pylist(), united.column(
            "embedding").to_pylist(), strict=True) for i in ids]
        assert sorted(pairs) == sorted((str(i), v) for i, v in enumerate(vectors))
