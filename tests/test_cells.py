"""Exact search by cells: the rows of a full scan, with cells left unread."""

from __future__ import annotations

import math

import numpy as np
import pytest

from versespan.operators import cells

SCHEMA = "id string, source string, embedding array<float>"
ASKED = "request_id int, source string, vector array<float>"


def brute(rows, queries, k):
    def distance(a, b):
        a, b = (np.array(x, "float32").astype(float) for x in (a, b))
        scale = math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())
        return float(1 - (a * b).sum() / scale) if scale else math.inf

    out = []
    for request, source, vector in queries:
        if source is None or not vector or any(x is None or math.isnan(x) for x in vector):
            continue
        near = sorted((round(distance(v, vector), 9), i) for i, s, v in rows
                      if s == source and v and len(v) == len(vector)
                      and not any(x is None or math.isnan(x) for x in v))[:k]
        out += [(request, i, rank) for rank, (_, i) in enumerate(near, 1)]
    return sorted(out)


def run(spark, frame, tmp_path, rows, queries, k, per_cell=16):
    cells.store_cells(frame(SCHEMA, *rows), str(tmp_path), per_cell)
    stored = cells.read_cells(spark, str(tmp_path))
    found = cells.nearest_in_cells(frame(ASKED, *queries), stored, k)
    got = sorted((r["request_id"], r["id"], r["rank"]) for r in found.rows.collect())
    return got, found.visited.count(), stored.directory.count()


def clustered(n, dims, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    which = rng.integers(0, 12, n)
    vectors = centres[which] + rng.normal(size=(n, dims)) * spread
    return [(f"v{i:04d}", "ab"[int(w) % 2], v.astype("float32").tolist())
            for i, (w, v) in enumerate(zip(which, vectors, strict=True))]


@pytest.mark.parametrize("k", [1, 7, 60])
def test_clustered_vectors_leave_cells_unread(spark, frame, tmp_path, k):
    rows = clustered(900, 24, 1, 0.05)
    queries = [(i, rows[i * 31][1], rows[i * 31][2]) for i in range(4)]
    got, visited, total = run(spark, frame, tmp_path, rows, queries, k)
    assert got == brute(rows, queries, k)
    assert visited < total / 2


def test_scattered_vectors_and_ties(spark, frame, tmp_path):
    rows = clustered(300, 6, 2, 3.0)
    rows += [(f"t{i:03d}", "a", rows[5][2]) for i in range(40)]
    queries = [(1, "a", rows[5][2]), (2, "b", rows[6][2]), (2, "a", rows[7][2]), (3, "c", rows[8][2])]
    got, *_ = run(spark, frame, tmp_path, rows, queries, 20)
    assert got == brute(rows, queries, 20)


def test_odd_vectors(spark, frame, tmp_path):
    nan = float("nan")
    rows = clustered(40, 4, 3, 1.0) + [
        ("zero", "a", [0.0] * 4), ("null", "a", None), ("nan", "a", [nan, 1.0, 1.0, 1.0]),
        ("hole", "a", [None, 1.0, 1.0, 1.0]), ("short", "a", [1.0, 2.0]), ("empty", "a", []),
        ("up", "7", [1.0, 0.0, 0.0, 0.0]), ("down", "7", [-1.0, 0.0, 0.0, 0.0])]
    queries = [(1, "a", [1.0, 0.0, 0.0, 1.0]), (2, "a", [1.0, 1.0]), (3, "a", [0.0] * 4), (4, None, [1.0] * 4),
               (5, "a", [nan] * 4), (6, "7", [0.5, 0.1, 0.0, 0.0])]
    got, *_ = run(spark, frame, tmp_path, rows, queries, 100, per_cell=4)
    assert got == brute(rows, queries, 100)


def test_no_queries_and_too_many(spark, frame, tmp_path):
    got, visited, _ = run(spark, frame, tmp_path, clustered(20, 4, 4, 1.0), [], 3)
    assert got == [] and visited == 0
    stored = cells.read_cells(spark, str(tmp_path))
    with pytest.raises(ValueError):
        cells.nearest_in_cells(frame(ASKED, *[(i, "a", [1.0] * 4) for i in range(5)]), stored, 3, 4)
