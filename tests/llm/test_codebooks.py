import hashlib
import math

import numpy as np
import pytest

from versespan.llm import codebooks

SCHEMA = "vec_id long, embedding array<{0}>, label int, error string, own int"
COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def brute(rows, entries=256, rounds=4):
    """The contract in Python's integers."""
    def floors(v):
        return [math.floor(x) * 1024 if abs(x) > 2 ** 60 else math.floor(1024 * x) for x in v]

    kept = [(i, floors(v), label) for i, v, label in rows
            if v and len(v) % 4 == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    cut = [[r[1][k * len(r[1]) // 4:(k + 1) * len(r[1]) // 4] for k in range(4)] for r in kept]
    books = [[list(c[k]) for c in cut[:entries]] for k in range(4)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for k in range(4):
            mine = [nearest(c[k], books[k])[1] for c in cut]
            for j in range(len(books[k])):
                held = [c[k] for c, m in zip(cut, mine) if m == j]
                if held:
                    books[k][j] = [sum(x) // len(held) for x in zip(*held)]
    found = [[nearest(c[k], books[k]) for k in range(4)] for c in cut]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    whole = {label: sum(e for e, r in zip(errors, kept) if r[2] == label) for label in {r[2] for r in kept}}

    def long(x):
        return x if x < 2 ** 63 else None

    return sorted([(r[0], "".join(f"{j:02x}" for _, j in f), long(e), long(whole[r[2]]), sha)
                   for r, f, e in zip(kept, found, errors)], key=repr)


def run(frame, rows, kind="float", **sizes):
    found = codebooks.codes(frame(SCHEMA.format(kind), *[(*r, "x", 3) for r in rows]), **sizes)
    return sorted([tuple(r[c] for c in COLUMNS) for r in found.collect()], key=repr)


def vectors(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dims)) * spread
    out = centres[rng.integers(0, 9, n)] + rng.normal(size=(n, dims)) * 0.2
    return [(int(i), row.astype("float32").tolist(), int(i) % 3 or None)
            for i, row in zip(rng.permutation(n) * 3, out)]


@pytest.mark.parametrize("entries,rounds", [(16, 4), (64, 6), (1, 2)])
def test_equals_brute_force(frame, entries, rounds):
    rows = vectors(500, 16, 1)
    assert run(frame, rows, entries=entries, rounds=rounds) == brute(rows, entries, rounds)


def test_ties_and_unused_entries(frame):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-2, 3, 8) / 1024).tolist(), None) for i in range(300)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(200)]
    assert run(frame, rows, entries=32) == brute(rows, 32)


def test_odd_rows(frame):
    rows = [(1, [0.5, 0.5, 1.0, 1.0], 1), (2, None, 1), (3, [], 1), (4, [float("nan"), 1.0, 1.0, 1.0], 1),
            (5, [None, 1.0, 1.0, 1.0], 2), (6, [float("inf"), 0.0, 0.0, 0.0], 2),
            (None, [0.1, 0.1, 0.2, 0.2], None), (7, [1.0, 2.0, 3.0], 1), (8, [1.0] * 8, 1),
            (9, [0.25] * 4, None), (9, [0.125] * 4, 2), (9, [0.25] * 4, 2)]
    assert run(frame, rows, entries=3) == brute(rows, 3)
    assert run(frame, rows[:1]) == brute(rows[:1])
    assert run(frame, rows[1:4]) == []
    assert run(frame, []) == []


@pytest.mark.parametrize("size,kind", [(1e7, "float"), (1e12, "float"), (1e30, "float"), (1e200, "double")])
def test_large_components(frame, size, kind):
    rng = np.random.default_rng(5)
    rows = vectors(60, 8, 6)
    held = np.float32 if kind == "float" else np.float64
    rows += [(1000 + i, (rng.normal(size=8) * size).astype(held).tolist(), 5) for i in range(20)]
    rows += [(-1, [float(held(size))] + [0.0] * 7, 6)]
    assert run(frame, rows, kind, entries=12) == brute(rows, 12)


def test_bounds_hold_and_adapt(spark, frame):
    """Bounds are below the true distances, ascend, and few are needed once entries rest."""
    rng = np.random.default_rng(7)
    rows, books = rng.integers(-500, 500, (400, 6)), rng.integers(-500, 500, (40, 6))
    bounds, best = codebooks.from_scratch(rows, books, 10)
    for step in range(4):
        true = codebooks.all_distances(rows, books)
        assert (best == true.min(1)).all() and (bounds.own == true.argmin(1)).all()
        at = np.sqrt(np.take_along_axis(true, bounds.near.astype(int), 1))
        assert (bounds.lower <= at).all() and (np.diff(bounds.lower, axis=1) >= 0).all()
        for i in range(len(rows)):
            rest = np.setdiff1d(np.arange(40), [*bounds.near[i], bounds.own[i]])
            assert bounds.outer[i] <= np.sqrt(true[i, rest].min())
        after = books + rng.integers(-30 // (step + 1), 30 // (step + 1) + 1, books.shape)
        moved = np.sqrt(((after - books) ** 2).sum(1)) * (1 + 1e-9)
        books = after
        bounds, best, need = codebooks.reassign(rows, books, moved, bounds, 10 - 2 * step)
        assert bounds.near.shape[1] == 10 - 2 * step
    true = codebooks.all_distances(rows, books)
    assert (best == true.min(1)).all() and (bounds.own == true.argmin(1)).all()
    widths = codebooks.compress(frame(SCHEMA.format("float"), *[
        (*r, "x", 3) for r in vectors(600, 16, 8)]), entries=64, rounds=10).widths
    assert len(widths) == 11 and widths == sorted(widths, reverse=True) and widths[-1] < widths[0]
