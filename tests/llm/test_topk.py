import math

import numpy as np
import pytest

from versespan.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, queries, k=5):
    def q(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * float(np.float32(x))) for x in v]

    known = [(i, q(v)) for i, v in rows if i is not None and q(v)]
    out = set()
    for i, v in queries:
        if i is None or q(v) is None:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q(v), w)), j) for j, w in known
                        if j != i and len(w) == len(q(v)))
        out |= {(i, rank, j, -s if -1 << 63 <= -s < 1 << 63 else None) for rank, (s, j) in enumerate(scored[:k], 1)}
    return out


def run(frame, rows, queries, **sizes):
    df = topk.top_k(frame(SCHEMA, *[(*r, "x") for r in rows]),
                    frame(SCHEMA, *[(*r, "x") for r in queries]), **sizes)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()]
    assert len(got) == len(set((g[0], g[1]) for g in got))
    return set(got)


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_equals_brute_force_with_ties(frame, block):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-3, 4, 6) / 256).astype("float32").tolist()) for i in range(150)]
    rows += [(500 + i, rows[i][1]) for i in range(20)]
    rows += [(900, [1.0] * 6), (901, [-1.0] * 6), (902, [0.0] * 6), (903, [0.0] * 6)]
    queries = rows[::10] + rows[-4:]
    assert run(frame, rows, queries, rows_per_block=block, queries_per_block=9) == brute(
        rows, queries)


def test_wide_values(frame):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=16) * 10.0 ** rng.integers(-3, 4)).astype("float32").tolist())
            for i in range(200)]
    assert run(frame, rows, rows[:20]) == brute(rows, rows[:20])


def test_rows_that_take_no_part(frame):
    rows = [(1, [0.5, 0.5]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [None, 1.0]),
            (6, [float("inf"), 0.0]), (None, [0.1, 0.1]), (7, [0.25, 0.5]), (8, [1.0])]
    assert run(frame, rows, rows) == {(1, 1, 7, 128 * 64 + 128 * 128), (7, 1, 1, 64 * 128 + 128 * 128)}
    assert run(frame, rows[:1], rows[:1]) == set()
    assert run(frame, [], []) == set()


def test_components_of_any_size(frame):
    rows = [(1, [0.5, 0.5]), (7, [0.25, 0.5]), (9, [1e30, 0.0]), (10, [-1e30, 70000.25]),
            (11, [3e38, -3e38]), (12, [65536.0, 1.0]), (13, [-65536.0, 1.0]), (14, [3e38, -3e38]),
            (15, [65535.0, -65535.0])]
    rows += [(100 + i, [i * 300.5, -i * i * 7.25]) for i in range(40)]
    got = run(frame, rows, rows)
    assert got == brute(rows, rows)
    assert (1, 1, 9, None) in got and (12, 1, 11, None) in got
    near = [r for r in rows if r[0] in (1, 7, 12, 13)]
    assert run(frame, near, near) == brute(near, near)
    assert (1, 1, 12, 128 * 256 * 65536 + 128 * 256) in run(frame, near, near)
    assert run(frame, rows, rows, rows_per_block=3, queries_per_block=5) == brute(rows, rows)


def test_long_vectors_are_exact(frame):
    rows = [(i, [65535.0 * (1 - 2 * (i % 2))] * (topk.NARROW_DIMS + 1)) for i in range(3)]
    assert run(frame, rows, rows) == brute(rows, rows)


def test_doubles_beyond_a_factor():
    for x in (1.7e308, -1.7e308, 1e300, 65536.125, -0.001, 5e-324, -5e-324):
        a, b = x.as_integer_ratio()
        assert topk.wide_integer(x) == 256 * a // b


def test_repeated_ids(frame):
    rows = [(1, [0.5]), (1, [0.25]), (2, [1.0]), (2, [1.0]), (3, [0.5])]
    got = run(frame, rows, rows[:2])
    assert got == {(1, 1, 2, 64 * 256), (1, 2, 2, 64 * 256), (1, 3, 3, 64 * 128)}
