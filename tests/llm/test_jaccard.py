import random
import re

import numpy as np
import pytest

from versespan.llm import jaccard, queries
from versespan.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, class string, n int"


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return sorted((i, len(s), root(i)) for i, s in sets)


def texts(seed, words=400):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(words)]
    rows = []
    for group in range(12):
        size = rng.choice([4, 5, 6, 9, 20, 40, 90])
        chain = [rng.choice(pool) for _ in range(size)]
        for _ in range(rng.choice([1, 2, 5, 9])):
            rows.append(" ".join(chain))
            chain = list(chain)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                place = rng.randrange(len(chain))
                chain[place:place + rng.choice([0, 1])] = [rng.choice(pool)] * rng.choice([0, 1])
    shared = " ".join(rng.choice(pool) for _ in range(30))
    rows += [shared + " " + " ".join(rng.choice(pool) for _ in range(rng.choice([2, 5, 9, 30])))
             for _ in range(15)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def result(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


@pytest.mark.parametrize("seed,frequent,tile", [(1, 64, 1024), (2, 3, 1024), (3, 3, 2)])
def test_components_equal_brute_force(frame, monkeypatch, seed, frequent, tile):
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "LEAST_SEEN", 1)
    monkeypatch.setattr(jaccard, "TILE_ROWS", tile)
    rows = texts(seed)
    df = frame(SCHEMA, *[(i, t, "x", 1) for i, t in rows])
    assert result(jaccard.near_duplicates(df)) == brute(rows)


def test_odd_rows(frame):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a  B"), (6, "a\x0bb"), (7, "a b c d e"),
            (8, "a b c d e f g h i j k l"), (9, "a b c d e f g h i j k z"), (9, "a b c d e"),
            (10, "q" * 200_000), (11, "q" * 200_000)]
    got = result(jaccard.near_duplicates(frame(SCHEMA, *[(*r, "x", 1) for r in rows])))
    assert [g[2] for g in got] == [1, 2, 3, 4, 4, 4, 7, 8, 7, 9, 10, 10] or got == [
        (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 4), (7, 1, 7), (8, 8, 8),
        (9, 1, 7), (9, 8, 9), (10, 1, 10), (11, 1, 10)]
    assert jaccard.near_duplicates(frame(SCHEMA)).count() == 0
    kept = jaccard.keep_first(frame(SCHEMA, (2, "a b", "x", 1), (1, "a b", "y", 2), (None, "a b", "", 3)))
    assert kept.columns == ["doc_id", "text", "class", "n"]
    assert sorted(kept.collect(), key=str) == sorted(
        [(1, "a b", "y", 2), (None, "a b", "", 3)], key=str)


def test_rows_that_repeat_an_id_link_for_themselves(frame):
    rows = [(7, "a b c d e"), (8, "p q r s t"), (9, "a b c d e"), (9, "p q r s t")]
    got = result(jaccard.near_duplicates(frame(SCHEMA, *[(*r, "x", 1) for r in rows])))
    assert got == [(7, 1, 7), (8, 1, 8), (9, 1, 7), (9, 1, 8)]


def test_shingle_sets_of_a_block_equal_those_of_single_texts():
    data = ["a b c d e f", "", "x", "É é a b c d", " lead", "t\x1cu v w x y z " * 50]
    joined = np.frombuffer("".join(data).encode(), np.uint8)
    starts = np.cumsum([0] + [len(t.encode()) for t in data])
    for text, own in zip(data, shingle_sets(joined, starts), strict=True):
        alone = np.frombuffer(text.encode(), np.uint8)
        assert np.array_equal(own, next(shingle_sets(alone, np.array([0, len(alone)]))))
        assert len(own) == len(shingles(text))


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(1)
    for size in (4, 30, 511, 600, 2040, 9000):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for share in (0.0, 0.05, 0.11, 0.2):
            other = np.unique(np.concatenate([base[int(size * share):], rng.integers(
                0, 1 << 63, int(size * share * rng.random()), dtype=np.uint64)]))
            a = np.unique(base)
            both = len(np.intersect1d(a, other))
            linked = 100 * both >= 80 * (len(a) + len(other) - both)
            fine = jaccard._may_link(np.array([len(a), len(other)]),
                                     [jaccard.bitmap(a).tobytes(), jaccard.bitmap(other).tobytes()],
                                     np.array([0]), np.array([1]))
            assert fine[0] or not linked


def test_long_chains_become_one_component(frame):
    links = frame("a long, b long", *[(i, i + 1) for i in range(1, 40)], (100, 101), (5, 5))
    got = {r["node"]: r["root"] for r in jaccard.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_few_links_are_one_job_and_equal_to_the_rounds(frame, monkeypatch):
    rng = np.random.default_rng(11)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-200, 200, (220, 2))]
    links, kept, written = frame("a long, b long", *pairs), jaccard.materialize, []

    def watched(df, purpose):
        written.append(purpose)
        return kept(df, purpose)

    monkeypatch.setattr(jaccard, "materialize", watched)
    few = sorted(tuple(r) for r in jaccard.components(links).collect())
    assert len(written) == 1
    assert jaccard.components(links.limit(0)).collect() == []
    monkeypatch.setattr(jaccard, "LINKS_AT_ONCE", 10)
    many = sorted(tuple(r) for r in jaccard.components(links).collect())
    assert len(written) > 3 and few == many


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert result(queries.QUERIES["op3_jaccard_tiles"](spark, sf_dir)) == brute(
        [(r["doc_id"], r["text"]) for r in docs])


def test_rows_without_a_partner_are_those_that_meet_no_other():
    rng = np.random.default_rng(3)
    for counts in ([2] * 40, [1, 3, 5, 30], [33, 34, 90]):
        key = np.repeat(np.arange(len(counts)), counts)
        n = rng.integers(4, 400, len(key))
        order = np.lexsort((n, key))
        key, n = key[order], n[order]
        pos = (rng.random(len(key)) * n / 5).astype(np.int64)
        got = jaccard._with_partner(key, n, pos)
        for x in range(len(key)):
            others = [y for y in range(len(key)) if y != x and key[y] == key[x]]
            meets = any(
                80 * max(n[x], n[y]) <= 100 * min(n[x], n[y])
                and 180 * (n[x] - pos[x]) >= 80 * (n[x] + n[y])
                and 180 * (n[y] - pos[y]) >= 80 * (n[x] + n[y]) for y in others)
            assert got[x] >= meets
            if len(others) < jaccard.NEIGHBOURS:
                assert got[x] == meets


def test_a_group_of_near_copies_is_not_tried_pair_by_pair(frame, monkeypatch):
    """Copies of one text that differ from each other more than from the text itself."""
    rng, made, plain = random.Random(5), [], jaccard.tile_pairs
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        words = list(base)
        for place in rng.sample(range(5, 115), 2):
            words[place] = f"x{i}y{place}"
        rows.append((i, " ".join(words)))

    def counted(*parts):
        pairs = plain(*parts)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard, "tile_pairs", counted)
    df = frame(SCHEMA, *[(i, t, "x", 1) for i, t in rows])
    assert result(jaccard.near_duplicates(df)) == brute(rows)
    assert sum(made) <= len(rows)
