import re
from itertools import permutations

import pytest

from versespan.llm import filter_audit
from versespan.llm.common import unpacked

DOCS = "doc_id long, text string, source string, mask int, good boolean"
LABELS = "doc_id long, quality int, toxic int, part string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows):
    """The filters each row fails, read off their definitions."""
    out = []
    for key, text, _ in rows:
        text = text or ""
        words = WORDS.findall(text)
        found = {"A"} if len(words) < 50 else set()
        if 100 * len(set(words)) < 65 * len(words):
            found.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            found.add("C")
        if re.search(r"[#$%&*|]", text):
            found.add("D")
        if key is not None and any(k is not None and k < key and (t or "") == text
                                   for k, t, _ in rows):
            found.add("E")
        out.append(found)
    return out


def brute(rows, labels):
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    bad = {k for k, _, t in labels if t == 1 and k is not None}
    failing, out = fails(rows), {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failing) if (r[2] or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                removed = [k for k, f in left if name in f]
                left = [(k, f) for k, f in left if name not in f]
                removed_by[name] += len(removed)
                out[part, "".join(order), step] = [
                    len(left), len(removed), sum(name in f for _, f in mine) - len(removed),
                    sum(f == {name} for _, f in mine),
                    sum(k in good for k in removed), sum(k in bad for k in removed), name]
        for (p, _, _), row in out.items():
            if p == part:
                row[-1] = removed_by[row[-1]] if row[-1] in removed_by else row[-1]
    return {(*k, *v) for k, v in out.items()}


def run(frame, rows, labels):
    found = filter_audit.audit(frame(DOCS, *[(*r, 7, True) for r in rows]),
                               frame(LABELS, *[(*r, "x") for r in labels]))
    got = [tuple(r[c] for c in (
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", "shapley")) for r in found.collect()]
    assert len(got) == len(set(got))
    return set(got)


PLAIN = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, PLAIN, "a"), (2, PLAIN, "a"), (3, PLAIN, "b"), (4, "short", "a"), (5, None, "a"),
    (6, "", "b"), (7, "x " * 80, "b"), (8, PLAIN + " #", None), (9, PLAIN.upper(), ""),
    (10, "SHORT $", "a"), (11, "x\x85y z  " * 60, "a"), (12, "\n\t \x0b", "b"),
    (None, PLAIN, "a"), (None, "alone", "b"), (4, "short", "a"), (4, "other", "b"),
    (13, "größe " * 30 + PLAIN, "a"), (14, PLAIN + "\x1c" + PLAIN, "b"),
]
LABELLED = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, None, 1), (5, 1, None), (7, 0, 1), (None, 1, 1),
            (99, 1, 1), (10, 1, 0)]


@pytest.mark.parametrize("size,words", [(1, 7), (400, 50), (4 << 20, 1 << 19)])
def test_equals_brute_force(frame, monkeypatch, size, words):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", size)
    monkeypatch.setattr(filter_audit, "WORDS_PER_BUCKET", words)
    assert run(frame, ROWS, LABELLED) == brute(ROWS, LABELLED)


def test_empty_tables(frame):
    assert run(frame, [], []) == set()
    assert run(frame, ROWS[:2], []) == brute(ROWS[:2], [])


def test_matrix_is_the_texts(frame, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 300)
    monkeypatch.setattr(filter_audit, "WORDS_PER_BUCKET", 20)
    matrix = filter_audit.document_term_matrix(frame(DOCS, *[(*r, 7, True) for r in ROWS])).collect()
    listed = {}
    for shard in matrix:
        indices, counts = (unpacked(bytes(shard[c])).tolist() for c in ("indices", "counts"))
        for i, key in enumerate(shard["doc_ids"]):
            at = slice(shard["starts"][i], shard["starts"][i + 1])
            listed.setdefault(key, []).append(
                dict(zip(indices[at], counts[at], strict=True)))
    words = {w for _, t, _ in ROWS for w in WORDS.findall(t or "")}
    used = {i for rows in listed.values() for r in rows for i in r}
    assert used == set(range(len(words)))
    assert sorted(map(sum, (r.values() for rows in listed.values() for r in rows))) == sorted(
        len(WORDS.findall(t or "")) for _, t, _ in ROWS)
    assert listed[1] == listed[2] == listed[3]


def test_long_text_and_many_copies(frame):
    rows = [(i, "same words here " * 30, "hot") for i in range(300)]
    rows += [(1000, "long Text % " * 200_000, "hot")]
    assert run(frame, rows, []) == brute(rows, [])
