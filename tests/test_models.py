"""Column functions and operators against plain Python models on random small input."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest
from conftest import rows
from pyspark.sql import functions as F

from versespan.functions import address as A
from versespan.functions import greek
from versespan.functions import text as X
from versespan.operators import export, joins


@pytest.fixture
def rng():
    return random.Random(7)


def address_model(text):
    """None, "error", or a list of (book, chapter, verse)."""
    t = text.strip(" ")
    m = re.fullmatch(r"(.+)\s+(\d+)[,:]\s*([\d.\-]+)", t, re.S | re.A)
    if m:
        out = []
        for part in m[3].split("."):
            if "-" in part:
                lo, hi = part.split("-")[:2]
                if lo == "":
                    return "error"
                lo, hi = int(lo), 999 if hi == "" else int(hi)
                if hi < lo:
                    break
                out += [(m[1].strip(" "), int(m[2]), v) for v in range(lo, hi + 1)]
            elif part == "":
                return "error"
            else:
                out.append((m[1].strip(" "), int(m[2]), int(part)))
        return out
    m = re.fullmatch(r"(.+)\s+(\d+)", t, re.S | re.A)
    if m:
        return [(re.sub(r"\s+", " ", m[1]).strip(" "), int(m[2]), None)]
    return [(re.sub(r"\s+", " ", t).strip(" "), None, None)] if t else None


def test_addresses(evaluate, rng):
    pieces = ["J", "1 Kor", "Ps", " ", "  ", "3", "12", ",", ":", ".", "-", "7", "16-18", "4-2",
              "990-", "x"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))) for _ in range(1500)]
    for text, got in zip(texts, evaluate(texts, A.parse_address)):
        expected = address_model(text)
        if expected is None:
            assert got is None or got["book"] is None, text
        elif expected == "error":
            assert got["error"] is not None, text
        else:
            assert got["error"] is None, text
            found = [(got["book"], got["chapter"], None)] if got["parts"] is None else [
                (got["book"], got["chapter"], v) for p in got["parts"]
                for v in range(p["lo"], p["hi"] + 1)]
            assert found == expected, text


def test_metadata_fixpoint(evaluate, rng):
    pieces = [f"<{c}{t}>" for t in "SmfnheX" for c in ("", "/")] + ["a", " ", "\n", "<s>", "</s>"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
             for _ in range(1500)]

    def model(text):
        while True:
            new = re.sub(r"<(S|m|f|n|h|e)>[^<>]*</\1>", "", text, flags=re.I)
            if new == text:
                return re.sub(r"\s+", " ", text)
            text = new

    assert evaluate(texts, X.text_without_metadata) == [model(t) for t in texts]


def test_tags(evaluate, rng):
    pieces = ["<S>", "</S>", "<m>", "</m>", "<i>", "</i>", "<pb/>", "1", "ab", " "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
             for _ in range(1000)]

    def model(text):
        text = re.sub(r"</?(strong|b|br|div|pb|t)[^>]*>", "", text, flags=re.I)
        text = text.replace("<i>", "[").replace("</i>", "]")
        out: dict = {}
        for tag, value in re.findall(r"<([A-Za-z][A-Za-z0-9]*)>([^<]+)</\1>", text):
            out.setdefault(tag, []).append(value)
        return out

    assert evaluate(texts, X.collect_tags) == [model(t) for t in texts]


def test_betacode_of_any_text(evaluate, rng):
    alphabet = [chr(p) for p in (*range(0x20, 0x250), *range(0x300, 0x400),
                                 *range(0x1F00, 0x2030), *range(0xAC00, 0xAC40), 0xE000, 0xE002,
                                 0x1D15E, 0x2126, 0xFB1D)]
    texts = ["".join(rng.choice(alphabet) for _ in range(20)) for _ in range(500)]

    def model(text):
        # Characters are taken one by one, as the marks they carry are.
        out = ""
        for char in text:
            for c in unicodedata.normalize("NFD", char):
                if c not in greek.MARKS:
                    out += greek.LETTERS.get(c.lower(), " ")
        return out

    assert evaluate(texts, greek.greek_to_betacode) == [model(t) for t in texts]


def test_following_positions(spark, rng):
    places = sorted({(rng.randint(1, 3), rng.randint(0, 4000), rng.randint(1, 3))
                     for _ in range(800)})
    df = spark.createDataFrame(places, "g int, chapter long, verse long").withColumn(
        "stretch", F.floor(F.col("chapter") / 64))
    got = joins.next_position(df, ["g"], ["stretch", "chapter", "verse"])
    expected = []
    for here, after in zip(places, [*places[1:], None]):
        same = after is not None and after[0] == here[0]
        expected.append((*here, after[1] if same else None, after[2] if same else None))
    assert rows(got, "g", "chapter", "verse", "next_chapter", "next_verse") == sorted(
        expected, key=repr)


def test_collapsed_ranges(spark, rng):
    chosen = sorted({(rng.randint(1, 40), rng.randint(1, 3), rng.randint(1, 5), rng.randint(1, 9))
                     for _ in range(900)})
    df = spark.createDataFrame(chosen, "request_id int, book_number int, chapter int, verse int") \
        .selectExpr("*", "'l' language", "'S' source", "concat_ws('/', book_number, chapter, "
                    "verse) id", "concat('B', book_number, ' ', chapter, ',', verse) address")
    expected = {}
    for request, book, chapter, verse in chosen:
        runs = expected.setdefault(request, [f"B{book} {chapter},"])
        if len(runs) > 1 and verse == runs[-1][1] + 1:
            runs[-1][1] = verse
        else:
            runs.append([verse, verse])
    texts = [(k, v[0] + ".".join(str(a) if a == b else f"{a}-{b}" for a, b in v[1:]))
             for k, v in expected.items()]
    got = joins.joined_parts(export.collapse_ranges(df), ["request_id"])
    assert rows(got) == sorted(texts, key=repr)


def test_nearest_by_task_equals_join(spark):
    from versespan.operators.search import nearest_in_source

    n = F.col("id")
    vectors = spark.range(0, 12000, 1, 3).select(
        n.cast("string").alias("id"), F.concat(F.lit("S"), (n % 2).cast("string")).alias("source"),
        F.array(*[((n * p) % 97 - 40).cast("float") for p in (7, 11, 13, 17)]).alias("embedding"))
    asked = spark.range(9).select(
        n.alias("request_id"), F.concat(F.lit("S"), (n % 3).cast("string")).alias("source"),
        F.array(*[((n + 1) * p % 31 - 9).cast("float") for p in (3, 5, 7, 9)]).alias("vector"))
    verses, stored = vectors.select("id", "source"), vectors.select("id", "embedding")
    joined = nearest_in_source(asked, verses, stored, 20, broadcast_rows=0)
    exact = {(r, rank): d for r, rank, d in rows(joined, "request_id", "rank", "distance")}
    assert len(exact) == 6 * 20
    for embeddings in (stored, vectors):
        got = nearest_in_source(asked, verses, embeddings, 20)
        found = rows(got, "request_id", "rank", "distance")
        assert len(found) == len(exact)
        for request, rank, distance in found:
            assert abs(distance - exact[request, rank]) < 1e-9


def test_python_tasks_do_not_need_the_package(tmp_path):
    """Run from a folder where workers can not import the package."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "run.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {root!r})\n"
        "import __spark_entry__ as entry\n"
        "from versespan.session import build_session\n"
        "spark = build_session(cpus=2)\n"
        "for name in ('knn_search', 'embed_backlog', 'search_verses'):\n"
        "    print(name, entry.queries()[name](spark, '/root/testdata/sf0.001').count() > 0)\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, timeout=240,
                          capture_output=True, text=True)
    assert done.stdout.split() == ["knn_search", "True", "embed_backlog", "True",
                                   "search_verses", "True"], done.stderr[-2000:]
