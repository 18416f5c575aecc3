"""From source files to answers."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_sources import _path

from versespan.corpus import Corpus, build_corpus
from versespan.operators.joins import joined_parts


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    out = str(tmp_path_factory.mktemp("corpus"))

    def write(language, table, name, schema, *data):
        spark.createDataFrame(list(data), schema).toPandas().to_parquet(
            _path(root, language, table, name), index=False)

    verse = "book_number int, chapter int, verse int, text string"
    for language, name, short in (("pl", "BT", "J"), ("la", "NVUL", "Io")):
        write(language, "books", name, "book_number int, short_name string", (500, short))
        write(language, "verses", name, verse,
              *[(500, c, v, f"slowo.Bog {c} {v}") for c in (1, 2) for v in range(1, 6)],
              (500, None, 1, "no chapter"))
        write(language, "info", name, "name string, value string", ("description", f"{name}!"))
    write("pl", "stories", "BT", "book_number int, chapter int, verse int, title string",
          (500, 1, 1, "Prolog"), (500, 1, 4, "Jan"), (500, 2, 3, "Kana"))
    write("pl", "commentaries", "BT.commentaries",
          "book_number int, chapter_number_from int, verse_number_from int, "
          "chapter_number_to int, verse_number_to int, marker string, text string",
          (500, 1, 2, 2, 1, "m n", "note"))
    write("pl", "dictionary", "BT", "topic string, definition string", ("logos", "<dl/>"),
          ("logos", "<dl/>"), ("x", "<dl/>"))
    refs = root / "refs.txt"
    refs.write_text("From\tTo\tVotes\nJohn.1.2\tJohn.2.1-John.2.3\t7\n")
    names = spark.createDataFrame([("JOHN", 500)], "name string, number int")
    build_corpus(spark, str(root), out, refs=str(refs), book_names=names)
    return Corpus(spark, out)


def ask(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_tables_and_rejects(spark, stored):
    assert rows(stored.sources, "id", "name", "description_short") == [
        ("la/1", "NVUL", "NVUL!"), ("pl/1", "BT", "BT!")]
    assert stored.verses.count() == 20
    assert spark.read.parquet(f"{stored.path}/rejects/verses").count() == 2
    duplicate = spark.read.parquet(f"{stored.path}/rejects/dictionary")
    assert rows(duplicate, "topic", "copies", "reason") == [("logos", 1, "duplicate key")]
    texts = {r["language"]: r["text"] for r in stored.verses.filter(
        "chapter = 1 and verse = 1").collect()}
    assert texts == {"pl": "slowo. Bog 1 1", "la": "slowo. Bog 1 1"}
    assert rows(stored.commentaries, "marker") == [("m n",)]


def test_answers(spark, stored):
    found = stored.fetch_verses(ask(
        spark, "request_id int, address string, source string", (1, "J 1,2-3", None),
        (2, "Io 2", "NVUL")))
    assert rows(found.rows.groupBy("request_id").count()) == [(1, 4), (2, 5)]
    told = stored.fetch_stories(ask(
        spark, "request_id int, source string, address string", (1, "BT", "J 2,1")))
    assert rows(told.rows, "title", "address") == [("Jan", "J 2,1-2")]
    ids = ask(spark, "request_id int, verse_id string", (1, "pl/1/500/1/2"))
    assert rows(stored.fetch_commentaries(ids).rows, "text") == [("note",)]
    assert rows(stored.cross_references(ids).rows, "address", "reference", "rate") == [
        ("J 1,2", "J 2,1-3", 7)]
    by_address = stored.cross_references_by_address(ask(
        spark, "request_id int, address string, source string", (1, "J 1,1-5", "NVUL")))
    assert rows(by_address.rows, "address", "reference", "rate") == [("Io 1,2", "Io 2,1-3", 7)]
    assert rows(stored.verse_dictionary(ids).rows) == []
    assert rows(stored.verse_metadata(ids), "metadata") == [({},)]
    assert rows(stored.list_sources("bt"), "name") == [("BT",)]
    document = stored.export(ask(
        spark, "request_id int, address string, source string", (1, "J 1,5", "BT")))
    document = joined_parts(document, ["request_id"])
    assert document.first()["document"].endswith('"text":"slowo. Bog 1 5"}]}}')


def test_search_after_embedding(spark, stored):
    def model(texts):
        if any(t.endswith("2 5") for t in texts):
            raise ValueError("too long")
        return [[float(t.count("1")), float(t.count("2")), 1.0] for t in texts]

    failed = stored.embed_source("BT", model)
    assert rows(failed) == [("pl/1/500/2/5", "too long")]
    assert stored.embeddings.count() == 9
    assert stored.embed_source("BT", model).count() == 1 and stored.embeddings.count() == 9
    hits = stored.search(ask(spark, "request_id int, search string", (1, "@BT 1 1"),
                             (2, "@BT ~J 2 2 2"), (3, "@NVUL ~Io 1"), (4, "@NVUL 1")),
                         model, k=2).rows
    assert rows(hits, "request_id", "rank", "id") == [
        (1, 1, "pl/1/500/1/1"), (1, 2, "pl/1/500/1/3"), (2, 1, "pl/1/500/2/2"),
        (2, 2, "pl/1/500/2/3"), (3, 1, "la/1/500/1/1"), (3, 2, "la/1/500/1/2")]


def test_selection(spark, stored):
    from pyspark.sql import functions as F

    chosen = stored.verses.filter("id = 'pl/1/500/1/2'").withColumn("request_id", F.lit(1))
    bundle = stored.select(chosen)
    assert rows(bundle.references, "reference") == [("J 2,1-3",)]
    assert rows(bundle.commentaries, "marker") == [("m n",)]
    assert rows(bundle.stories, "title") == [("Prolog",)]


def test_lookups_parse_no_dictionary_entry(spark, stored):
    ids = ask(spark, "request_id int, verse_id string", (1, "pl/1/500/1/2"))
    found = stored.verse_dictionary(ids).rows
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "xpath" not in plan.lower() and "entries" not in stored.dictionary.columns
    assert rows(stored.entries, "topic", "well_formed")


def test_sheets_of_a_corpus(spark, stored):
    import datetime as dt

    assert stored.sheets.count() == 0
    t = dt.datetime(2024, 1, 1)
    data = '{"title":"T","items":[{"kind":"pericope","address":"J 1,1-2","source":"BT"}]}'
    changes = ask(spark, "id string, data string, ts timestamp", ("s", data, t), ("e", "{}", t),
                  ("x", None, t))
    assert rows(stored.upsert_sheets(changes, 0), "id") == [("x",)]
    assert rows(stored.sheets, "id") == [("e",), ("s",)]
    one = ask(spark, "id string", ("s",))
    assert rows(stored.hydrate_sheets(one), "verse") == [(1,), (2,)]
    text = joined_parts(stored.sheet_markdown(one), ["sheet_id"]).first()["document"]
    assert text == ("# T\n\n###### J 1,1-2 (BT)\n- <sup>1</sup> slowo. Bog 1 1\n"
                    "- <sup>2</sup> slowo. Bog 1 2")
    kept = stored.cleanup_sheets(F.lit("2024-03-01").cast("timestamp")).kept
    assert rows(kept, "id") == [("s",)]
    batch = ask(spark, "input_id int, source string, batch string", (1, "BT", "J 1; J 2"))
    assert rows(stored.expand_batch(batch), "address") == [("J 1",), ("J 2",)]


def test_lookups_prune_what_is_stored(spark, stored):
    """Few requests reach the scan as literals: partitions by language or source are skipped."""
    def scans(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.splitlines() if "FileScan" in line]

    asked = ask(spark, "request_id int, address string, source string", (1, "J 1,1-5", "BT"))
    ids = ask(spark, "request_id int, verse_id string", (1, "pl/1/500/1/2"))
    for found in (stored.fetch_verses(asked).rows, stored.verse_metadata(ids),
                  stored.verse_dictionary(ids).rows):
        verses = [line for line in scans(found) if "/verses]" in line]
        assert verses and all("PartitionFilters: [language" in line.replace("isnotnull(language", "")
                              or "language#" in line.split("PartitionFilters: [")[1].split("]")[0]
                              for line in verses), verses
    stored.embed_source("BT", lambda texts: [[1.0, 2.0, 3.0] for _ in texts])
    near = stored.search(ask(spark, "request_id int, search string", (1, "@BT 1 1")),
                         lambda texts: [[1.0, 0.0, 1.0] for _ in texts], k=2)
    assert near.rows.count() == 2
    from versespan.operators.search import nearest_in_source
    plan = nearest_in_source(ask(spark, "request_id int, source string, vector array<float>",
                                 (1, "BT", [1.0, 0.0, 1.0])), stored.verses, stored.embeddings, 2)
    vectors = [line for line in scans(plan) if "/embeddings]" in line]
    assert vectors and all("source#" in line.split("PartitionFilters: [")[1].split("]")[0]
                           for line in vectors)
