from __future__ import annotations

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from versespan import schemas
from versespan.sources import files as I
from versespan.sources import sinks
from versespan.streaming import sheets as T


def _write(df, root, language, table, name):
    """One parquet file per source, named as its source."""
    df.coalesce(1).toPandas().to_parquet(_path(root, language, table, name), index=False)


def _path(root, language, table, name):
    folder = root / language / table
    folder.mkdir(parents=True, exist_ok=True)
    return str(folder / f"{name}.parquet")


def test_merge_from_files(spark, frame, tmp_path):
    _write(frame("book_number int, short_name string, long_name string",
                 (10, "Gen", "Genesis"), (20, "Ex", None)), tmp_path, "pl", "books", "BT")
    _write(frame("book_number int, short_name string", (10, "Rdz")), tmp_path, "pl", "books",
           "AB.more")
    verse = "book_number int, chapter int, verse int, text string"
    _write(frame(verse, (10, 1, 1, "a"), (99, 1, 1, "no book")), tmp_path, "pl", "verses", "BT")
    _write(frame(verse, (10, 1, 2, "b")), tmp_path, "pl", "verses", "AB.more")
    _write(frame(verse, (10, 1, 3, "no books file")), tmp_path, "pl", "verses", "AB.other")
    _write(frame("book_number string, chapter int, verse int, text string", (None, 1, 1, "t0"),
                 ("10", 1, 1, "t1"), ("5", 1, 1, "t2"), ("12abc", 1, 1, "t3"), (" ", 1, 1, "t4")),
           tmp_path, "pl", "stories", "BT")
    _write(frame("name string, value string", ("description", "Tysiąclatka"), ("x", "y")),
           tmp_path, "pl", "info", "BT")
    tables = {table: I.read_sources(spark, str(tmp_path), table)
              for table in ("info", "books", "verses", "stories")}
    merged = I.merge_corpus(tables)
    assert rows(merged["sources"], "id", "name", "description_short") == [
        ("pl/1", "AB", None), ("pl/2", "BT", "Tysiąclatka")]
    assert rows(merged["books"], "id", "long_name") == [
        ("pl/1/10", "Rdz"), ("pl/2/10", "Genesis"), ("pl/2/20", "Ex")]
    assert rows(merged["verses"], "id", "source", "address", "book_name") == [
        ("pl/1/10/1/2", "AB", "Rdz 1,2", "Rdz"), ("pl/2/10/1/1", "BT", "Gen 1,1", "Genesis")]
    assert rows(merged["stories"], "book_number", "title") == [
        (10, "t1"), (12, "t3"), (None, "t0")]


def test_numbers_follow_first_path(frame):
    df = frame("language string, path string, name string", ("pl", "b/X.1", "X"),
               ("pl", "a/Y.1", "Y"), ("pl", "a/X.0", "X"), ("la", "z/Y.1", "Y"))
    assert rows(I.assign_source_numbers(df), "language", "name", "source_number") == [
        ("la", "Y", 1), ("pl", "X", 1), ("pl", "Y", 2)]


def test_file_name(evaluate):
    assert evaluate(["/d/X.commentaries.SQLite3", "X.parquet", "/d/X"], I.file_name) == [
        "X", "X", "X"]


def test_split_by_language(frame):
    info = frame("path string, name string, value string", ("a", "language", "pl"),
                 ("b", "language", ""), ("c", "other", "pl"))
    files = frame("path string, name string", ("a", "O'Neil"), ("b", "B"), ("c", "C"))
    kept, rejected = I.split_by_language(info, files)
    assert rows(kept, "path", "name", "language") == [("a", "O_Neil", "pl")]
    assert rows(rejected, "path") == [("b",), ("c",)]


def test_link_extract(frame):
    pages = frame("page_id int, html string",
                  (1, '<a href="_dl.php?back=bbl&a=BT_03&b=mybible&c">x</a><a href="_dl.php?b=1">'))
    assert rows(I.extract_links(pages)) == [(1, 0, "BT_03")]


def test_cross_ref_file(spark, tmp_path):
    path = tmp_path / "refs.txt"
    path.write_text('From Verse\tTo Verse\tVotes\nGen.1.1\tEx.2.3-Ex.2.4\t5\nGen.1.2\t"Q.1\t\n')
    assert rows(I.read_cross_refs(spark, str(path))) == [
        ("Gen.1.1", "Ex.2.3-Ex.2.4", "5"), ("Gen.1.2", '"Q.1', None)]


def test_load_and_read_tables(spark, frame, tmp_path):
    row = ("pl/1/10/1/1", "pl", "BT", "Gen", "Genesis", "Gen 1,1", 1, 10, 1, 1, "t")
    tables = {"verses": frame(schemas.VERSES, row).withColumn(
        "chapter", F.col("chapter").cast("string")),
        "other": frame("x int", (1,))}
    sinks.load_tables(tables, str(tmp_path / "c"))
    back = sinks.read_tables(spark, str(tmp_path / "c"), ["verses"])["verses"]
    assert rows(back) == [row] and back.schema == schemas.VERSES
    assert (tmp_path / "c" / "verses" / "language=pl").is_dir()
    assert not (tmp_path / "c" / "other").exists()
    plan = back.filter("language = 'pl' and source_number = 1").select("text") \
        ._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(language" in plan and "PushedFilters: [IsNotNull(source_number)" in plan


def test_append_absent(spark, frame, tmp_path):
    path = str(tmp_path / "e")
    frame("id string, n int", ("a", 1)).write.parquet(path)
    new = frame("id string, n int", ("a", 2), ("b", 3), ("b", 4))
    sinks.append_absent(spark, path, new, ["id"])
    assert rows(spark.read.parquet(path)) == [("a", 1), ("b", 3)]


def test_stream_upserts(spark, frame, tmp_path):
    schema = "id string, data string, ts timestamp"
    incoming, root = str(tmp_path / "in"), str(tmp_path / "table")
    day = [dt.datetime(2024, 1, n) for n in range(1, 6)]

    def run(*changes):
        frame(schema, *changes).coalesce(1).write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(schema).parquet(incoming)
        T.stream_upsert_sheets(stream, root, str(tmp_path / "check")).awaitTermination()

    run(("a", "1", day[1]), ("a", "0", day[0]), (None, "n", day[0]))
    first = T.current_sheets(spark, root)
    assert rows(first.filter("id = 'a'")) == [("a", "1", day[0])] and first.count() == 2
    T.compact(spark, root, str(tmp_path / "snap"))
    run(("a", "2", day[2]), ("b", "3", day[3]))
    for snapshot, after in ((None, -1), (str(tmp_path / "snap"), 0)):
        table = T.current_sheets(spark, root, snapshot, after)
        assert rows(table.filter("data <> 'n'")) == [("a", "2", day[0]), ("b", "3", day[3])]
        assert table.count() == 3


def test_sheet_table_without_a_stream(spark, frame, tmp_path):
    schema = "id string, data string, ts timestamp"
    root, old, new = str(tmp_path / "table"), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 9)
    T.write_changes(frame(schema, ("a", "{}", old), ("b", '{"title":"x"}', old)), root, 0)
    T.write_changes(frame(schema, ("b", '{"title":"y"}', new), ("c", "{}", new)), root, 1)
    T.write_changes(frame(schema, ("b", '{"title":"y"}', new), ("c", "{}", new)), root, 1)
    T.compact(spark, root, str(tmp_path / "snap"), as_of=F.lit("2024-01-10").cast("timestamp"))
    assert rows(spark.read.parquet(str(tmp_path / "snap"))) == [
        ("b", '{"title":"y"}', old), ("c", "{}", new)]


def test_bucketed_verses_are_not_shuffled(spark, frame, tmp_path):
    from versespan.operators.lookup import fetch_verses

    row = ("pl/1/10/1/1", "pl", "BT", "Gen", "Genesis", "Gen 1,1", 1, 10, 1, 1, "t")
    sinks.save_bucketed(frame(schemas.VERSES, row), "bucketed_verses",
                        ["source", "book_number", "chapter"], 4, str(tmp_path / "b"))
    stored = spark.table("bucketed_verses")
    books = frame("book_number int, short_name string", (10, "Gen"))
    chapters = frame("source string, book_number int, chapter int", ("BT", 10, 1))
    asked = frame("request_id int, address string, source string", (1, "Gen 1", None))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = fetch_verses(asked, stored, books, chapters, broadcast_rows=0).rows
        assert found.count() == 1
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table bucketed_verses")
    scan = plan.index("bucketed_verses")
    above = plan[:scan].rsplit("SortMergeJoin", 1)[1]
    assert "Exchange" not in above and "Bucketed: true" in plan
