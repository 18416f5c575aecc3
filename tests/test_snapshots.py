"""Folding sheet changes into snapshots."""

from __future__ import annotations

import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from versespan.streaming import sheets as T

SCHEMA = "id string, data string, ts timestamp"
OLD, NEW = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 9)


def opened(df):
    return {f.split("/table/")[1].split("/part-")[0] for f in df.inputFiles()}


def test_readers_open_later_folders_only(spark, frame, tmp_path):
    root = f"file://{tmp_path}/table"
    assert T.current_sheets(spark, root).count() == 0
    for batch in range(3):
        T.write_changes(frame(SCHEMA, ("a", f'"{batch}"', NEW), (f"s{batch}", "{}", OLD)), root, batch)
    first = T.fold(spark, root)
    assert (first.number, first.batch_id) == (0, 2)
    assert all(f.startswith("snapshots/") for f in opened(T.current_sheets(spark, root)))
    T.write_changes(frame(SCHEMA, ("a", '"late"', OLD)), root, 1)          # folded: changes nothing
    T.write_changes(frame(SCHEMA, ("b", '"x"', NEW), ("a", '"older"', OLD)), root, 3)
    now = T.current_sheets(spark, root)
    assert {f for f in opened(now) if "changes" in f} == {"changes/batch_id=3"}
    assert rows(now, "id", "data") == [
        ("a", '"2"'), ("b", '"x"'), ("s0", "{}"), ("s1", "{}"), ("s2", "{}")]


def test_clean_up_while_folding_and_what_is_kept(spark, frame, tmp_path):
    root = f"file://{tmp_path}/table"
    T.write_changes(frame(SCHEMA, ("a", "{}", OLD), ("b", '{"title":"x"}', OLD)), root, 0)
    T.fold(spark, root)
    old_reader = T.current_sheets(spark, root)
    T.write_changes(frame(SCHEMA, ("c", "{}", NEW)), root, 1)
    T.fold(spark, root, F.lit("2024-01-10").cast("timestamp"))
    assert rows(T.current_sheets(spark, root), "id") == [("b",), ("c",)]
    assert rows(old_reader, "id") == [("a",), ("b",)]      # a reader of the last snapshot goes on
    T.fold(spark, root)
    T.fold(spark, root)
    assert len(list((tmp_path / "table" / "snapshots").iterdir())) <= 3
    assert not (tmp_path / "table" / "changes" / "batch_id=0").exists()
    assert rows(T.current_sheets(spark, root), "id") == [("b",), ("c",)]


def test_a_fold_that_dies_changes_nothing(spark, frame, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/table"
    T.write_changes(frame(SCHEMA, ("a", "1", OLD)), root, 0)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(T.Files, "publish", die)
        with pytest.raises(RuntimeError):
            T.fold(spark, root)
    assert T.last_manifest(spark, root).number == -1
    assert rows(T.current_sheets(spark, root), "id", "data") == [("a", "1")]
    assert T.fold(spark, root).number == 0
    with pytest.raises(FileExistsError):
        T.Files(spark, root).publish(f"{root}/manifests/{0:012d}.json", "{}")
    assert T.last_manifest(spark, root).batch_id == 0
