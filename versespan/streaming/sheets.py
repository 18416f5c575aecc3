"""Streaming upserts of the sheet table.

A micro-batch costs what its own changes cost: it is reduced to one row per sheet and
written to a folder named after the batch, which a replay overwrites. Readers merge the
change folders with the last snapshot.

``fold`` writes a new snapshot and then publishes a manifest, a small numbered file that names
the snapshot and the last batch in it. The highest manifest counts. A reader opens its snapshot
and the later change folders only, so folded batches cost it nothing; a fold that dies before it
publishes has changed nothing. What the manifest before the last one named is removed.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from versespan import schemas
from versespan.operators.sheets import (
    check_changes, cleanup_sheets, latest_changes, upsert_sheets,
)
from versespan.session import Files

_CHANGES = "id string, data string, ts timestamp, first_ts timestamp, batch_id bigint"
_SNAPSHOT = "id string, data string, created_at timestamp, ts timestamp, batch_id bigint"


def write_changes(changes: DataFrame, root: str, batch_id: int) -> None:
    """Store one batch of ``id, data, ts`` changes, one row per sheet.

    A change without an id becomes a new sheet under a random id. Storing a batch again
    replaces it, unless a snapshot holds it already: then there is nothing left to do.
    """
    if batch_id <= last_manifest(changes.sparkSession, root).batch_id:
        return
    known = latest_changes(changes).select(
        "id", "data", F.col("last_ts").alias("ts"), "first_ts")
    fresh = check_changes(changes).rows.filter(F.col("id").isNull()).select(
        F.uuid().alias("id"), "data", "ts", F.col("ts").alias("first_ts"))
    known.unionByName(fresh).write.mode("overwrite").parquet(
        f"{root}/changes/batch_id={batch_id}")


def stream_upsert_sheets(changes: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Run a stream of ``id, data, ts`` changes into ``root`` until its input is used up."""
    return changes.writeStream.foreachBatch(
        lambda batch, batch_id: write_changes(batch, root, batch_id)
    ).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Manifest(NamedTuple):
    """What a snapshot holds: ``number`` counts the folds, -1 before the first."""

    number: int
    snapshot: str | None
    batch_id: int


def _manifest(files: Files, root: str, number: int) -> Manifest:
    found = json.loads(files.read(f"{root}/manifests/{number:012d}.json"))
    return Manifest(number, f"{root}/snapshots/{found['snapshot']}", found["batch_id"])


def last_manifest(spark: SparkSession, root: str) -> Manifest:
    files = Files(spark, root)
    names = [n for n in files.names(f"{root}/manifests") if n.endswith(".json")]
    return _manifest(files, root, int(names[-1][:-5])) if names else Manifest(-1, None, -1)


def _batches(files: Files, root: str) -> list[int]:
    return sorted(int(n.partition("=")[2]) for n in files.names(f"{root}/changes")
                  if n.startswith("batch_id="))


def _changes_after(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """The change folders of later batches; no other is opened."""
    later = [b for b in _batches(Files(spark, root), root) if b > batch_id]
    if not later:
        return spark.createDataFrame([], _CHANGES)
    return spark.read.schema(_CHANGES).option("basePath", f"{root}/changes").parquet(
        *[f"{root}/changes/batch_id={b}" for b in later])


def fold(spark: SparkSession, root: str, as_of: Column | None = None) -> Manifest:
    """Put the changes so far into a new snapshot, without sheets stale at ``as_of``, and
    publish it. Of two folds at once one is published; the other raises ``FileExistsError``."""
    files, last = Files(spark, root), last_manifest(spark, root)
    batch_id = max([last.batch_id, *_batches(files, root)])
    table = _merged(spark, last, _changes_after(spark, root, last.batch_id).filter(
        F.col("batch_id") <= batch_id))
    kept = table if as_of is None else cleanup_sheets(table, as_of).kept
    name = f"{last.number + 1:012d}-{uuid.uuid4().hex}"
    kept.write.parquet(f"{root}/snapshots/{name}")
    files.publish(f"{root}/manifests/{last.number + 1:012d}.json",
                  json.dumps({"snapshot": name, "batch_id": batch_id}))
    _forget(files, root, last, f"{root}/snapshots/{name}")
    return last_manifest(spark, root)


def _forget(files: Files, root: str, last: Manifest, new: str) -> None:
    """Remove what only readers older than the last manifest but one could still open: batches
    ``last`` holds, and snapshots before its own."""
    for batch in _batches(files, root):
        if batch <= last.batch_id:
            files.remove(f"{root}/changes/batch_id={batch}")
    for name in files.names(f"{root}/snapshots"):
        path = f"{root}/snapshots/{name}"
        if path not in (last.snapshot, new) and int(name[:12]) < last.number:
            files.remove(path)


def current_sheets(spark: SparkSession, root: str, snapshot: str | None = None,
                   after_batch: int = -1) -> DataFrame:
    """The sheet table: the snapshot, if any, with the later change folders merged in.

    Unless a snapshot ``compact`` wrote is given, it is the one of the last manifest. Before the
    first change there are no folders and the snapshot is all.
    """
    if snapshot is None:
        manifest = last_manifest(spark, root)
        log = _changes_after(spark, root, max(after_batch, manifest.batch_id))
        return _merged(spark, manifest, log).select("id", "data", "created_at")
    log = _changes_after(spark, root, after_batch)
    latest = log.groupBy("id").agg(
        F.max(F.struct("ts", "batch_id", "data"))["data"].alias("data"),
        F.min("first_ts").alias("ts"))
    return upsert_sheets(spark.read.schema(schemas.SHEETS).parquet(snapshot), latest)


def _merged(spark: SparkSession, manifest: Manifest, log: DataFrame) -> DataFrame:
    """A snapshot and later changes as a snapshot. It keeps when a sheet changed last, so a
    table does not depend on when it was folded."""
    if manifest.snapshot:
        base = spark.read.schema(_SNAPSHOT).parquet(manifest.snapshot)
        log = log.unionByName(base.withColumnRenamed("created_at", "first_ts"))
    return log.groupBy("id").agg(
        F.max(F.struct("ts", "batch_id", "data")).alias("_last"),
        F.min("first_ts").alias("created_at")).select(
        "id", "_last.data", "created_at", "_last.ts", "_last.batch_id")


def compact(spark: SparkSession, root: str, target: str, snapshot: str | None = None,
            after_batch: int = -1, as_of: Column | None = None) -> None:
    """Write the merged table to a new snapshot path, without sheets stale at ``as_of``."""
    merged = current_sheets(spark, root, snapshot, after_batch)
    kept = merged if as_of is None else cleanup_sheets(merged, as_of).kept
    kept.write.parquet(target)
