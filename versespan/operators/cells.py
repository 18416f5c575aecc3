"""Nearest verses by cells of vectors, exact: a query reads only cells that can hold a result.

Vectors of a source are dealt to cells by the signs of a few fixed projections. Each cell's
centre is the mean direction of its vectors and its radius the largest angle between the two,
so the angle between a query and any vector of the cell is at least the angle to the centre less
the radius, and at most both together. A query first reads the cells that surely hold ``k``
vectors nearer than the rest could promise; the ``k``-th distance found there then says which of
the other cells can still hold a nearer one, and only those are read.

A cell's vectors are stored one after another, so the cells named prune what is read. Nothing
about the result depends on how well the cells fit: with poor cells more of them are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from versespan.functions.vectors import cosine_distance
from versespan.operators.joins import measured, pruned, top_per_request
from versespan.operators.nearest import MATCHES, best_of_partition
from versespan.operators.search import check_vectors

ROWS_PER_CELL = 512
MOST_BITS = 20
NO_LENGTH = -1               # the cell of vectors without a length, at no distance from anything
SLACK = 1e-6                 # radians: more than rounding moves an angle
IDS_PER_ROW = 64             # so many ids share one stored copy of their vector
STORED = "source string, embedding array<float>, dims int, cell bigint, ids array<string>"
DEALT = f"{STORED}, mark bigint"
CELLS = "source string, dims int, cell bigint, n bigint, centre array<double>, radius double"


class Cells(NamedTuple):
    """Vectors with their cell, and the cells with their bounds."""

    members: DataFrame       # id, source, embedding, dims, cell
    directory: DataFrame     # one row or more per cell, each with the bounds of its vectors


class Found(NamedTuple):
    rows: DataFrame
    visited: DataFrame       # (source, dims, cell) read in one wave or the other


def _projections(dims: int, bits: int) -> np.ndarray:
    return np.random.default_rng(dims).standard_normal((MOST_BITS, dims))[:bits]


def _marks(matrix: np.ndarray) -> np.ndarray:
    """A hash of each vector, to bring equal ones together."""
    odd = np.random.default_rng(matrix.shape[1]).integers(0, 1 << 62, matrix.shape[1], np.int64) | 1
    return (np.ascontiguousarray(matrix, np.float32).view(np.int32) * odd).sum(axis=1)


def _deal(bits: int):
    """For ``mapInArrow``: each vector's cell and mark, equal vectors of a batch in one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            cell, mark = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                matrix = flat.astype(float).reshape(len(rows), size)
                signs = matrix @ _projections(size, bits).T > 0
                cell[rows] = signs @ (1 << np.arange(bits))
                cell[rows[~matrix.any(axis=1)]] = NO_LENGTH
                mark[rows] = _marks(flat.reshape(len(rows), size))
            ids = pa.ListArray.from_arrays(
                pa.array(np.arange(len(sizes) + 1, dtype=np.int32)), batch.column("id"))
            yield _united(pa.RecordBatch.from_arrays(
                [batch.column("source"), vectors, pa.array(sizes, pa.int32()),
                 pa.array(cell, pa.int64()), ids, pa.array(mark, pa.int64())],
                ["source", "embedding", "dims", "cell", "ids", "mark"]))

    return run


def _united(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch in order of its marks with the ids of equal vectors in one row, up to a number."""
    keys = [batch.column("source").dictionary_encode().indices.fill_null(-1), *(
        batch.column(c) for c in ("dims", "cell", "mark"))]
    keys = [k.to_numpy(zero_copy_only=False) for k in keys]
    order = np.lexsort(keys[::-1])
    batch, keys = batch.take(pa.array(order)), [k[order] for k in keys]
    if not len(order):
        return batch
    new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
    sizes = keys[1]
    for size in np.unique(sizes).tolist():              # a mark may be that of another vector too
        rows = np.flatnonzero(sizes == size)
        flat = batch.column("embedding").take(pa.array(rows)).flatten()
        bits = flat.to_numpy(zero_copy_only=False).astype(np.float32).view(np.int32)
        bits = bits.reshape(len(rows), size)
        new[rows[1:]] |= (bits[1:] != bits[:-1]).any(axis=1)
    counts = batch.column("ids").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.cumsum(counts) - counts
    before -= np.maximum.accumulate(np.where(new, before, 0))
    full = before // IDS_PER_ROW
    new[1:] |= full[1:] != full[:-1]
    starts = np.flatnonzero(new)
    ids = pa.ListArray.from_arrays(
        pa.array(np.r_[0, np.cumsum(np.add.reduceat(counts, starts))].astype(np.int32)),
        batch.column("ids").flatten())
    firsts = batch.take(pa.array(starts))
    return firsts.set_column(batch.schema.names.index("ids"), "ids", ids)


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return map(_united, batches)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's number of vectors and sum of directions per cell. Members are stored in order of
    their cells, so neighbouring rows of one cell are summed up, and no more than a batch is held.
    A row counts as many times as ``copies`` says."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c) for c in ("source", "dims", "cell")]
        codes = [keys[0].dictionary_encode().indices, keys[1], keys[2]]
        codes = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in codes], axis=1)
        starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]).any(axis=1)])
        sizes = codes[starts, 1]
        stops = np.r_[starts[1:], len(codes)]
        for size in np.unique(sizes).tolist():
            runs = np.flatnonzero(sizes == size)
            counts = stops[runs] - starts[runs]
            rows = np.flatnonzero(np.repeat(sizes == size, stops - starts))
            flat = batch.column("embedding").take(pa.array(rows)).flatten()
            matrix = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), size)
            lengths = np.sqrt((matrix * matrix).sum(axis=1))
            matrix /= np.where(lengths == 0, 1.0, lengths)[:, None]
            copies = np.ones(len(rows))
            if "copies" in batch.schema.names:
                copies = batch.column("copies").to_numpy(zero_copy_only=False)[rows].astype(float)
            totals = np.add.reduceat(np.c_[copies, matrix * copies[:, None]],
                                     np.r_[0, np.cumsum(counts)[:-1]], axis=0)
            at = pa.array(np.repeat(starts[runs], size + 1))
            yield pa.RecordBatch.from_arrays(
                [*(k.take(at) for k in keys),
                 pa.array(np.tile(np.arange(size + 1, dtype=np.int32), len(runs))),
                 pa.array(totals.ravel())], ["source", "dims", "cell", "place", "total"])


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For stored rows with ``copies``: number of vectors, centre and radius of each run of
    neighbouring rows of one cell and batch, whose vectors are met once."""
    for batch in batches:
        for sums in _sums(iter([batch])):
            size = sums.column("dims")[0].as_py()
            rows = np.flatnonzero(batch.column("dims").to_numpy(zero_copy_only=False) == size)
            own = batch.take(pa.array(rows))
            totals = sums.column("total").to_numpy().reshape(-1, size + 1)
            heads = sums.take(pa.array(np.arange(len(totals)) * (size + 1)))
            keys = [own.column("source").dictionary_encode().indices.fill_null(-1),
                    own.column("cell")]
            keys = [k.to_numpy(zero_copy_only=False) for k in keys]
            new = np.any([k[1:] != k[:-1] for k in keys], axis=0) | (np.diff(rows) > 1)
            run = np.r_[0, np.cumsum(new)]
            matrix = own.column("embedding").flatten().to_numpy(zero_copy_only=False)
            matrix = matrix.astype(float).reshape(len(rows), size)
            centres = totals[:, 1:]
            with np.errstate(divide="ignore", invalid="ignore"):
                cosine = (matrix * centres[run]).sum(axis=1) / np.sqrt(
                    (matrix * matrix).sum(axis=1) * (centres * centres).sum(axis=1)[run])
                angle = np.arccos(np.clip(cosine, -1.0, 1.0))
            # a centre without a length bounds nothing: its cell may hold any angle
            radius = np.zeros(len(totals))
            np.maximum.at(radius, run, np.where(np.isnan(angle), math.pi, angle))
            offsets = np.arange(len(totals) + 1, dtype=np.int32) * size
            yield pa.RecordBatch.from_arrays(
                [heads.column("source"), heads.column("dims"), heads.column("cell"),
                 pa.array(totals[:, 0].astype(np.int64)), pa.ListArray.from_arrays(
                     pa.array(offsets), pa.array(centres.ravel())), pa.array(radius)],
                [c.split()[0] for c in CELLS.split(", ")])


def store_cells(vectors: DataFrame, path: str, rows_per_cell: int = ROWS_PER_CELL) -> None:
    """Store vectors ``(id, source, embedding)`` by cell at ``path``.

    The number of projections follows the number of vectors, so a cell's size does not grow
    (up to ``MOST_BITS``). Vectors ``check_vectors`` rejects are left out. Each vector is shuffled
    once, to where it is stored; bounds are taken from the stored rows as they lie. Ids of one
    source with the same vector share a stored copy.
    """
    spark = vectors.sparkSession
    fine = check_vectors(vectors.select("id", "source", "embedding")).rows.select(
        "id", "source", F.col("embedding").cast("array<float>").alias("embedding"))
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, fine.count()) / rows_per_cell))))
    order = ["source", "dims", "cell", "mark"]
    fine.mapInArrow(_deal(bits), DEALT).repartitionByRange(*order, F.col("ids")[0]) \
        .sortWithinPartitions(*order).mapInArrow(_unite, DEALT).sortWithinPartitions(*order) \
        .drop("mark").write.mode("overwrite").partitionBy("source").parquet(f"{path}/members")
    spark.read.schema(STORED).parquet(f"{path}/members").select(
        "source", "dims", "cell", "embedding", F.size("ids").alias("copies")).mapInArrow(
        _bounds, CELLS).write.mode("overwrite").partitionBy("source").parquet(f"{path}/directory")


def read_cells(spark, path: str) -> Cells:
    """The stored cells; sources are strings whatever their names look like."""
    stored = spark.read.schema(STORED).parquet(f"{path}/members")
    return Cells(stored.select(F.explode("ids").alias("id"), "source", "embedding", "dims", "cell"),
                 spark.read.schema(CELLS).parquet(f"{path}/directory"))


def _angle(a: Column, b: Column) -> Column:
    cosine = F.lit(1.0) - cosine_distance(a, b)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def nearest_in_cells(queries: DataFrame, cells: Cells, k: int, most_queries: int = 1024) -> Found:
    """The ``k`` stored vectors of its source nearest to each ``(request_id, source, vector)``,
    the same rows and distances as ``nearest_in_source`` finds.

    ``queries`` are few: ``most_queries`` at most. Vectors without a length come last, without a
    distance. Request ids may repeat; each row asks for itself.
    """
    spark = queries.sparkSession
    wanted = check_vectors(queries.select("request_id", "source", "vector").dropna(
        subset=["source"]), "vector").rows
    few = wanted.limit(most_queries + 1).collect()
    if len(few) > most_queries:
        raise ValueError(f"more than {most_queries} queries")
    numbered = [(n, q["source"], [float(x) for x in q["vector"]]) for n, q in enumerate(few)]
    asked = F.broadcast(spark.createDataFrame(
        [(n, s, len(v), v) for n, s, v in numbered],
        "query bigint, source string, dims int, vector array<double>"))
    sources = F.col("source").isin(sorted({s for _, s, _ in numbered}))
    angle = F.when(F.col("cell") != NO_LENGTH, F.nanvl(_angle(F.col("centre"), F.col("vector")),
                                                       F.lit(None).cast("double")))
    bounds = cells.directory.filter(sources).join(asked, ["source", "dims"]).select(
        "query", "source", "dims", "cell", "n", (angle - F.col("radius") - SLACK).alias("lower"),
        (angle + F.col("radius")).alias("upper"))

    by_upper = Window.partitionBy("query").orderBy(F.col("upper").asc_nulls_last(), "cell")
    before = F.sum("n").over(by_upper.rowsBetween(Window.unboundedPreceding, -1))
    plan = bounds.withColumn("first", F.coalesce(before, F.lit(0)) < k)
    key = ["source", "dims", "cell"]

    def read(which: DataFrame) -> DataFrame:
        side, values = measured(which.select(*key).distinct())
        members = pruned(cells.members.filter(sources), values, ["source", "cell"])
        return members.join(side, key, "left_semi").select("id", "source", "embedding").mapInArrow(
            best_of_partition([(s, v) for _, s, v in numbered], k), MATCHES)

    by_query = Window.partitionBy("query").orderBy(F.col("distance").asc_nulls_last(), "id")
    first = read(plan.filter("first")).withColumn("place", F.row_number().over(by_query)).filter(
        F.col("place") <= k).drop("place").collect()
    reach = {}
    for row in first:                                    # of fewer than k, all must be read
        reach.setdefault(row["query"], []).append(row["distance"])
    limits = []
    for n, _, _ in numbered:
        known = reach.get(n, [])
        worst = max(known) if len(known) >= k and not any(math.isnan(d) for d in known) else None
        limits.append((n, math.acos(max(-1.0, min(1.0, 1.0 - worst))) if worst is not None else None))
    limits = F.broadcast(spark.createDataFrame(limits, "query bigint, limit double"))
    open_ = plan.join(limits, "query")
    second = open_.filter(~F.col("first")).filter(
        F.col("limit").isNull() | F.coalesce(F.col("lower") <= F.col("limit"), F.col("limit").isNull())
        | (F.col("upper").isNull() & (F.col("cell") != NO_LENGTH)))
    names = F.broadcast(spark.createDataFrame(
        [(n, q["request_id"]) for n, q in enumerate(few)],
        T.StructType([T.StructField("query", T.LongType()), wanted.schema["request_id"]])))
    kept = spark.createDataFrame([tuple(r) for r in first], MATCHES)
    # both waves meet a row's distance by the same code, so a row read twice is one row
    best = kept.unionByName(read(second)).dropDuplicates(["query", "id"])
    rows = top_per_request(best.join(names, "query"), "query",
                           [F.col("distance").asc_nulls_last(), F.col("id").asc()], k, F.col("id"))
    return Found(rows.select("request_id", "id", "distance", "rank"),
                 plan.filter("first").select(*key).unionByName(second.select(*key)).distinct())
