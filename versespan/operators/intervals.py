"""A stored index of verse intervals: which intervals cover a point, read from one block.

An interval is kept once in every chapter block it touches, cut to that block, so a point finds
all intervals that cover it under its own block. An interval that runs over more than
``BLOCKS_KEPT`` blocks keeps one more row, under the block ``FAR``, for all that lies beyond;
a point asks that block of its book too. The stored rows lie in order of their key and start,
so a lookup that names few keys reads few row groups, and nothing is expanded when it runs.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versespan.functions import address as A
from versespan.operators.joins import pruned

BLOCKS_KEPT = 256
FAR = -1


def interval_index(intervals: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``intervals`` with ``block``, a row for each block touched, ``lo`` and ``hi`` cut to it.

    Intervals that are empty or have no ends give no row.
    """
    first, last = A.block(F.col(lo)), A.block(F.col(hi))
    kept = F.least(last, first + (BLOCKS_KEPT - 1))
    width = A.POSITIONS_PER_CHAPTER

    def piece(block: Column, start: Column, stop: Column) -> Column:
        return F.struct(block.cast("bigint").alias("block"), start.cast("bigint").alias("lo"),
                        stop.cast("bigint").alias("hi"))

    near = F.transform(F.sequence(first, kept), lambda b: piece(
        b, F.greatest(F.col(lo), b * width), F.least(F.col(hi), b * width + (width - 1))))
    far = F.when(last > kept, F.array(piece(F.lit(FAR), (kept + 1) * width, F.col(hi))))
    pieces = F.when(far.isNull(), near).otherwise(F.concat(near, far))
    rest = [c for c in intervals.columns if c not in (lo, hi)]
    return intervals.filter(F.col(lo) <= F.col(hi)).select(
        *rest, F.inline(pieces))


def store_index(index: DataFrame, key: list[str], partition: str, path: str) -> None:
    """Store an index by ``partition`` and in order of the rest of its key, block and start."""
    order = [partition, *[k for k in key if k != partition], "block", "lo"]
    index.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(
        "overwrite").partitionBy(partition).parquet(path)


def covering(index: DataFrame, asked: DataFrame, key: list[str],
             values: pa.Table | None = None) -> DataFrame:
    """Rows of the index met by the ranges of ``asked`` (``key, block, first, last``) that lie
    within one block each, with both sides' columns.

    ``values`` are what ``asked`` holds, if it is small: its keys, blocks and ends then reach
    the scan as literals.
    """
    if values is not None and values.num_rows:
        ends = pc.min(values.column("first")).as_py(), pc.max(values.column("last")).as_py()
        blocks = pa.concat_tables([values.select([*key, "block"]),
                                   values.select(key).append_column(
                                       "block", pa.array([FAR] * values.num_rows, pa.int64()))])
        index = pruned(index, blocks, [*key, "block"])
        if None not in ends:
            index = index.filter((F.col("lo") <= ends[1]) & (F.col("hi") >= ends[0]))
    both = asked.withColumn("block", F.explode(F.array(
        F.col("block").cast("bigint"), F.lit(FAR).cast("bigint"))))
    if values is not None:
        both = F.broadcast(both)
    return index.join(both, [*key, "block"]).filter(
        (F.col("lo") <= F.col("last")) & (F.col("hi") >= F.col("first")))
