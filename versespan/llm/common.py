"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versespan.session import shared_dir

BLOCK_BYTES = 1 << 20
BUCKETS = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents that nothing may be learned from: crc32 of the id's text is 2 mod 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of a string column, each of about ``limit`` bytes or one text.

    Null texts become empty ones.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if held and held + size > limit:
            yield column.slice(start, row - start)
            start, held = row, 0
        held += int(size)
    if start < len(column):
        yield column.slice(start)


def as_bytes(block: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a block's texts one after another, and where each text starts
    (one more entry than texts)."""
    offsets = np.frombuffer(block.buffers()[1], dtype=np.int64)[
        block.offset:block.offset + len(block) + 1]
    data = block.buffers()[2]
    if data is None or not len(block):
        return np.zeros(0, np.uint8), np.zeros(len(block) + 1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


#: Spark's setting that an action's shuffle files go when it ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and the folder, for :func:`discard`.

    The shuffle files of the write go with its end; else they stay until the driver happens to
    collect its garbage.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark, purpose), spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def packed(values: np.ndarray) -> bytes:
    """Integers as bytes: differences, their bytes of equal weight side by side, compressed."""
    steps = np.diff(values.astype("<i8"), prepend=0)
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(
        planes.tobytes(), asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    if not size:
        return np.zeros(0, np.int64)
    planes = pa.Codec("zstd").decompress(blob[8:], 8 * size, asbytes=True)
    steps = np.frombuffer(planes, np.uint8).reshape(8, size).T
    return np.cumsum(np.ascontiguousarray(steps).view("<i8").ravel())


def mixed(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes with every input bit spread over all bits."""
    hashes = hashes ^ (hashes >> np.uint64(33))
    hashes *= np.uint64(0xFF51AFD7ED558CCD)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xC4CEB9FE1A85EC53)
    return hashes ^ (hashes >> np.uint64(32))


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each 64-bit hash, of ``n`` (below 2**31); larger hashes never come earlier."""
    return ((hashes >> np.uint64(33)) * np.uint64(n) >> np.uint64(31)).astype(np.int64)


def bounded_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """About ``n`` rows picked by a hash of ``key``, at most ``2 * n``; all if there are few.

    Used only where a model is fitted. The pick depends on the key alone, so it is the same
    however the table is split.
    """
    total = rows.count()
    if total <= n:
        return rows
    share = int(BUCKETS * n / total) + 1
    return rows.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)) < share).limit(2 * n)


def kept_in_process(key: Hashable, make: Callable[[], Any]) -> Any:
    """``make()``, done once in a Python worker and reused by its later tasks.

    Functions travel with their tasks, so a module's own variables would start afresh.
    """
    kept = sys.__dict__.setdefault("_versespan_kept", {})
    if key not in kept:
        kept[key] = make()
        gc.freeze()              # large tables that stay need not be looked through again
    return kept[key]
