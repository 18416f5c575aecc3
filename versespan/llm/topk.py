"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to integers. A block of rows is kept as bitmaps, one per dimension and
bit of the (non-negative) offset value. For a query, the slices of its dimensions are added
with bitmap arithmetic: a bitmap enters at the weight of its bit plus that of the query's bit,
complemented where the query's component is negative, and full adders reduce the bitmaps of
each weight to one, carries going to the next. The sum's slices are then read from the most
significant downward, keeping the rows that are surely in and those still level. Rows level to
the last slice are tied; the smallest ids of them fill the rest.

Rows whose quantised components do not fit 64-bit arithmetic are in blocks of their own, and
their values, slices' weights and scores are Python's integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versespan.session import materialize

ROWS_PER_BLOCK = 1 << 13
QUERIES_PER_BLOCK = 1 << 9
FACTOR = 256
LIMIT = 1 << 24          # quantised components from here on make a row a wide one
NARROW_DIMS = 1 << 14    # longer vectors are wide ones, too: a sum of products would not fit
WIDE_SHARE = 32          # a block of wide rows has this share of the rows, as it has more slices
MATCHES = "query_id bigint, vec_id bigint, size int, score bigint, beyond binary"
BEYOND_BITS = 4096       # scores that no bigint holds are compared as integers of this width


def takes_part(vector: Column) -> Column:
    """False for NULL and empty vectors and those with a NULL or non-finite component."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def is_wide(vector: Column) -> Column:
    return (F.size(vector) > NARROW_DIMS) | F.exists(
        vector, lambda x: F.abs(x.cast("double") * FACTOR) >= LIMIT)


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component as an array of bigint, for vectors that are not wide."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * FACTOR))


def wide_integer(x: float) -> int:
    """floor(256 * x), exact for all finite numbers."""
    return math.floor(x * FACTOR) if abs(x) < 1e300 else int(x) * FACTOR


class SlicedBlock:
    """The bit slices of a block of quantised rows, in order of id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, slices: np.ndarray):
        """``ids`` in order, their rows, and the slices: dimension x bit x word."""
        self.ids, self.rows, self.slices = ids, rows, slices
        self.bits, self.words = slices.shape[1:]
        self.present = self._pack((np.arange(self.words * 64) < len(ids))[None])[0]

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray) -> SlicedBlock:
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        raised = (rows - rows.min()).T                                   # dimension x row
        bits, words = max(int(raised.max()).bit_length(), 1), -(-len(ids) // 64)
        padded = np.zeros((len(raised), words * 64), raised.dtype)
        padded[:, :len(ids)] = raised
        return cls(ids, rows, np.stack([cls._pack(padded >> b & 1) for b in range(bits)], axis=1))

    @staticmethod
    def _pack(flags: np.ndarray) -> np.ndarray:
        return np.packbits(flags.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)

    def add_up(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of a sum that orders the rows as their score does."""
        size = np.abs(query)
        waiting: dict[int, list[np.ndarray]] = {}
        for bit in range(int(size.max()).bit_length()):
            for sign in (1, -1):
                dims = np.flatnonzero((size >> bit & 1).astype(bool) & (np.sign(query) == sign))
                if len(dims):
                    taken = self.slices[dims] if sign > 0 else ~self.slices[dims]
                    for b in range(self.bits):
                        waiting.setdefault(bit + b, []).append(taken[:, b])
        out, weight = [], 0
        while waiting:
            parts = waiting.pop(weight, None)
            if parts is None:
                out.append(np.zeros(self.words, np.uint64))
                weight += 1
                continue
            stack = np.concatenate(parts)
            while len(stack) > 1:
                if len(stack) == 2:
                    a, b = stack
                    carry, stack = (a & b)[None], (a ^ b)[None]
                else:
                    third = len(stack) // 3
                    a, b, c = stack[:third], stack[third:2 * third], stack[2 * third:3 * third]
                    half = a ^ b
                    carry = (a & b) | (c & half)
                    stack = np.concatenate([half ^ c, stack[3 * third:]])
                waiting.setdefault(weight + 1, []).append(carry)
            out.append(stack[0])
            weight += 1
        return out

    def best(self, query: np.ndarray, own: int, k: int) -> np.ndarray:
        """Rows (as places in the block) of the ``k`` highest scores, ids other than ``own``;
        of equal scores those with the smallest ids."""
        level = self.present.copy()
        first, last = np.searchsorted(self.ids, [own, own + 1])
        for place in range(first, last):
            level[place // 64] &= ~np.uint64(1 << (place % 64))
        sure = np.zeros_like(level)
        for bits in reversed(self.add_up(query)):
            high = level & bits
            found = sure | high
            count = int(np.bitwise_count(found).sum())
            if count > k:
                level = high
            else:
                sure, level = found, level & ~bits
                if count == k:
                    level = np.zeros_like(level)
                    break
        chosen = self._places(sure)
        return np.concatenate([chosen, self._places(level)[:max(k - len(chosen), 0)]])

    @staticmethod
    def _places(bits: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bits)
        flags = np.unpackbits(bits[words].view(np.uint8), bitorder="little").reshape(-1, 64)
        row, col = np.nonzero(flags)
        return words[row] * 64 + col


def search_block(block: SlicedBlock, query_ids: np.ndarray, queries: np.ndarray,
                 k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query id, row id and exact score of each query's best rows in one block. Rows and
    queries are of 64-bit integers, or one or both of Python's."""
    out = []
    for own, query in zip(query_ids, queries, strict=True):
        places = block.best(query, int(own), k)
        out.append((np.full(len(places), own), block.ids[places], block.rows[places] @ query))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Ids, quantised rows, and the bytes these are read back from by :func:`_rows`."""
    table = table.combine_chunks()
    ids = table.column("vec_id").to_numpy().astype(np.int64)
    wide = table.column("wide")[0].as_py()
    flat = table.column("v" if wide else "q").combine_chunks().flatten()
    data = flat.to_numpy(zero_copy_only=False).astype("<f8" if wide else "<i4")
    data = data.reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    return ids, _rows(data.tobytes(), wide, data.shape[1]), data.tobytes()


def _rows(data: bytes | pa.Buffer, wide: bool, dims: int) -> np.ndarray:
    if not wide:
        return np.frombuffer(data, "<i4").astype(np.int64).reshape(-1, dims)
    exact = np.empty(len(data) // 8 if isinstance(data, bytes) else data.size // 8, object)
    exact[:] = [wide_integer(x) for x in np.frombuffer(data, "<f8").tolist()]
    return exact.reshape(-1, dims)


def _numbered(rows: DataFrame, per_block: int, name: str) -> tuple[DataFrame, int]:
    """Rows with the number of their block, by a hash of the id, and how many blocks there are.
    Wide rows have the last numbers.

    The counts steer how many blocks there are, not what is found.
    """
    counts = {r["wide"]: r["count"] for r in rows.groupBy("wide").count().collect()}
    narrow = -(-counts.get(False, 0) // per_block)
    wide = -(-counts.get(True, 0) // max(per_block // WIDE_SHARE, 1))
    code = F.xxhash64("vec_id", F.lit(17))
    return rows.withColumn(name, F.when(
        F.col("wide"), narrow + F.pmod(code, F.lit(max(wide, 1)))).otherwise(
        F.pmod(code, F.lit(max(narrow, 1))))), max(narrow + wide, 1)


def _ready(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("v")) \
        .filter(takes_part(F.col("v")) & F.col("vec_id").isNotNull())
    return rows.withColumn("wide", is_wide(F.col("v"))).select(
        "vec_id", F.size("v").alias("dims"), "wide",
        F.when(~F.col("wide"), quantised(F.col("v"))).alias("q"),
        F.when(F.col("wide"), F.col("v").cast("array<double>")).alias("v"))


def build_index(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                rows_per_block: int = ROWS_PER_BLOCK) -> tuple[DataFrame, int]:
    """The stored index, a row per block, and the number of blocks. Every row that takes part is
    in it; blocks are dealt by a hash of the id and hold vectors of one length."""
    rows, n = _numbered(_ready(vectors, vec_id, embedding), rows_per_block, "block")

    def build(table: pa.Table) -> pa.Table:
        ids, exact, data = _matrix(table)
        block = SlicedBlock.build(ids, exact)
        return pa.table({
            "dims": pa.array([exact.shape[1]], pa.int32()),
            "block": table.column("block")[:1].cast(pa.int64()),
            "wide": table.column("wide")[:1],
            "ids": pa.array([ids.tobytes()], pa.binary()),
            "rows": pa.array([data], pa.binary()),
            "slices": pa.array([block.slices.tobytes()], pa.binary()),
            "bits": pa.array([block.bits], pa.int32())})

    built = rows.groupBy("dims", "block").applyInArrow(
        build, "dims int, block bigint, wide boolean, ids binary, rows binary, slices binary, "
               "bits int")
    return materialize(built, "slices"), n


def _matches(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    """Found rows; scores that no bigint holds are put into ``size`` (1, or -1 if they are
    negative) and ``beyond``, which orders them."""
    score, size, beyond = scores, np.zeros(len(scores), np.int32), [None] * len(scores)
    if scores.dtype == object:
        exact = scores.tolist()
        score = [s if -1 << 63 <= s < 1 << 63 else None for s in exact]
        size = [0 if s is not None else 1 if e > 0 else -1
                for s, e in zip(score, exact, strict=True)]
        beyond = [((1 << BEYOND_BITS - 1) + e).to_bytes(BEYOND_BITS // 8, "big") if z else None
                  for e, z in zip(exact, size, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids, pa.int64()), pa.array(ids, pa.int64()), pa.array(size, pa.int32()),
         pa.array(score, pa.int64()), pa.array(beyond, pa.binary())],
        ["query_id", "vec_id", "size", "score", "beyond"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id",
          embedding: str = "embedding", rows_per_block: int = ROWS_PER_BLOCK,
          queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best rows, ties to the smaller id.

    ``queries`` has the same columns as ``vectors``; every row but those with the query's own id
    is a candidate. NULL and empty vectors, those with a NULL or non-finite component, and rows
    with a NULL id take no part; a score that no bigint holds is ranked by its exact value and
    returned as NULL. Vectors are compared with those of the same length only. A query id that occurs
    several times asks once, with its smallest vector; repeated rows are candidates each for
    itself. Fewer candidates than ``k`` give fewer rows, empty tables none. Other columns are
    ignored.

    Blocks of queries meet blocks of rows by the row block's number; what a task holds is
    bounded by the two block sizes, and only ``k`` rows per query and block leave it.
    """
    index, n_blocks = build_index(vectors, vec_id, embedding, rows_per_block)
    asked = _ready(queries, vec_id, embedding).groupBy("vec_id").agg(
        F.min(F.struct("dims", "wide", "q", "v")).alias("least")).select("vec_id", "least.*")
    asked, _ = _numbered(asked, queries_per_block, "query_block")

    def gather(table: pa.Table) -> pa.Table:
        ids, exact, data = _matrix(table)
        return pa.table({"dims": pa.array([exact.shape[1]], pa.int32()),
                         "wide_queries": table.column("wide")[:1],
                         "query_ids": pa.array([ids.tobytes()], pa.binary()),
                         "queries": pa.array([data], pa.binary())})

    wanted = asked.groupBy("dims", "query_block").applyInArrow(
        gather, "dims int, wide_queries boolean, query_ids binary, queries binary")
    wanted = wanted.withColumn("block", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))
    pairs = wanted.join(index, ["dims", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in range(batch.num_rows):
                row = {name: batch.column(name)[place] for name in batch.schema.names}
                dims, bits = row["dims"].as_py(), row["bits"].as_py()
                ids = np.frombuffer(row["ids"].as_buffer(), np.int64)
                rows = _rows(row["rows"].as_buffer(), row["wide"].as_py(), dims)
                asking = _rows(row["queries"].as_buffer(), row["wide_queries"].as_py(), dims)
                if object in (rows.dtype, asking.dtype):
                    rows, asking = rows.astype(object), asking.astype(object)
                slices = np.frombuffer(row["slices"].as_buffer(), np.uint64)
                yield _matches(*search_block(
                    SlicedBlock(ids, rows, slices.reshape(dims, bits, -1)),
                    np.frombuffer(row["query_ids"].as_buffer(), np.int64), asking, k))

    found = pairs.mapInArrow(run, MATCHES)
    best = Window.partitionBy("query_id").orderBy(
        F.desc("size"), F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
