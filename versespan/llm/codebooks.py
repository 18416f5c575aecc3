"""Vectors compressed to four codes, by k-means whose bounds adapt themselves.

A vector's components become integers and the vector is cut into equal consecutive parts. Each
part position has a codebook of up to 256 entries, which begins as that part of the rows of the
smallest ids. A round assigns each part to its nearest entry and moves each entry to the floored
mean of its parts; afterwards parts are assigned once more.

Assignment follows Drake and Hamerly's bounds. With each part are stored its entry, the ``b``
entries next in distance with a lower bound of the distance to each, in order, and one outer
bound for all entries beyond. When entries have moved, each bound is lowered by how far its entry
went, the outer one by the farthest move, and the distance to the part's own entry is computed
anew. Bounds not above that distance are uncertain: the distances to their entries are computed
in integers and compared as integers, equal ones going to the lower index. If the outer bound is
uncertain too, all distances are. ``b`` adapts: it begins at an eighth of the entries and becomes,
after each round, the number of uncertain entries that all but few parts had in it.

Everything that decides is exact: distances are integers (in floating point only as far as that
holds integers exactly, in Python's own integers where 64 bits do not suffice), bounds are only
ever rounded down, and sums are added as decimal limbs.

Nulls and odd rows: rows whose vector is NULL, holds a NULL or non-finite component, is empty or
does not cut into equal parts are dropped, and so are those of another length than the kept row
with the smallest id. Rows repeating an id are rows of their own; of rows with one id those with
the smaller vector come first. A NULL id comes last. With fewer rows than entries the codebook is
that small. An ``error`` or ``label_error`` that no long holds is NULL. Tables without a kept
row give an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versespan.llm.common import discard, stored
from versespan.operators.joins import small_side
from versespan.session import materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
ENOUGH = 0.95            # share of parts whose uncertain entries the next round's b covers
LIMB_BITS = 32
LARGEST = {"<f4": float(np.finfo("<f4").max), "<f8": float(np.finfo("<f8").max)}
BLOCK_ROWS = 4096
STATE = ("vec_id bigint, label {label}, vector {vector}, own binary, near binary, lower binary, "
         "outer binary, error string, need array<int>")
SUMS = "kind string, part int, entry int, place int, limb int, amount bigint"
ROUNDING = 1e-9


def usable(vector: Column) -> Column:
    """Vectors that take part: of finite components only and of a length that cuts equally."""
    whole = F.forall(vector, lambda x: F.coalesce(
        ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(whole & (F.size(vector) > 0) & (F.size(vector) % PARTS == 0), F.lit(False))


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles, in Python's integers if 64 bits may not do."""
    if not values.size or np.abs(values).max() < 2 ** 40:
        return np.floor(values * SCALE).astype(np.int64)
    def whole(x: float) -> int:
        return int(x) * SCALE if abs(x) >= 2 ** 53 else int(np.floor(x * SCALE))
    return np.array([whole(x) for x in values.ravel()], object).reshape(values.shape)


def _reach(values: np.ndarray) -> int:
    return int(max(abs(values.min()), abs(values.max()))) if values.size else 0


def all_distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every entry."""
    most = rows.shape[1] * (_reach(rows) + _reach(entries)) ** 2
    if most < 2 ** 52:
        a, c = rows.astype(float), entries.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    kind = np.int64 if most < 2 ** 62 else object
    out = np.empty((len(rows), len(entries)), kind)
    for j, entry in enumerate(entries.astype(kind)):
        out[:, j] = ((rows.astype(kind) - entry) ** 2).sum(1)
    return out


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to the entry beside it."""
    most = rows.shape[1] * (_reach(rows) + _reach(entries)) ** 2 if len(rows) else 0
    kind = np.int64 if most < 2 ** 62 else object
    return ((rows.astype(kind) - entries.astype(kind)) ** 2).sum(1)


def _floating(squared: np.ndarray, beyond: float) -> np.ndarray:
    """As doubles; integers that no double holds become ``beyond``."""
    if squared.dtype == object:
        squared = np.array([float(v) if v < 2 ** 1023 else beyond for v in squared.ravel()],
                           float).reshape(squared.shape)
    return squared.astype(float)


def _below(squared: np.ndarray) -> np.ndarray:
    """Distances as doubles, surely not above the true ones."""
    return np.sqrt(_floating(squared, 2.0 ** 1023)) * (1 - ROUNDING)


def _above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(_floating(squared, np.inf)) * (1 + ROUNDING)


class Bounds(NamedTuple):
    """For n parts: their entry, the next entries and their lower bounds, the bound of the rest."""

    own: np.ndarray          # n
    near: np.ndarray         # n x b
    lower: np.ndarray        # n x b, ascending
    outer: np.ndarray        # n


def from_scratch(rows: np.ndarray, entries: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
    """Bounds of parts that have none, and the distances to their entries."""
    squared = all_distances(rows, entries)
    order = np.argsort(squared, axis=1, kind="stable")       # equal ones by index
    b = min(b, len(entries) - 1)
    lower = _below(np.take_along_axis(squared, order, 1))
    outer = lower[:, b + 1] if b + 1 < len(entries) else np.full(len(rows), np.inf)
    at = np.arange(len(rows))
    return Bounds(order[:, 0].astype(np.uint8), order[:, 1:b + 1].astype(np.uint8),
                  lower[:, 1:b + 1], outer), squared[at, order[:, 0]]


def reassign(rows: np.ndarray, entries: np.ndarray, moved: np.ndarray, old: Bounds,
             b: int) -> tuple[Bounds, np.ndarray, np.ndarray]:
    """Bounds after the entries moved by ``moved`` at most, the distances to the new own entries,
    and how many near entries of each part were uncertain (all of them and one: everything)."""
    n, width = old.near.shape
    at = np.arange(n)
    lower = old.lower - moved[old.near]
    outer = old.outer - moved.max()
    lower = np.minimum.accumulate(np.column_stack([lower, outer])[:, ::-1], axis=1)[:, ::-1]
    own_squared = distances(rows, entries[old.own])
    upper = _above(own_squared)
    need = (lower <= upper[:, None]).sum(1)                  # a prefix: bounds ascend
    own, near, best = old.own.copy(), old.near.copy(), own_squared.copy()
    lower, outer = lower[:, :-1].copy(), outer.copy()
    for count in np.unique(need[(need > 0) & (need <= width)]):
        chosen = at[need == count]
        tried = np.column_stack([old.own[chosen], old.near[chosen, :count]])
        squared = np.column_stack([own_squared[chosen], *[
            distances(rows[chosen], entries[tried[:, j]]) for j in range(1, count + 1)]])
        by_index = np.argsort(tried, axis=1, kind="stable")
        tried, squared = (np.take_along_axis(x, by_index, 1) for x in (tried, squared))
        order = np.argsort(squared, axis=1, kind="stable")
        tried, squared = (np.take_along_axis(x, order, 1) for x in (tried, squared))
        own[chosen], best[chosen] = tried[:, 0], squared[:, 0]
        near[chosen, :count] = tried[:, 1:]
        lower[chosen, :count] = _below(squared[:, 1:])
    anew = at[need > width]
    if len(anew):
        fresh, squared = from_scratch(rows[anew], entries, width)
        own[anew], near[anew], lower[anew] = fresh.own, fresh.near, fresh.lower
        outer[anew], best[anew] = fresh.outer, squared
    lower = np.minimum.accumulate(np.column_stack([lower, outer])[:, ::-1], axis=1)[:, ::-1]
    b = min(b, width)
    return Bounds(own, near[:, :b], lower[:, :b], lower[:, b]), best, need


KINDS = {"own": "u1", "near": "u1", "lower": "<f4", "outer": "<f4"}


def _blobs(values: list[np.ndarray], kind: str) -> pa.Array:
    """For each row the values of its parts one after another; bounds are rounded down."""
    together = np.stack([v.reshape(len(v), -1) for v in values], axis=1)
    if kind == "<f4":
        rounded = np.clip(together, -LARGEST[kind], LARGEST[kind]).astype(kind)
        together = np.nextafter(rounded, np.float32(-np.inf))
    return pa.array([row.tobytes() for row in together.astype(kind)], pa.binary())


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(
        batch.num_rows, -1)


def _stored(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of equally long blobs as rows x parts x values."""
    found = np.frombuffer(b"".join(batch.column(name).to_pylist()), KINDS[name]).reshape(
        batch.num_rows, PARTS, -1)
    return found.astype(float) if KINDS[name] == "<f4" else found


def _assign(codebooks: list[np.ndarray], moved: list[np.ndarray] | None, b: int):
    """A task's work of one assignment: of vectors alone, or of vectors with their bounds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(start, BLOCK_ROWS)
                parts = np.split(integers(_vectors(batch)), PARTS, axis=1)
                if moved is None:
                    done = [(*from_scratch(p, c, b), np.zeros(len(p), int))
                            for p, c in zip(parts, codebooks, strict=True)]
                else:
                    own, near, lower, outer = (_stored(batch, name) for name in KINDS)
                    done = [reassign(p, codebooks[i], moved[i], Bounds(
                        own[:, i, 0], near[:, i], lower[:, i], outer[:, i, 0]), b)
                        for i, p in enumerate(parts)]
                bounds, errors, need = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id"), batch.column("label"), batch.column("vector"),
                    *[_blobs([getattr(q, name) for q in bounds], kind)
                      for name, kind in KINDS.items()],
                    pa.array([str(sum(map(int, row))) for row in zip(*errors, strict=True)]),
                    pa.array(np.stack(need, axis=1).tolist(), pa.list_(pa.int32()))],
                    ["vec_id", "label", "vector", *KINDS, "error", "need"])

    return run


def _sum_up(size: int):
    """Sums of a task's parts by entry, as limbs; how many parts each entry has; and how many
    parts had so many uncertain entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        counts, needs = np.zeros((PARTS, size), np.int64), np.zeros(size + 1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _stored(batch, "own")[:, :, 0]
            needs += np.bincount(batch.column("need").flatten().to_numpy(), minlength=size + 1)
            for i, part in enumerate(np.split(integers(_vectors(batch)), PARTS, axis=1)):
                counts[i] += np.bincount(own[:, i], minlength=size)
                order = np.argsort(own[:, i], kind="stable")
                entries, first = np.unique(own[order, i], return_index=True)
                for entry, total in zip(entries, np.add.reduceat(
                        part[order].astype(object) if _reach(part) > 2 ** 40 else part[order],
                        first, axis=0), strict=True):
                    key = i, int(entry)
                    sums[key] = sums.get(key, 0) + total.astype(object)
        rows = [("count", i, j, 0, 0, int(n)) for i, line in enumerate(counts)
                for j, n in enumerate(line) if n]
        rows += [("need", 0, j, 0, 0, int(n)) for j, n in enumerate(needs) if n]
        for (i, j), total in sums.items():
            for place, value in enumerate(total):
                limb, value = 0, int(value)
                while value:
                    low = abs(value) & ((1 << LIMB_BITS) - 1)
                    rows.append(("sum", i, j, place, limb, low if value > 0 else -low))
                    value, limb = (abs(value) >> LIMB_BITS) * (1 if value > 0 else -1), limb + 1
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("kind", "part", "entry", "place", "limb", "amount"), r, strict=True))
             for r in rows],
            pa.schema([("kind", pa.string()), ("part", pa.int32()), ("entry", pa.int32()),
                       ("place", pa.int32()), ("limb", pa.int32()), ("amount", pa.int64())]))

    return run


def _moved_to(state: DataFrame, codebooks: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Each entry at the floored mean of its parts, and the number of uncertain entries that was
    enough for all but few parts. The sums are added by Spark; what reaches the driver is a row
    per number of the codebooks, whatever the table's size."""
    totals = state.select("vector", "own", "need").mapInArrow(_sum_up(len(codebooks[0])), SUMS) \
        .groupBy("kind", "part", "entry", "place", "limb") \
        .agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount")).collect()
    counts = {(r["part"], r["entry"]): int(r["amount"]) for r in totals if r["kind"] == "count"}
    sums: dict[tuple[int, int, int], int] = {}
    for r in totals:
        if r["kind"] == "sum":
            key = r["part"], r["entry"], r["place"]
            sums[key] = sums.get(key, 0) + (int(r["amount"]) << (LIMB_BITS * r["limb"]))
    needs = sorted((r["entry"], int(r["amount"])) for r in totals if r["kind"] == "need")
    enough = np.searchsorted(np.cumsum([n for _, n in needs]), ENOUGH * sum(n for _, n in needs))
    after = [np.array([[sums.get((i, j, p), 0) // counts[i, j] if (i, j) in counts else int(old)
                        for p, old in enumerate(entry)] for j, entry in enumerate(book)], object)
             for i, book in enumerate(codebooks)]
    return [_narrow(book) for book in after], needs[enough][0]


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if _reach(book) < 2 ** 60 else book


class Compressed(NamedTuple):
    """The stored codes with errors, the final codebooks, and the ``b`` of each assignment."""

    rows: DataFrame
    codebooks: list[np.ndarray]
    widths: list[int]


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
             label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> Compressed:
    """Codes ``own`` (a byte a part) and ``error`` (all parts' together) of every kept row.

    ``entries`` is 256 at most. A round reads the last round's rows with their bounds, writes
    them anew and removes the last round's folder.
    """
    spark, vector = vectors.sparkSession, F.col(embedding)
    if vectors.schema[embedding].dataType.elementType not in (T.FloatType(), T.DoubleType()):
        vector = vector.cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"),
                          F.col(label).alias("label"), vector.alias("vector"))
    rows = rows.filter(usable(F.col("vector")))
    by_id = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector")
    first = by_id.limit(1).collect()
    if not first:
        return Compressed(rows.select("vec_id", "label", F.lit(b"").alias("own"),
                                      F.lit("").alias("error")), [], [])
    alike = F.size("vector") == len(first[0]["vector"])
    rows = rows.filter(alike)
    begin = integers(np.array([r["vector"] for r in by_id.filter(alike).limit(entries).collect()]))
    codebooks = [_narrow(p) for p in np.split(begin, PARTS, axis=1)]
    schema = STATE.format(label=rows.schema["label"].dataType.simpleString(),
                          vector=rows.schema["vector"].dataType.simpleString())

    b = max(1, entries // 8)
    widths, state, moved, old = [], rows, None, None
    while True:
        widths.append(b)
        state, path = stored(state.mapInArrow(_assign(codebooks, moved, b), schema), "codes")
        if old is not None:
            discard(spark, old)
        if len(widths) > rounds:
            return Compressed(state.select("vec_id", "label", "own", "error"), codebooks, widths)
        after, needed = _moved_to(state, codebooks)
        moved = [_above(distances(a, c)) for a, c in zip(after, codebooks, strict=True)]
        codebooks, old = after, path
        if len(widths) > 1:
            b = max(1, min(b, needed))


def codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
          label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept row.

    Errors are added as decimals of 38 digits. There is one row a label in the sums, so a label
    that most rows have is joined as a broadcast side, or as a skewed key that can be split.
    """
    done = compress(vectors, vec_id, embedding, label, entries, rounds)
    text = ",".join(str(int(x)) for book in done.codebooks for entry in book for x in entry)

    def as_long(value: Column) -> Column:
        return F.when(value <= F.lit(2 ** 63 - 1), value.cast("bigint"))

    rows = done.rows.select("vec_id", "label", F.lower(F.hex("own")).alias("code"),
                            F.col("error").try_cast("decimal(38,0)").alias("exact"))
    same = materialize(rows.groupBy("label").agg(
        F.try_sum("exact").alias("total"), F.count_if(F.col("exact").isNull()).alias("beyond")),
        "labels").select(F.col("label").alias("_label"), F.when(
            F.col("beyond") == 0, as_long(F.col("total"))).alias("label_error"))
    return rows.join(small_side(same), F.col("label").eqNullSafe(F.col("_label")), "left").select(
        "vec_id", "code", as_long(F.col("exact")).alias("error"), "label_error",
        F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
