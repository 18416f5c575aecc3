"""Join and ordering helpers that keep their plans sound when one key is very large."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from versespan.session import materialize

BROADCAST_ROWS = 50_000
BROADCAST_CHARS = 32 * 1024 * 1024
NARROW_CHARS = 2000
PRUNED_VALUES = 500
PART_LINES = 256
COPIES_PER_CHUNK = 65_536


class Checked(NamedTuple):
    """A result and the requests it could not answer, with the reason."""

    rows: DataFrame
    rejects: DataFrame


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS,
               max_chars: int = BROADCAST_CHARS) -> DataFrame:
    """``df`` marked for broadcast if it is below both bounds, else as it is.

    Without the mark the join is left to Catalyst and AQE: a shuffled join on the same
    keys, with skewed partitions split at run time. What was read to find the size is kept:
    the rows of a small side are the plan's own data from then on, so what they come from
    is not computed again. Rows of more than ``NARROW_CHARS`` characters are only measured.
    """
    return measured(df, max_rows, max_chars).rows


class Measured(NamedTuple):
    """A side of a join, and its values if they were few enough to be read."""

    rows: DataFrame
    values: pa.Table | None


def pruned(big: DataFrame, values: pa.Table | None, columns: Sequence[str]) -> DataFrame:
    """``big`` filtered to the values the small side has in ``columns``, where these are few:
    literals that reach the scan and prune its partitions and row groups."""
    for name in columns if values is not None else ():
        found = pc.unique(values.column(name).drop_null())
        if len(found) <= PRUNED_VALUES:
            big = big.filter(F.col(name).isin(found.to_pylist()))
    return big


def measured(df: DataFrame, max_rows: int = BROADCAST_ROWS,
             max_chars: int = BROADCAST_CHARS) -> Measured:
    """See ``small_side``."""
    width = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    names = [f"_c{i}" for i in range(len(df.columns))]
    row = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)])
    read = df.select(width.alias("w"), F.when(width <= NARROW_CHARS, row).alias("r")).limit(
        max_rows + 1).toArrow()
    widths = read.column("w").to_numpy()
    if len(widths) > max_rows or widths.sum() > max_chars:
        return Measured(df, None)
    if not len(widths) or widths.max() > NARROW_CHARS:
        return Measured(F.broadcast(df), None)
    rows = read.column("r").combine_chunks()
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
    table = pa.Table.from_arrays([rows.field(n) for n in names], names)
    kept = df.sparkSession.createDataFrame(
        table, T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, df.schema)]))
    return Measured(F.broadcast(kept.toDF(*df.columns)), table.rename_columns(df.columns))


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS,
             max_chars: int = BROADCAST_CHARS) -> bool:
    width = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    widths = df.select(width.alias("w")).limit(max_rows + 1).collect()
    return len(widths) <= max_rows and sum(w["w"] for w in widths) <= max_chars


def answer_once(requests: DataFrame, by: list[str], answer: Callable[[DataFrame], DataFrame],
                broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``answer(requests)``, asking each different question once where that pays.

    A few requests are answered as they are. Many requests that repeat few questions (the
    columns ``by``) are reduced to those questions, which can then be broadcast, and the
    answers are handed back to the requests. Distinct questions are estimated first, so
    requests that hardly repeat themselves are not shuffled to find that out.
    """
    if not broadcast_rows:
        return answer(requests)
    few = measured(requests, broadcast_rows).rows
    if few is not requests:              # what was read is the answer's input from here on
        return answer(few)
    keyed = requests.withColumn("question", F.to_json(F.struct(*by)))
    if keyed.agg(F.approx_count_distinct("question")).first()[0] > 1.2 * broadcast_rows:
        return answer(requests)
    questions = keyed.select(F.col("question").alias("request_id"), *by).distinct()
    if not is_small(questions, broadcast_rows):
        return answer(requests)
    found = answer(questions)
    return found.withColumnRenamed("request_id", "question").join(
        keyed.select("request_id", "question"), "question").select(*found.columns)


def computed(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a column that later steps read but Catalyst does not copy.

    A filter on a plain computed column is pushed below it, and projections are merged
    into it, each with its own copy of the expression; a generator is evaluated once.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def repeat_rows(df: DataFrame, copies: str) -> DataFrame:
    """Emit each row ``copies`` times; a very large count is produced in chunks."""
    last = ((F.col(copies) - 1) / COPIES_PER_CHUNK).cast("bigint")
    chunked = df.filter(F.col(copies) > 0).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    left = F.col(copies) - F.col("_chunk") * COPIES_PER_CHUNK
    return chunked.withColumn("_copy", F.explode(F.sequence(
        F.lit(1).cast("bigint"), F.least(left, F.lit(COPIES_PER_CHUNK)).cast("bigint")))) \
        .drop("_chunk", "_copy", copies)


def next_position(positions: DataFrame, group: list[str], digits: list[str]) -> DataFrame:
    """Add ``next_<digit>`` columns: the following position inside each group.

    ``positions`` holds distinct rows of ``group + digits`` with no NULL digit. A single
    window over a whole group would sort a hot group in one task, so the work is done
    digit by digit: the finest digit is ordered inside its parent, and what has no
    follower there takes the first position of the parent's own follower.
    """
    finest = len(digits) - 1
    out, found = positions, []
    for level in range(finest, -1, -1):
        parent, digit, rest = group + digits[:level], digits[level], digits[level:]
        here = F.struct(*rest)
        if level == finest:
            heads = positions.withColumn("_head", here)
        else:
            heads = positions.groupBy(*parent, digit).agg(F.min(here).alias("_head"))
        window = Window.partitionBy(*parent).orderBy(digit)
        step = heads.withColumn("_next", F.lead("_head").over(window))
        place = F.struct(*[F.col(d) for d in digits[:level]],
                         *[F.col(f"_next.{d}").alias(d) for d in rest])
        step = step.select(*parent, digit, F.when(
            F.col("_next").isNotNull(), place).alias(f"_next{level}"))
        out = step if level == finest else out.join(step, [*parent, digit])
        found.append(F.col(f"_next{level}"))
    return out.withColumn("_following", F.coalesce(*found)).select(
        *group, *digits, *[F.col(f"_following.{d}").alias(f"next_{d}") for d in digits])


def carry_forward(df: DataFrame, group: list[str], order: str, value: str, out: str,
                  block_size: int = 4096) -> DataFrame:
    """Last non-NULL ``value`` strictly before each row, ``order`` being a row number.

    Rows are filled inside blocks of ``block_size``; one summary row per block carries
    the value across, so a very long group is never one task.
    """
    keyed = df.withColumn("_block", F.floor(F.col(order) / block_size))
    inside = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    blocks = keyed.groupBy(*group, "_block").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    carried = blocks.select(*group, "_block",
                            F.last("_last", ignorenulls=True).over(across).alias("_carry"))
    filled = keyed.withColumn("_seen", F.last(value, ignorenulls=True).over(inside))
    return filled.join(carried, [*group, "_block"]).withColumn(
        out, F.coalesce("_seen", "_carry")).drop("_block", "_seen", "_carry")


def top_per_request(df: DataFrame, request: str, order: list[Column], k: int,
                    spread: Column, buckets: int = 64) -> DataFrame:
    """First ``k`` rows of each request in ``order`` (which must end in a unique column).

    The window limit runs per partition before any row moves, then per bucket, then per
    request, so one request with most of the rows is never sorted in a single task.
    """
    bucket = F.pmod(F.xxhash64(spread), F.lit(buckets))
    part = Window.partitionBy(request, "_bucket").orderBy(*order)
    whole = Window.partitionBy(request).orderBy(*order)
    first = df.withColumn("_bucket", bucket).withColumn("_rank", F.row_number().over(part)) \
        .filter(F.col("_rank") <= k).drop("_rank", "_bucket")
    return first.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)


def explode_range(df: DataFrame, lo: Column, hi: Column, out: str) -> DataFrame:
    """One row per number from ``lo`` to ``hi``, in chunks, so a very wide range is no array.

    An empty range gives no row, one with a NULL end a single row with NULL.
    """
    start, stop = lo.cast("bigint"), hi.cast("bigint")
    open_end = start.isNull() | stop.isNull()
    chunks = F.when(open_end, F.array(F.lit(None).cast("bigint"))).when(
        start <= stop, F.sequence(F.lit(0).cast("bigint"), F.floor(
            (stop - start) / COPIES_PER_CHUNK).cast("bigint")))
    first = start + F.col("_chunk") * COPIES_PER_CHUNK
    numbers = F.when(F.col("_chunk").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(
        F.sequence(first, F.least(stop, first + (COPIES_PER_CHUNK - 1))))
    return df.withColumn("_chunk", F.explode(chunks)).withColumn(
        out, F.explode(numbers)).drop("_chunk")


def in_parts(lines: DataFrame, key: list[str], order: list[str], within: Sequence[str] = (),
             text: str = "text", sep: str = "", lead: str | None = None) -> DataFrame:
    """Documents as ordered parts ``key, part, text``, whatever their size.

    ``order`` are integer columns (NULL counts as -1); the last numbers the lines, and every
    ``PART_LINES`` numbers begin a new part. ``within`` orders lines of one number. ``part``
    is an array that sorts as the parts follow one another, so no task ever holds more
    than one part. Of the column ``lead`` the value in a part's first line is kept.
    """
    cells = [F.coalesce(F.col(c).cast("bigint"), F.lit(-1).cast("bigint")) for c in order]
    place = F.array(*cells[:-1], F.floor(cells[-1] / PART_LINES).cast("bigint"))
    ordered = F.array_sort(F.collect_list(F.struct(*order, *within, F.col(text).alias("_text"))))
    kept = [F.min_by(lead, F.struct(*order, *within)).alias(lead)] if lead else []
    return lines.groupBy(*key, place.alias("part")).agg(
        F.array_join(F.transform(ordered, lambda r: r["_text"]), sep).alias("text"), *kept)


def joined_parts(parts: DataFrame, key: list[str], out: str = "document") -> DataFrame:
    """Each document as one value, for documents known to fit into one."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "text")))
    return parts.groupBy(*key).agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias(out))


def running_total(ordered: DataFrame, amount: str, out: str) -> DataFrame:
    """Add ``out``, the sum of ``amount`` over the rows before each in the order the rows have.

    Rows are added up per partition; only one number per partition is summed up in order.
    """
    step = 1 << 33                                  # what the ids of two partitions differ by
    stored = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn(
        "_part", F.floor(F.col("_at") / step)), "ordered")
    sums = stored.groupBy("_part").agg(F.sum(amount).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return stored.withColumn("_sum", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(
        offsets, "_part").withColumn(out, F.col("_before") + F.col("_sum")).drop(
        "_part", "_before", "_sum", "_at")


def placed(ordered: DataFrame) -> DataFrame:
    """Add ``place``, counting from 1 in the order the rows have.

    Rows are counted per partition; only one number per partition is summed up in order.
    """
    step = 1 << 33                                  # what the ids of two partitions differ by
    stored = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.floor(F.col("_at") / step)
    counts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return stored.withColumn("_part", part).join(offsets, "_part").withColumn(
        "place", F.col("_before") + F.col("_at") % step + 1).drop("_part", "_before", "_at")
