"""How five document filters act on one another, in every order, from a document-term matrix.

Texts are read once, in blocks. A block becomes a shard of a sparse document-term matrix: its
words are numbered inside the block, and a row of the shard table holds the compressed rows
(where each document's entries start, their words, their counts) and the block's word list.
The word lists of all shards make one dictionary that numbers words without gaps, a shard's
own numbers are exchanged for those, and what is stored are shards of one matrix over all
documents. Row sums are then word counts and the number of a row's entries is the number of
its distinct words.

Filters, as bits of a document's mask (see :func:`failures`):

=  ==  ==========================================================================
A   1  fewer than 50 words
B   2  100 * distinct words < 65 * words
C   4  100 * characters A-Z > 5 * code points
D   8  a character of ``#$%&*|``
E  16  the same text as a document with a smaller id, wherever that document is
=  ==  ==========================================================================

Nulls and odd rows: a NULL text is empty (it fails A only, and E if another empty text has a
smaller id). A NULL part counts as the empty string. A document with a NULL id has no label,
never fails E and makes no other document fail it. Rows that repeat an id are documents of
their own; equal texts under one id do not fail E for each other. Several label rows of one id
count as good (toxic) if any of them is. Words end at ASCII white space only, so a text of any
length or script is a list of words. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versespan.llm.common import as_bytes, bucket_of, mixed, packed, text_blocks, unpacked
from versespan.operators.joins import small_side
from versespan.session import materialize

FILTERS = "ABCDE"
SHARD_BYTES = 4 << 20
WORDS_PER_BUCKET = 1 << 19
SHARDS = ("shard bigint, doc_ids array<bigint>, parts array<string>, digests array<binary>, "
          "marks array<int>, starts array<int>, codes binary, counts binary, n_words bigint, "
          "words binary")
NUMBERED = "shard bigint, bucket bigint, n_words bigint, numbers binary, words binary"
MATRIX = ("shard bigint, doc_ids array<bigint>, parts array<string>, digests array<binary>, "
          "marks array<int>, starts array<int>, counts binary, indices binary")
ROWS = "doc_id bigint, part string, digest binary, mask int"
ORDERS = "array<struct<filter_order:string,step:int,bit:int,before:int>>"


def _flags(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


UPPER = _flags(bytes(range(ord("A"), ord("Z") + 1)))
SYMBOL = _flags(b"#$%&*|")
LEADING = np.arange(256) & 0xC0 != 0x80          # not a continuation byte: one a code point


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of a block's flags are set in each text."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def _word_hashes(words: pa.Array) -> np.ndarray:
    data, offsets = as_bytes(words)
    sizes = np.diff(offsets)
    weights = np.full(int(sizes.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64)
    weights[0] = 1
    np.multiply.accumulate(weights, out=weights)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
    return mixed(np.add.reduceat((data + np.uint64(1)) * weights[place], offsets[:-1])) \
        if len(words) else np.zeros(0, np.uint64)


def _shard(block: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Where the entries of each text start, the entries' words (numbered in the block) and
    counts, and the words in the order of their hashes."""
    split = pc.ascii_split_whitespace(block)
    owner = np.repeat(np.arange(len(block)), pc.list_value_length(split).to_numpy())
    words = split.flatten()
    real = pc.not_equal(words, "")
    owner = owner[real.to_numpy(zero_copy_only=False)]
    encoded = words.filter(real).dictionary_encode()
    order = np.argsort(_word_hashes(encoded.dictionary), kind="stable")
    code = np.empty(len(order), np.int64)
    code[order] = np.arange(len(order))
    pairs, counts = np.unique(owner.astype(np.int64) << 32 | code[encoded.indices.to_numpy()],
                              return_counts=True)
    starts = np.searchsorted(pairs, np.arange(len(block) + 1, dtype=np.int64) << 32)
    return starts, pairs & 0xFFFFFFFF, counts, encoded.dictionary.take(pa.array(order))


def _lines(words: pa.Array) -> bytes:
    """Words, which hold no white space, as compressed lines."""
    text = b"\n".join(words.cast(pa.large_binary()).to_pylist())
    return len(text).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(text, asbytes=True)


def _words(blob: bytes) -> list[bytes]:
    return pa.Codec("zstd").decompress(
        blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True).split(b"\n")


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        done = 0
        for block in text_blocks(batch.column("text"), SHARD_BYTES):
            data, offsets = as_bytes(block)
            marks = np.where(100 * _sums(UPPER[data], offsets) > 5 * _sums(LEADING[data], offsets), 4, 0)
            marks |= np.where(_sums(SYMBOL[data], offsets) > 0, 8, 0)
            starts, codes, counts, words = _shard(block)
            digests = [hashlib.sha256(data[a:b]).digest()
                       for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            here = batch.slice(done, len(block))
            done += len(block)
            lists = [here.column("doc_id"), here.column("part"), pa.array(digests, pa.binary()),
                     pa.array(marks, pa.int32()), pa.array(starts, pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | number], pa.int64()),
                 *[pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in lists],
                 pa.array([packed(codes)], pa.binary()), pa.array([packed(counts)], pa.binary()),
                 pa.array([len(words)], pa.int64()), pa.array([_lines(words)], pa.binary())],
                ["shard", "doc_ids", "parts", "digests", "marks", "starts", "codes", "counts",
                 "n_words", "words"])
            number += 1


def dictionary(shards: DataFrame) -> DataFrame:
    """Every distinct word of the shards numbered, and each shard's words as such numbers.

    Words are dealt to buckets by their hash; a shard's list is in the order of the hashes, so a
    bucket takes one stretch of it. A bucket numbers its distinct words from 0. Rows with a
    ``shard`` hold the ``numbers`` of that stretch, rows without hold the bucket's ``words`` and
    how many they are. A word comes once from each shard, however often it is used there, and
    the number of buckets follows the number of words, so a bucket's size does not grow.
    """
    total = shards.agg(F.sum("n_words")).first()[0] or 0
    n = total // WORDS_PER_BUCKET + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                if not batch.column("n_words")[row].as_py():
                    continue
                words = pa.array(_words(batch.column("words")[row].as_py()), pa.large_binary())
                bucket = bucket_of(_word_hashes(words), n)
                ends = np.searchsorted(bucket, np.unique(bucket), side="right")
                for first, end in zip([0, *ends[:-1]], ends, strict=True):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("shard").slice(row, 1), pa.array([bucket[first]], pa.int64()),
                         pa.array([_lines(words[first:end])], pa.binary())],
                        ["shard", "bucket", "words"])

    def number(group: pa.Table) -> pa.Table:
        lists = [_words(blob.as_py()) for blob in group.column("words")]
        sizes = np.cumsum([0, *map(len, lists)])
        encoded = pa.array([w for words in lists for w in words], pa.large_binary()) \
            .dictionary_encode()
        order = np.argsort(_word_hashes(encoded.dictionary), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ranks = rank[encoded.indices.to_numpy()]
        bucket = group.column("bucket")[0].as_py()
        rows = [{"shard": s.as_py(), "bucket": bucket, "numbers": packed(ranks[a:b])}
                for s, a, b in zip(group.column("shard"), sizes[:-1], sizes[1:], strict=True)]
        words = {"shard": None, "bucket": bucket, "n_words": len(order),
                 "words": _lines(encoded.dictionary.take(pa.array(order)))}
        return pa.Table.from_pylist([*rows, words], pa.schema([
            ("shard", pa.int64()), ("bucket", pa.int64()), ("n_words", pa.int64()),
            ("numbers", pa.binary()), ("words", pa.binary())]))

    dealt = shards.select("shard", "n_words", "words").mapInArrow(
        deal, "shard bigint, bucket bigint, words binary")
    return materialize(dealt.groupBy("bucket").applyInArrow(number, NUMBERED), "dictionary")


def document_term_matrix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                         part: str = "source") -> DataFrame:
    """Stored shards of the document-term matrix, about ``SHARD_BYTES`` of text each.

    ``doc_ids``, ``parts``, ``digests`` (SHA-256 of the text) and ``marks`` (bits C and D) have an
    entry a document; document i's entries are those of ``indices`` and ``counts`` (``unpacked``)
    from ``starts[i]`` to before ``starts[i + 1]``. ``indices`` number the words of all shards
    from 0 without gaps: a bucket's words follow those of the buckets before it.
    """
    shards = materialize(docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col(text).alias("text")).mapInArrow(_read_shards, SHARDS), "shards")
    known = dictionary(shards)
    begin = known.filter("shard IS NULL").select("bucket", (F.sum("n_words").over(
        Window.orderBy("bucket")) - F.col("n_words")).alias("begin"))
    numbers = known.filter("shard IS NOT NULL").select("shard", "bucket", "numbers") \
        .join(small_side(begin), "bucket").groupBy("shard").agg(
            F.array_sort(F.collect_list(F.struct("bucket", "begin", "numbers"))).alias("stretches"))

    def exchange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                stretches = batch.column("stretches")[row].as_py() or []
                ids = np.concatenate([np.zeros(0, np.int64), *[
                    s["begin"] + unpacked(s["numbers"]) for s in stretches]])
                indices = ids[unpacked(batch.column("codes")[row].as_py())]
                kept = batch.slice(row, 1).drop_columns(["codes", "stretches"])
                yield kept.append_column("indices", pa.array([packed(indices)], pa.binary()))

    return materialize(shards.drop("words", "n_words").join(numbers, "shard", "left").select(
        "shard", "doc_ids", "parts", "digests", "marks", "starts", "counts", "codes", "stretches")
        .mapInArrow(exchange, MATRIX), "matrix")


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            def values(name: str, batch=batch, row=row) -> pa.Array:
                return batch.column(name)[row].values

            starts = values("starts").to_numpy()
            counts = unpacked(batch.column("counts")[row].as_py())
            entries = np.diff(starts)
            sums = np.diff(np.concatenate([[0], np.cumsum(counts)])[starts])
            mask = values("marks").to_numpy() | np.where(sums < 50, 1, 0) \
                | np.where(100 * entries < 65 * sums, 2, 0)
            yield pa.RecordBatch.from_arrays(
                [values("doc_ids"), values("parts"), values("digests"), pa.array(mask, pa.int32())],
                ["doc_id", "part", "digest", "mask"])


def failures(matrix: DataFrame) -> DataFrame:
    """``doc_id, part, digest, mask`` of every document, the mask with all five bits.

    The least id of each text is an aggregate; a row passes E if it is that row. The join is on
    text and id together, so the copies of one text are many keys.
    """
    rows = materialize(matrix.select("doc_ids", "parts", "digests", "marks", "starts", "counts")
                       .mapInArrow(_read_rows, ROWS), "masks")
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")) \
        .filter(F.col("doc_id").isNotNull()).withColumn("least", F.lit(True))
    copy = F.col("least").isNull() & F.col("doc_id").isNotNull()
    return rows.join(least, ["digest", "doc_id"], "left").withColumn(
        "mask", F.col("mask").bitwiseOR(F.when(copy, 16).otherwise(0))).drop("least")


def _orders() -> Column:
    """The steps of every order: the step's bit, and the bits of the filters before it."""
    steps = [{"filter_order": "".join(order), "step": place + 1, "bit": 1 << FILTERS.index(name),
              "before": sum(1 << FILTERS.index(n) for n in order[:place])}
             for order in permutations(FILTERS) for place, name in enumerate(order)]
    return F.from_json(F.lit(json.dumps(steps)), ORDERS)


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          part: str = "source") -> DataFrame:
    """What each filter removes in each place of each order, per part.

    ``labels`` has ``quality`` and ``toxic`` by the same id column. Documents are counted by
    (part, mask, label) first; the 600 steps meet those counts, at most 32 a part, not the
    documents. ``shapley`` needs no sum over orders: a filter is the first of the n that a
    document fails in 120 / n of the 120 orders.
    """
    found = failures(document_term_matrix(docs, doc_id, text, part))
    known = labels.groupBy(F.col(doc_id).cast("bigint").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    cells = found.join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("bad").alias("bad"))
    steps = cells.withColumn("s", F.explode(_orders())).select(
        "part", "mask", "n", "good", "bad", "s.*")
    fails, earlier = (F.col("mask").bitwiseAND(F.col(c)) != 0 for c in ("bit", "before"))

    def total(which: Column, of: Column, name: str) -> Column:
        return F.sum(F.when(which, of).otherwise(0)).cast("bigint").alias(name)

    n, share = F.col("n"), F.floor(
        F.lit(120) / F.greatest(F.bit_count("mask"), F.lit(1))).cast("bigint")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier, n, "kept"), total(fails & ~earlier, n, "removed"),
        total(fails & earlier, n, "redundant"), total(F.col("mask") == F.col("bit"), n, "unique_fails"),
        total(fails & ~earlier, F.col("good"), "good_lost"),
        total(fails & ~earlier, F.col("bad"), "toxic_lost"),
        total(fails, n * share, "shapley"))
