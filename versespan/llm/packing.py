"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each document's ids fill whole windows first; its rest is placed, online, into the open window
whose level keeps the sum of squared counts of open windows per level least. The counts stand
in a level array, so placing costs one vector expression however many windows are open. When a
task's documents are done (or very many windows are open), the open windows are closed by
cutting: documents of the emptiest fill up the fullest, so that one window per task at most is
left with padding. Documents are packed where they are read; nothing is shuffled.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versespan.llm.common import kept_in_process, text_blocks

WINDOW = 2048
END_ID = 1
MAX_OPEN = 8192          # open windows per task; beyond that the emptier half is closed
CACHE_ENTRIES = 100_000  # stretches remembered in each of two tables
AT_ONCE = 2048           # new stretches that the tokenizer gets in one text
WORDS_AT_ONCE = 256      # the same of new words of plain letters
CACHE_CHARS = 64
TAILS = ".,;:!?*#$&%|<>"
MARK = "^"               # stands between stretches that are encoded together
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
PLAIN = re.compile(f"[{LETTERS}]+")
LATIN = bytes(range(256)).decode("latin-1").lower().translate(
    dict.fromkeys(map(ord, "\t\n\v\f\r"), " ")).encode("latin-1")    # what a Latin-1 byte becomes


def stretches(text: str) -> list[str]:
    """What stands between spaces and line ends, in small letters as far as these are sure: those
    of Latin-1 texts, and A-Z in others."""
    try:
        text = text.encode("latin-1").translate(LATIN).decode("latin-1")
    except UnicodeEncodeError:
        text = text.encode().lower().decode().replace("\n", " ")
    return text.split(" ")
PIECES = ("doc_id {}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


class _Known(dict):
    """Ids of stretches. One that neither this table nor the one before it has stands for itself
    in ``new`` with an empty value, to be filled in."""

    def __init__(self, before: dict[str, bytes]):
        super().__init__()
        self.before = before
        self.new: dict[str, bytearray] = {}

    def __missing__(self, word: str) -> bytes | bytearray:
        found = self.before.get(word)
        if found is None:
            found = self.new[word] = bytearray()
        self[word] = found
        return found


class WordIds:
    """Ids of whole texts by a ``tokenizers`` file that ignores the case of Latin-1 letters and
    whose pre-tokens never hold white space, nor a letter or digit before punctuation.

    Texts are cut at spaces and line ends, and the ids of each stretch are remembered in two
    tables of bounded size: what is used stays when the older table is given up. New stretches,
    less the punctuation at their end, go to the tokenizer up to ``AT_ONCE`` in one text, with a
    mark between them that none of them holds. Words of ``LETTERS`` alone need neither the
    normalizer nor a mark: the token that ends a word tells so by its suffix.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mark = self._encoded([MARK])[0]
        self.plain, self.ends = self._plain()
        self.known = _Known({})

    def _plain(self) -> tuple[Any, np.ndarray]:
        """A tokenizer for words of ``LETTERS``, and which ids end a word; none if the file's
        normalizer changes such words, its pre-tokens part them or ends are not told."""
        from tokenizers import Tokenizer

        whole, two = self.tokenizer, f"{LETTERS} {LETTERS[::-1]}"
        vocabulary = whole.get_vocab()
        ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        suffix = getattr(whole.model, "end_of_word_suffix", None)
        same = whole.normalizer is None or whole.normalizer.normalize_str(two) == two
        if not suffix or not same or whole.pre_tokenizer is None or len(
                whole.pre_tokenizer.pre_tokenize_str(two)) != 2:
            return None, ends
        ends[[n for token, n in vocabulary.items() if token.endswith(suffix)]] = True
        plain = Tokenizer(whole.model)
        plain.pre_tokenizer = whole.pre_tokenizer
        return plain, ends

    def _encoded(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, "<u4") for found in self.tokenizer.encode_batch_fast(
            words, add_special_tokens=False)]

    def _keep(self, words: list[str], places: list[bytearray], ids: np.ndarray,
              stops: np.ndarray, gap: int) -> None:
        """Remember each word's ids: up to its stop, the next begin ``gap`` bytes behind it."""
        known, data, start = self.known, ids.tobytes(), 0
        for word, place, stop in zip(words, places, (4 * stops).tolist(), strict=True):
            known[word] = found = data[start:stop]
            place += found
            start = stop + gap

    def _fill(self, new: dict[str, bytearray]) -> None:
        """Encode stretches and remember their ids."""
        together = [word for word in new if MARK not in word]
        [ids] = self._encoded([f" {MARK} ".join(together)])
        stops = np.flatnonzero(ids == self.mark)
        alone = new
        if len(self.mark) == 1 and len(stops) == len(together) - 1:
            self._keep(together, [new[word] for word in together], ids,
                       np.append(stops, len(ids)), 4)
            alone = [word for word in new if MARK in word]
        for word, ids in zip(alone, self._encoded(list(alone)), strict=True):
            self.known[word] = found = ids.tobytes()
            new[word] += found

    def _fill_plain(self, words: list[str], places: list[bytearray]) -> None:
        """The same for words of ``LETTERS``."""
        [found] = self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(words):
            self._keep(words, places, ids, stops, 0)
        else:
            self._fill(dict(zip(words, places, strict=True)))

    def _learn(self) -> None:
        known, asked = self.known, self.known.new
        known.new = {}
        parts, whole = [], {}
        for word, place in asked.items():
            stem = word.rstrip(TAILS)
            if len(stem) < len(word) and stem and stem[-1].isalnum():
                parts.append((word, place, known[stem], known[word[len(stem):]]))
            else:
                whole[word] = place
        whole |= known.new
        known.new = {}
        words = list(filter(PLAIN.fullmatch, whole)) if self.plain else []
        places = [whole[word] for word in words]
        for at in range(0, len(words), WORDS_AT_ONCE):
            stop = at + WORDS_AT_ONCE
            self._fill_plain(words[at:stop], places[at:stop])
        plain = set(words)
        words = [word for word in whole if word not in plain]
        for at in range(0, len(words), AT_ONCE):
            self._fill({word: whole[word] for word in words[at:at + AT_ONCE]})
        for word, place, stem, tail in parts:
            known[word] = found = b"".join((stem, tail))
            place += found
        for word in whole:
            if len(word) > CACHE_CHARS:
                del known[word]
        for word, *_ in parts:
            if len(word) > CACHE_CHARS:
                del known[word]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHE_ENTRIES:
            self.known = _Known(dict(self.known))
        find = self.known.__getitem__
        found = [list(map(find, stretches(text))) for text in texts]
        if self.known.new:
            self._learn()
        return [b"".join(ids) for ids in found]


def kept_word_ids(path: str) -> WordIds:
    return kept_in_process(("word ids", path), lambda: WordIds(path))


class Packer:
    """Places documents one after another; ``emit`` gets the rows of closed windows.

    Rows are ``(doc, start, length, crc, doc_tokens, window, offset)``.
    """

    def __init__(self, emit: Callable[[tuple], None], window: int = WINDOW,
                 max_open: int = MAX_OPEN):
        self.emit, self.window, self.max_open = emit, window, max_open
        self.counts = np.zeros(window + 1, np.int64)     # open windows per level
        self.open: list[list[list[tuple]]] = [[] for _ in range(window)]
        self.n_open = self.n_windows = 0

    def add(self, doc, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.window:
            self._close([(doc, total, start, ids[4 * start:4 * (start + self.window)])])
            start += self.window
        if start < total:
            self._place((doc, total, start, ids[4 * start:]), total - start)

    def _place(self, piece: tuple, size: int) -> None:
        counts, full = self.counts, self.window
        # sum of squares after placing, less the sum before: a window leaves level h, one
        # comes to level h + size; a full window is no longer counted
        levels = np.flatnonzero(counts[:full - size + 1])
        change = 2 * counts[levels + size] + 1 - (2 * counts[levels] - 1)
        change[levels + size == full] = 1 - 2 * counts[full - size]
        best = int(change.argmin()) if len(levels) else -1
        if best < 0 or 2 * counts[size] + 1 < change[best]:
            level, pieces = 0, []
            self.n_open += 1
        else:
            level = int(levels[best])
            pieces = self.open[level].pop()
            counts[level] -= 1
        pieces.append(piece)
        if level + size == full:
            self.n_open -= 1
            self._close(pieces)
            return
        self.open[level + size].append(pieces)
        counts[level + size] += 1
        if self.n_open > self.max_open:
            self._settle(keep=self.max_open // 2)

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, total, start, ids in pieces:
            self.emit((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.n_windows, offset))
            offset += len(ids) // 4
        self.n_windows += 1

    def _settle(self, keep: int) -> None:
        """Close open windows but the ``keep`` fullest: pieces of the emptiest top up the rest.

        One window may be left over that is not full; it stays open if others do.
        """
        by_level = [(level, pieces) for level in range(1, self.window)
                    for pieces in self.open[level]]
        chosen = by_level[:len(by_level) - keep]
        for level, _ in chosen:
            self.open[level].pop(0)
            self.counts[level] -= 1
        self.n_open -= len(chosen)
        loose: list[tuple] = []
        low, high = 0, len(chosen) - 1
        while low <= high or loose:
            if low <= high:
                level, pieces = chosen[high]
                high -= 1
            else:
                level, pieces = 0, []
            gap = self.window - level
            while gap and (loose or low <= high):
                if not loose:
                    loose = chosen[low][1][::-1]
                    low += 1
                doc, total, start, ids = loose.pop()
                taken = min(gap, len(ids) // 4)
                pieces.append((doc, total, start, ids[:4 * taken]))
                gap -= taken
                if 4 * taken < len(ids):
                    loose.append((doc, total, start + taken, ids[4 * taken:]))
            if gap and keep:
                self.open[self.window - gap].append(pieces)
                self.counts[self.window - gap] += 1
                self.n_open += 1
            else:
                self._close(pieces)

    def finish(self) -> None:
        self._settle(keep=0)


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
         window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, a row per piece.

    A document is the ids of its whole text by the tokenizer file at ``path`` (without special
    tokens) and ``end_id``; NULL and empty texts are ``end_id`` alone. Every id is in exactly one
    piece, and the pieces of a sequence stand one after another from offset 0. Repeated rows
    are packed each for itself, a NULL id stays NULL. Other columns are ignored, an empty
    table gives no rows. ``sequence_id`` is the number of the input partition times 2**32 plus a
    counter, so it is the same when a lost task runs again.
    """
    kind = docs.schema[doc_id].dataType
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rows = kept_word_ids(path), []
        base = TaskContext.get().partitionId() << 32
        packer = Packer(rows.append, window)
        arrow = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            rows.clear()
            kinds = [arrow] + [pa.int64()] * 6
            columns[5] = [base + n for n in columns[5]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            arrow, place = batch.column(0).type, 0
            for block in text_blocks(batch.column(1)):
                ids = batch.column(0).slice(place, len(block)).to_pylist()
                place += len(block)
                for doc, found in zip(ids, words(block.to_pylist()), strict=True):
                    packer.add(doc, found + end)
            if len(rows) > 20_000:
                yield out()
        if arrow is not None:
            packer.finish()
            yield out()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, PIECES.format(kind.simpleString()))
