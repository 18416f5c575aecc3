"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

A leaf holds a run of pre-tokens (one, at first) with its characters and its tokens; inner
nodes hold sums. An edit finds its leaves by descending the character sums, re-splits and
re-encodes those and the context that could change with them, puts the new pre-tokens into
the first of the leaves, empties the others and updates the sums on their paths.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

from versespan.llm.bpe import Chunks, little_endian, quick_split, read_ranks
from versespan.llm.common import kept_in_process, text_blocks

LOOK = 2                 # the pattern looks at most this far beyond the end of a pre-token


class CountTree:
    def __init__(self, pieces: Sequence[str], chars: np.ndarray, tokens: np.ndarray,
                 split: Callable[[str], list[str]], count: Callable[[str], int]):
        self.split, self.count = split, count
        self.leaves: list[str | list[str]] = list(pieces)       # a pre-token, or a run of them
        self.width = 1 << max(len(pieces) - 1, 0).bit_length()
        self.chars, self.tokens = self._sums(chars), self._sums(tokens)
        self.encoded = 0         # pre-tokens encoded again by edits

    def _sums(self, leaves: np.ndarray) -> np.ndarray:
        out = np.zeros(2 * self.width, np.int64)
        out[self.width:self.width + len(leaves)] = leaves
        level = self.width
        while level > 1:
            out[level // 2:level] = out[level:2 * level:2] + out[level + 1:2 * level:2]
            level //= 2
        return out

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    def tokens_before(self, leaf: int) -> int:
        """Tokens in the leaves before ``leaf``: the left siblings on its path."""
        node, total = leaf + self.width, 0
        while node > 1:
            total += int(self.tokens[node - 1]) if node & 1 else 0
            node //= 2
        return total

    def _find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before that leaf."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if position - before >= self.chars[node]:
                before += int(self.chars[node])
                node += 1
        return node - self.width, before

    def pieces_in(self, leaf: int) -> list[str]:
        held = self.leaves[leaf]
        return [held] if isinstance(held, str) else held

    def _set(self, leaf: int, pieces: list[str], tokens: int) -> None:
        self.leaves[leaf] = pieces
        node = leaf + self.width
        self.chars[node], self.tokens[node] = sum(map(len, pieces)), tokens
        while node > 1:
            node //= 2
            for sums in (self.chars, self.tokens):
                sums[node] = sums[2 * node] + sums[2 * node + 1]

    def text(self) -> str:
        return "".join("".join(leaf) for leaf in self.leaves)

    def edit(self, start: int, delete: int, insert: str) -> None:
        """Replace ``delete`` characters from ``start`` on by ``insert``; positions beyond the
        end are moved to the end, negative ones to the start."""
        start = min(max(start, 0), self.n_chars)
        stop = min(start + max(delete, 0), self.n_chars)
        if start == stop and not insert:
            return
        if not self.leaves:
            self.leaves = [[]]
        # from the last leaf on that ends more than LOOK characters before the edit
        anchor = max(start - LOOK - 1, 0)
        first, before = self._find(min(anchor, max(self.n_chars - 1, 0)))
        first = min(first, len(self.leaves) - 1)
        last, ahead = first, 8
        old: list[str] = list(self.pieces_in(first))
        size = sum(map(len, old))
        while True:
            while last + 1 < len(self.leaves) and before + size < stop + ahead:
                last += 1
                old += self.pieces_in(last)
                size += sum(map(len, self.pieces_in(last)))
            at_end = last + 1 == len(self.leaves)
            whole = "".join(old)
            new_text = whole[:start - before] + insert + whole[stop - before:]
            new = self.split(new_text)
            kept = self._agree(old, new, stop - before, start - before + len(insert),
                               len(new_text), at_end)
            if kept is not None:
                break
            ahead *= 4
        n_old, n_new = kept
        # the leaves that hold the replaced pre-tokens, whole leaves only
        changed, tail, leaf = n_old, [], first - 1
        while changed > 0 or leaf < first:
            leaf += 1
            changed -= len(self.pieces_in(leaf))
        if changed < 0:
            tail = self.pieces_in(leaf)[changed:]
        fresh = new[:n_new]
        self.encoded += len(fresh)
        pieces = fresh + tail
        self._set(first, pieces, sum(map(self.count, pieces)))
        for other in range(first + 1, leaf + 1):
            self._set(other, [], 0)

    def _agree(self, old: list[str], new: list[str], old_from: int, new_from: int,
               new_size: int, at_end: bool) -> tuple[int, int] | None:
        """How many old and new pre-tokens stand before the first border behind the edit that
        both have; None if there is none that can be trusted."""
        borders, place = {}, 0
        for i, piece in enumerate(old):
            if place >= old_from:
                borders[place - old_from] = i
            place += len(piece)
        borders.setdefault(place - old_from, len(old))
        place = 0
        for j in range(len(new) + 1):
            sure = place + LOOK < new_size or at_end
            if place >= new_from and sure and place - new_from in borders:
                return borders[place - new_from], j
            if j < len(new):
                place += len(new[j])
        return None


def tree_of(text: str, chunks: Chunks, split: Callable[[str], list[str]],
            count: Callable[[str], int]) -> CountTree:
    parts = chunks(text)
    pieces = list(chain.from_iterable([part[0] for part in parts]))
    chars = np.frombuffer(b"".join([part[1] for part in parts]), "<u4")
    tokens = np.frombuffer(b"".join([part[2] for part in parts]), "<u4")
    return CountTree(pieces, chars, tokens, split, count)


def _tools(path: str, pattern: str) -> tuple:
    """Per worker: what splits a text into counted stretches, into pre-tokens, and counts one."""
    encoding = kept_in_process(("tiktoken", path, pattern), lambda: tiktoken.Encoding(
        "counts", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={}))
    find = regex.compile(pattern).findall

    def count(piece: str) -> int:
        return len(encoding.encode_ordinary(piece))

    def part(text: str) -> tuple[Sequence[str], bytes, bytes]:
        pieces = quick_split(text) or tuple(find(text))
        return (pieces, little_endian(map(len, pieces)), little_endian(map(count, pieces)))

    chunks = kept_in_process(("bpe counts", path, pattern), lambda: Chunks(part))
    return chunks, find, count


def edited_counts(path: str, pattern: str, text: Column, edits: Column) -> Column:
    """Token counts of each whole text before and after its edits.

    ``edits`` is an array of (start, delete, insert), in code points, applied one after another
    to the document as the one before left it. The struct holds ``n_pretokens`` and
    ``n_tokens`` before, ``n_tokens_after``, ``n_chars_after`` and ``n_encoded``, the pre-tokens
    encoded again. A NULL text is empty; a NULL array is no edits, a NULL edit is left out, a
    NULL start or delete is 0, a NULL insert empty. Positions outside the text are moved to
    its ends.
    """
    @F.arrow_udf("struct<n_pretokens:bigint,n_tokens:bigint,n_tokens_after:bigint,"
                 "n_chars_after:bigint,n_encoded:bigint>")
    def run(column: pa.Array, changes: pa.Array) -> pa.Array:
        chunks, split, count = _tools(path, pattern)
        rows, place = [], 0
        for block in text_blocks(column):
            wanted = changes.slice(place, len(block)).to_pylist()
            place += len(block)
            for one, steps in zip(block.to_pylist(), wanted, strict=True):
                tree = tree_of(one, chunks, split, count)
                before = tree.n_tokens
                n_pieces = len(tree.leaves)
                for step in steps or ():
                    if step is not None:
                        start, delete, insert = step.values()
                        tree.edit(start or 0, delete or 0, insert or "")
                rows.append((n_pieces, before, tree.n_tokens, tree.n_chars, tree.encoded))
        names = ["n_pretokens", "n_tokens", "n_tokens_after", "n_chars_after", "n_encoded"]
        return pa.StructArray.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names)

    return run(text, edits)
