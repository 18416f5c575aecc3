"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a pre-token exactly one vocabulary token can be the last one of its
encoding: a suffix of the prefix that stays apart from the last token of what stands before
it. Two tokens stay apart if, undoing their merges from the latest to the earliest, no merge
across their border would have come first. So the last token of each prefix follows from
those of shorter prefixes, in one pass; it never changes when bytes are appended, and after an
edit only the prefixes from there on are computed again, until they agree with the old ones.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Sequence
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from versespan.llm.common import kept_in_process, text_blocks

MEMO_BYTES = 40              # longer pre-tokens are not remembered
MEMO_ENTRIES = 400_000
LOOSE_SPACE = re.compile(r" (?:\s|\Z)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def quick_split(text: str) -> tuple[str, ...] | None:
    """The pre-tokens of a space and a word of letters, with a full stop or comma or without;
    anything else needs the pattern."""
    word = text[1:]
    if text[:1] == " " and word[:-1].isalpha():
        if word[-1] in ".,":
            return (text[:-1], word[-1])
        if word.isalpha():
            return (text,)
    return None


class Vocabulary:
    """Ranks of a tiktoken file, with the two parts each token is merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.usable = {}         # tokens that are their own encoding
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            if len(token) == 1:
                self.usable[token] = rank
                continue
            two = self._merged_below(token, rank)
            if len(two) == 2:
                self.parts[rank] = (ranks[two[0]], ranks[two[1]])
                self.usable[token] = rank
        self._apart: dict[tuple[int, int], bool] = {}
        # finds the usable tokens that end at each byte of a text
        self.suffixes = ahocorasick.Automaton()
        for token, rank in self.usable.items():
            self.suffixes.add_word(token.decode("latin-1"), (len(token), rank))
        if self.usable:
            self.suffixes.make_automaton()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        return cls(read_ranks(path))

    def _merged_below(self, token: bytes, limit: int) -> list[bytes]:
        """The token's bytes after all merges that rank below it."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, place = limit, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1], limit)
                if rank < best:
                    best, place = rank, i
            if place < 0:
                break
            parts[place:place + 2] = [parts[place] + parts[place + 1]]
        return parts

    def apart(self, first: int, second: int) -> bool:
        """Whether the two tokens, side by side, are the encoding of their joined bytes."""
        known = self._apart.get((first, second))
        if known is None:
            if len(self._apart) > 2 * MEMO_ENTRIES:
                self._apart.clear()
            known = self._apart[first, second] = self._stays_apart(first, second)
        return known

    def _stays_apart(self, first: int, second: int) -> bool:
        tokens, ranks, parts = self.tokens, self.ranks, self.parts
        before = None            # a merge across the border must rank below this to win
        while True:
            across = ranks.get(tokens[first] + tokens[second])
            if across is not None and (before is None or across < before):
                return False
            made_first = first if first in parts else -1
            made_second = second if second in parts else -1
            if made_first < 0 and made_second < 0:
                return True
            if made_first > made_second:
                before, first = made_first, parts[first][1]       # equal ranks: the left wins
            else:
                before, second = made_second + 1, parts[second][0]


class PrefixEncoding:
    """A pre-token and the last token of each of its prefixes; it can be appended to and edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _last_at(self, end: int) -> int:
        """The last token of the first ``end`` bytes, from those of shorter prefixes."""
        data, last, v = self.data, self.last, self.vocabulary
        usable = v.usable
        for start in range(max(0, end - v.longest), end):
            token = usable.get(data[start:end])
            if token is not None and (start == 0 or v.apart(last[start - 1], token)):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        """Earlier prefixes stay as they are."""
        self.data += more
        for end in range(len(self.last) + 1, len(self.data) + 1):
            self.last.append(self._last_at(end))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes ``start`` to ``stop``; returns the prefixes computed.

        Once as many prefixes in a row as the longest token has bytes agree with the old ones,
        each by a token that lies behind the edit, all later ones do too.
        """
        old, v = self.last, self.vocabulary
        shift = len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start]
        edited, agreeing = start + len(new), 0
        for end in range(start + 1, len(self.data) + 1):
            token = self._last_at(end)
            self.last.append(token)
            same = (end > edited and old[end - shift - 1] == token
                    and end - len(v.tokens[token]) >= edited)
            agreeing = agreeing + 1 if same else 0
            if agreeing >= v.longest:
                self.last += old[end - shift:]
                return end - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class Encoder:
    """Whole texts to ids: pre-tokens by the pattern, each encoded for itself.

    What was found out about pairs of tokens and about short pre-tokens is remembered in
    tables of bounded size.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.find = regex.compile(pattern).findall
        self.pieces: dict[str, tuple[int, ...]] = {}

    def pieces_of(self, text: str) -> Sequence[str]:
        """The pre-tokens of a text."""
        return quick_split(text) or self.find(text)

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        found = self.pieces.get(piece)
        if found is None:
            found = self._encode(piece.encode("utf-8", "surrogatepass"))
            if len(self.pieces) > MEMO_ENTRIES:
                self.pieces.clear()
            if len(piece) <= MEMO_BYTES:
                self.pieces[piece] = found
        return found

    def _encode(self, data: bytes) -> tuple[int, ...]:
        v = self.vocabulary
        whole = v.ranks.get(data)
        if whole is not None:
            return (whole,)
        last = [-1] * len(data)                  # of the prefix that ends at each byte
        known, apart = v._apart, v.apart
        for end, (size, token) in v.suffixes.iter(data.decode("latin-1")):
            if last[end] < 0:
                if size > end:
                    last[end] = token
                else:
                    pair = (last[end - size], token)
                    fits = known.get(pair)
                    if fits or fits is None and apart(*pair):
                        last[end] = token
        out, end, tokens = [], len(data), v.tokens
        while end:
            out.append(last[end - 1])
            end -= len(tokens[out[-1]])
        return tuple(out[::-1])


class Chunks:
    """Something worked out per stretch of text between spaces, and remembered.

    Where a space is followed by something else than white space, a pre-token ends before it,
    so a text may be cut there and its parts treated one by one. Other texts are given to
    ``make`` whole.
    """

    def __init__(self, make: Callable[[str], Any]):
        self.make = make
        self.spaced: dict[str, Any] = {}

    def __call__(self, text: str) -> list[Any]:
        if LOOSE_SPACE.search(text):
            return [self.make(text)]
        first, *words = text.split(" ")
        known, make = self.spaced, self.make
        out = [make(first)]
        try:
            out += map(known.__getitem__, words)
        except KeyError:
            if len(known) > MEMO_ENTRIES:
                known.clear()
            del out[1:]
            for word in words:
                found = known.get(word)
                if found is None:
                    found = make(" " + word)
                    if len(word) <= MEMO_BYTES:
                        known[word] = found
                out.append(found)
        return out


def kept_encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a vocabulary file, built once per Python worker."""
    return kept_in_process(("bpe", path, pattern),
                           lambda: Encoder(Vocabulary.load(path), pattern))


def id_bytes(encoder: Encoder, text: str) -> bytes:
    """The ids of a pre-token sequence as little-endian unsigned 32-bit integers."""
    ids: list[int] = []
    for piece in encoder.pieces_of(text):
        ids += encoder.piece_ids(piece)
    return little_endian(ids)


def little_endian(values: Iterable[int]) -> bytes:
    """The values as unsigned 32-bit integers; ``array`` is quick for the few of a word."""
    packed = array("I", values)
    return packed.tobytes() if sys.byteorder == "little" else np.array(packed, "<u4").tobytes()


def decode(vocabulary: Vocabulary, ids: Iterable[int]) -> bytes:
    return b"".join(map(vocabulary.tokens.__getitem__, ids))


def encode_texts(path: str, pattern: str, texts: list[str]) -> list[bytes]:
    encoder = kept_encoder(path, pattern)
    chunks = kept_in_process(("bpe ids", path, pattern),
                             lambda: Chunks(lambda part: id_bytes(encoder, part)))
    return [b"".join(chunks(text)) for text in texts]


def token_ids(path: str, pattern: str, text: Column) -> Column:
    """The ids of each whole text (array of int) without special tokens; a NULL text is empty,
    an empty text has no ids. ``path`` must be readable in every Python worker."""
    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for block in text_blocks(column):
            out += [np.frombuffer(x, "<u4").astype("int32")
                    for x in encode_texts(path, pattern, block.to_pylist())]
        return pa.array(out, pa.list_(pa.int32()))

    return run(text)


def decoded(path: str, pattern: str, ids: Column) -> Column:
    """The bytes of each array of ids; NULL for NULL."""
    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        vocabulary = kept_encoder(path, pattern).vocabulary
        return pa.array([None if x is None else decode(vocabulary, x)
                         for x in column.to_pylist()], pa.binary())

    return run(ids)


def round_trip(path: str, pattern: str, text: Column) -> Column:
    """``n_tokens, ids_sha256, decoded_sha256`` of each text: its ids, and what they decode to.

    Same cases as :func:`token_ids`; the ids themselves do not leave the worker.
    """
    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def run(column: pa.Array) -> pa.Array:
        counts, shas, back = [], [], []
        vocabulary = kept_encoder(path, pattern).vocabulary
        for block in text_blocks(column):
            for ids in encode_texts(path, pattern, block.to_pylist()):
                counts.append(len(ids) // 4)
                shas.append(hashlib.sha256(ids).hexdigest())
                data = decode(vocabulary, np.frombuffer(ids, "<u4").tolist())
                back.append(hashlib.sha256(data).hexdigest())
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(shas, pa.string()),
             pa.array(back, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)
