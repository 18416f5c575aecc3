import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from versespan.llm import bpe, counts, packing

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b\n\n  c \n", "\t\tx\x1cy z", "don't 'll 's",
       "<|endoftext|> <|startoftext|>", "é日本語😀 1234567", "x" * 5000, " " * 3000, "ab" * 3000,
       "A b  c\x85 d", "é ́ ΑΣ İI", "a\x00b. word, word. (word) Word.", "1/2 #!x"]


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    return ODD + [r["text"] for r in rows]


def test_ids_equal_the_library(tik, texts):
    for text, ids in zip(texts, bpe.encode_texts(RANKS, P.PATTERN, texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(text), text[:50]


def test_random_bytes_of_one_pretoken(tik):
    v = bpe.kept_encoder(RANKS, P.PATTERN).vocabulary
    rng = random.Random(3)
    for _ in range(400):
        piece = "".join(rng.choice("abeinrst") for _ in range(rng.randint(1, 60)))
        assert bpe.PrefixEncoding(v, piece.encode()).ids() == tik.encode_ordinary(piece)


def test_appends_and_edits_equal_a_fresh_encoding():
    v = bpe.kept_encoder(RANKS, P.PATTERN).vocabulary
    rng = random.Random(4)
    one = bpe.PrefixEncoding(v)
    for _ in range(120):
        new = "".join(rng.choice("aeinrst ") for _ in range(rng.randint(0, 30))).encode()
        if rng.random() < 0.4:
            one.append(new)
        else:
            start = rng.randint(0, len(one.data))
            stop = rng.randint(start, min(len(one.data), start + 20))
            one.replace(start, stop, new)
        assert one.last == bpe.PrefixEncoding(v, one.data).last
    long = bpe.PrefixEncoding(v, b"an example of text " * 200)
    assert long.replace(5, 9, b"xy") < 1000 < len(long.data)


def test_round_trip_column(spark, tik):
    rows = [(i, t) for i, t in enumerate([*ODD, None])]
    df = spark.createDataFrame(rows, "found int, text string")
    got = {r["found"]: r["r"] for r in df.select("found", bpe.round_trip(
        RANKS, P.PATTERN, F.col("text")).alias("r")).collect()}
    for i, text in rows:
        ids = tik.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    ids = df.filter("found = 12").select(bpe.token_ids(RANKS, P.PATTERN, F.col("text")).alias("i"))
    back = ids.select(bpe.decoded(RANKS, P.PATTERN, F.col("i"))).first()[0]
    assert bytes(back).decode() == ODD[12]


def test_edited_trees_equal_a_fresh_count(tik, texts):
    rng = random.Random(5)
    tools = counts._tools(RANKS, P.PATTERN)
    bits = ["", " ", "\n", "'", "s", " the", "word ", "  ", "9", "é!", " \n\n x", "'ll"]
    for text in rng.sample(texts, 60) + ODD:
        tree, now = counts.tree_of(text, *tools), text
        assert tree.n_tokens == len(tik.encode_ordinary(text))
        for _ in range(8):
            start, delete = rng.randint(0, len(now)), rng.choice([0, 0, 1, 2, 7, 300])
            insert = rng.choice(bits) + rng.choice(bits)
            tree.edit(start, delete, insert)
            now = now[:start] + insert + now[start + delete:]
            assert tree.text() == now and tree.n_chars == len(now)
            assert tree.n_tokens == len(tik.encode_ordinary(now)), (text[:40], start, insert)
            leaf = rng.randrange(len(tree.leaves))
            before = [p for i in range(leaf) for p in tree.pieces_in(i)]
            assert tree.tokens_before(leaf) == sum(len(tik.encode_ordinary(p)) for p in before)


def test_an_edit_encodes_little_of_a_long_text(texts):
    text = max(texts[len(ODD):], key=len)
    tree = counts.tree_of(text, *counts._tools(RANKS, P.PATTERN))
    tree.edit(len(text) // 2, 3, "new")
    assert tree.encoded < 40 < len(tree.leaves)


def test_edited_counts_column(spark, tik):
    kind = "i int, text string, found int, edits array<struct<start:int,delete:int,insert:string>>"
    rows = [(0, "some words here", 1, [(0, 4, "Many"), (99, 3, " more"), (-5, 0, "x")]),
            (1, None, 1, [(0, 0, "a b")]), (2, "", 1, None), (3, "abc", 1, [None, (None,) * 3])]
    df = spark.createDataFrame(rows, kind)
    got = [r[0] for r in df.orderBy("i").select(counts.edited_counts(
        RANKS, P.PATTERN, F.col("text"), F.col("edits"))).collect()]
    after = ["xMany words here more", "a b", "", "abc"]
    assert [r["n_tokens_after"] for r in got] == [len(tik.encode_ordinary(t)) for t in after]
    assert [r["n_chars_after"] for r in got] == [len(t) for t in after]
    assert df.limit(0).select(counts.edited_counts(
        RANKS, P.PATTERN, F.col("text"), F.col("edits"))).count() == 0


def test_word_ids_equal_the_library(texts):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    found = packing.WordIds(WORDS)(texts)
    for text, ids in zip(texts, found, strict=True):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:50]


def rebuilt(rows):
    docs, windows = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, total, window, offset in rows:
        docs[doc].append((start, length, crc, total))
        windows[window].append((offset, length))
    for pieces in windows.values():
        place = 0
        for offset, length in sorted(pieces):
            assert offset == place and length > 0
            place += length
        assert place <= packing.WINDOW
    return docs, {w: sum(n for _, n in p) for w, p in windows.items()}


@pytest.mark.parametrize("max_open", [8192, 5])
def test_packing_keeps_every_id_once_with_little_padding(max_open):
    rng = random.Random(6)
    rows, ids = [], {}
    packer = packing.Packer(rows.append, max_open=max_open)
    for doc in range(600):
        size = rng.choice([1, 2, 2047, 2048, 2049, 7000, rng.randint(1, 3000)])
        ids[doc] = np.array([rng.randrange(50_000) for _ in range(size)], "<u4")
        packer.add(doc, ids[doc].tobytes())
    packer.finish()
    docs, fill = rebuilt(rows)
    for doc, own in ids.items():
        place = 0
        for start, length, crc, total in sorted(docs[doc]):
            assert start == place and total == len(own)
            assert crc == zlib.crc32(own[start:start + length].tobytes())
            place += length
        assert place == len(own)
    assert sum(n < packing.WINDOW for n in fill.values()) <= 1


def test_level_chosen_has_the_least_sum_of_squares():
    rng = random.Random(7)
    packer = packing.Packer(lambda row: None, window=24)
    for doc in range(3000):
        size = rng.choice([3, 5, 5, 8, 11, 24, 17])
        before = packer.counts.copy()
        packer.add(doc, bytes(4 * size))
        after = int((packer.counts ** 2).sum())
        if size == 24:
            continue
        options = []
        for level in [0, *np.flatnonzero(before)]:
            if level + size <= 24:
                trial = before.copy()
                trial[level] -= level > 0
                trial[level + size] += level + size < 24
                options.append(int((trial ** 2).sum()))
        assert after == min(options)


def test_pack_handles_odd_rows(spark):
    kind = "doc_id long, text string, start string, offset int"
    rows = [(None, "a b", "x", 1), (1, None, "x", 1), (2, "", "x", 1), (3, "w " * 9000, "x", 1),
            (4, "same", "x", 1), (4, "same", "x", 1)]
    got = packing.pack(spark.createDataFrame(rows, kind).coalesce(1), WORDS).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == {None: 3, 1: 1, 2: 1, 3: 9001, 4: 2}
    assert sum(r["length"] for r in got) == 3 + 1 + 1 + 9001 + 2 + 2
    assert packing.pack(spark.createDataFrame([], kind), WORDS).count() == 0


def test_new_stretches_go_to_the_tokenizer_in_bounded_texts():
    words = packing.WordIds(WORDS)
    plain, sizes = words._encoded, []

    def watched(texts):
        sizes.extend(map(len, texts))
        return plain(texts)

    words._encoded = watched
    text = " ".join(f"w{i}x{i * 7919 % 10007}" for i in range(30_000)) + " end^mark tail."
    found = words([text, "again w1x7919"])
    assert max(sizes) < 100_000 < len(text)
    assert found[0] == plain([text])[0].tobytes()
    assert found[1] == plain(["again w1x7919"])[0].tobytes()


def test_plain_words_need_no_normalizer_and_no_mark():
    """Small and capital Latin-1 letters; other letters, marks and digits still go that way."""
    words = packing.WordIds(WORDS)
    plain, sent = words._encoded, []

    def watched(texts):
        sent.extend(texts)
        return plain(texts)

    rng = random.Random(5)
    letters = [chr(c) for c in range(256) if chr(c).isalpha() and chr(c) not in "ªºµ"]
    some = ["".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(3000)]
    latin = " ".join(some) + ".\tÉTÉ,\r\x0bÀ\x0cÿß\nend"
    odd = ["º µm ª x\x85Y É\xa0È", "É́té ΑΣ İI ﬁx Œuvre ſo K", "x1y É2 ×÷ À×"]
    words._encoded = watched
    found = words([latin])
    assert sum(map(len, sent)) < 100 < len(latin)
    library = Tokenizer.from_file(WORDS)
    for text, ids in zip([latin, *odd], found + words(odd), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:50]
