"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams (2 to 4 bytes, ASCII letters
lower-cased); a linear softmax over that mean gives the language. Embeddings and softmax are
trained together by stochastic gradient descent on random stretches of the sample texts. A
temperature, and the confidence below which a prediction is rejected, are fitted on texts
kept out of the descent.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versespan.llm.common import as_bytes, bounded_sample, text_blocks

UNDETERMINED = "und"
BITS = 14
WIDTH = 16
SIZES = (2, 3, 4)
SAMPLE_TEXTS = 2000
SAMPLE_TEXT_BYTES = 1 << 16
STEPS = 500
BATCH = 48
CHUNK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class LanguageModel(NamedTuple):
    """``table`` gives each n-gram's share in the logits: embeddings times softmax weights."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def subwords(data: np.ndarray) -> np.ndarray:
    """Hashed n-grams: one row per size of ``SIZES``, one column per byte. Bytes after the end
    count as zero, so an n-gram that begins in a text's last bytes is a mark of its end."""
    low = _LOWER[data].astype(np.uint32)
    padded = np.concatenate([low, np.zeros(max(SIZES), np.uint32)])
    value, out, n = np.zeros(len(data), np.uint32), [], len(data)
    for size in range(1, max(SIZES) + 1):
        value = (value << np.uint32(8)) | padded[size - 1:size - 1 + n]
        if size in SIZES:
            salted = value * np.uint32(2654435761) + np.uint32(size * 40503)
            out.append((salted ^ (salted >> np.uint32(15))) * np.uint32(2246822519)
                       >> np.uint32(32 - BITS))
    return np.stack(out)


def _softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def _shares(texts: list[np.ndarray]) -> np.ndarray:
    """Dense rows: how often each bucket is hit, divided by all hits."""
    rows = np.zeros((len(texts), 1 << BITS), np.float32)
    for i, data in enumerate(texts):
        hits = subwords(data).ravel()
        rows[i] = np.bincount(hits, minlength=1 << BITS) / max(len(hits), 1)
    return rows


def train(texts: list[str], languages: list[str], seed: int = 7) -> LanguageModel:
    """Fit on ``texts`` and their ``languages``; no texts give a model without languages."""
    names = tuple(sorted(set(languages)))
    if not names:
        return LanguageModel((), np.zeros((1 << BITS, 0), np.float32),
                             np.zeros(0, np.float32), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    labels = np.array([names.index(x) for x in languages])
    known = np.flatnonzero([len(d) > 0 for d in data])
    order = rng.permutation(known)
    tuned, fitted = order[:len(order) // 5], order[len(order) // 5:]
    if not len(tuned):
        tuned = fitted
    embed = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    weight = rng.normal(0, 0.3, (WIDTH, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    by_label = [fitted[labels[fitted] == k] for k in range(len(names))]
    present = [k for k in range(len(names)) if len(by_label[k])]

    def stretch(i: int) -> np.ndarray:
        length = int(np.exp(rng.uniform(np.log(4), np.log(1500))))
        start = int(rng.integers(0, max(1, len(data[i]) - length + 1)))
        return data[i][start:start + length]

    for step in range(STEPS if present else 0):
        rate = 1.0 - step / STEPS
        picked = rng.choice(present, BATCH)           # every language alike
        rows = [rng.choice(by_label[k]) for k in picked]
        shares = _shares([stretch(i) for i in rows])
        mean = shares @ embed
        error = _softmax(mean @ weight + bias)
        error[np.arange(BATCH), labels[rows]] -= 1
        error /= BATCH
        back = error @ weight.T
        weight -= rate * 4.0 * (mean.T @ error)
        bias -= rate * 0.2 * error.sum(axis=0)
        embed -= rate * 120.0 * (shares.T @ back)
    table = embed @ weight
    # temperature and rejection on the texts kept out: whole ones and stretches of them
    tests = [data[i] for i in tuned] + [stretch(i) for i in tuned]
    truth = np.concatenate([labels[tuned], labels[tuned]]) if len(tuned) else np.zeros(0, int)
    if not len(tests):
        return LanguageModel(names, table, bias, 1.0, 0.0)
    logits = np.concatenate([_shares(tests[i:i + 64]) @ table + bias
                             for i in range(0, len(tests), 64)])

    def loss(t: float) -> float:
        return -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-9).mean()

    temperature = min((0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0), key=loss)
    sure = _softmax(logits / temperature)
    right, confidence = sure.argmax(axis=1) == truth, sure.max(axis=1)
    order = np.argsort(-confidence, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    accepted = np.flatnonzero(wrong <= 0.01)          # the most texts with 99 % right
    threshold = float(confidence[order[accepted[-1]]]) if len(accepted) else 1.0
    return LanguageModel(names, table.astype(np.float32), bias, float(temperature), threshold)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
        n: int = SAMPLE_TEXTS) -> LanguageModel:
    """A model from about ``n`` of the rows given (at most ``2 * n``), picked by a hash of the
    id; rows with a NULL text or language, and texts over 64 KiB, are not picked."""
    usable = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"),
                         F.col(lang).cast("string").alias("lang")).filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull()
        & (F.octet_length("text") <= SAMPLE_TEXT_BYTES))
    rows = bounded_sample(usable, "id", n).collect()
    rows.sort(key=lambda r: (str(r["id"]), r["text"], r["lang"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def spaced(data: np.ndarray, starts: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts with ``gap`` zero bytes after each, and where each now starts."""
    lengths = np.diff(starts)
    moved = starts[:-1] + gap * np.arange(len(lengths))
    out = np.zeros(len(data) + gap * len(lengths), np.uint8)
    out[np.arange(len(data)) + np.repeat(gap * np.arange(len(lengths)), lengths)] = data
    return out, moved


def logits(model: LanguageModel, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean n-gram logits of each text; a long text is summed over chunks of its bytes."""
    lengths, reach = np.diff(starts), max(SIZES) - 1
    sums = np.zeros((len(lengths), len(model.languages)))
    padded, begins = spaced(data, starts, reach)
    for first in range(0, len(padded), CHUNK):
        last = min(first + CHUNK, len(padded))
        hits = subwords(padded[first:last + reach])[:, :last - first]
        begin = np.clip(begins, first, last) - first
        end = np.clip(begins + lengths, first, last) - first
        rows = np.flatnonzero(end > begin)
        if not len(rows):
            continue
        edges = np.stack([begin[rows], end[rows]], axis=1).ravel()
        edges = edges[:-1] if edges[-1] == last - first else edges
        for own in hits:
            sums[rows] += np.add.reduceat(model.table[own], edges, axis=0)[::2]
    return sums / np.maximum(lengths * len(SIZES), 1)[:, None] + model.bias


def identify(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and confidence per text; ``und`` and 0 for NULL texts and those without a letter."""
    column = pa.array(texts, pa.string())
    names, scores = [], []
    for block in text_blocks(column):
        got = _identify_block(model, block)
        names += got[0]
        scores.append(got[1])
    return names, np.concatenate(scores) if scores else np.zeros(0)


def _identify_block(model: LanguageModel, block: pa.Array) -> tuple[list[str], np.ndarray]:
    data, starts = as_bytes(block)
    seen = np.concatenate([[0], np.cumsum(_LETTER[data])])
    letters = seen[starts[1:]] > seen[starts[:-1]]
    high = np.concatenate([[0], np.cumsum(data >= 128)])
    for i in np.flatnonzero(~letters & (high[starts[1:]] > high[starts[:-1]])):
        letters[i] = has_letter(data[starts[i]:starts[i + 1]].tobytes())
    if not model.languages:
        return [UNDETERMINED] * len(block), np.zeros(len(block))
    sure = _softmax(logits(model, data, starts) / model.temperature)
    best = sure.argmax(axis=1)
    names = [model.languages[k] if ok else UNDETERMINED
             for k, ok in zip(best, letters, strict=True)]
    return names, np.where(letters, sure[np.arange(len(best)), best], 0.0)


def language(model: LanguageModel, text: Column) -> Column:
    """A struct ``lang_pred, score, rejected`` per text, over the whole text.

    ``und`` with score 0 stands for NULL and empty texts and texts without any letter, and for
    all texts if there was nothing to learn from. ``rejected`` marks these, and predictions
    less sure than the model's threshold. Equal texts get equal results.
    """
    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def run(column: pa.Array) -> pa.Array:
        names, scores = [], []
        for block in text_blocks(column):
            got = _identify_block(model, block)
            names += got[0]
            scores.append(got[1])
        score = np.concatenate(scores) if scores else np.zeros(0)
        rejected = (score < model.threshold) | np.array(
            [n == UNDETERMINED for n in names], bool)
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(score, pa.float64()),
             pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])

    return run(text)
