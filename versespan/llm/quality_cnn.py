"""Quality classifier: a byte-level convolutional network in NumPy.

The bytes of a text are cut into segments; a chunk is two neighbouring segments, so chunks
overlap by half and cover the whole text. Filters over ``WIDTH`` bytes are max-pooled inside
each chunk, a hidden layer sees each chunk's maxima (a chunk that repeats one word reaches few
of them), and the hidden units' maximum and mean over all chunks give one logit. Filters are
tables from byte to weight, one per place in the filter, so no byte embedding is multiplied
out. Everything is trained by Adam on labelled texts; the probability is calibrated on texts
kept out of that.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versespan.llm.common import as_bytes, bounded_sample, text_blocks

SEGMENT = 128            # bytes; a chunk is two segments
WIDTH = 6                # bytes that a filter sees
STRIDE = 2
FILTERS = 24
HIDDEN = 16
SAMPLE_TEXTS = 1500      # of each label
SAMPLE_TEXT_BYTES = 1 << 14
STEPS = 1200
BATCH = 16
SHORT_SHARE = 0.25       # of the label 1 examples are short stretches of their texts
SEGMENTS_AT_ONCE = 4096
FILLER = 0.5             # score without any training text


class QualityModel(NamedTuple):
    filters: np.ndarray      # WIDTH x 256 x FILTERS
    filter_bias: np.ndarray
    hidden: np.ndarray       # FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray          # 2 * HIDDEN
    out_bias: float
    scale: float             # calibration of the logit
    shift: float


def untrained() -> QualityModel:
    return QualityModel(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32),
                        np.zeros((FILTERS, HIDDEN), np.float32), np.zeros(HIDDEN, np.float32),
                        np.zeros(2 * HIDDEN, np.float32), 0.0, 1.0, 0.0)


def segments(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments of each text as rows of ``SEGMENT + WIDTH`` bytes (the last bytes are the next
    segment's first, or zeros), and how many each text has (one at least)."""
    lengths = np.diff(starts)
    count = np.maximum(-(-lengths // SEGMENT), 1)
    first = np.concatenate([[0], np.cumsum(count)])
    flat = np.zeros((first[-1] + 1) * SEGMENT, np.uint8)
    flat[np.arange(len(data)) + np.repeat(first[:-1] * SEGMENT - starts[:-1], lengths)] = data
    rows = np.empty((first[-1], SEGMENT + WIDTH), np.uint8)
    body = flat.reshape(-1, SEGMENT)
    rows[:, :SEGMENT] = body[:-1]
    rows[:, SEGMENT:] = body[1:, :WIDTH]
    rows[first[1:] - 1, SEGMENT:] = 0
    return rows, count


def convolve(model: QualityModel, rows: np.ndarray) -> np.ndarray:
    """Filter outputs per segment and position, before pooling."""
    out = None
    for j in range(WIDTH):
        part = model.filters[j].take(rows[:, j:j + SEGMENT:STRIDE], axis=0)
        out = part if out is None else np.add(out, part, out=out)
    return out


def pool_chunks(pooled: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk maxima from segment maxima; per chunk its two segments; where texts' chunks start.

    A text of ``n`` segments has ``n - 1`` chunks, one if it has a single segment.
    """
    first = np.concatenate([[0], np.cumsum(count)])
    left = np.arange(first[-1])
    last = np.zeros(first[-1], bool)
    last[first[1:] - 1] = True
    alone = np.zeros(first[-1], bool)
    alone[first[:-1][count == 1]] = True
    left = left[~last | alone]
    right = np.where(alone[left], left, np.minimum(left + 1, first[-1] - 1))
    chunk_start = np.concatenate([[0], np.cumsum(np.maximum(count - 1, 1))])
    return np.maximum(pooled[left], pooled[right]), np.stack([left, right]), chunk_start


def _head(model: QualityModel, chunks: np.ndarray, chunk_start: np.ndarray) -> tuple:
    act = np.maximum(chunks + model.filter_bias, 0)
    hidden = np.maximum(act @ model.hidden + model.hidden_bias, 0)
    top = np.maximum.reduceat(hidden, chunk_start[:-1], axis=0)
    mean = np.add.reduceat(hidden, chunk_start[:-1], axis=0) / np.diff(chunk_start)[:, None]
    logit = np.concatenate([top, mean], axis=1) @ model.out + model.out_bias
    return act, hidden, top, mean, logit


def pooled_segments(model: QualityModel, rows: np.ndarray) -> np.ndarray:
    return np.concatenate([convolve(model, rows[i:i + SEGMENTS_AT_ONCE]).max(axis=1)
                           for i in range(0, len(rows), SEGMENTS_AT_ONCE)])


def raw_logits(model: QualityModel, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    rows, count = segments(data, starts)
    chunks, _, chunk_start = pool_chunks(pooled_segments(model, rows), count)
    return _head(model, chunks, chunk_start)[-1]


def probabilities(model: QualityModel, block: pa.Array) -> np.ndarray:
    if not len(block):
        return np.zeros(0)
    data, starts = as_bytes(block)
    logit = raw_logits(model, data, starts) * model.scale + model.shift
    return 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))


def _gradients(model: QualityModel, data: np.ndarray, starts: np.ndarray, labels: np.ndarray,
               weights: np.ndarray) -> list[np.ndarray]:
    rows, count = segments(data, starts)
    conv = convolve(model, rows)
    place = conv.argmax(axis=1)
    pooled = np.take_along_axis(conv, place[:, None], axis=1)[:, 0]
    chunks, pair, start = pool_chunks(pooled, count)
    act, hidden, top, mean, logit = _head(model, chunks, start)
    error = weights * (1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30))) - labels) / len(labels)
    text_of = np.repeat(np.arange(len(labels)), np.diff(start))
    both = np.concatenate([top, mean], axis=1)
    g_out, g_out_bias = both.T @ error, error.sum()
    is_top = hidden >= top[text_of]
    ties = np.add.reduceat(is_top, start[:-1], axis=0)
    g_hidden = is_top / ties[text_of] * (error[:, None] * model.out[:HIDDEN])[text_of]
    g_hidden += ((error / np.diff(start))[:, None] * model.out[HIDDEN:])[text_of]
    g_hidden *= hidden > 0
    g_act = (g_hidden @ model.hidden.T) * (act > 0)
    from_right = pooled[pair[1]] > pooled[pair[0]]
    g_pooled = np.zeros_like(pooled)
    np.add.at(g_pooled, pair[0], np.where(from_right, 0, g_act))
    np.add.at(g_pooled, pair[1], np.where(from_right, g_act, 0))
    g_filters = np.zeros_like(model.filters)
    unit = np.broadcast_to(np.arange(FILTERS), place.shape)
    for j in range(WIDTH):
        byte = np.take_along_axis(rows, place * STRIDE + j, axis=1)
        g_filters[j] = np.bincount((byte.astype(np.int64) * FILTERS + unit).ravel(),
                                   g_pooled.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return [g_filters, g_act.sum(axis=0), act.T @ g_hidden, g_hidden.sum(axis=0), g_out,
            np.asarray(g_out_bias)]


def _block(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), starts


def train(texts: list[str], labels: list[int], seed: int = 11) -> QualityModel:
    """Fit on texts and their labels (0 or 1). With one label or none missing, the scores of
    the untrained network are constant: the label's own share, or one half without texts."""
    model = untrained()
    truth = np.array(labels, dtype=float)
    if len(set(labels)) < 2:
        return model._replace(shift=0.0 if not labels else (8.0 if labels[0] else -8.0))
    rng = np.random.default_rng(seed)
    data = [t.encode() for t in texts]
    order = rng.permutation(len(data))
    tuned, fitted = order[:len(order) // 5], order[len(order) // 5:]
    by_label = [fitted[truth[fitted] == k] for k in (0, 1)]
    if any(not len(x) for x in by_label) or len(set(truth[tuned])) < 2:
        tuned = fitted = order
        by_label = [fitted[truth[fitted] == k] for k in (0, 1)]

    def example(i: int) -> bytes:
        """The text, or for label 1 now and then a short stretch of it, as short texts are rare."""
        whole = data[i]
        if truth[i] == 0 or rng.random() > SHORT_SHARE:
            return whole
        start = whole.find(b" ", int(rng.integers(0, len(whole) + 1))) + 1
        return whole[start:start + int(np.exp(rng.uniform(np.log(8), np.log(300))))]

    params = [rng.normal(0, 0.15, (WIDTH, 256, FILTERS)), np.zeros(FILTERS),
              rng.normal(0, 0.3, (FILTERS, HIDDEN)), np.zeros(HIDDEN),
              rng.normal(0, 0.3, 2 * HIDDEN), np.asarray(0.0)]
    params = [p.astype(np.float32) for p in params]
    moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        half = BATCH // 2
        picked = np.concatenate([rng.choice(by_label[0], half), rng.choice(by_label[1], half)])
        model = QualityModel(*params[:5], float(params[5]), 1.0, 0.0)
        grads = _gradients(model, *_block([example(i) for i in picked]), truth[picked],
                           np.ones(BATCH))
        rate = 0.01 * min(1.0, 2.0 * (1 - step / (STEPS + 1)))
        for i, g in enumerate(grads):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            square[i] = 0.995 * square[i] + 0.005 * g * g
            params[i] = (params[i] - rate * (moment[i] / (1 - 0.9 ** step)) / (
                np.sqrt(square[i] / (1 - 0.995 ** step)) + 1e-6)).astype(np.float32)
    model = QualityModel(*params[:5], float(params[5]), 1.0, 0.0)
    logit = raw_logits(model, *_block([data[i] for i in tuned]))
    scale, shift = _calibrated(logit, truth[tuned])
    return model._replace(scale=scale, shift=shift)


def _calibrated(logit: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logit that minimise the log loss (with a little shrinking)."""
    scale, shift = 1.0, 0.0
    spread = max(float(np.std(logit)), 1e-3)
    x = logit / spread
    a, b = scale * spread, shift
    soft = truth * 0.98 + 0.01
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        a -= 0.5 * float(((p - soft) * x).mean())
        b -= 0.5 * float((p - soft).mean())
    return max(a, 0.05) / spread, b


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
        label: str = "quality", n: int = SAMPLE_TEXTS) -> QualityModel:
    """A model from about ``n`` texts of each label (at most ``2 * n``), picked by a hash of the
    id. Texts over 16 KiB, NULL texts and labels other than 0 and 1 are not picked; an id
    labelled more than once counts with each label it has."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")) \
        .filter(F.col("label").isin(0, 1)).distinct()
    picked = [bounded_sample(known.filter(F.col("label") == k), "id", n) for k in (0, 1)]
    usable = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter(
        F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_TEXT_BYTES))
    ids = F.broadcast(picked[0].unionByName(picked[1]))         # at most 4 * n rows
    rows = usable.join(ids, "id").limit(4 * n).collect()
    rows.sort(key=lambda r: (str(r["id"]), r["text"], r["label"]))
    return train([r["text"] for r in rows], [r["label"] for r in rows])


def quality(model: QualityModel, text: Column) -> Column:
    """Probability of label 1 for each whole text, 0 to 1.

    A NULL text is scored as an empty one, an empty one as a segment of zero bytes. Equal
    texts get equal scores.
    """
    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        parts = [probabilities(model, block) for block in text_blocks(column)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return run(text)


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text",
              threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns as they are."""
    return docs.filter(quality(model, F.col(text)) >= threshold)
