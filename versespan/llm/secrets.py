"""Secret scans: fixed patterns, and a character CNN in NumPy over every other candidate.

A candidate is a run of 16 or more of ``[A-Za-z0-9+/_=-]`` that no pattern has found, or what
is left of a run, 16 or more characters, beside what patterns have found in it. The network sees its characters and those around it (a long one in overlapping pieces, of which
the highest score counts). It is trained on findings: what the patterns mark in the
documents is labelled a secret, other runs are labelled none. It starts from a bounded number of
either; where there are more, all of them are trained on, dealt to tasks whose networks are
averaged after each round, and calibration and threshold come from all that are kept out. Half of
the secrets are shown without their surroundings, so that the network learns what they look like
and not only what stands before them. Scores are calibrated on findings kept out of training. The threshold must
find the stated share of those; of the thresholds that do so and let the fewest others through
it is the middle one, but not below 0.5 where 0.5 finds the share, too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versespan.llm.common import text_blocks
from versespan.session import materialize

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
                    r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
MIN_CANDIDATE = 16
CANDIDATE = re.compile("[A-Za-z0-9+/_=-]{%d,}" % MIN_CANDIDATE)
OTHER_RUN = re.compile("[A-Za-z0-9+/_=-]{8,}")        # labelled none, if no pattern has it
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
AROUND, INSIDE, STEP = 24, 48, 40
ROW = AROUND + INSIDE + AROUND
WIDTH, FILTERS, HIDDEN = 5, 16, 12
SAMPLE_FINDINGS = 2_000      # of each label, which the network starts from
SHARD_ROWS, SHARD_LEAST = 16_384, 256    # findings a task trains on; of each label at least
ROUNDS, RATE = 2, 0.001
FIXED = 1 << 32              # weights are added up as integers, in any order
BINS = 1024                  # a unit of the network's output is counted in so many steps
STEPS, BATCH = 500, 64
SEED = 5
RECALL = 0.95
REPLACEMENT = "[SECRET]"
SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


class SecretModel(NamedTuple):
    filters: np.ndarray      # WIDTH x 512 x FILTERS; characters inside are moved up by 256
    bias: np.ndarray
    hidden: np.ndarray       # 2 * FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float
    shift: float
    threshold: float


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """``(kind, start, end, start of the value)`` of what the patterns find, per kind from left
    to right without overlaps; by start, then in the order of the kinds."""
    found = []
    low = text.lower()
    if any(hint in low for hint in HINTS):
        found += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _others(text: str, pattern: re.Pattern, spans: list[tuple]) -> Iterator[tuple[int, int]]:
    """Runs of the pattern that touch no span."""
    for m in pattern.finditer(text):
        if not any(s[1] < m.end() and m.start() < s[2] for s in spans):
            yield m.span()


def _candidates(text: str, spans: list[tuple]) -> Iterator[tuple[int, int]]:
    """Runs, and the parts of runs between spans (which are in order of their start)."""
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        for s in spans:
            if s[1] < end and start < s[2]:
                if s[1] - start >= MIN_CANDIDATE:
                    yield start, s[1]
                start = s[2]
        if end - start >= MIN_CANDIDATE:
            yield start, end


def windows(text: str, start: int, end: int) -> np.ndarray:
    """The network's input: rows of ``ROW`` codes, one per piece of the candidate. Characters
    beyond Latin-1 are code 1, places without a character 0."""
    def codes(a: int, b: int) -> np.ndarray:
        part = text[max(a, 0):b].encode("utf-32-le", "surrogatepass")
        values = np.frombuffer(part, "<u4")
        return np.where(values < 256, values, 1).astype(np.int16)

    rows, at = [], start
    while True:
        stop = min(at + INSIDE, end)
        row = np.zeros(ROW, np.int16)
        before, body, after = codes(at - AROUND, at), codes(at, stop), codes(stop, stop + AROUND)
        row[AROUND - len(before):AROUND] = before
        row[AROUND:AROUND + len(body)] = body + 256
        row[AROUND + len(body):AROUND + len(body) + len(after)] = after
        rows.append(row)
        if stop == end:
            return np.stack(rows)
        at += STEP


def _forward(model: SecretModel, rows: np.ndarray) -> tuple:
    n = ROW - WIDTH + 1
    conv = sum(model.filters[j].take(rows[:, j:j + n], axis=0) for j in range(WIDTH))
    act = np.maximum(conv + model.bias, 0)
    place = act.argmax(axis=1)
    top = np.take_along_axis(act, place[:, None], axis=1)[:, 0]
    both = np.concatenate([top, act.mean(axis=1)], axis=1)
    hidden = np.maximum(both @ model.hidden + model.hidden_bias, 0)
    return act, place, both, hidden, hidden @ model.out + model.out_bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def scores(model: SecretModel, rows: np.ndarray) -> np.ndarray:
    parts = [_forward(model, rows[i:i + 1024])[-1] for i in range(0, len(rows), 1024)]
    return _sigmoid(np.concatenate(parts) * model.scale + model.shift)


def _gradients(model: SecretModel, rows: np.ndarray, truth: np.ndarray) -> list[np.ndarray]:
    n = ROW - WIDTH + 1
    act, place, both, hidden, logit = _forward(model, rows)
    error = (_sigmoid(logit) - truth) / len(rows)
    g_hidden = error[:, None] * model.out * (hidden > 0)
    g_both = g_hidden @ model.hidden.T
    g_act = np.broadcast_to(g_both[:, None, FILTERS:] / n, act.shape).copy()
    at = (np.arange(len(rows))[:, None], place, np.arange(FILTERS)[None])
    g_act[at] += g_both[:, :FILTERS]
    g_act *= act > 0
    g_filters = np.zeros_like(model.filters)
    for j in range(WIDTH):
        np.add.at(g_filters[j], rows[:, j:j + n], g_act)
    return [g_filters, g_act.sum(axis=(0, 1)), both.T @ g_hidden, g_hidden.sum(axis=0),
            hidden.T @ error, np.asarray(error.sum())]


def no_model() -> SecretModel:
    """Marks nothing: used where there are no findings to learn from."""
    return SecretModel(np.zeros((WIDTH, 512, FILTERS), np.float32), np.zeros(FILTERS, np.float32),
                       np.zeros((2 * FILTERS, HIDDEN), np.float32), np.zeros(HIDDEN, np.float32),
                       np.zeros(HIDDEN, np.float32), 0.0, 1.0, 0.0, 2.0)


def _bare(batch: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Half of the rows without their surroundings."""
    blank = rng.random(len(batch)) < 0.5
    return np.where(blank[:, None] & (batch < 256), 0, batch)


def _descend(params: list, moment: list, square: list, grads: list, step: int,
             rate: float) -> None:
    for i, g in enumerate(grads):
        moment[i] = 0.9 * moment[i] + 0.1 * g
        square[i] = 0.995 * square[i] + 0.005 * g * g
        params[i] = (params[i] - rate * (moment[i] / (1 - 0.9 ** step)) / (
            np.sqrt(square[i] / (1 - 0.995 ** step)) + 1e-6)).astype(np.float32)


def _kept_out(n: int, seed: int) -> np.ndarray:
    """Which of ``n`` rows :func:`train` does not fit on."""
    return np.random.default_rng(seed).permutation(n)[:n // 4]


def train(rows: np.ndarray, truth: np.ndarray, seed: int = SEED) -> SecretModel | None:
    """Fit on window rows and labels (1 secret, 0 none); None without both labels."""
    if len(set(truth.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    tuned, fitted = order[:len(order) // 4], order[len(order) // 4:]    # tuned: _kept_out
    if len(set(truth[tuned].tolist())) < 2 or len(set(truth[fitted].tolist())) < 2:
        tuned = fitted = order
    params = [rng.normal(0, 0.1, (WIDTH, 512, FILTERS)), np.zeros(FILTERS),
              rng.normal(0, 0.3, (2 * FILTERS, HIDDEN)), np.zeros(HIDDEN),
              rng.normal(0, 0.3, HIDDEN), np.asarray(0.0)]
    params = [p.astype(np.float32) for p in params]
    moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    groups = [fitted[truth[fitted] == k] for k in (0, 1)]

    for step in range(1, STEPS + 1):
        picked = np.concatenate([rng.choice(g, BATCH // 2) for g in groups])
        model = SecretModel(*params[:5], float(params[5]), 1.0, 0.0, 0.5)
        grads = _gradients(model, _bare(rows[picked], rng), truth[picked])
        _descend(params, moment, square, grads, step,
                 0.008 * min(1.0, 2.0 * (1 - step / (STEPS + 1))))
    model = SecretModel(*params[:5], float(params[5]), 1.0, 0.0, 0.5)
    kept = np.concatenate([rows[tuned], np.where(rows[tuned] < 256, 0, rows[tuned])])
    answer = np.concatenate([truth[tuned]] * 2)
    logit = _forward(model, kept)[-1]
    return _with_threshold(model, logit, answer)


def _with_threshold(model: SecretModel, logit: np.ndarray, answer: np.ndarray,
                    weight: np.ndarray | None = None) -> SecretModel:
    """The model calibrated on findings kept out, each counted ``weight`` times."""
    scale, shift = _calibrated(logit, answer, weight)
    sure = _sigmoid(logit * scale + shift)
    order = np.argsort(sure, kind="stable")
    order = order[answer[order] == 1]
    seen = np.cumsum(np.ones(len(order), np.int64) if weight is None else weight[order])
    at = np.searchsorted(seen, int(seen[-1] * (1 - RECALL)), side="right")
    highest = float(sure[order[at]])                              # that keeps the recall
    below = sure[(answer == 0) & (sure < highest)]
    threshold = (highest + float(below.max(initial=0.0))) / 2
    if highest > 0.5:
        threshold = max(threshold, 0.5)                           # never above the highest
    return model._replace(scale=scale, shift=shift, threshold=threshold)


def _calibrated(logit: np.ndarray, truth: np.ndarray,
                weight: np.ndarray | None = None) -> tuple[float, float]:
    """Scale and shift that minimise the log loss on the kept findings, slightly smoothed."""
    def mean(values: np.ndarray) -> float:
        return float(values.mean() if weight is None else np.average(values, weights=weight))

    spread = max(float(np.std(logit)) if weight is None else
                 mean((logit - mean(logit)) ** 2) ** 0.5, 1e-3)
    x, soft, a, b = logit / spread, truth * 0.98 + 0.01, 1.0, 0.0
    for _ in range(400):
        p = _sigmoid(a * x + b)
        a -= 0.5 * mean((p - soft) * x)
        b -= 0.5 * mean(p - soft)
    return max(a, 0.05) / spread, b


def _findings(text: str) -> Iterator[tuple[np.ndarray, int]]:
    spans = base_spans(text)
    for _, _, end, value in spans:
        yield windows(text, value, min(end, value + INSIDE))[0], 1
    for start, end in _others(text, OTHER_RUN, spans):
        if end - start >= 16 or not text[start:end].isalpha():
            yield windows(text, start, min(end, start + INSIDE))[0], 0


def labelled_findings(docs: DataFrame, text: str = "text") -> DataFrame:
    """``codes, label, h`` for pattern findings (1) and other runs (0) of all documents; plain
    words count from 16 letters on. ``h`` is a hash of the codes; equal findings of a label are
    one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                found = {}
                for one in block.to_pylist():
                    for row, label in _findings(one):
                        data = row.tobytes()
                        h = int.from_bytes(blake2b(data, digest_size=8).digest(), signed=True)
                        found[label, h] = row
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found.values()), pa.list_(pa.int16())),
                     pa.array([label for label, _ in found], pa.int32()),
                     pa.array([h for _, h in found], pa.int64())], ["codes", "label", "h"])

    return docs.select(F.col(text).alias("text")).mapInArrow(
        run, "codes array<smallint>, label int, h bigint").dropDuplicates(["label", "h"])


def _codes(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int16).reshape(-1, ROW)


def _train_shard(start: SecretModel, round_: int):
    """The weights that a shard's findings make of ``start``, as integers; each finding is seen at
    least once, as many secrets as others."""
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("h", "ascending"), ("label", "ascending")])
        rows, truth = _codes(group.column("codes").combine_chunks()), group.column("label").to_numpy()
        shard = group.column("shard")[0].as_py()
        rng = np.random.default_rng([SEED, round_, shard])
        params = [np.asarray(p, np.float32) for p in start[:6]]
        moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        groups = [rng.permutation(np.flatnonzero(truth == k)) for k in (0, 1)]
        steps = -(-max(map(len, groups)) // (BATCH // 2)) if all(map(len, groups)) else 0
        order = [np.resize(g, (steps, BATCH // 2)) for g in groups]
        for step in range(1, steps + 1):
            picked = np.concatenate([g[step - 1] for g in order])
            model = SecretModel(*params[:5], float(params[5]), 1.0, 0.0, 0.5)
            _descend(params, moment, square,
                     _gradients(model, _bare(rows[picked], rng), truth[picked]), step, RATE)
        flat = np.concatenate([np.ravel(p) for p in params]).astype(np.float64)
        return pa.table({"shard": pa.array([shard], pa.int64()), "n": pa.array([1], pa.int64()),
                         "weights": pa.array([np.rint(flat * FIXED).astype(np.int64).tobytes()],
                                             pa.binary())})

    return run


def _add_up(group: pa.Table) -> pa.Table:
    """The sum of some shards' weights, and how many there are."""
    total = sum(np.frombuffer(w.as_py(), np.int64) for w in group.column("weights"))
    return pa.table({"n": pa.array([group.num_rows], pa.int64()),
                     "weights": pa.array([total.tobytes()], pa.binary())})


def _outputs(model: SecretModel):
    """How often the network gives which output to findings of a label, with and without their
    surroundings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _codes(batch.column(0))
                logit = np.concatenate([
                    _forward(model, part[i:i + 1024])[-1] for part in (rows, np.where(rows < 256, 0, rows))
                    for i in range(0, len(rows), 1024)])
                place = np.floor(np.clip(logit, -64, 64) * BINS).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(batch.column(1).to_numpy(), 2), pa.int32()),
                     pa.array(place)], ["label", "place"])

    return run


def _train_on_all(start: SecretModel, found: DataFrame, counts: dict[int, int]) -> SecretModel:
    """``start`` trained on all findings but those ``kept`` out, which calibrate it. A label with
    few findings sends each of them to several shards."""
    shards = -(-sum(counts.values()) // SHARD_ROWS)
    copies = {k: min(shards, -(-shards * SHARD_LEAST // n)) for k, n in counts.items()}
    every = F.sequence(F.lit(0), F.when(F.col("label") == 1, copies[1]).otherwise(copies[0]) - 1)
    dealt = found.filter("not kept").select("codes", "label", "h", F.explode(every).alias("copy"))
    dealt = dealt.withColumn("shard", F.pmod(
        F.pmod("h", F.lit(shards)) + F.col("copy"), F.lit(shards)).cast("bigint"))
    model = start
    for round_ in range(ROUNDS):
        sums = dealt.groupBy("shard").applyInArrow(
            _train_shard(model, round_), "shard bigint, n bigint, weights binary").groupBy(
            F.pmod("shard", F.lit(16))).applyInArrow(_add_up, "n bigint, weights binary").collect()
        flat = sum(np.frombuffer(r["weights"], np.int64) for r in sums) / FIXED / sum(
            r["n"] for r in sums)
        sizes = np.cumsum([np.size(p) for p in model[:6]])
        parts = [part.astype(np.float32).reshape(np.shape(p)) for part, p in zip(
            np.split(flat, sizes[:-1]), model[:6], strict=True)]
        model = model._replace(**dict(zip(model._fields[:5], parts[:5], strict=True)),
                               out_bias=float(parts[5]))
    seen = found.filter("kept").select("codes", "label").mapInArrow(
        _outputs(model), "label int, place bigint").groupBy("label", "place").count().orderBy(
        "label", "place").collect()
    answer = np.array([r["label"] for r in seen])
    if len(set(answer.tolist())) < 2:
        return start
    return _with_threshold(model, np.array([r["place"] for r in seen]) / BINS, answer,
                           np.array([r["count"] for r in seen]))


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> SecretModel:
    """A model from all different findings of all documents; ids (``doc_id``) have no part in it.

    It starts from the ``SAMPLE_FINDINGS`` of each label with the least hashes. If there are more,
    all are trained on, but those kept out: what ``train`` kept out of the first, and a quarter
    of the others by their hashes. It is the same however the table is split.
    """
    found = materialize(labelled_findings(docs, text), "findings")
    first = []
    for label in (0, 1):
        first += found.filter(F.col("label") == label).orderBy("h").limit(
            SAMPLE_FINDINGS).collect()
    if not first:
        return no_model()
    truth = np.array([r["label"] for r in first])
    start = train(np.array([r["codes"] for r in first], np.int16), truth)
    if start is None:
        return no_model()
    counts = {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}
    if max(counts.values()) <= SAMPLE_FINDINGS:
        return start
    out = set(_kept_out(len(first), SEED).tolist())
    kept = F.pmod("h", F.lit(4)) == 0
    for label in (0, 1):
        own = [i for i in np.flatnonzero(truth == label).tolist()]
        last = first[own[-1]]["h"]
        kept = F.when((F.col("label") == label) & (F.col("h") <= last), F.col("h").isin(
            [first[i]["h"] for i in own if i in out])).otherwise(kept)
    return _train_on_all(start, found.withColumn("kept", kept), counts)


def all_spans(model: SecretModel, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
    """Pattern spans (score 1) and the candidates that the network marks, by start and kind."""
    found, rows, whose = [], [], []
    for i, text in enumerate(texts):
        spans = base_spans(text)
        found.append([(kind, start, end, 1.0) for kind, start, end, _ in spans])
        for start, end in _candidates(text, spans):
            pieces = windows(text, start, end)
            rows.append(pieces)
            whose.append((i, start, end, len(pieces)))
    if rows and model.threshold <= 1.0:
        sure, at = scores(model, np.concatenate(rows)), 0
        for i, start, end, n in whose:
            score = float(sure[at:at + n].max())
            at += n
            if score >= model.threshold:
                found[i].append(("cnn", start, end, score))
    for spans in found:
        spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def secret_spans(model: SecretModel, text: Column) -> Column:
    """Spans ``(kind, start, end, score)`` of each whole text, offsets in code points, end
    exclusive; an empty array for NULL and empty texts. Pattern spans of different kinds may
    overlap; those of the network overlap no other."""
    @F.arrow_udf(SPANS)
    def run(column: pa.Array) -> pa.Array:
        out = []
        for block in text_blocks(column):
            out += [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans]
                    for spans in all_spans(model, block.to_pylist())]
        return pa.array(out, pa.list_(pa.struct([
            ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
            ("score", pa.float64())])))

    return run(text)


def redacted(model: SecretModel, text: Column) -> Column:
    """Each text with every span (overlapping ones as one) replaced; NULL stays NULL."""
    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        out, empty = [], column.is_null().to_pylist()
        for block in text_blocks(column):
            texts = block.to_pylist()
            for one, spans in zip(texts, all_spans(model, texts), strict=True):
                parts, at = [], 0
                for _, start, end, _ in spans:
                    if start >= at:
                        parts += [one[at:start], REPLACEMENT]
                    at = max(at, end)
                out.append("".join([*parts, one[at:]]) if spans else one)
        return pa.array([None if gone else one for one, gone in zip(out, empty, strict=True)],
                        pa.string())

    return run(text)
