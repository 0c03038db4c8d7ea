"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, released, small_batches, text_of
from .langid import fold

#: Bounded sample of labelled documents of each class that the field is fitted on.
SAMPLE_DOCS = 1_500
#: Training steps, their size and the penalty on weights.
STEPS, RATE, PENALTY = 120, 0.15, 1e-3
#: Bytes of text whose lines are scored side by side.
BATCH_BYTES = 1_000_000
BINS = 10
#: Largest preference for a line to share its neighbour's label (documents carry one label for all lines).
MAX_BOND = 1.5

# Classes of bytes: lower, upper, digit, space, sentence marks, symbols, beyond ASCII, control.
_CLASS = np.full(256, 5, np.int64)
_CLASS[:32], _CLASS[127], _CLASS[128:] = 7, 7, 6
_CLASS[[9, 11, 12, 13, 32]] = 3
for _k, _chars in ((0, b"abcdefghijklmnopqrstuvwxyz"), (1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"0123456789"), (4, b".,;:?'\"-")):
    _CLASS[list(_chars)] = _k
_SHARE = np.array([0.005, 0.015, 0.03, 0.06, 0.1, 0.18, 0.35, 0.6, 0.85])
_EDGES = (
    np.array([1, 8, 20, 40, 80, 150, 300, 600, 1200]),  # bytes
    _SHARE, _SHARE, _SHARE, _SHARE, _SHARE,  # upper, digit, symbol, mark, beyond ASCII
    np.array([0.02, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.999]),  # distinct words
    np.array([1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 8, 11, 20]),  # bytes a word
    np.array([0.5, 0.6, 0.7, 0.76, 0.8, 0.83, 0.86, 0.9, 0.95]),  # lower-case and beyond
)
FEATURES = len(_EDGES)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binned features ``(lines, FEATURES)``, bytes of each line, and lines of each text."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(data == 10)
    size = np.diff(ends, prepend=-1) - 1
    n = len(ends)
    counts = np.zeros((n, 8))
    owner = np.repeat(np.arange(n), size + 1)
    counts += np.bincount(owner * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8)
    words, distinct = np.empty(n), np.empty(n)
    for i, line in enumerate(joined.split(b"\n")[:-1]):
        w = line.split()
        words[i], distinct[i] = len(w), len(set(w))
    per, per_word = np.maximum(size, 1), np.maximum(words, 1)
    values = (
        size, counts[:, 1] / per, counts[:, 2] / per, counts[:, 5] / per, counts[:, 4] / per, counts[:, 6] / per,
        distinct / per_word, (size - counts[:, 3]) / per_word, (counts[:, 0] + counts[:, 6] + counts[:, 3]) / per,
    )
    bins = np.stack([np.searchsorted(e, v, side="right") for e, v in zip(_EDGES, values, strict=True)], axis=1).astype(np.uint8)
    return bins, size, np.array([t.count(b"\n") + 1 for t in texts])


class Layout:
    """Lines of many texts arranged step by step: the t-th lines of all texts with so many, together."""

    def __init__(self, lines: np.ndarray):
        self.lines = lines
        start = np.cumsum(lines) - lines
        order = np.argsort(-lines, kind="stable")
        self.active = np.searchsorted(-lines[order], -np.arange(int(lines.max(initial=0))), side="left")
        self.rows = [start[order[:n]] + t for t, n in enumerate(self.active)]


def _neighbours(bins: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Column numbers of the active features of each line: its own, its predecessor's, its successor's."""
    base = bins.astype(np.int64) + np.arange(FEATURES) * BINS
    width = FEATURES * BINS
    before, after = np.empty_like(base), np.empty_like(base)
    before[1:], after[:-1] = base[:-1] + width, base[1:] + 2 * width
    first = np.cumsum(lines) - lines
    none = 3 * width
    before[first] = none
    after[first + lines - 1] = none + 1
    return np.concatenate((base, before, after), axis=1)


WIDTH = 3 * FEATURES * BINS + 2


def marginals(score: np.ndarray, bond: float, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all texts: P(line is good), and P(a line shares its predecessor's label).

    ``score`` is each line's log-odds of good; neighbours with equal labels gain ``bond``.
    """
    same, other = np.exp(bond), 1.0
    odds = np.exp(np.clip(score, -30, 30))
    ahead, behind = np.empty(len(score)), np.ones(len(score)) * 0.5
    prior = None
    for rows in layout.rows:
        good = odds[rows] if prior is None else odds[rows] * (prior[: len(rows)] * same + (1 - prior[: len(rows)]) * other)
        bad = np.ones(len(rows)) if prior is None else prior[: len(rows)] * other + (1 - prior[: len(rows)]) * same
        prior = good / (good + bad)
        ahead[rows] = prior
    for t in range(len(layout.rows) - 1, 0, -1):
        rows = layout.rows[t]
        back = layout.rows[t - 1][: len(rows)]
        g, b = odds[rows] * behind[rows], 1 - behind[rows]
        to_good, to_bad = same * g + other * b, other * g + same * b
        behind[back] = to_good / (to_good + to_bad)
    joint = ahead * behind
    good = joint / (joint + (1 - ahead) * (1 - behind))
    shares = np.ones(len(score))
    for t in range(1, len(layout.rows)):
        rows = layout.rows[t]
        p = ahead[layout.rows[t - 1][: len(rows)]]
        g, b = odds[rows] * behind[rows], 1 - behind[rows]
        equal = same * (p * g + (1 - p) * b)
        shares[rows] = equal / (equal + other * (p * b + (1 - p) * g))
    return good, shares


class Field:
    """Weights of line features (own and neighbours'), the bond of neighbours, and a calibration."""

    def __init__(self, weights: np.ndarray, bond: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bond, self.slope, self.shift = weights, bond, slope, shift

    def _document(self, bins: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Log-odds of the length-weighted mean marginal of each text."""
        score = self.weights[_neighbours(bins, lines)].sum(axis=1)
        good, _ = marginals(score, self.bond, Layout(lines))
        weight = size + 1.0
        first = np.cumsum(lines) - lines
        mean = np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-(self.slope * self._document(*line_features(texts)) + self.shift)))

    @classmethod
    def fit(cls, docs: list[tuple[int, np.ndarray, np.ndarray]]) -> Field:
        """``(label, bins, sizes)`` of each document; every line carries its document's label.

        Documents count alike, whatever their number of lines. Without both classes the field
        is flat and scores 0.5, or its only class.
        """
        labels = np.array([d[0] for d in docs], float)
        if len(set(labels.tolist())) < 2:
            return cls(np.zeros(WIDTH), 0.0, 1.0, 0.0 if not len(labels) else (4.0 if labels[0] else -4.0))
        lines = np.array([len(d[1]) for d in docs])
        bins, size = np.concatenate([d[1] for d in docs]), np.concatenate([d[2] for d in docs])
        active, layout = _neighbours(bins, lines), Layout(lines)
        y = np.repeat(labels, lines)
        share = np.repeat(np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / lines, lines)
        firsts = np.zeros(len(y), bool)
        firsts[np.cumsum(lines) - lines] = True
        params, m, v = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
        flat = active.ravel()
        for step in range(1, STEPS + 1):
            good, shares = marginals(params[active].sum(axis=1), params[-1], layout)
            grad = np.bincount(flat, np.repeat((y - good) * share, active.shape[1]), WIDTH + 1) / len(docs)
            grad[-1] = ((1 - shares) * share)[~firsts].sum() / len(docs)
            grad -= PENALTY * params
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            params = params + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            params[-1] = min(max(params[-1], 0.0), MAX_BOND)
        field = cls(params[:-1], float(params[-1]))
        x = field._document(bins, size, lines)
        for _ in range(50):  # Newton steps of the calibration, lightly tied to the identity
            p = 1 / (1 + np.exp(-(field.slope * x + field.shift)))
            w = p * (1 - p) + 1e-6
            g = np.array([((labels - p) * x).sum() - (field.slope - 1), (labels - p).sum() - field.shift])
            h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]])
            step_ = np.linalg.solve(h, g)
            field.slope, field.shift = max(0.05, field.slope + float(np.clip(step_[0], -1, 1))), field.shift + float(np.clip(step_[1], -1, 1))
        return field


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [line_features([t.as_py()]) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].astype(np.int64).tobytes() for f in found], pa.binary())],
            names=["label", "bins", "size"],
        )


def fit_field(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> Field:
    """Fit on a bounded, hash-ordered sample of labelled documents outside the held-out fold."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(labels["doc_id"].cast("long").alias("doc_id"))
    marked = known.agg(F.max(F.col("quality").cast("int")).alias("label")).where(fold(F.col("doc_id"), folds) != held)
    present = docs.select(docs["doc_id"].cast("long").alias("doc_id")).distinct()
    ids = marked.join(present, "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id", F.lit(13)))
    chosen = hash_sample(ids, "label", SAMPLE_DOCS).select("doc_id", "label")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("raw"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("label", "raw").mapInArrow(_feature_rows, "label int, bins binary, size binary")
    got = sorted(((r["label"], bytes(r["bins"]), bytes(r["size"])) for r in rows.collect()))
    return Field.fit([(int(k > 0), np.frombuffer(b, np.uint8).reshape(-1, FEATURES), np.frombuffer(s, np.int64)) for k, b, s in got])


def _scores(batches: Iterator[pa.RecordBatch], field) -> Iterator[pa.RecordBatch]:
    model = field.value
    for batch in batches:
        raw = batch.column(2)
        at = 0
        while at < batch.num_rows:
            end, total, texts = at, 0, []
            while end < batch.num_rows and (end == at or total <= BATCH_BYTES):
                texts.append(raw[end].as_py())
                total += len(texts[-1])
                end += 1
            score = model.score(texts)
            cols = [batch.column(i).slice(at, end - at) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )
            at = end


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs(doc_id, text)``.

    A linear-chain field labels every line good or bad from binned features of the line and its
    neighbours; forward-backward marginals, weighted by line length, give the document's
    score, calibrated on the training sample. Only labels outside the held-out fold are used,
    and only text is scored. A null text counts as empty, an empty one is a single empty
    line; repeated rows give repeated rows, a null doc_id counts as held out; several labels of
    a document count as their largest; with no labels all scores are 0.5.
    """
    small_batches(docs.sparkSession)
    field = docs.sparkSession.sparkContext.broadcast(fit_field(docs, labels, folds, held))
    kind = docs.schema["doc_id"].dataType.simpleString()
    held_out = F.coalesce(fold(docs["doc_id"], folds) == held, F.lit(True))
    rows = docs.select("doc_id", held_out.alias("held_out"), text_of(docs).cast("binary").alias("raw"))
    return rows.mapInArrow(lambda it: released(_scores(it, field)), f"doc_id {kind}, held_out boolean, score double, predicted int")
