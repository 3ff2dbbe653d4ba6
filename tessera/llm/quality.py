"""Quality classifier: Naive Bayes support vectors on n-grams of bytes.

An n-gram's indicator (it occurs in the text or not) is scaled by the log of the ratio of its shares in the two classes; a
linear hinge-loss model on these scaled indicators is fitted by dual coordinate descent; its margins become probabilities by
a sigmoid that is fitted on margins of held-back folds.

The model is fitted by a task on a bounded sample of labelled rows (`max_train`, those whose doc_id hashes lowest), and only
its weights reach the driver; scoring covers every whole text, in one pass without a shuffle, with weights of a fixed size.

Defined results: null and empty texts have no n-grams and get the score of the bias alone; labels with null doc_id or
quality are ignored, and several labels of a doc_id count as 1 if their mean is at least a half; with labels of fewer than
two classes the score is the share of label 1 (a half without labels); repeated rows get equal scores; other columns of the
input, of whatever name, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, give_back

#: Labelled documents that a model is fitted on, at most.
MAX_TRAIN = 8000
#: Bytes in an n-gram, and the number of features they are hashed to.
GRAM, BITS = 3, 18
THRESHOLD = 0.7


def repetition(distinct: int, size: int, bits: int = BITS) -> np.uint32:
    """One more indicator: the share of n-grams that are distinct, in steps of an eighth of a doubling, for each doubling of the size."""
    level = min(63, int(-8 * math.log2(max(distinct, 1) / size)))
    return np.uint32(((size.bit_length() << 6 | level) * 2654435769 + 0x5BD1E995 & 0xFFFFFFFF) >> (32 - bits))


def grams(raw: np.ndarray, n: int = GRAM, bits: int = BITS) -> np.ndarray:
    """The distinct hashed n-grams of one text's bytes."""
    if len(raw) < n:
        return np.zeros(0, np.int64)
    x = np.zeros(len(raw) - n + 1, np.uint32)
    for j in range(n):
        x = x << np.uint32(8) | raw[j : len(raw) - n + 1 + j]
    x = np.unique((x * np.uint32(2654435769)) >> np.uint32(32 - bits))
    return np.append(x, repetition(len(x), len(raw), bits)).astype(np.int64)


class Seen:
    """grams() without sorting: of equal features, the one that was written last into a table counts."""

    def __init__(self, bits: int = BITS):
        self.last = np.zeros(1 << bits, np.int32)

    def __call__(self, raw: np.ndarray, n: int = GRAM, bits: int = BITS) -> np.ndarray:
        if len(raw) < n:
            return np.zeros(0, np.uint32)
        x = np.zeros(len(raw) - n + 1, np.uint32)
        for j in range(n):
            x = x << np.uint32(8) | raw[j : len(raw) - n + 1 + j]
        x = (x * np.uint32(2654435769)) >> np.uint32(32 - bits)
        at = np.arange(len(x), dtype=np.int32)
        self.last[x] = at
        x = x[self.last[x] == at]
        return np.append(x, repetition(len(x), len(raw), bits))


def weight(n: int) -> float:
    """What each of a row's n indicators counts, so that rows of all sizes have margins of one scale."""
    return 24 / (n + 24)


@dataclass
class LinearModel:
    """Weights of the features, bias, and the sigmoid that makes a margin a probability."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum(dtype=np.float64)) * weight(len(x)) + self.bias if len(x) else self.bias

    def probability(self, margin: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * margin + self.offset))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    """log of (share of each feature among those of class 1) / (the same of class 0), smoothed by alpha."""
    total = []
    for label in (1, 0):
        mine = [r for r, v in zip(rows, y, strict=True) if v == label]
        c = alpha + (np.bincount(np.concatenate(mine), minlength=size) if mine else np.zeros(size))
        total.append(np.log(c / c.sum()))
    return total[0] - total[1]


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 12, balance: bool = True, seed: int = 1) -> tuple[np.ndarray, float]:
    """(weights on indicators, bias) of the L2-regularised hinge loss; a row's features are scale * weight(their number).

    Each step solves one row's dual variable exactly, within 0 and its cost; rows come in a new order every epoch.
    balance: each class has the same total cost.
    """
    sign = np.where(y == 1, 1.0, -1.0)
    share = (y == 1).mean()
    most = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) * cost if balance else np.full(len(y), cost)
    square = np.array([float(np.square(scale[r]).sum()) * weight(len(r)) ** 2 for r in rows]) + 1.0  # the bias is a feature of value 1
    w, bias, dual, rng = np.zeros(len(scale)), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            r, s = rows[i], sign[i]
            v = scale[r] * weight(len(r))
            new = min(max(dual[i] - (s * (w[r] @ v + bias) - 1) / square[i], 0.0), most[i])
            step = new - dual[i]
            if step:
                w[r] += s * step * v
                bias += s * step
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w * scale, bias


def fit_sigmoid(margins: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(slope, offset) by Newton steps on the log loss, with targets drawn in a little from 0 and 1."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, math.log((n1 + 1) / (n0 + 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-12)
        g = np.array([d @ margins, d.sum()]) + [1e-3 * a, 0]
        hess = np.array([[(h * margins) @ margins + 1e-3, h @ margins], [h @ margins, h.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-8:
            break
    return a, b


def fit(rows: list[np.ndarray], y: np.ndarray, size: int = 1 << BITS, folds: int = 3, cost: float = 1.0) -> LinearModel:
    """The model of feature rows and their labels (0 or 1)."""
    if not len(y) or y.min() == y.max():
        p = (float(y.sum()) + 0.5) / (len(y) + 1.0)
        return LinearModel(np.zeros(size, np.float32), math.log(p / (1 - p)))

    def one(keep: np.ndarray) -> LinearModel:
        mine = [r for r, k in zip(rows, keep, strict=True) if k]
        return LinearModel(*dual_coordinate_descent(mine, y[keep], log_count_ratios(mine, y[keep], size), cost))

    fold, margins = np.arange(len(y)) % folds, np.zeros(len(y))
    for f in range(folds):
        train = fold != f
        if len(np.unique(y[train])) < 2:
            margins[~train] = 0.0
            continue
        model = one(train)
        margins[~train] = [model.margin(r) for r, k in zip(rows, ~train, strict=True) if k]
    model = one(np.ones(len(y), bool))
    model.slope, model.offset = fit_sigmoid(margins, y)
    model.weights = model.weights.astype(np.float32)
    return model


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows of which no label is learnt: the remainder by 4 of crc32 of the doc_id as text is 2."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_train: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, x, y): features and labels of at most about max_train labelled documents that are not held out, in one partition.

    The doc_ids of the sample, of bounded number, are sent to the scan of the documents; what comes back are features. Of
    several documents of one doc_id, all are taken, up to twice max_train rows, in the order of a hash of doc_id and of the features.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null").where(~held_out())
    chosen = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for rows, buf, off in blocks(batches, "text"):
            x = [seen(buf[a:b]).astype("<u4").tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(x, pa.binary()), rows.column("y")], ["doc_id", "x", "y"])

    taken = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    return taken.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, x binary, y int").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(2 * max_train)


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all training rows of a task, as a row."""
    held = sorted(r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("doc_id", "x", "y")], strict=True))
    model = fit([np.frombuffer(x, "<u4").view(np.int32) for _, x, _ in held], np.array([y for *_, y in held], np.int64))
    cells = (model.weights.tobytes(), model.bias, model.slope, model.offset)
    held.clear()
    give_back()
    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, (pa.binary(), *[pa.float64()] * 3), strict=True)], ["weights", "bias", "slope", "offset"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, text: str = "text", doc_id: str = "doc_id") -> LinearModel:
    """Fitted by a task, on rows of bounded number: the driver gets the weights, a number for each feature."""
    r = training_rows(docs, labels, label, max_train, text, doc_id).mapInArrow(_fit_rows, "weights binary, bias double, slope double, offset double").first()
    return fit([], np.zeros(0, np.int64)) if r is None else LinearModel(np.frombuffer(r.weights, np.float32), r.bias, r.slope, r.offset)


def score(docs: DataFrame, model: LinearModel, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, model = Seen(), sent.value
        for rows, buf, off in blocks(batches, "text"):
            p = [model.probability(model.margin(seen(buf[a:b]))) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return keyed.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: LinearModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, model = Seen(), sent.value
        for rows, buf, off in blocks(batches, text):
            good = [model.probability(model.margin(seen(buf[a:b]))) >= threshold for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield rows.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
