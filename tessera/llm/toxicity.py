"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models on the text's word indicators and on the probabilities of the
categories before. While training, these probabilities are out of fold: a row gets them from models that have not seen it,
so that later models learn from probabilities as good as those that unseen texts have.

The categories of a row come from the label table: columns that are there as they are, and two that `toxic` and `quality`
make: `toxic_junk`, toxic text of low quality (spam, shouting), and `toxic_prose`, toxic text that is well written. A row
counts in each category that its labels settle: without a quality label, a toxic row still teaches `toxic`, and a row that
isn't toxic is neither of the two. A model is a logistic regression on
the words that tell the category, scaled by their log-odds for it, fitted by adaptive minibatch gradients on a bounded sample of labelled rows (`max_train`, those whose doc_id
hashes lowest); scoring covers every whole text in one pass without a shuffle.

Defined results: null, empty and word-less texts have the bias alone; labels with null doc_id are ignored, and a null
category for that category; without labels of both classes a category's probability is its share of ones (a half without labels); repeated rows
get equal scores; other columns of the input, of whatever name, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import ALNUM, U64, Rolling, blocks, spans
from .quality import held_out

MAX_TRAIN = 12_000
BITS = 20
THRESHOLD = 0.5
#: Words whose rows stray less from the category's share, in standard deviations, have no weight.
LEAST_Z = 4.0
CATEGORIES = ("toxic_junk", "toxic_prose", "toxic")


def features(buf: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(hashed words, offsets): the distinct words of each text, by row."""
    start, end, row = spans(buf, off, ALNUM)
    x = (Rolling(buf, True).ranges(start, end) >> U64(64 - bits)).astype(np.int64)
    key = np.unique(row.astype(np.int64) << bits | x)
    return key & ((1 << bits) - 1), np.searchsorted(key >> bits, np.arange(len(off)))


@dataclass
class Link:
    """One category's model: word weights, weights of earlier categories' log-odds, bias."""

    words: np.ndarray
    earlier: np.ndarray
    bias: float

    def __call__(self, x: np.ndarray, off: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Probabilities of rows (words x, offsets off) given the earlier categories' probabilities, a row each."""
        total = np.concatenate([[0.0], np.cumsum(self.words[x], dtype=np.float64)])
        margin = total[off[1:]] - total[off[:-1]] + log_odds(before) @ self.earlier + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def fit_link(x: np.ndarray, off: np.ndarray, before: np.ndarray, y: np.ndarray, size: int, epochs: int = 25, ridge: float = 1e-4, seed: int = 1) -> Link:
    """Logistic regression, adaptive steps for each weight, in minibatches; rare words need few steps and get long ones."""
    share = (float(y.sum()) + 0.5) / (len(y) + 1.0)
    bias = math.log(share / (1 - share))
    model = Link(np.zeros(size), np.zeros(before.shape[1]), bias)
    if not len(y) or y.min() == y.max():
        return model
    of_row = np.repeat(y, np.diff(off))
    ones, all_ = np.bincount(x[of_row == 1], minlength=size) + share, np.bincount(x, minlength=size) + 1.0
    z = (ones - share * all_) / np.sqrt(all_ * share * (1 - share))  # how far a word's rows stray from the category's share
    kept = (np.abs(z) >= LEAST_Z)[x]
    scale = np.log((ones + 0.5) / (all_ - ones + 0.5) * (1 - share) / share)
    off = np.concatenate([[0], np.cumsum(kept)])[off]
    x = x[kept]
    odds, rng = log_odds(before), np.random.default_rng(seed)
    g_words, g_rest = np.full(size, 1e-6), np.full(before.shape[1] + 1, 1e-6)
    n, step = np.diff(off), 64
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), step):
            rows = order[lo : lo + step]
            size_of = n[rows]
            flat = np.repeat(off[rows] - (np.cumsum(size_of) - size_of), size_of) + np.arange(int(size_of.sum()))
            words, owner = x[flat], np.repeat(np.arange(len(rows)), size_of)
            margin = np.bincount(owner, model.words[words] * scale[words], len(rows)) + odds[rows] @ model.earlier + model.bias
            error = weight[rows] * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y[rows])
            u, back = np.unique(words, return_inverse=True)
            g = np.bincount(back, error[owner], len(u)) * scale[u] + ridge * model.words[u] * len(rows)
            g_words[u] += g * g
            model.words[u] -= 0.3 * g / np.sqrt(g_words[u])
            rest = np.append(odds[rows].T @ error, error.sum())
            g_rest += rest * rest
            change = 0.1 * rest / np.sqrt(g_rest)
            model.earlier -= change[:-1]
            model.bias -= float(change[-1])
    model.words *= scale
    return model


@dataclass
class Chain:
    categories: tuple[str, ...]
    links: list[Link] = field(default_factory=list)

    def probabilities(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        """A row's probabilities, a column for each category."""
        out = np.zeros((len(off) - 1, len(self.links)))
        for k, link in enumerate(self.links):
            out[:, k] = link(x, off, out[:, :k])
        return out


def fit_chain(x: np.ndarray, off: np.ndarray, y: np.ndarray, categories: tuple[str, ...], size: int = 1 << BITS, folds: int = 3) -> Chain:
    """y: a column for each category: 1, 0, or not a number where a row's labels don't settle it."""
    chain, n = Chain(categories), len(off) - 1
    fold, before = np.arange(n) % folds, np.zeros((n, 0))

    def fit(keep: np.ndarray, k: int) -> Link:
        count = np.diff(off)[keep]
        flat = np.repeat(off[keep] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return fit_link(x[flat], np.concatenate([[0], np.cumsum(count)]), before[keep], y[keep, k].astype(np.int64), size)

    for k in range(len(categories)):
        known = ~np.isnan(y[:, k])
        chain.links.append(fit(np.flatnonzero(known), k))
        if k + 1 == len(categories):
            break
        unseen = np.zeros(n)
        for f in range(folds):
            part = fit(np.flatnonzero(known & (fold != f)), k)
            unseen[fold == f] = part(x, off, before)[fold == f]
        before = np.column_stack([before, unseen])
    return chain


def _label_columns(labels: DataFrame, categories: tuple[str, ...]) -> list[Column]:
    have = {c.lower() for c in labels.columns}
    number = lambda c: F.col(c).cast("double") if c in have else F.lit(None).cast("double")
    toxic, quality = number("toxic") >= 0.5, number("quality") >= 0.5
    made = {"toxic_junk": toxic & ~quality, "toxic_prose": toxic & quality}
    return [(made[c].cast("double") if c in made and c not in have else number(c)).alias(f"y{i}") for i, c in enumerate(categories)]


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, max_train: int = MAX_TRAIN, text: str = "text", doc_id: str = "doc_id") -> Chain:
    """A chain over the categories, learnt from rows that are not held out. The sample's rows, of bounded number, reach the driver as hashed words."""
    ys = [f"y{i}" for i in range(len(categories))]
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *_label_columns(labels, categories)).where("doc_id is not null").dropna("all", subset=ys).where(~held_out())
    chosen = known.groupBy("doc_id").agg(*[(F.avg(c) >= 0.5).cast("int").alias(c) for c in ys]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in blocks(batches, "text"):
            x, at = features(buf, off)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([x[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), *[rows.column(c) for c in ys]], ["doc_id", "x", *ys])

    taken = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", *ys)
    rows = taken.mapInArrow(run, "doc_id long, x binary, " + ", ".join(f"{c} int" for c in ys)).orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(2 * max_train)
    held = sorted(((r.doc_id, bytes(r.x), *[math.nan if r[c] is None else float(r[c]) for c in ys]) for r in rows.toLocalIterator()), key=lambda r: r[:2])
    x = np.frombuffer(b"".join(r[1] for r in held), "<u4").astype(np.int64)
    off = np.concatenate([[0], np.cumsum([len(r[1]) // 4 for r in held])]).astype(np.int64)
    return fit_chain(x, off, np.array([r[2:] for r in held], np.float64).reshape(len(held), len(ys)), categories)


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, p_<category> for each category, score (the last one's) and predicted, of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(Chain(chain.categories, [Link(m.words.astype(np.float32), m.earlier, m.bias) for m in chain.links]))
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in blocks(batches, "text"):
            p = sent.value.probabilities(*features(buf, off))
            last = p[:, -1]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), *[pa.array(c) for c in p.T], pa.array(last), pa.array((last >= threshold).astype(np.int32))], ["doc_id", "held_out", *names, "score", "predicted"])

    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return keyed.mapInArrow(run, "doc_id long, held_out boolean, " + ", ".join(f"{c} double" for c in names) + ", score double, predicted int")
