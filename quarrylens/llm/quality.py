"""Operator 9: quality by naive Bayes support vectors.

A text's features are indicators of its n-grams: words, pairs of words, shapes of words (their cases, digits and punctuation)
and triples of shapes, hashed to ``FEATURES`` columns; a pair of equal words and a line that came before have columns
of their own. Indicators are scaled by the log ratio of the classes' smoothed counts, and a linear hinge-loss
model is fitted to them by dual coordinate descent. A logistic calibration on rows that the model hasn't
seen turns margins into scores.

The fit reads at most ``PER_CLASS`` labelled rows of each class, whole texts of ``CLASS_BYTES`` together; scores cover all rows and
whole texts. Null and empty texts have no features and get the score of the intercept. Without labelled rows of both classes,
every score is the share of label 1 (0 without labels). Ids in ``labels`` may repeat: the larger label counts. Ids in documents may be
null or repeat, and other columns don't matter: rows are judged one by one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.llm.kernels import SPACED, Words, blocks, byte_class, lowered, mix, random_words
from quarrylens.llm.samples import labelled, logistic, remainder, shuffled, sigmoid
from quarrylens.llm.scratch import bounded, table

PER_CLASS = 2_000
FEATURES = 1 << 18
SMOOTHING, COST, EPOCHS = 1.0, 0.1, 30
THRESHOLD = 0.3
_VALUES, _SEED = lowered(9), 90
_LINES = byte_class("\n")


def _shape_values() -> np.ndarray:
    values = random_words(91, 256)
    for same in (range(97, 123), range(65, 91), range(48, 58), range(128, 256)):
        values[list(same)] = values[same[0]]
    return values


_SHAPES = _shape_values()
_PLACES = random_words(92, 8)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct feature columns of each document of a block, and their bounds by document."""
    words = Words(data, offsets, SPACED, _VALUES)
    shapes = Words(data, offsets, SPACED, _SHAPES)
    lines = Words(data, offsets, _LINES, _VALUES)
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), words.counts)
    pairs, at, _ = words.grams(2, _SEED)
    pairs = np.where(words.hash[at] == words.hash[np.minimum(at + 1, max(0, len(words.hash) - 1))], _PLACES[0], pairs) if len(at) else pairs
    triples, at3, _ = shapes.grams(3, _SEED + 1)
    line_owner = np.repeat(np.arange(n), lines.counts)
    order = np.lexsort((lines.hash, line_owner))
    again = order[1:][(lines.hash[order][1:] == lines.hash[order][:-1]) & (line_owner[order][1:] == line_owner[order][:-1])] if len(order) else order
    parts = [(words.hash, owner), (pairs, owner[at]), (shapes.hash ^ _PLACES[1], owner), (triples ^ _PLACES[2], owner[at3]), (np.full(len(again), _PLACES[3]), line_owner[again])]
    code = np.concatenate([(d.astype(np.int64) << 18) | (mix(h) % np.uint64(FEATURES)).astype(np.int64) for h, d in parts])
    code = np.unique(code)
    return code & (FEATURES - 1), np.searchsorted(code >> 18, np.arange(n + 1))


def descend(rows: list[np.ndarray], ratios: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the intercept) that minimise |w|^2 / 2 + sum of cost * hinge loss, by dual coordinate descent; rows are scaled to length 1."""
    w = np.zeros(FEATURES + 1)
    alpha = np.zeros(len(rows))
    values = [_unit(ratios[r]) for r in rows]
    rng = np.random.default_rng(9)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            grad = y[i] * (w[r] @ v + w[-1]) - 1
            new = min(max(alpha[i] - grad / (v @ v + 1), 0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                w[-1] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.sqrt(v @ v)
    return v / size if size else v


class Model:
    """margin = (sum of w * ratio over a text's features) / (length of its ratios) + intercept; score = sigmoid(a * margin + b)."""

    def __init__(self, weighted: np.ndarray | None, squares: np.ndarray | None, intercept: float, calibration: tuple[float, float]):
        self.weighted, self.squares, self.intercept, self.calibration = weighted, squares, intercept, calibration

    def margins(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weighted[codes], dtype=np.float64)])
        length = np.concatenate([[0.0], np.cumsum(self.squares[codes], dtype=np.float64)])
        dot, size = total[bounds[1:]] - total[bounds[:-1]], length[bounds[1:]] - length[bounds[:-1]]
        return np.where(size > 1e-9, dot / np.sqrt(np.maximum(size, 1e-9)), 0) + self.intercept

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.weighted is None:
            return np.full(len(column), self.intercept)
        out = [self.margins(*features(data, offsets)) for _, _, data, offsets in blocks(column)]
        a, b = self.calibration
        return sigmoid(a * np.concatenate(out) + b) if out else np.zeros(0)


def _linear(rows: list[np.ndarray], y: np.ndarray) -> Model:
    sign = np.where(y > 0, 1.0, -1.0)
    counts = [np.bincount(np.concatenate([r for r, s in zip(rows, sign, strict=True) if s == side] or [np.zeros(0, np.int64)]), minlength=FEATURES) + SMOOTHING for side in (1, -1)]
    ratios = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    cost = COST * np.where(sign > 0, len(y) / (2 * max(1, (sign > 0).sum())), len(y) / (2 * max(1, (sign < 0).sum())))
    w = descend(rows, ratios, sign, cost)
    return Model((w[:-1] * ratios).astype(np.float32), (ratios**2).astype(np.float32), float(w[-1]), (1.0, 0.0))


def fit(sample: list[tuple[str, int]], natural: float | None = None) -> Model:
    """``natural``: the share of label 1 among all labelled rows, where the sample holds the classes in another one."""
    sample = shuffled(sample)
    y = np.array([label for _, label in sample], float)
    prior = float(natural if natural is not None else (y.mean() if len(y) else 0.0))
    if len(set(y[::4])) < 2 or len(set(np.delete(y, np.s_[::4]))) < 2:
        return Model(None, None, prior, (1.0, 0.0))
    rows = []
    for lo, hi, data, offsets in blocks(pa.array([t for t, _ in sample], pa.string())):
        codes, bounds = features(data, offsets)
        rows += [codes[bounds[d] : bounds[d + 1]] for d in range(hi - lo)]
    apart = np.arange(len(rows)) % 4 == 0
    half = _linear([r for r, a in zip(rows, apart, strict=True) if not a], y[~apart])
    held = [r for r, a in zip(rows, apart, strict=True) if a]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in held])])
    a, b = logistic(np.column_stack([half.margins(np.concatenate(held), bounds), np.ones(len(held))]), y[apart])
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    whole = _linear(rows, y)
    whole.calibration = (float(a), float(b + np.log(prior / (1 - prior)) - np.log(share / (1 - share))))
    return whole


def quality(docs: DataFrame, model: Model, text_column: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text (0 to 1), all columns kept."""
    at, names = docs.columns.index(text_column), [*docs.columns, out]
    known = docs.sparkSession.sparkContext.broadcast(model)  # two float arrays of FEATURES

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known.value.scores(batch.column(at)), pa.float64())], names)

    return bounded(docs).mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def trained(spark: SparkSession, sf_dir: str) -> Model:
    docs, labels = (table(spark, sf_dir, name).filter(remainder("doc_id", 5) != 0) for name in ("documents", "labels"))
    share = labels.agg(F.avg((F.col("quality") > 0).cast("double"))).first()[0]
    return fit(labelled(docs, labels, "quality", PER_CLASS), share)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), trained(spark, sf_dir))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
