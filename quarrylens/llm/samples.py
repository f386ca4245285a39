"""Bounded, repeatable training samples, and the logistic calibration that classifiers share."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: whole texts of a training sample, by class: where more were chosen, the longest stay out
CLASS_BYTES = 32 << 20


def remainder(id_column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a document (0 for a null id)."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % n, F.lit(0))


def within_budget(rows: DataFrame, by: str, text: str, most: int = CLASS_BYTES) -> DataFrame:
    """The rows of a bounded sample whose whole texts hold at most ``most`` bytes for each value of ``by``, the shortest first."""
    size = F.coalesce(F.octet_length(text), F.lit(0))
    order = Window.partitionBy(by).orderBy(size, F.xxhash64(text)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_bytes", F.sum(size).over(order)).filter(F.col("_bytes") <= most).drop("_bytes")


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, classes: tuple = (0, 1), id_column: str = "doc_id", text_column: str = "text") -> list[tuple[str, int]]:
    """At most ``per_class`` (text, label) rows of each class, those with the smallest hashes of their ids; whole texts.

    ``labels`` has the rows that may be learnt from and no others. The ids are chosen before any text is read; of the rows of a
    repeated id the one with the smallest hash of its text counts. So what is broadcast has ``per_class`` ids a class, and what is
    collected ``per_class`` texts of ``CLASS_BYTES`` together.
    """
    own = labels.filter(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(F.max(label).alias("_label"))
    chosen = None
    for c in classes:
        part = own.filter(F.col("_label") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(id_column).alias("_i"), F.col(text_column).alias("_text")).join(F.broadcast(chosen), F.col("_i") == F.col("_id"))
    rows = rows.groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("_text"), "_text"))["_text"].alias("_text"))
    return sorted((r["_text"] or "", int(r["_label"])) for r in within_budget(rows, "_label", "_text").collect())


def shuffled(rows: list[tuple[str | None, int]]) -> list[tuple[str, int]]:
    """The rows in an order that depends on their texts alone, so that folds by place don't follow ids or labels."""
    return sorted(((text or "", y) for text, y in rows), key=lambda r: (zlib.crc32(r[0].encode()), *r))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last column of x should be constant."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w
