"""Operator 11: hard-negative mining by distributed radix selection.

An anchor's positives are the best scored other rows of its label; its hard negatives are the best scored rows of other labels whose
score lies in a window below a positive's score. Both are the first k rows of a window of integer scores, found without sorting
or moving rows: vectors stand in blocks, each pair of a block of anchors and a block of rows is one matrix product, and a task counts
scores in a histogram for each window, by their leading digit first. The sums of these histograms locate the bucket of the
kth score; the next pass counts the next digit within that bucket only, until the kth score is known to the last digit.
Then rows of at least that score, and no others, are gathered. Anchors are a query set that is held against all rows block by block.

What a task sends is bounded whatever the scores: of a histogram only the highest buckets that together hold k rows (a lower one
can't hold the kth score of all rows), and of gathered rows the first k of a window. So any number of equal vectors or ties
costs a few rows for each task, and no label, window or score is a group in one task.

Rows with a null label or vector, or with a null or non-finite component, take no part. Each row stands for itself: repeated ids or
equal rows are further anchors and candidates. Ties go to the smaller id, null last; a null id is no anchor. Vectors of unlike
lengths are compared over what both have. An anchor without positives, or a positive without negatives, yields no
row, an empty table an empty result, and other columns don't matter. Scores of 2**53 or more, which doubles don't hold, are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.llm.scratch import bounded, drop, saved, table
from quarrylens.llm.vectors import EXACT, floored, in_blocks, is_whole, unpacked

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
DIGIT, ANCHORS, HELD = 9, 512, 4

_WINDOWS = "array<struct<at: int, win: int, low: long, high: long, need: int>>"
_COUNTS = "place long, at int, win int, bucket long, n long"
_ROWS = "place long, at int, win int, score long, anchor_id long, row_id long"


class Windows:
    """The windows of a block of anchors as matrices (anchor, window); where there is none, low is above high."""

    def __init__(self, batch: pa.RecordBatch, k: int, anchors: int):
        column = batch.column("windows")
        at, win, low, high, need = (np.asarray(x) for x in column.values.slice(column.offsets[k].as_py(), column.offsets[k + 1].as_py() - column.offsets[k].as_py()).flatten())
        self.count = int(win.max()) + 1 if len(win) else 0
        self.low, self.high, self.need = np.full((anchors, self.count), 1), np.zeros((anchors, self.count), np.int64), np.zeros((anchors, self.count), np.int64)
        self.low[at, win], self.high[at, win], self.need[at, win] = low, high, need
        open_ = self.low <= self.high
        self.least = np.where(open_, self.low, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
        self.most = np.where(open_, self.high, np.iinfo(np.int64).min).max(1, initial=np.iinfo(np.int64).min)


def _scored(batches: Iterator[pa.RecordBatch], width: int, same: bool, exact: type) -> Iterator[tuple]:
    """For each pair of blocks the pairs of anchor and row whose score lies in any of the anchor's windows."""
    for batch in batches:
        for k in range(batch.num_rows):
            place, ids, labels, numbers, vectors = unpacked(batch, k, width)
            _, r_ids, r_labels, r_numbers, r_vectors = unpacked(batch, k, width, "r_")
            windows = Windows(batch, k, len(ids))
            scores = vectors.astype(exact) @ r_vectors.astype(exact).T
            fits = (scores >= windows.least[:, None]) & (scores <= windows.most[:, None]) & ((labels[:, 1:] == r_labels[None, :, 1]) == same)
            a, r = np.nonzero(fits)
            if same:  # a row is no candidate of its own
                other = numbers[a] != r_numbers[r]
                a, r = a[other], r[other]
            yield place, ids, windows, a, r_ids[r], scores[a, r].astype(np.int64)


def _histograms(batches: Iterator[pa.RecordBatch], width: int, same: bool, exact: type, shift: int) -> Iterator[pa.RecordBatch]:
    """Counts by window and bucket (score >> shift), the highest buckets of a window that hold as many rows as it needs."""
    held: dict[int, tuple[Windows, np.ndarray, np.ndarray]] = {}

    def sent(place: int) -> pa.RecordBatch:
        windows, first, counts = held.pop(place)
        above = np.cumsum(counts[..., ::-1], -1)[..., ::-1] - counts
        at, win, bucket = np.nonzero((counts > 0) & (above < windows.need[..., None]))
        n = counts[at, win, bucket]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), place)), pa.array(at.astype(np.int32)), pa.array(win.astype(np.int32)), pa.array(bucket + first[at, win]), pa.array(n)], names)

    names = ["place", "at", "win", "bucket", "n"]
    for place, _, windows, a, _, scores in _scored(batches, width, same, exact):
        if place not in held:
            if len(held) == HELD:
                yield sent(next(iter(held)))
            first = windows.low >> shift
            held[place] = windows, first, np.zeros((*windows.low.shape, int(((windows.high >> shift) - first).max(initial=0)) + 1), np.int64)
        windows, first, counts = held[place]
        buckets = scores >> shift
        for w in range(windows.count):
            at = np.flatnonzero((scores >= windows.low[a, w]) & (scores <= windows.high[a, w]))
            flat = a[at] * counts.shape[2] + buckets[at] - first[a[at], w]
            counts[:, w] += np.bincount(flat, minlength=len(counts) * counts.shape[2]).reshape(len(counts), -1)
    for place in list(held):
        yield sent(place)


def _gathered(batches: Iterator[pa.RecordBatch], width: int, same: bool, exact: type) -> Iterator[pa.RecordBatch]:
    """The rows in each window, the first ones of a task as far as the window needs."""
    held: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}

    def first(found: np.ndarray) -> np.ndarray:
        """Columns: anchor, window, need, score, id is null, id."""
        found = found[np.lexsort((found[:, 5], found[:, 4], -found[:, 3], found[:, 1], found[:, 0]))]
        starts = np.ones(len(found), bool)
        starts[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
        at = np.flatnonzero(starts)
        rank = np.arange(len(found)) - np.repeat(at, np.diff(np.append(at, len(found))))
        return found[rank < found[:, 2]]

    def sent(place: int) -> pa.RecordBatch:
        ids, found = held.pop(place)
        x = first(np.concatenate(found))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), place)), pa.array(x[:, 0].astype(np.int32)), pa.array(x[:, 1].astype(np.int32)), pa.array(x[:, 3]), pa.array(ids[x[:, 0], 1], mask=ids[x[:, 0], 0] > 0), pa.array(x[:, 5], mask=x[:, 4] > 0)], names)

    names = ["place", "at", "win", "score", "anchor_id", "row_id"]
    for place, ids, windows, a, r_ids, scores in _scored(batches, width, same, exact):
        if place not in held:
            if len(held) == HELD:
                yield sent(next(iter(held)))
            held[place] = ids, [np.zeros((0, 6), np.int64)]
        kept = held[place][1]
        for w in range(windows.count):
            at = np.flatnonzero((scores >= windows.low[a, w]) & (scores <= windows.high[a, w]))
            kept.append(first(np.column_stack([a[at], np.full(len(at), w), windows.need[a[at], w], scores[at], r_ids[at]])))
        if len(kept) > 64:
            kept[:] = [first(np.concatenate(kept))]
    for place in list(held):
        yield sent(place)


def select(anchors: DataFrame, rows: DataFrame, windows: DataFrame, width: int, most: int, same: bool) -> DataFrame:
    """The first rows of each window: (place, at, win, score, anchor_id, row_id, rank).

    ``anchors`` and ``rows`` are blocks; ``windows`` (place, at, win, low, high, need): the window ``win`` of the anchor at ``at`` in
    the block ``place`` takes its ``need`` best rows with scores from low to high. No score is beyond ``most``; ``same``:
    rows of the anchor's label are meant, not those of others.
    """
    key = ["place", "at", "win"]
    exact = np.float32 if most < 1 << 24 else np.float64
    right = rows.select(*(F.col(c).alias("r_" + c) for c in rows.columns))

    def pairs(open_: DataFrame) -> DataFrame:
        held = open_.groupBy("place").agg(F.collect_list(F.struct("at", "win", "low", "high", "need")).alias("windows"))  # of the anchors in one block
        return bounded(anchors.join(held.withColumn("windows", F.col("windows").cast(_WINDOWS)), "place").crossJoin(right))

    # low and high narrow to the bucket of the score that is sought, floor is the lowest score that is taken in the end
    state = windows.select(*key, F.greatest("low", F.lit(-most)).alias("low"), F.least("high", F.lit(most)).alias("high"), "need")
    state = saved(state.withColumns({"top": F.col("high"), "k": F.col("need"), "floor": F.col("low")}), "windows")
    shift = max(0, (2 * most + 1).bit_length() - DIGIT)
    while True:
        counts = pairs(state.filter("low <= high")).mapInArrow(lambda b, s=shift: _histograms(b, width, same, exact, s), _COUNTS)
        summed = counts.groupBy(*key, "bucket").agg(F.sum("n").alias("n"))
        upto = summed.withColumn("upto", F.sum("n").over(Window.partitionBy(*key).orderBy(F.desc("bucket"))))
        found = upto.join(state.select(*key, "need"), key).filter("upto >= need and upto - n < need").select(*key, "bucket", (F.col("upto") - F.col("n")).alias("above"))
        here, width_ = F.col("bucket"), 1 << shift
        narrowed = state.join(found, key, "left").select(
            *key,
            F.when(here.isNull(), 1).otherwise(F.greatest("low", here * width_)).alias("low"),  # fewer rows than are sought: all are taken
            F.when(here.isNull(), 0).otherwise(F.least("high", here * width_ + (width_ - 1))).alias("high"),
            (F.col("need") - F.coalesce("above", F.lit(0))).cast("int").alias("need"),
            "top",
            "k",
            F.when(here.isNull(), F.col("floor")).otherwise(F.greatest("floor", here * width_)).alias("floor"),
        )
        before, state = state, saved(narrowed, "windows")
        drop(before)
        if shift == 0:
            break
        shift = max(0, shift - DIGIT)
    last = state.select(*key, F.col("floor").alias("low"), F.col("top").alias("high"), F.col("k").alias("need"))
    rows_ = pairs(last.filter("low <= high")).mapInArrow(lambda b: _gathered(b, width, same, exact), _ROWS)
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("row_id"))
    best = rows_.withColumn("rank", F.row_number().over(order)).join(state.select(*key, "k"), key).filter("rank <= k").drop("k")
    out = saved(best, "selected")
    drop(state)
    return out


def hard_negatives(
    rows: DataFrame, anchors: Column, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the first ``negatives`` rows of another label for each row
    where ``anchors`` holds and each of its first ``positives`` rows of its label, scored from ``low`` to ``high`` percent of the positive."""
    kept = rows.filter(F.col(label).isNotNull() & is_whole(vector)).select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), floored(vector, scale).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    kept = saved(kept.withColumn("number", F.monotonically_increasing_id()), "vectors")
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    count, asked, width, most = kept.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("vector")), F.max(norm)).first()
    if (most or 0) >= EXACT:
        raise ValueError("scores of 2**53 or more")
    width, most = max(width or 1, 1), int(most or 0) + 1
    blocks = in_blocks(kept, width, count, "rows")
    queries = in_blocks(kept.filter("anchor"), width, asked, "anchors", ANCHORS)
    drop(kept)

    each = queries.select("place", F.explode(F.sequence(F.lit(0), (F.length("numbers") / 8 - 1).cast("int"))).alias("at"))
    near = select(queries, blocks, each.select("place", "at", F.lit(0).alias("win"), F.lit(-most).cast("long").alias("low"), F.lit(most).cast("long").alias("high"), F.lit(positives).alias("need")), width, most, True)
    near = near.select("place", "at", (F.col("rank") - 1).alias("win"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
    bounds = near.filter(F.expr(f"{low} * positive_score <= {high} * positive_score"))  # else no score fits
    bounds = bounds.select("place", "at", "win", F.expr(f"({low} * positive_score + 99) div 100").alias("low"), F.expr(f"({high} * positive_score) div 100").alias("high"), F.lit(negatives).alias("need"))
    hard = select(queries, blocks, bounds, width, most, False)
    drop(queries)
    drop(blocks)
    return hard.join(near, ["place", "at", "win"]).select("anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)), F.col("vec_id") % 50 == 0)
