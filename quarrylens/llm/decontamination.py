"""Operator 8: benchmark decontamination by winnowing.

1. Words are hashed; of every ``KEEP`` consecutive ``GRAM``-word hashes the smallest is kept (the rightmost of equals). A shared span of
   ``GRAM + KEEP - 1`` words holds the same kept hash on both sides, so no window of ten words goes unseen. Items of fewer than ten
   words are one window; those too short for the guarantee are looked up at every position by their own length.
2. The fingerprints of the documents are joined with those of the benchmark.
3. Hits are extended: the windows of the document that hold a hit are joined with the benchmark's windows, by hash and word for word.

Both sides are tables, whose sizes decide how Spark joins them: nothing of either is collected, or broadcast by hand, but the lengths
below ten that items have. What is common to many documents is joined with distinct hashes and windows, so no pairs of documents
arise, and frequent ones are split as skewed joins.

Null and empty texts have no words, and an item without words is in no document. Item ids are compared as strings, a null one reads as the
empty string; repeated item ids count once. Rows are known by where they are stored: ids may be null or repeat, repeated documents
are judged one by one, and other columns don't matter. A very long text is read a part at a time; its words' hashes are held
together. An empty table gives an empty result, an empty benchmark clean documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.kernels import ALNUM, Words, blocks, lowered
from quarrylens.llm.scratch import bounded, files_for, saved, table, unused, with_row_key

WINDOW, GRAM, KEEP = 10, 5, 6
#: in place of a length: fingerprints that winnowing keeps, and a text's number of words in place of a hash
KEPT, WORDS = 0, -1
_VALUES, _SEED = lowered(8), 80


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, ALNUM, _VALUES)


def kept(hashes: np.ndarray, bounds: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the rightmost smallest hash of each ``keep`` consecutive ones that lie in one document."""
    if len(hashes) < keep:
        return np.zeros(0, np.int64)
    least, where = hashes[: len(hashes) - keep + 1].copy(), np.arange(len(hashes) - keep + 1)
    for i in range(1, keep):
        later = hashes[i : len(hashes) - keep + 1 + i]
        better = later <= least
        least[better] = later[better]
        where[better] = np.flatnonzero(better) + i
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return np.unique(where[owner[: len(where)] == owner[keep - 1 :]])


def _fingerprints(w: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, place in it) of the kept fingerprints, or of all windows of a length."""
    n = length or GRAM
    hashes, at, bounds = w.grams(n, _SEED + n)
    chosen = kept(hashes, bounds, KEEP) if length == KEPT else np.arange(len(hashes))
    doc = np.searchsorted(bounds, chosen, "right") - 1
    return hashes[chosen], doc, at[chosen] - w.bounds[doc]


def _spelled(data: np.ndarray, w: Words, first: int, n: int) -> str:
    return b" ".join(data[s:e].tobytes().lower() for s, e in zip(w.starts[first : first + n], w.ends[first : first + n], strict=True)).decode()


def _item_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, n, h, words): the windows of each item, and its kept fingerprints under ``KEPT``."""
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(1)):
            w = words_of(data, offsets)
            rows = []
            for n in sorted({min(int(c), WINDOW) for c in w.counts if c}):
                whole = np.minimum(w.counts, WINDOW) == n
                for h, d, at in zip(*(x.tolist() for x in _fingerprints(w, n)), strict=True):
                    if whole[d]:
                        rows.append((lo + d, n, h, _spelled(data, w, int(w.bounds[d]) + at, n)))
            hashes, docs, _ = _fingerprints(w, KEPT)
            rows += [(lo + d, KEPT, h, None) for h, d in zip(hashes.tolist(), docs.tolist(), strict=True)]
            at, n, h, spelled = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int32()), pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(spelled, pa.string())], ["item", "n", "h", "words"])


def _document_pass(lengths: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, n, h, at): the fingerprints of each text, and one row with its number of words."""

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in blocks(batch.column(1)):
                w = words_of(data, offsets)
                every = (w.counts.astype(np.uint64), np.arange(len(w.counts)), np.zeros(len(w.counts), np.int64))
                for n in [WORDS, *lengths]:
                    hashes, doc, at = every if n == WORDS else _fingerprints(w, n)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + doc)), pa.array(np.full(len(doc), n, np.int32)), pa.array(hashes.view(np.int64)), pa.array(at.astype(np.int32))], ["key", "n", "h", "at"])

    return fingerprints


def _extend_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, first, n, h, words): the windows around the hits (n, at) of each text."""
    for batch in batches:
        keys, texts, hits = batch.columns
        for lo, hi, data, offsets in blocks(texts):
            w = words_of(data, offsets)
            grams: dict[int, dict[int, int]] = {}
            rows = []
            for d in range(lo, hi):
                begin, count = int(w.bounds[d - lo]), int(w.counts[d - lo])
                asked = set()
                for hit in hits[d].as_py():
                    n, at = hit["n"] or WINDOW, hit["at"]
                    asked |= {(n, s) for s in (range(at + GRAM - WINDOW, at + 1) if hit["n"] == KEPT else (at,)) if 0 <= s <= count - n}
                for n, s in sorted(asked):
                    if n not in grams:
                        hashes, at, _ = w.grams(n, _SEED + n)
                        grams[n] = dict(zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True))
                    rows.append((d, s, n, grams[n][begin + s], _spelled(data, w, begin + s, n)))
            at, first, n, h, spelled = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(h, pa.int64()), pa.array(spelled, pa.string())], ["key", "first", "n", "h", "words"])


def occurrences(rows: DataFrame, benchmark: DataFrame, item_column: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """((key, first, n, h, words), (item, n, h, words), (key, n_words)): the benchmark's windows in ``rows`` (key, text), all of them, and the rows' words."""
    items = bounded(benchmark.select(F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text")))
    files, few = files_for(rows.count()), files_for(items.count(), 2_000)
    windows = saved(items.mapInArrow(_item_pass, "item string, n int, h long, words string"), "windows", few)
    known = saved(windows.filter(F.col("n") != WINDOW).select("n", "h").distinct(), "fingerprints", few)
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())  # WINDOW numbers at most
    kind = rows.schema["key"].dataType.simpleString()
    prints = bounded(rows.select("key", "text")).mapInArrow(_document_pass(lengths), f"key {kind}, n int, h long, at int")
    found = prints.join(known.withColumn("known", F.lit(True)), ["n", "h"], "left").filter(F.col("known") | (F.col("n") == WORDS))
    found = saved(found.select("key", "n", "h", "at"), "found", files)
    hits = saved(found.filter(F.col("n") != WORDS).groupBy("key").agg(F.collect_set(F.struct("n", "at")).alias("hits")), "hits", files)
    around = rows.select("key", "text").join(hits, "key").select("key", "text", "hits").mapInArrow(_extend_pass, f"key {kind}, first int, n int, h long, words string")
    windows = windows.filter(F.col("n") != KEPT)
    distinct = saved(windows.select("n", "h", "words").distinct(), "distinct", few)
    matched = saved(around.join(distinct, ["n", "h", "words"], "left_semi").select("key", "first", "n", "h", "words"), "matched", files)
    return matched, windows, found.filter(F.col("n") == WORDS).select("key", F.col("h").alias("n_words"))


def _covered(spans: Column) -> Column:
    """How many places the spans (first, end), in order of first, cover."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["first"]))).alias("n"))
    return F.aggregate(spans, start, step)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of ``docs``."""
    key = unused(docs, "row")
    rows = with_row_key(docs, key).select(F.col(key).alias("key"), F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    matched, windows, counts = occurrences(rows, benchmark, item_column, item_text)
    hit = matched.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("first", (F.col("first") + F.col("n")).alias("end")))).alias("spans")).select("key", _covered(F.col("spans")).alias("n_hit"))
    items = matched.select("key", "n", "h", "words").distinct().join(windows.distinct(), ["n", "h", "words"]).select("key", "item").distinct()
    items = items.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = rows.select("id", "key").join(counts, "key").join(hit.join(items, "key"), "key", "left")
    items, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_column), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("doc_id", F.col("doc_id").cast("long"))


def clean(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns."""
    key = unused(docs, "row")
    rows = with_row_key(docs, key)
    matched, _, _ = occurrences(rows.select(F.col(key).alias("key"), F.col(text_column).alias("text")), benchmark, item_column, item_text)
    return rows.join(matched.select(F.col("key").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of the benchmark; null and empty texts stay."""
    return clean(docs, table(spark, sf_dir, "benchmark"))
