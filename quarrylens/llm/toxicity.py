"""Operator 6: toxicity by compression distance.

Two zstandard dictionaries are trained: one on the windows of ordinary labelled text, and one on the stretches of toxic labelled
text that are denser there, by how often their strings occur and not only by where they are absent; windows of ordinary text that
hold such strings are no part of the first. The second stands before the
first, so that what both kinds of text share costs the same with either. Every window of ``WINDOW`` bytes of a text (overlapping by
``OVERLAP``) is compressed with both; by how many bytes the toxic dictionary does better is the window's
distance. A logistic model turns a text's largest distances and the mean over all its windows into a score, so the threshold
on it is calibrated. It is fitted on all labelled rows, each measured by dictionaries of the ``FOLDS`` - 1 folds without it;
the dictionaries that score are trained on all of them.

What is compressed is not the letters as they stand: in a word's first ``BEGINNING`` bytes every letter but the first is replaced by a byte that depends on all of
the word up to it (``chained``). So a word that begins like a toxic one shares no string with ordinary words that merely hold the same syllables further on, and
costs the ordinary dictionary much more than the toxic one.

The fit reads a sample of at most ``PER_CLASS`` labelled rows of each class, whole texts of ``CLASS_BYTES`` together; everything else
covers all rows and whole texts. Null and empty texts get the score of a text without any distance. Without labelled rows of both
classes, every score is the share of label 1 (0 without labels). Ids in ``labels`` may repeat: the larger label counts. Ids in
documents may be null or repeat, and other columns don't matter: rows are judged one by one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.llm.samples import labelled, logistic, remainder, shuffled, sigmoid
from quarrylens.llm.scratch import bounded, table, unused

PER_CLASS = 1_200
WINDOW, OVERLAP, LEVEL = 128, 24, 9
ORDINARY_BYTES, TOXIC_BYTES, FOLDS = 65_536, 4_096, 3
#: a marking string: GRAM chained bytes that at least this share of toxic texts hold, e**LEAST_ODDS times as dense as in ordinary
#: ones and by LEAST_Z standard deviations more frequent than there
GRAM, LEAST_SHARE, LEAST_ODDS, LEAST_Z = 5, 0.03, 2.0, 5.0
#: shares in which strings are counted
PARTS = 8
THRESHOLD = 0.7

#: windows that are chained together, bytes of whole texts that are, and the bytes at a word's beginning that are; the rest of a longer word stays,
#: so that a window that repeats one word can still be shortened
BLOCK, PIECE, BEGINNING = 256, 1 << 16, 16
_IN_WORDS, _OWN_WORDS = np.zeros(256, bool), np.zeros(256, bool)
_IN_WORDS[[*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(0x80, 0x100)]] = True
#: first bytes of characters from U+0800 on, which begin anew, as many of their scripts leave no space between words
_OWN_WORDS[0xE0:] = True
_BASE = 0x915F77F5
_POWERS, _INVERSES = (np.cumprod(np.array([1, *[x] * (PIECE - 1)], np.uint32), dtype=np.uint32) for x in (_BASE, pow(_BASE, -1, 1 << 32)))


def windows(text: bytes) -> Iterator[bytes]:
    """Overlapping windows; a shorter last one is repeated to full length, as zstandard stores what it can hardly shorten."""
    for at in range(0, max(1, len(text) - OVERLAP), WINDOW - OVERLAP):
        w = text[at : at + WINDOW]
        yield w if len(w) == WINDOW else (w * (WINDOW // max(1, len(w)) + 1))[:WINDOW]


def chained(pieces: list[bytes]) -> list[bytes]:
    """Lower-case pieces of one length: each letter of a word's beginning but its first becomes a byte of a hash of the word up to it."""
    a = np.frombuffer(b"".join(pieces), np.uint8).reshape(len(pieces), -1)
    n, inside = a.shape[1], _IN_WORDS[a]
    begins = ~inside
    begins[:, :1] = True
    begins[:, 1:] |= ~inside[:, :-1] | _OWN_WORDS[a[:, 1:]]
    places = np.arange(n, dtype=np.int32)
    at = np.maximum.accumulate(np.where(begins, places, 0), axis=1)
    terms = (a.astype(np.uint32) + np.uint32(1)) * _POWERS[:n]
    sums = np.cumsum(terms, axis=1, dtype=np.uint32)
    hashes = (sums - np.take_along_axis(sums - terms, at, axis=1)) * _INVERSES[at]
    hashes = (hashes ^ (hashes >> np.uint32(15))) * np.uint32(0x9E3779B1)
    return [row.tobytes() for row in np.where(begins | (places - at >= BEGINNING), a, (hashes >> np.uint32(24)).astype(np.uint8))]


def chained_text(text: bytes) -> bytes:
    """A whole lower-case text, chained by pieces."""
    return b"".join(chained([text[k : k + PIECE]])[0] for k in range(0, len(text), PIECE))


def chained_windows(text: bytes) -> Iterator[bytes]:
    """The chained windows of a lower-case text; a word that a window cuts begins anew there."""
    found = windows(text)
    while block := list(islice(found, BLOCK)):
        yield from chained(block)


def _grams(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    return sum(data[i : len(data) - GRAM + 1 + i] << np.uint64(8 * i) for i in range(GRAM))


def _counts(texts: list[bytes], part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one of ``PARTS`` shares of all strings of ``GRAM`` bytes: which there are, how many texts hold each, and how often they occur."""
    held = [g[(g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(61) == part] for g in map(_grams, texts)] or [np.zeros(0, np.uint64)]
    grams, often = np.unique(np.concatenate(held), return_counts=True)
    _, n = np.unique(np.concatenate([np.unique(g) for g in held]), return_counts=True)
    return grams, n, often


def marking_strings(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """The strings of ``GRAM`` bytes that mark toxic texts; all texts are chained."""
    total, total_others = (sum(max(0, len(t) - GRAM + 1) for t in texts) for texts in (toxic, ordinary))
    out = []
    for part in range(PARTS):  # so that the driver doesn't hold all strings of all texts at once
        grams, n, often = _counts(toxic, part)
        others, _, m = _counts(ordinary, part)
        at = np.minimum(np.searchsorted(others, grams), max(0, len(others) - 1))
        there = np.where(others[at] == grams, m[at], 0) if len(others) else np.zeros(len(grams), np.int64)
        usual = (there + 0.5) / max(1, total_others)
        dense = np.log((often + 0.5) / max(1, total) / usual) > LEAST_ODDS
        certain = (often - usual * total) / np.sqrt(usual * total + 1) > LEAST_Z
        out.append(grams[(n >= max(3, LEAST_SHARE * len(toxic))) & dense & certain])
    return np.concatenate(out)


def unmarked(ordinary: list[bytes], marking: np.ndarray) -> list[bytes]:
    """The windows of ordinary texts that hold no marking string, so that their dictionary doesn't learn the ones that occur there now and then."""
    found = []
    for t in ordinary:
        hits = np.concatenate([[0], np.cumsum(np.isin(_grams(t), marking))])
        for k, w in enumerate(windows(t)):
            at = k * (WINDOW - OVERLAP)
            first, last = (min(x, len(hits) - 1) for x in (at, at + WINDOW - GRAM + 1))
            if hits[first] == hits[last]:
                found.append(w)
    return found


def stretches(toxic: list[bytes], marking: np.ndarray) -> list[bytes]:
    """The stretches of toxic texts that are made of marking strings, each as often as it occurs."""
    found = []
    for t in toxic:
        hits = np.flatnonzero(np.isin(_grams(t), marking))
        if len(hits):
            cut = np.flatnonzero(np.diff(hits) > GRAM)
            found += [t[a : b + GRAM] for a, b in zip(np.concatenate([hits[:1], hits[cut + 1]]), np.concatenate([hits[cut], hits[-1:]]), strict=True)]
    return found


def trained_dictionary(size: int, samples: list[bytes]) -> bytes:
    """A zstandard dictionary of at most ``size`` bytes; of too little text to choose from, the text itself."""
    try:
        return zs.train_dictionary(size, samples).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-size:]


class Model:
    """The two dictionaries and the calibration; small enough to travel with a task."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray | None, prior: float):
        self.ordinary, self.toxic, self.weights, self.prior = ordinary, toxic, weights, prior

    def __getstate__(self):
        return self.ordinary, self.toxic, self.weights, self.prior

    def __setstate__(self, state):
        self.__init__(*state)

    def plain_compressors(self):
        """Of chained windows."""
        out = []
        for content in (self.ordinary, self.toxic):
            known = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            how = zs.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS)
            known.precompute_compress(compression_params=how)
            out.append(zs.ZstdCompressor(dict_data=known, compression_params=how).compress)
        return out

    def compressors(self):
        """Of lower-case windows."""
        return [lambda window, compress=compress: compress(chained([window])[0]) for compress in self.plain_compressors()]

    @staticmethod
    def features(text: bytes, ordinary, toxic) -> list[float]:
        """Of the windows' distances: the largest, the next one, the mean of what exceeds one byte, and the mean of all."""
        first, second, over, total, n = 0, 0, 0, 0, 0
        for w in chained_windows(text.lower()):
            d = len(ordinary(w)) - len(toxic(w))
            n, total = n + 1, total + d
            if d > 0:
                over += d - 1
                first, second = (d, first) if d > first else (first, max(second, d))
        return [min(first, 12), min(second, 12), over / n, total / n, 1.0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        ordinary, toxic = self.plain_compressors()
        return sigmoid(np.array([self.features(t, ordinary, toxic) for t in texts]).reshape(-1, 5) @ self.weights)


def dictionaries(rows: list[tuple[bytes, int]]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary of labelled chained texts."""
    toxic, fine = ([t for t, y2 in rows if y2 == y] for y in (1, 0))
    marking = marking_strings(toxic, fine)
    ordinary = trained_dictionary(ORDINARY_BYTES, unmarked(fine, marking))
    return ordinary, trained_dictionary(TOXIC_BYTES, stretches(toxic, marking)) + ordinary


def fit(rows: list[tuple[str, int]]) -> Model:
    """Dictionaries from all rows; the calibration from each fold's rows, measured by the dictionaries of the other folds."""
    rows = [(text.encode(), y) for text, y in shuffled(rows)]
    prior = float(np.mean([y for _, y in rows])) if rows else 0.0
    chains = [(chained_text(t.lower()), y) for t, y in rows]
    others = [[row for i, row in enumerate(chains) if i % FOLDS != k] for k in range(FOLDS)]
    if any(len({y for _, y in part}) < 2 for part in others):
        return Model(b"", b"", None, prior)
    measured = []
    for k, part in enumerate(others):
        with_both = Model(*dictionaries(part), None, prior).plain_compressors()
        measured += [(Model.features(t, *with_both), y) for t, y in rows[k::FOLDS]]
    weights = logistic(np.array([x for x, _ in measured]), np.array([y for _, y in measured], float))
    return Model(*dictionaries(chains), weights, prior)


def toxicity(docs: DataFrame, model: Model, text_column: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text (0 to 1), all columns kept."""
    at, names = docs.columns.index(text_column), [*docs.columns, out]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores([(x.as_py() or "").encode() for x in batch.column(at)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names)

    return bounded(docs).mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def trained(spark: SparkSession, sf_dir: str) -> Model:
    docs, labels = (table(spark, sf_dir, name).filter(remainder("doc_id", 3) != 1) for name in ("documents", "labels"))
    return fit(labelled(docs, labels, "toxic", PER_CLASS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), trained(spark, sf_dir))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score stays below the threshold, with their columns; null and empty texts have no distance and stay unless toxic rows are the rule."""
    score = unused(docs, "toxicity")
    return toxicity(docs, trained(spark, sf_dir), out=score).filter(F.col(score) < THRESHOLD).drop(score)
