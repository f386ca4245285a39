"""Operator 4: language identification by the nearest centroid.

A text becomes a vector of its byte trigrams (A-Z lower-cased, digits and ASCII punctuation read as spaces), hashed to ``WIDTH``
columns, weighted by TF-IDF and scaled to length 1. Each language has up to ``CENTROIDS`` centroids, found by spherical
k-means on its training texts; the language of the centroid with the largest cosine wins (ties: the first by name). A text
whose distance from that centroid exceeds the centroid's radius, the distance within which ``INSIDE`` of the training texts
nearest to it lie, is marked as rejected.

The fit reads at most ``PER_LANGUAGE`` labelled rows of each language, one for each bucket of hashed ids, whole texts of
``CLASS_BYTES`` together, and each language is a group of its own, so that the number of languages adds tasks and 128 KiB each to the model; predictions cover all rows and whole texts. Null texts and texts without a letter are ``und`` with
score 0. Without training rows every text is ``und``. Repeated rows and ids, null ids and extra columns don't matter: rows are judged
one by one, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.llm.kernels import blocks
from quarrylens.llm.samples import remainder, within_budget
from quarrylens.llm.scratch import bounded, drop, saved, table

PER_LANGUAGE = 500
WIDTH, CENTROIDS, INSIDE = 8_192, 4, 0.995
#: documents whose dense vectors are held at a time
ROWS = 128
UNKNOWN = "und"


def _folded() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint32)
    fold[65:91] = fold[97:123]
    fold[[b for b in range(128) if not (97 <= b <= 122 or 65 <= b <= 90)]] = 32
    return fold


_FOLD = _folded()
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Trigram counts, one dense row for each document."""
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, WIDTH), np.float32)
    b = _FOLD[data]
    code = ((b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:]) * np.uint32(2654435761) >> np.uint32(19)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    inside = owner[:-2] == owner[2:]
    return np.bincount(owner[:-2][inside] * WIDTH + code[inside], minlength=n * WIDTH).reshape(n, WIDTH).astype(np.float32)


def _scaled(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


class Model:
    def __init__(self, languages: list[str], owner: np.ndarray, centroids: np.ndarray, idf: np.ndarray, radius: np.ndarray):
        self.languages, self.owner, self.centroids, self.idf, self.radius = languages, owner, centroids, idf, radius

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected) of each row."""
        best, score, rejected = [], np.zeros(len(column)), np.zeros(len(column), bool)
        for lo in range(0, len(column), ROWS):
            part = column.slice(lo, ROWS)
            for first, end, data, offsets in blocks(part):
                letters = np.concatenate([[0], np.cumsum(_LETTER[data])])[offsets]
                spelled = np.diff(letters) > 0
                for d in np.flatnonzero(~spelled):
                    spelled[d] = any(c.isalpha() for c in part[first + int(d)].as_py() or "")
                if not self.languages:
                    best += [UNKNOWN] * (end - first)
                    continue
                near = _scaled(counts(data, offsets) * self.idf) @ self.centroids.T
                which = near.argmax(axis=1)
                cosine = np.clip(near[np.arange(len(which)), which], 0, 1)
                best += [self.languages[self.owner[k]] if s else UNKNOWN for k, s in zip(which, spelled, strict=True)]
                score[lo + first : lo + end] = np.where(spelled, cosine, 0)
                rejected[lo + first : lo + end] = ~spelled | (1 - cosine > self.radius[which])
        return best, score, rejected


def _clusters(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each next one starts at the row farthest from all centres."""
    centres = _scaled(x.mean(axis=0, keepdims=True))
    for _ in range(1, min(k, len(x))):
        centres = np.vstack([centres, x[(x @ centres.T).max(axis=1).argmin()]])
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        moved = np.vstack([x[nearest == c].mean(axis=0) if (nearest == c).any() else centres[c] for c in range(len(centres))])
        moved = _scaled(moved)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres[np.unique((x @ centres.T).argmax(axis=1))]


def _dense(texts: list[str]) -> Iterator[np.ndarray]:
    """The trigram counts of some texts at a time."""
    for lo in range(0, len(texts), ROWS):
        for _, _, data, offsets in blocks(pa.array(texts[lo : lo + ROWS])):
            yield counts(data, offsets)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each column occurs; the number of texts as column -1."""
    seen, n = np.zeros(WIDTH, np.int64), 0
    for batch in batches:
        for x in _dense(batch.column(0).to_pylist()):
            seen += (x > 0).sum(axis=0)
            n += len(x)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *seen[at].tolist()], pa.int64())], ["at", "n"])


def fit(sampled: DataFrame) -> Model:
    """The model of ``sampled`` (text, lang), in three Spark jobs: frequencies, the clusters of each language, radii.

    A task holds the vectors of one language, ``PER_LANGUAGE`` rows, and the driver frequencies and centroids: 128 KiB a language.
    """
    spark = sampled.sparkSession
    rows = bounded(saved(sampled.filter("text <> ''").select("text", "lang").distinct(), "languages"))
    found = {r["at"]: r["n"] for r in rows.select("text").mapInArrow(_frequencies, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}  # WIDTH rows
    total = found.pop(-1, 0)
    seen = np.zeros(WIDTH)
    seen[list(found)] = list(found.values())
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32) if total else np.zeros(WIDTH, np.float32)
    weights = spark.sparkContext.broadcast(idf)

    def clustered(part: pa.Table) -> pa.Table:
        texts = sorted(part.column("text").to_pylist())
        x = _scaled(np.vstack(list(_dense(texts))) * weights.value)
        centres = _clusters(x, CENTROIDS).astype("<f4")
        return pa.table({"lang": pa.array([part.column("lang")[0].as_py()] * len(centres), pa.string()), "k": pa.array(range(len(centres)), pa.int32()), "centre": pa.array([c.tobytes() for c in centres], pa.binary())})

    made = sorted((r["lang"], r["k"], r["centre"]) for r in rows.groupBy("lang").applyInArrow(clustered, "lang string, k int, centre binary").collect())  # CENTROIDS rows a language
    languages = sorted({lang for lang, _, _ in made})
    owner = np.array([languages.index(lang) for lang, _, _ in made], int)
    centroids = np.array([np.frombuffer(c, "<f4") for _, _, c in made], np.float32).reshape(-1, WIDTH)
    near = spark.sparkContext.broadcast((idf, centroids))

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, centroids = near.value
        for batch in batches:
            for x in _dense(batch.column(0).to_pylist()):
                cosine = _scaled(x * idf) @ centroids.T
                which = cosine.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array((1 - cosine[np.arange(len(which)), which]).astype(float))], ["k", "away"])

    radius = np.ones(len(centroids))
    if languages:
        for r in rows.select("text").mapInArrow(away, "k long, away double").groupBy("k").agg(F.percentile("away", INSIDE).alias("r")).collect():
            radius[r["k"]] = r["r"]
    drop(rows)
    return Model(languages, owner, centroids, idf, radius)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(text, lang) of the row with the smallest hashes of id and text of each of ``per_language`` buckets of ids, by language."""
    h, t = F.xxhash64(id_column), F.xxhash64(text_column)
    own = docs.filter(F.col(lang_column).isNotNull()).select(F.col(lang_column).alias("_lang"), F.pmod(h, F.lit(per_language)).alias("_bucket"), F.struct(h.alias("h"), t.alias("t")).alias("_key"), F.col(text_column).alias("_text"))
    # a written table has a size that Spark knows, so it broadcasts these few rows a language instead of shuffling texts, unless there are very many
    chosen = saved(own.groupBy("_lang", "_bucket").agg(F.min("_key").alias("_key")), "chosen")
    rows = own.join(chosen, ["_lang", "_bucket", "_key"]).dropDuplicates(["_lang", "_bucket"])
    return within_budget(rows, "_lang", "_text").select(F.col("_text").alias("text"), F.col("_lang").alias("lang"))


def identify(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (cosine) and rejected, all columns kept."""
    at, names = docs.columns.index(text_column), [*docs.columns, "lang_pred", "score", "rejected"]
    known = docs.sparkSession.sparkContext.broadcast(model)  # at most CENTROIDS rows of WIDTH floats a language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score, rejected = known.value.predict(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score), pa.array(rejected)], names)

    return bounded(docs).mapInArrow(predict, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(sample(docs.filter(remainder("doc_id", 4) != 2)))
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
