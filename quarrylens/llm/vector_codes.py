"""Operator 12: product codes of vectors, with VA-file filtering of codebook entries.

Vectors of integers are cut into equal parts; each part position has a codebook, fitted by rounds of assigning every part to its
nearest entry and replacing entries by the floored means of their parts. The nearest entry is found as in a VA-file: the
coordinates of entries are quantised to ``BITS`` bits, so an entry is a row of cells; for each query a table of the least and the largest
squared distance from its coordinates to each cell turns an entry's cells into a lower and an upper bound; and only entries whose lower
bound doesn't exceed the least upper bound are compared by integer distances. The bounds hold always, so the result is exact.

A round is one pass over blocks of vectors: a task sums the parts of each entry and sends these sums once, so neither a label nor an entry that a
third of all rows share is a group in one task. The driver holds codebooks only: ``ENTRIES`` rows, however many vectors there are.

Rows with a null vector, or with null or non-finite components, are dropped, and so are vectors of another length than that of the
smallest id. A length that isn't a multiple of the number of parts is filled up with zeros. Repeated ids and equal rows are
rows of their own; a null id comes last, and ties for the first entries go by the vectors. With fewer rows than entries, codebooks have as many entries as rows. An empty table
gives an empty result; other columns don't matter. Components whose squared distances don't fit doubles (2**53) are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.scratch import bounded, drop, saved, table
from quarrylens.llm.vectors import EXACT, floored, in_blocks, is_whole, unpacked

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BITS = 3
CHUNK = 1024


class Cells:
    """The entries of a codebook, quantised to at most 2**BITS cells a coordinate with about as many entries each."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        n, width = entries.shape
        cells = 1 << bits
        order = np.sort(entries, 0)
        starts = order[np.arange(cells) * n // cells]  # (cell, coordinate); the first one is the least coordinate
        cell = np.stack([np.searchsorted(np.unique(starts[:, d]), entries[:, d], "right") - 1 for d in range(width)], 1) if width else np.zeros((n, 0), np.int64)
        self.low, self.high = np.zeros((width, cells)), np.zeros((width, cells))
        self.member = np.zeros((width, cells, n))  # 1 where the entry lies in the cell
        for d in range(width):
            self.member[d, cell[:, d], np.arange(n)] = 1
            for c in range(cells):
                inside = entries[cell[:, d] == c, d]
                if len(inside):
                    self.low[d, c], self.high[d, c] = inside.min(), inside.max()
        self.member = self.member.reshape(width * cells, n)

    def candidates(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, entry), in this order, that the bounds leave; each query has one at least."""
        x = queries[:, :, None].astype(np.float64)
        below, above = self.low - x, x - self.high
        nearest, farthest = np.maximum(np.maximum(below, above), 0), np.maximum(np.abs(x - self.low), np.abs(x - self.high))
        least, most = ((y * y).reshape(len(queries), -1) @ self.member for y in (nearest, farthest))
        return np.nonzero(least <= most.min(1)[:, None])

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each query's nearest entry, the first one among equally near."""
        index, distance = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for lo in range(0, len(queries), CHUNK):
            part = queries[lo : lo + CHUNK]
            q, e = self.candidates(part)
            apart = part[q] - self.entries[e]
            d = np.einsum("ij,ij->i", apart, apart)
            starts = np.searchsorted(q, np.arange(len(part)))
            least = np.minimum.reduceat(d, starts)
            hits = np.flatnonzero(d == least[q])
            first = hits[np.searchsorted(q[hits], np.arange(len(part)))]
            index[lo : lo + CHUNK], distance[lo : lo + CHUNK] = e[first], least
        return index, distance


def _parts(vectors: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(vectors.astype(np.int64), parts, 1)


def _refined(blocks: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, length = books.shape
    fields = [f"s{d}" for d in range(length)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        total, n = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                for p, x in enumerate(_parts(unpacked(batch, k, width)[4], parts)):
                    index, _ = cells[p].nearest(x)
                    order = np.argsort(index, kind="stable")
                    used, starts = np.unique(index[order], return_index=True)
                    total[p, used] += np.add.reduceat(x[order], starts, 0)
                    n[p] += np.bincount(index, minlength=entries)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(n[p, e]), *(pa.array(total[p, e, d]) for d in range(length))], ["part", "entry", "n", *fields])

    found = bounded(blocks).mapInArrow(sums, ", ".join(f"{c} long" for c in ["part", "entry", "n", *fields]))
    out = books.copy()
    for part, entry, n, *s in found.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ["n", *fields])).collect():  # parts x entries rows
        out[part, entry] = [x // n for x in s]
    return out


def codes(
    rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error), codebooks): the code and the squared error of each vector, and the fitted codebooks (part, entry, position)."""
    kept = rows.filter(is_whole(vector)).select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.lit(0).cast("long").alias("number"), floored(vector, scale).alias("vector"))
    order = [F.asc_nulls_last("id"), F.asc("vector")]
    schema = f"`{id_column}` long, `{label}` long, code string, error long"
    if not (one := kept.orderBy(*order).head(1)):
        return rows.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    length = len(one[0]["vector"])
    width = -(-length // parts) * parts
    kept = kept.filter(F.size("vector") == length).withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0).cast("long"), width - length)))
    count, largest = kept.agg(F.count("*"), F.max(F.aggregate("vector", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double")))))).first()
    if width * (2 * largest) ** 2 >= EXACT or largest >= 1 << 31:
        raise ValueError("squared distances of 2**53 or more")
    books = np.array([r["vector"] for r in kept.orderBy(*order).limit(entries).collect()], np.int64).reshape(-1, parts, width // parts).transpose(1, 0, 2).copy()
    blocks = in_blocks(kept, width, count, "vectors")
    for _ in range(rounds):
        books = _refined(blocks, books, width)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        hexes = np.array([f"{x:02x}" for x in range(max(256, entries))], object)
        for batch in batches:
            for k in range(batch.num_rows):
                _, ids, labels, _, vectors = unpacked(batch, k, width)
                found = [cells[p].nearest(x) for p, x in enumerate(_parts(vectors, parts))]
                code = ["".join(x) for x in zip(*(hexes[index] for index, _ in found), strict=True)]
                error = sum(d for _, d in found)
                yield pa.RecordBatch.from_arrays([pa.array(ids[:, 1], mask=ids[:, 0] > 0), pa.array(labels[:, 1], mask=labels[:, 0] > 0), pa.array(code, pa.string()), pa.array(error)], [id_column, label, "code", "error"])

    out = saved(bounded(blocks).mapInArrow(coded, schema), "codes")
    drop(blocks)
    return out, books


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with the sum of errors over the rows of equal label, nulls together."""
    sums = coded.groupBy(F.col(label).alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col(label).eqNullSafe(F.col("of"))).drop("of")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes(table(spark, sf_dir, "embeddings"))
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
