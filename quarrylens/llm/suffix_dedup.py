"""Operator 1: removal of repeated byte strings by prefix-free parsing.

A byte is removed if a string of ``SPAN`` (200) bytes that covers it starts anywhere else too.

1. Parse. A rolling hash over ``TRIGGER`` bytes is taken at every byte; the trigger of a start i is the place of the
   smallest hash (the rightmost of equals) among the ``SPAN // 2 + 1`` places from i on. Triggers depend only on
   the bytes of the string that starts at i, so equal strings have their triggers at the same offset. The starts of one trigger, up to
   the end of its hashed bytes, are a phrase. The parse suffix of a phrase is the text from its trigger on.
2. Prune. A phrase whose parse suffix begins like no other one in the corpus, by the hash of ``SPAN // 2`` bytes that all strings of
   the phrase hold, has no repeated string, and goes. Equal phrases with equal parse suffixes are one entry with a count; all
   strings of an entry that occurs twice are repeated.
3. Order. Entries whose parse suffixes begin alike are brought together. Their distinct phrases are the dictionary, whose suffix array is
   built by prefix doubling; their parse suffixes are sorted, with the common prefixes of neighbours. No phrase's suffix is
   a prefix of another's, so the two combine into the order of all strings, byte by byte, and a string is repeated if it shares
   ``SPAN`` bytes with a neighbour.
4. Starts so found are gathered by document and the bytes that they cover are cut out.

Groups of more than ``GROUP`` entries aren't ordered but halved by hashes: an entry's starts are cut into ranges by their distance from the trigger
(``RANGES``). If no other entry holds the bytes that all strings of a range share, none of them is repeated; if another one holds all bytes of the
range, all are; and only what is left is cut finer, down to single strings, beside one entry of each kind that is found, as it may hold a part of
them. So an entry costs a few rows in place of one for each
of its strings, no group has to fit in one task and none is cut short. Keys are hashes of 64 bits: that entries are one, and that strings of
such groups are equal, is not compared byte by byte.

Null and empty texts, and texts under 200 bytes, lose nothing. Rows are known by where they are stored: ids may repeat or be null,
repeated rows are copies of each other, and other columns don't matter. A very long text is parsed ``PIECE`` bytes at a time.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.kernels import POWERS, blocks, prefix_sums, random_words, spans_hash
from quarrylens.llm.scratch import bounded, files_for, saved, table, unused, with_row_key

SPAN, TRIGGER = 200, 16
REACH = SPAN // 2 + 1
#: dictionary entries of one parse suffix that are ordered by one task at most, and entries that are ordered at a time
GROUP, CHUNK = 200, 4_000
#: how many starts the ranges of a larger group have, round by round
RANGES = (16, 4, 1)
PIECE = 1 << 19
_VALUES = random_words(1, 256)
_PLACE = np.uint64((1 << 24) - 1)
_SEGMENT = 1 << 22
_KEY = "struct<file:bigint,row:bigint>"


def _rightmost_least(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each i the rightmost place of the smallest hash in [i, i + width)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if n > _SEGMENT:  # so that places fit in 24 bits; every window lies in one segment
        return np.concatenate([lo + _rightmost_least(hashes[lo : min(len(hashes), lo + _SEGMENT + width - 1)], width) for lo in range(0, n, _SEGMENT)])
    tagged = (hashes & ~_PLACE) | (_PLACE - np.arange(len(hashes), dtype=np.uint64))
    padded = np.full(-(-len(tagged) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(tagged)] = tagged
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    return (_PLACE - (least & _PLACE)).astype(np.int64)


class Parse:
    """The phrases of a block: document, first and last start, trigger (places in the block)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.sums = prefix_sums(_VALUES[data], POWERS)
        at = np.arange(max(0, len(data) - TRIGGER + 1))
        hashes = spans_hash(self.sums, at, at + TRIGGER, POWERS)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        starts = np.arange(max(0, len(data) - SPAN + 1))
        starts = starts[owner[: len(starts)] == owner[SPAN - 1 :]] if len(starts) else starts
        trigger = _rightmost_least(hashes, REACH)[starts] if len(starts) else starts
        first = np.ones(len(starts), bool)
        # strings of different documents never share a trigger: it lies inside the string
        first[1:] = trigger[1:] != trigger[:-1]
        heads = np.flatnonzero(first)
        self.trigger, self.first = trigger[heads], starts[heads]
        self.last = starts[np.append(heads[1:], len(starts)) - 1] if len(starts) else starts
        self.doc = owner[self.first] if len(starts) else starts

    def suffix_keys(self) -> np.ndarray:
        return spans_hash(self.sums, self.trigger, self.trigger + SPAN // 2, POWERS).view(np.int64)

    def entry_keys(self) -> np.ndarray:
        return spans_hash(self.sums, self.first, self.last + SPAN, POWERS).view(np.int64)


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place in its text, bytes, offsets): blocks of documents, and of longer ones parts that hold each start's string once."""
    for lo, hi, data, offsets in blocks(column):
        if hi - lo > 1 or len(data) <= PIECE:
            yield lo, 0, data, offsets
            continue
        for at in range(0, len(data) - SPAN + 1, PIECE):
            part = data[at : at + PIECE + SPAN - 1]
            yield lo, at, part, np.array([0, len(part)])


def _suffix_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in pieces(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(Parse(data, offsets).suffix_keys())], ["c"])


def _phrase_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, at, data, offsets in pieces(batch.column(1)):
            p = Parse(data, offsets)
            first = at + p.first - offsets[p.doc]
            # the length and the trigger's offset share one column
            shape = (p.last - p.first) * 256 + (p.trigger - p.first)
            yield pa.RecordBatch.from_arrays([pa.array(p.suffix_keys()), pa.array(p.entry_keys()), batch.column(0).take(pa.array(lo + p.doc)), pa.array(first.astype(np.int32)), pa.array(shape.astype(np.int32))], ["c", "u", "key", "first", "shape"])


def _cut_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the phrases asked for, with their parse suffixes: of each text the rows of ``asked`` (c, large, first, shape)."""
    names = ["c", "large", "key", "first", "shape", "bytes"]
    for batch in batches:
        keys, texts, asked = batch.columns
        ends, rows = asked.offsets.to_numpy(), asked.values
        for k in range(batch.num_rows):
            raw = texts[k].as_buffer()
            for lo in range(ends[k], ends[k + 1], 4_096):
                part = rows.slice(lo, min(4_096, ends[k + 1] - lo))
                c, large, first, shape = part.flatten()
                begin = first.to_numpy()
                cut = [raw[a:b].to_pybytes() for a, b in zip(begin.tolist(), (begin + shape.to_numpy() // 256 + SPAN).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([c, large, pa.repeat(keys[k], len(part)), first, shape, pa.array(cut, pa.binary())], names)


def dictionary_suffixes(phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rank of every suffix among those of the distinct phrases, where each phrase's suffixes begin), by prefix doubling; equal suffixes have equal ranks."""
    distinct = sorted(set(phrases))
    begins = np.concatenate([[0], np.cumsum([len(p) for p in distinct])])
    known = dict(zip(distinct, begins.tolist(), strict=False))
    data = np.frombuffer(b"".join(distinct), np.uint8).astype(np.uint64) + np.uint64(1)  # 0: the phrase has ended
    n = len(data)
    left = np.repeat(begins[1:], np.diff(begins)) - np.arange(n)
    key, width = np.zeros(n, np.uint64), 7
    for k in range(width):
        ahead = np.zeros(n, np.uint64)
        ahead[: n - k] = data[k:]
        key = key << np.uint64(9) | np.where(left > k, ahead, np.uint64(0))
    rank = np.unique(key, return_inverse=True)[1]
    while width < left.max(initial=0) and rank.max() + 1 < n:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1
        rank = np.unique(rank * (n + 1) + np.where(left > width, ahead, 0), return_inverse=True)[1]
        width *= 2
    return rank, np.array([known[p] for p in phrases], np.int64)


def repeated(cut: list[bytes], triggers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each start of each entry: (entry, offset, repeated among these)."""
    # parse suffixes, sorted, and the common prefixes of neighbours
    right = np.zeros((len(cut), SPAN), np.uint8)
    for k, (b, t) in enumerate(zip(cut, triggers.tolist(), strict=True)):
        tail = b[t : t + SPAN]
        right[k, : len(tail)] = np.frombuffer(tail, np.uint8)
    order = np.argsort(right.view(f"S{SPAN}").ravel(), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    differs = right[order][1:] != right[order][:-1]
    lcp = np.where(differs.any(axis=1), differs.argmax(axis=1), SPAN) if len(order) > 1 else np.zeros(0, np.int64)
    # the dictionary's suffixes, one for each start
    suffixes, begins = dictionary_suffixes([b[: t + TRIGGER] for b, t in zip(cut, triggers.tolist(), strict=True)])
    entry = np.repeat(np.arange(len(cut)), lengths + 1)
    offset = np.arange(len(entry)) - np.repeat(np.cumsum(lengths + 1) - (lengths + 1), lengths + 1)
    suffix = suffixes[begins[entry] + offset]
    # corpus order: by the dictionary's suffix, then by the parse suffix
    both = np.argsort(suffix * len(cut) + rank[entry], kind="stable")
    found = np.zeros(len(entry), bool)
    same = np.flatnonzero(suffix[both][1:] == suffix[both][:-1])
    a, b = both[same], both[same + 1]
    common = _least_between(lcp, rank[entry[a]], rank[entry[b]]) + triggers[entry[a]] - offset[a]
    found[a[common >= SPAN]] = True
    found[b[common >= SPAN]] = True
    return entry, offset, found


def _least_between(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The smallest of x[lo:hi] for each pair lo < hi, by tables of powers of two."""
    tables = [x]
    while 2 ** len(tables) <= len(x):
        t, step = tables[-1], 2 ** (len(tables) - 1)
        tables.append(np.minimum(t[:-step], t[step:]))
    out = np.full(len(lo), SPAN, np.int64)
    level = np.log2(np.maximum(hi - lo, 1)).astype(np.int64)
    for k in np.unique(level):
        at = np.flatnonzero((level == k) & (hi > lo))
        out[at] = np.minimum(tables[k][lo[at]], tables[k][hi[at] - 2**k])
    return out


def _ordered(rows: pa.Table) -> pa.RecordBatch:
    """The repeated runs of whole groups."""
    shape, first = rows["shape"].to_numpy(), rows["first"].to_numpy()
    entry, offset, found = repeated(rows["bytes"].to_pylist(), shape % 256, shape // 256)
    before = np.concatenate([[False], found[:-1] & (entry[1:] == entry[:-1])])
    after = np.concatenate([found[1:] & (entry[1:] == entry[:-1]), [False]])
    at, end = np.flatnonzero(found & ~before), np.flatnonzero(found & ~after)
    place = lambda x: pa.array((first[entry[x]] + offset[x]).astype(np.int32))
    return pa.RecordBatch.from_arrays([rows["key"].combine_chunks().take(pa.array(entry[at])), place(at), place(end)], ["key", "lo", "hi"])


def _order_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by c; whole groups are ordered together, about ``CHUNK`` entries at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = [b.column(0).to_numpy() for b in (*held[-1:], batch)]
        changes = np.flatnonzero(groups[-1][1:] != groups[-1][:-1]) + 1
        if held and groups[0][-1] != groups[1][0]:
            changes = np.concatenate([[0], changes])
        begin, size = 0, sum(b.num_rows for b in held)
        for at in changes.tolist():
            if size + at - begin >= CHUNK:
                yield _ordered(pa.Table.from_batches([*held, batch.slice(begin, at - begin)]))
                held, begin, size = [], at, 0
        held.append(batch.slice(begin))
    if held:
        yield _ordered(pa.Table.from_batches(held))


def _range_pass(width: int):
    """Of entries with the ranges asked for (key, first, shape, bytes, ranges): each range with the hash of what its strings share, and of all their bytes."""
    names = ["key", "first", "at", "lo", "hi", "clip", "core", "all"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, first, shape, cut, ranges = batch.columns
            entry = np.repeat(np.arange(batch.num_rows), ranges.value_lengths().to_numpy())
            at = ranges.flatten().to_numpy().astype(np.int64)
            raw = cut.to_pylist()
            sums = prefix_sums(_VALUES[np.frombuffer(b"".join(raw), np.uint8)], POWERS)
            most = shape.to_numpy()[entry].astype(np.int64) % 256  # the first start is the farthest from the trigger
            least = most - shape.to_numpy()[entry] // 256
            near, far = np.maximum(at, least), np.minimum(at + width - 1, most)
            trigger = np.concatenate([[0], np.cumsum([len(b) for b in raw])])[entry] + most
            core = spans_hash(sums, trigger - at, trigger + SPAN - (at + width - 1), POWERS)
            whole = spans_hash(sums, trigger - far, trigger + SPAN - near, POWERS)
            place = lambda x: pa.array((first.to_numpy()[entry] + most - x).astype(np.int32))  # noqa: E731,B023
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(entry)), first.take(pa.array(entry)), pa.array(at.astype(np.int32)), place(far), place(near), pa.array((near * 256 + far).astype(np.int32)), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64))], names)

    return hashed


def repeated_ranges(entries: DataFrame, files: int) -> DataFrame | None:
    """(key, lo, hi) of the starts whose strings another one of ``entries`` (key, first, shape, bytes) holds; none if there are no entries."""
    if entries.isEmpty():
        return None
    most = F.col("shape") % 256
    least = most - F.floor(F.col("shape") / 256)
    cut_finer = lambda x, width: F.floor(x / width)
    asked = entries.withColumn("ranges", F.transform(F.sequence(cut_finer(least, RANGES[0]), cut_finer(most, RANGES[0])), lambda x: (x * RANGES[0]).cast("int")))
    found = None
    for width, finer in zip(RANGES, [*RANGES[1:], 0], strict=True):
        kind = f"key {_KEY}, first int, at int, lo int, hi int, clip int, core long, all long"
        rows = saved(asked.select("key", "first", "shape", "bytes", "ranges").mapInArrow(_range_pass(width), kind), "ranges", files)
        own = F.struct("key", "first")
        whole = saved(rows.groupBy("clip", "all").agg(F.count("*").alias("n"), F.min(own).alias("one")).filter("n > 1").drop("n"), "whole", files)
        held = rows.join(whole, ["clip", "all"], "left")
        held = saved(held, "held", files) if finer else held
        runs = held.filter("one is not null").select("key", "lo", "hi")
        found = runs if found is None else found.unionByName(runs)
        if finer:  # ranges that are left, and one of each kind that is found, which they may hold a part of
            alike = saved(held.groupBy("at", "core").agg(F.count("*").alias("n"), F.count_if(F.col("one").isNull()).alias("open")).filter("n > 1 and open > 0").select("at", "core"), "alike", files)
            parts = F.transform(F.sequence(F.lit(0), F.lit(width // finer - 1)), lambda k: (F.col("at") + k * finer).cast("int"))
            left = held.join(alike, ["at", "core"], "left_semi").filter(F.col("one").isNull() | (F.col("one") == own)).groupBy("key", "first").agg(F.flatten(F.collect_list(parts)).alias("ranges"))
            asked = entries.join(left, ["key", "first"]).withColumn("ranges", F.filter("ranges", lambda x: (x <= most) & (x + finer > least)))
    return found


def kept_bytes(raw: bytes, runs: list[dict] | None) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs); ``runs``: first and last starts of repeated strings."""
    if not runs:
        return raw, 0, 0
    out, removed, spans, end = [], 0, 0, -1
    at = 0
    for lo, hi in sorted((r["lo"], r["hi"]) for r in runs):
        if lo > end:
            out.append(raw[at:lo])
            spans += 1
            removed += hi + SPAN - lo
            at = end = hi + SPAN
        elif hi + SPAN > end:
            removed += hi + SPAN - end
            at = end = hi + SPAN
    out.append(raw[at:])
    return b"".join(out), removed, spans


def repeated_runs(rows: DataFrame) -> DataFrame:
    """(key, runs) of the ``rows`` (key, text) that hold repeated strings."""
    files = files_for(rows.count())
    rows = bounded(rows)
    twice = rows.select("text").mapInArrow(_suffix_pass, "c long").groupBy("c").agg(F.count("*").alias("n")).filter("n > 1").select("c")
    twice = saved(twice, "twice", files)  # both sides of the join are then dealt out anew, and frequent keys split
    phrases = rows.select("key", "text").mapInArrow(_phrase_pass, f"c long, u long, key {_KEY}, first int, shape int")
    alike = saved(phrases.join(twice, "c"), "phrases", files)
    entries = alike.groupBy("c", "u").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "shape")).alias("r"))
    entries = saved(entries, "entries", files)
    groups = saved(entries.groupBy("c").agg(F.count("*").alias("entries")).filter("entries > 1"), "groups", files)
    asked = entries.join(groups, "c").select(F.col("r.key").alias("key"), F.struct("c", (F.col("entries") > GROUP).alias("large"), F.col("r.first").alias("first"), F.col("r.shape").alias("shape")).alias("a"))
    asked = asked.groupBy("key").agg(F.collect_list("a").alias("asked"))
    cut = rows.join(asked, "key").select("key", "text", "asked")
    cut = saved(cut.mapInArrow(_cut_pass, f"c long, large boolean, key {_KEY}, first int, shape int, bytes binary"), "cut")
    found = cut.filter("not large").repartition("c").sortWithinPartitions("c").mapInArrow(_order_pass, f"key {_KEY}, lo int, hi int")
    across = repeated_ranges(cut.filter("large").select("key", "first", "shape", "bytes"), files)
    found = found if across is None else found.unionByName(across)
    whole = alike.join(saved(entries.filter("n > 1").select("c", "u"), "whole", files), ["c", "u"]).select("key", F.col("first").alias("lo"), (F.col("first") + F.floor(F.col("shape") / 256)).cast("int").alias("hi"))
    return found.unionByName(whole).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))


def _with_runs(docs: DataFrame, text_column: str) -> tuple[DataFrame, str]:
    """``docs`` with the repeated runs of each text, and that column's name; the row's key is its last column."""
    key, runs = unused(docs, "row"), unused(docs, "runs")
    rows = with_row_key(docs, key)
    found = repeated_runs(rows.select(F.col(key).alias("key"), F.col(text_column).alias("text")))
    return rows.join(found.select(F.col("key").alias(key), F.col("runs").alias(runs)), key, "left"), runs


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each document; kept: the remaining bytes."""
    own, runs = _with_runs(docs, text_column)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [((text.as_py() or "").encode(), r.as_py()) for text, r in zip(batch.column(1), batch.column(2), strict=True)]
            left = [kept_bytes(raw, r) for raw, r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(raw) for raw, _ in rows], pa.int64()), pa.array([x[1] for x in left], pa.int64()), pa.array([x[2] for x in left], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in left], pa.string()), pa.array([x[0] for x in left], pa.binary())], names)

    names = [id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    kind = docs.schema[id_column].dataType.simpleString()
    return bounded(own.select(id_column, text_column, runs)).mapInArrow(cut, f"`{id_column}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept").withColumn("doc_id", F.col("doc_id").cast("long"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without repeated strings; bytes of a character cut in two go with it. n_chars follows the text."""
    own, runs = _with_runs(docs, "text")
    at, names = docs.columns.index("text"), docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text.as_py() if text.as_py() is None or not r.as_py() else kept_bytes(text.as_py().encode(), r.as_py())[0].decode(errors="ignore") for text, r in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True)]
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    left = bounded(own.select(*names, runs)).mapInArrow(cut, docs.schema)
    return left.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else left
