"""Operator 13: token ids in binary files, with a minimal perfect hash index for access by document key.

``write`` encodes documents in ascending order of their keys and writes the ids raw, little-endian, into shards of about ``SHARD_BYTES``:
tasks take ranges of keys, so shards follow each other as keys do. A shard is ``MAGIC``, the ids of its documents one after
another, then where each of them starts, and a footer. Its name is new for each attempt, and only shards that the table of shards lists
count: a task that fails or runs twice leaves a file that nothing reads.

The index maps keys to places. Keys are dealt by hash into buckets of about ``BUCKET`` keys; a bucket has a minimal perfect hash
(levels of bits: a key takes the first level at which no other one shares its bit, and its number is the rank of that bit), and by number
a 32-bit fingerprint and the key's runs of documents: shard, first document, documents. ``read`` takes a table of keys: it joins them with their buckets,
finds each one's number in constant time, drops those whose fingerprint differs, and reads the ids at their offsets. A key that isn't
there yields no row, but for a chance of 2**-32.

Keys are integers; rows with equal keys are runs of documents in the order in which they are stored, and all are read. The key null comes last and has a bucket of
its own. A null text counts as empty and has the end id alone; long texts are encoded in parts. An empty table gives no shards, an empty index and
no rows. Other columns don't matter.
"""

from __future__ import annotations

import re
import struct
import sys
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.llm.kernels import mix
from quarrylens.llm.scratch import bounded, drop, folder, saved, table, unused, with_row_key
from quarrylens.llm.token_counts import BATCH_BYTES, HELD_BYTES, KEPT_BYTES, LONGEST, TOKENIZER, Counter, broken, parts

END = 2
SHARD_BYTES = 64 << 20
READ_BYTES, GAP_BYTES = 4 << 20, 1 << 16
BUCKET = 1024
KEPT = 420_000
SPECIAL = b"<|"
_STEM = re.compile("([a-zß-öø-ÿÀ-ÖØ-Þ]+)([!-&(-/:-@\\[-`{-~]*)")
MAGIC = b"TOKENIDS"
_FOOTER = struct.Struct("<QQI4s")  # documents, ids, bytes of an id


# ---------------------------------------------------------------- ids of texts


class Encoder(Counter):
    """Token ids as bytes, with the pieces and boundaries that token counts rest on; the pieces met last are kept."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        spelt = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = str.maketrans({c: spelt(c.lower())[0][0] for c in map(chr, range(0xC0, 0x100)) if c.isalpha()})
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _batch(self, pieces: list[bytes]) -> Iterable[bytes]:
        words = [p.decode() for p in pieces]
        whole = self.tokenizer.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0]
        ids, owners = np.array(whole.ids, self.kind), whole.word_ids
        if None in owners:
            return [np.array(x.ids, self.kind).tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        ends = np.cumsum(np.bincount(np.array(owners, np.int64), minlength=len(words))) * self.kind.itemsize
        raw, starts = ids.tobytes(), [0, *ends[:-1].tolist()]
        return [raw[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]

    def _whole(self, pieces: Iterable[bytes]) -> None:
        """Learns pieces by the whole tokenizer, in batches of equal bytes."""
        batch: list[bytes] = []
        held = 0
        for p in pieces:
            batch.append(p)
            held += len(p)
            if held >= BATCH_BYTES:
                self.known.update(zip(batch, self._batch(batch), strict=True))
                batch, held = [], 0
        if batch:
            self.known.update(zip(batch, self._batch(batch), strict=True))

    def _missing(self, pieces: Iterable[bytes]) -> list[bytes]:
        """Those pieces that aren't known; what was known before is known again."""
        known, older, out = self.known, self.older, []
        for p in pieces:
            if p not in known:
                if (ids := older.get(p)) is not None:
                    known[p] = ids
                else:
                    out.append(p)
        return out

    def _learn(self, new: set[bytes]) -> list[bytes]:
        """Learns pieces. Latin letters are a match of their own before ASCII characters other than letters, digits and apostrophes, and none of them
        composes with another, so the model gets them as they are, past the normaliser and the pattern."""
        learnt = self._missing(new)
        split: dict[bytes, tuple[bytes, bytes]] = {}
        stems: set[bytes] = set()
        for p in learnt:
            if m := _STEM.fullmatch(p.decode()):
                stem, tail = m.groups()
                if tail:
                    split[p] = stem.encode(), tail.encode()
                else:
                    stems.add(p)
        stems.update(self._missing({s for s, _ in split.values()} - stems))
        merge, letters, code, kind, known = self.tokenizer.model.tokenize, self.letters, struct.pack, self.kind.char, self.known
        for p in stems:
            ids = [x.id for x in merge(p.decode().translate(letters))]
            known[p] = code(f"<{len(ids)}{kind}", *ids)
        tails = self._missing({t for _, t in split.values()})
        self._whole(chain(tails, (p for p in learnt if p not in split and p not in stems)))
        for p, (stem, tail) in split.items():
            known[p] = known[stem] + known[tail]
        return [*learnt, *stems, *tails]

    def _pieces_of(self, texts: list[bytes]) -> Iterator[bytes]:
        # at ASCII white space; the tokenizer lower-cases all but special strings
        split = [(t if SPECIAL in t else t.lower()).split() for t in texts]
        new = set(chain.from_iterable(split)).difference(self.known)
        if any(len(p) > LONGEST for p in new):  # none of these is kept
            split = [[q for p in ps for q in (broken(p) if len(p) > LONGEST else (p,))] for ps in split]
            new = set(chain.from_iterable(split)).difference(self.known)
        learnt = self._learn(new)
        known = self.known
        for ps in split:
            yield b"".join(map(known.__getitem__, ps))
        for p in learnt:
            if len(p) > KEPT_BYTES:
                known.pop(p, None)
        if len(known) > KEPT:
            self.known, self.older = {}, known

    def encoded(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        batch: list[bytes] = []
        held = 0
        for text in texts:
            if len(text) > HELD_BYTES:
                yield from self._pieces_of(batch)
                batch, held = [], 0
                yield b"".join(x for part in parts(text) for x in self._pieces_of([part]))
                continue
            batch.append(text)
            held += len(text)
            if held >= HELD_BYTES:
                yield from self._pieces_of(batch)
                batch, held = [], 0
        yield from self._pieces_of(batch)


def encoder(name: str = TOKENIZER) -> Encoder:
    """Loaded once for each Python worker."""
    import public_tokenizers

    held = sys.modules.setdefault("_quarrylens_encoders", type(sys)("_quarrylens_encoders")).__dict__
    if name not in held:
        held[name] = Encoder(str(public_tokenizers.path(name)))
    return held[name]


# ---------------------------------------------------------------- minimal perfect hash of a bucket


def _level(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(mix(keys.astype(np.uint64)) ^ np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64) + np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)).astype("<u4")


def perfect(keys: np.ndarray) -> list[np.ndarray]:
    """The levels of a minimal perfect hash of distinct integers: arrays of 0 and 1."""
    levels = []
    while len(keys):
        size = 64 * -(-2 * len(keys) // 64)
        at = (_level(keys, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone.astype(np.uint8))
        keys = keys[~alone[at]]
    return levels


def numbers(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The number of each key, from 0; -1 where no level has a bit for it."""
    out, left, base = np.full(len(keys), -1), np.arange(len(keys)), 0
    for k, bits in enumerate(levels):
        rank = np.cumsum(bits, dtype=np.int64)
        at = (_level(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at] == 1
        out[left[hit]] = base + rank[at[hit]] - 1
        base, left = base + int(rank[-1]), left[~hit]
    return out


_INDEX = "bucket long, levels binary, sizes array<long>, fingerprints binary, starts binary, runs binary"


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket: its hash, and fingerprints and runs in the order of the keys' numbers."""
    for batch in batches:
        for row in batch.to_pylist():
            keys = np.array([e["key"] or 0 for e in row["entries"]], np.int64)
            levels = perfect(keys)
            order = np.argsort(numbers(levels, keys))
            runs = [[(r["shard"], r["first"], r["docs"]) for r in row["entries"][i]["runs"]] for i in order]
            starts = np.cumsum([0, *map(len, runs)])
            out = [row["bucket"], np.packbits(np.concatenate(levels)).tobytes(), [len(x) for x in levels], fingerprint(keys[order]).tobytes(), starts.astype("<i8").tobytes(), np.array(list(chain.from_iterable(runs)), "<i8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()], strict=True)], ["bucket", "levels", "sizes", "fingerprints", "starts", "runs"])


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of the keys of each bucket, by its index."""
    for batch in batches:
        for k in range(batch.num_rows):
            get = lambda name: batch.column(name)[k]
            asked = get("keys").values
            keys = np.asarray(asked.fill_null(0)).astype(np.int64)
            sizes = get("sizes").as_py()
            levels = np.split(np.unpackbits(np.frombuffer(get("levels").as_buffer(), np.uint8))[: sum(sizes)], np.cumsum(sizes)[:-1])
            prints, starts = np.frombuffer(get("fingerprints").as_buffer(), "<u4"), np.frombuffer(get("starts").as_buffer(), "<i8")
            runs = np.frombuffer(get("runs").as_buffer(), "<i8").reshape(-1, 3)
            number = numbers(levels, keys)
            there = np.flatnonzero(number >= 0)
            there = there[prints[number[there]] == fingerprint(keys[there])]
            n = starts[number[there] + 1] - starts[number[there]]
            at = np.repeat(starts[number[there]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(np.repeat(there, n))), *(pa.array(runs[at, c]) for c in range(3))], ["key", "shard", "first", "docs"])


# ---------------------------------------------------------------- files


def _store(path: str):
    """The file system of a folder that all executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Shard:
    """A shard that is being written."""

    def __init__(self, where: str, width: int):
        store, path = _store(where)
        store.create_dir(path, recursive=True)
        self.name, self.width = f"ids-{uuid.uuid4().hex}.bin", width
        self.out = store.open_output_stream(f"{path}/{self.name}", buffer_size=1 << 20)
        self.out.write(MAGIC)
        self.ends = [0]

    def add(self, ids: bytes) -> int:
        self.out.write(ids)
        self.ends.append(self.ends[-1] + len(ids) // self.width)
        return len(self.ends) - 2

    def close(self) -> None:
        self.out.write(np.array(self.ends, "<u8").tobytes())
        self.out.write(_FOOTER.pack(len(self.ends) - 1, self.ends[-1], self.width, MAGIC[:4]))
        self.out.close()


_RUNS = "part long, nth long, name string, key long, first long, docs long, ids long"


def _written(batches: Iterator[pa.RecordBatch], where: str, tokenizer: str, end: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Writes sorted documents (key, text) and yields the runs of documents of one key in one shard."""
    coder = encoder(tokenizer)
    last = np.array([end], coder.kind).tobytes()
    part, nth, shard = TaskContext.get().partitionId(), 0, None
    rows: list[list] = []
    for batch in batches:
        keys = batch.column(0).to_pylist()
        texts = (x or b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist())
        for key, ids in zip(keys, coder.encoded(texts), strict=True):
            if shard is not None and shard.ends[-1] * shard.width >= shard_bytes:
                shard.close()
                nth, shard = nth + 1, None
            shard = shard or _Shard(where, coder.kind.itemsize)
            ids += last
            first = shard.add(ids)
            if rows and rows[-1][1:4] == [nth, shard.name, key]:
                rows[-1][5] += 1
                rows[-1][6] += len(ids) // shard.width
            else:
                rows.append([part, nth, shard.name, key, first, 1, len(ids) // shard.width])
        if len(rows) > 10_000:  # the last run may go on
            yield _batch(rows[:-1])
            rows = rows[-1:]
    if shard is not None:
        shard.close()
    yield _batch(rows)


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k == 2 else pa.int64()) for k, x in enumerate(columns)], ["part", "nth", "name", "key", "first", "docs", "ids"])


class Shard:
    """A written shard: where its documents start, and their ids."""

    def __init__(self, where: str, name: str):
        store, path = _store(where)
        self.file = store.open_input_file(f"{path}/{name}")
        size = self.file.size()
        docs, ids, self.width, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC[:4] or size != len(MAGIC) + ids * self.width + 8 * (docs + 1) + _FOOTER.size:
            raise OSError(f"{name} is no whole shard")
        self.ends = np.frombuffer(self.file.read_at(8 * (docs + 1), len(MAGIC) + ids * self.width), "<u8").astype(np.int64)

    def ids(self, first: int, end: int) -> bytes:
        """The bytes of the documents from ``first`` to before ``end``."""
        lo, hi = self.ends[first], self.ends[end]
        return self.file.read_at(int(hi - lo) * self.width, len(MAGIC) + int(lo) * self.width)


_DOCS = "key long, start long, n_tokens long, ids binary"


def _read(batches: Iterator[pa.RecordBatch], where: str) -> Iterator[pa.RecordBatch]:
    """The documents of runs (key, name, base, first, docs) that are sorted by shard and place, read in stretches of about ``READ_BYTES``."""
    opened: tuple[str, Shard] | None = None
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("key", "name", "base", "first", "docs")), strict=True))
        k = 0
        while k < len(rows):
            name, base = rows[k][1:3]
            if opened is None or opened[0] != name:
                opened = name, Shard(where, name)
            shard = opened[1]
            places: list[tuple[int | None, int]] = []  # key, document
            lo = end = rows[k][3]
            while k < len(rows) and rows[k][1] == name:
                key, _, _, first, docs = rows[k]
                if places and (first < end or (shard.ends[first] - shard.ends[end]) * shard.width > GAP_BYTES):
                    break
                # of a long run as much as fits; its rest is read next
                fits = int(np.searchsorted(shard.ends, shard.ends[lo] + READ_BYTES // shard.width, "right")) - 1
                n = min(docs, max(fits - first, 0 if places else 1))
                if not n:
                    break
                places += [(key, first + i) for i in range(n)]
                end = max(end, first + n)
                if n < docs:
                    rows[k] = (key, name, base, first + n, docs - n)
                    break
                k += 1
            raw = np.frombuffer(shard.ids(lo, end), f"<u{shard.width}").astype("<u4").tobytes()
            at = np.array([p for _, p in places], np.int64)
            starts, ends = shard.ends[at], shard.ends[at + 1]
            ids = [raw[4 * a : 4 * b] for a, b in zip((starts - shard.ends[lo]).tolist(), (ends - shard.ends[lo]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([key for key, _ in places], pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(ids, pa.binary())], ["key", "start", "n_tokens", "ids"])


@dataclass
class TokenFiles:
    """Written token ids: the folder, the shards (shard, name, base, docs, ids) and the index by bucket."""

    where: str
    shards: DataFrame
    index: DataFrame
    buckets: int

    @staticmethod
    def open(spark: SparkSession, where: str) -> TokenFiles:
        index = spark.read.parquet(f"{where}/index")
        return TokenFiles(where, spark.read.parquet(f"{where}/shards"), index.drop("buckets"), index.agg(F.max("buckets")).first()[0] or 1)


def _bucket(key: str, buckets: int):
    return F.when(F.col(key).isNull(), buckets).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)))


def write(docs: DataFrame, where: str | None = None, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = TOKENIZER, end: int = END, shard_bytes: int = SHARD_BYTES) -> TokenFiles:
    """Writes the ids of ``docs`` below ``where`` (by default a folder of its own in the shared one), in ascending order of their keys."""
    spark = docs.sparkSession
    where = where or f"{folder(spark)}/token-ids-{uuid.uuid4().hex}"
    keyed = with_row_key(docs, at := unused(docs, "at"))
    rows = keyed.select(F.col(id_column).cast("long").alias("key"), F.col(text_column).alias("text"), F.col(at).alias("at"))
    order = [F.asc_nulls_last("key"), F.asc("at")]  # the place too, so that rows of one key are dealt to many tasks
    dealt = bounded(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text"))
    runs = saved(dealt.mapInArrow(lambda b: _written(b, where, tokenizer, end, shard_bytes), _RUNS), "runs")

    per_shard = runs.groupBy("part", "nth", "name").agg(F.sum("docs").alias("docs"), F.sum("ids").alias("ids"))  # one row for SHARD_BYTES
    before = Window.orderBy("part", "nth")
    per_shard = per_shard.withColumns({"shard": F.row_number().over(before).cast("long"), "base": F.coalesce(F.sum("ids").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    per_shard.select("part", "nth", "shard", "name", "base", "docs", "ids").write.parquet(f"{where}/shards")
    shards = spark.read.parquet(f"{where}/shards")

    count = runs.count()  # of keys, but for those that cross shards
    buckets = max(1, -(-count // BUCKET))
    numbered = runs.join(shards.select("part", "nth", "shard"), ["part", "nth"])
    of_key = numbered.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("shard", "first", "docs"))).alias("runs"))  # a run for each shard at most
    grouped = of_key.groupBy(_bucket("key", buckets).alias("bucket")).agg(F.collect_list(F.struct("key", "runs")).alias("entries"))
    bounded(grouped).mapInArrow(_indexed, _INDEX).withColumn("buckets", F.lit(buckets).cast("long")).write.parquet(f"{where}/index")
    drop(runs)
    return TokenFiles(where, shards, spark.read.parquet(f"{where}/index").drop("buckets"), buckets)


def read(files: TokenFiles, keys: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids): the documents of each key in ``keys``, once however often the key is asked for; ``start``: the ids of all documents
    before it, ``ids``: little-endian 32-bit integers."""
    asked = keys.select(F.col(id_column).cast("long").alias("key")).distinct()
    by_bucket = asked.groupBy(_bucket("key", files.buckets).alias("bucket")).agg(F.array_agg(F.struct("key")).alias("asked"))
    by_bucket = by_bucket.select("bucket", F.col("asked.key").alias("keys"))  # null is a key
    found = bounded(by_bucket.join(files.index, "bucket")).mapInArrow(_located, "key long, shard long, first long, docs long")
    placed = found.join(files.shards.select("shard", "name", "base"), "shard").repartition("shard").sortWithinPartitions("shard", "first")
    where = files.where
    return bounded(placed.select("key", "name", "base", "first", "docs")).mapInArrow(lambda b: _read(b, where), _DOCS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = read(write(docs), docs)
    return out.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
