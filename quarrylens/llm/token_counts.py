"""Operator 3: token counts.

An Arrow function encodes batches and returns lengths only. Texts are split at safe boundaries, runs of
ASCII white space: the tokenizer drops white space before it merges, neither its pattern nor the
composition of characters (NFC) reaches across it, and no special string holds any. So the count of a
text is the sum over its pieces, a piece being judged alone, and each distinct piece is encoded once.
A piece of more than ``LONGEST`` bytes is split where the pattern always ends a match: behind an ASCII digit, which is a match of its
own, before another one or an ASCII letter, and before wide punctuation behind an ASCII letter or digit or a Chinese, Japanese or
Korean character (other letters may get a mark of their own when the library composes them). Only a longer run without any
of these, which the library merges as one word, stays whole.

Texts are taken together, and very long ones apart, in parts of about ``HELD_BYTES``; what is new in them goes to the library in
batches of about ``BATCH_BYTES`` bytes, whatever the number of rows. A worker keeps the counts of at most ``KEPT`` short
pieces. So memory depends on neither the lengths of texts nor their number.

Null counts as empty; an empty text has no tokens. Rows keep their place: repeated rows, ties, null ids and extra
columns don't matter, and an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.scratch import bounded, table

TOKENIZER = "word_bpe_49k.json"
BATCH_BYTES, HELD_BYTES = 65_536, 1 << 20
KEPT, KEPT_BYTES, LONGEST = 400_000, 48, 4_096
LIMIT = 2048
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
_BOUNDARY = re.compile("(?<=[0-9])(?=[0-9A-Za-z])|(?<=[0-9A-Za-zぁ-ゖァ-ヺ一-鿿가-힣])(?=[、。！，：；？])")


def parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``HELD_BYTES``, cut at white space."""
    lo = 0
    while len(text) - lo > HELD_BYTES:
        hi = lo + HELD_BYTES
        cut = max(text.rfind(c, lo + 1, hi) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut < 0:
            found = _SPACE.search(text, hi)
            cut = found.start() if found else len(text)
        yield text[lo:cut]
        lo = cut
    yield text[lo:]


def broken(piece: bytes) -> Iterator[bytes]:
    """A long piece in parts of at least ``LONGEST`` characters, cut where there is a boundary."""
    text, lo = piece.decode(), 0
    while found := _BOUNDARY.search(text, lo + LONGEST):
        yield text[lo : found.start()].encode()
        lo = found.start()
    yield text[lo:].encode()


class Counter:
    """Counts tokens with a vocabulary file of the ``tokenizers`` library whose tokenizer drops white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kept: dict[bytes, int] = {}

    def encode(self, pieces: list[bytes]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    def learn(self, pieces: Iterable[bytes]) -> dict[bytes, int]:
        """The counts of ``pieces``, encoded in batches of equal bytes."""
        out: dict[bytes, int] = {}
        batch: list[bytes] = []
        held = 0
        for p in pieces:
            batch.append(p)
            held += len(p)
            if held >= BATCH_BYTES:
                out.update(zip(batch, self.encode(batch), strict=True))
                batch, held = [], 0
        if batch:
            out.update(zip(batch, self.encode(batch), strict=True))
        return out

    def counts(self, texts: Iterable[bytes]) -> list[int]:
        """The number of tokens of each text."""
        out: list[int] = []
        held: list[tuple[int, bytes]] = []
        size = 0
        for k, text in enumerate(texts):
            out.append(0)
            for part in parts(text):
                held.append((k, part))
                size += len(part)
                if size >= HELD_BYTES:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, bytes]], out: list[int]) -> None:
        kept, split = self.kept, [(k, part.split()) for k, part in held]  # at ASCII white space
        new = set(chain.from_iterable(ps for _, ps in split)).difference(kept)
        if any(len(p) > LONGEST for p in new):  # none of these is kept
            split = [(k, [q for p in ps for q in (broken(p) if len(p) > LONGEST else (p,))]) for k, ps in split]
            new = set(chain.from_iterable(ps for _, ps in split)).difference(kept)
        new = self.learn(new)
        kept.update(new)
        for k, ps in split:
            out[k] += sum(map(kept.__getitem__, ps))
        for p in new:
            if len(p) > KEPT_BYTES:
                del kept[p]
        if len(kept) > KEPT:
            kept.clear()

    def count(self, text: bytes) -> int:
        return self.counts([text])[0]


def counter(name: str = TOKENIZER) -> Counter:
    """Loaded once for each Python worker."""
    import public_tokenizers

    held = sys.modules.setdefault("_quarrylens_tokenizers", type(sys)("_quarrylens_tokenizers")).__dict__
    if name not in held:
        held[name] = Counter(str(public_tokenizers.path(name)))
    return held[name]


def token_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT, load: Callable = counter) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row of ``docs``, over its whole text."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = load(tokenizer).counts
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            n = counts(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names)

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    names = [id_column, "n_bytes", "n_tokens", "over_limit"]
    return bounded(rows).mapInArrow(lengths, f"`{id_column}` {rows.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")))
