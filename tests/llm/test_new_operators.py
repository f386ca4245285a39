import functools
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylens.llm import hard_negatives, queries, token_files, vector_codes
from quarrylens.llm.token_counts import TOKENIZER

ROWS = "vec_id long, embedding array<float>, label int, vector string, id int, number int, anchor string, text string"


def made(spark, rows):
    return spark.createDataFrame([(i, v, c, "x", 1, 2, "y", None) for i, v, c in rows], ROWS)


def vectors(seed=3, n=260, width=8):
    """Ties, copies, repeated ids, nulls, holes and values that aren't finite."""
    rng = random.Random(seed)
    copy = [rng.uniform(-1, 1) for _ in range(width)]
    rows = [(k, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(width)], rng.randrange(4)) for k in range(n)]
    rows += [(1000 + k, copy, k % 3) for k in range(90)] + [(50, copy, 1), (50, copy, 1), (7, copy, 2), (None, copy, 1), (None, copy, 0)]
    rows += [(2000, None, 1), (2050, [None] + copy[1:], 1), (2100, [float("nan")] + copy[1:], 1), (2150, [float("inf")] + copy[1:], 1), (2200, copy, None), (-50, copy, 2)]
    return rows


def brute_negatives(rows, asked, scale=256, positives=5, negatives=3, low=50, high=95):
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v], c) for i, v, c in rows if v is not None and c is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for k, (i, v, c) in enumerate(kept):
        if i is None or not asked(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), j, d) for m, (j, w, d) in enumerate(kept) if m != k]
        for score, j, _ in sorted((x for x in scored if x[2] == c), key=order)[:positives]:
            fit = sorted((x for x in scored if x[2] != c and low * score <= 100 * x[0] <= high * score), key=order)[:negatives]
            out += [(i, j, r + 1, x[1], score, x[0]) for r, x in enumerate(fit)]
    return sorted(out, key=str)


def mined(df, **more):
    return sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, **more).collect()), key=str)


def test_hard_negatives_are_those_of_brute_force(spark):
    rows = vectors()
    assert mined(made(spark, rows).repartition(5)) == brute_negatives(rows, lambda i: i % 50 == 0)


@pytest.mark.parametrize("digit", [2, 30])
def test_hard_negatives_do_not_depend_on_blocks_or_digits(spark, monkeypatch, digit):
    for name, value in (("DIGIT", digit), ("ANCHORS", 2), ("HELD", 1)):
        monkeypatch.setattr(hard_negatives, name, value)
    monkeypatch.setattr("quarrylens.llm.vectors.BLOCK_BYTES", 1 << 9)
    rows = vectors(4, 120)
    got = mined(made(spark, rows), positives=2, negatives=6, low=10, high=90)
    assert got == brute_negatives(rows, lambda i: i % 50 == 0, positives=2, negatives=6, low=10, high=90)


def test_hard_negatives_of_odd_tables(spark):
    assert mined(made(spark, [])) == []
    assert mined(made(spark, [(None, [1.0], 1), (3, [1.0], 2)])) == []  # no anchor
    assert mined(made(spark, [(0, [1.0], 1)])) == []  # no other row
    rows = [(0, [1.0, 1.0], 1), (1, [1.0], 1), (2, [0.5, 0.4, 9.0], 2), (3, [], 2)]  # unlike lengths
    assert mined(made(spark, rows)) == brute_negatives(rows, lambda i: i % 50 == 0)
    with pytest.raises(ValueError, match="2\\*\\*53"):
        mined(made(spark, [(0, [1e30], 1)]))


def test_positives_below_zero_have_no_negatives(spark):
    rows = [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.6], 2)]
    assert mined(made(spark, rows)) == brute_negatives(rows, lambda i: i % 50 == 0) == []


def brute_codes(rows, scale=1024, parts=4, entries=256, rounds=4):
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(kept[0][1])
    width = -(-length // parts)
    kept = [(i, v + [0] * (width * parts - length), c) for i, v, c in kept if len(v) == length]
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    apart = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e, strict=True))
    near = lambda x, book: min((apart(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(part(v, p), books[p])[1], []).append(part(v, p))
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    found = [(i, c, [near(part(v, p), books[p]) for p in range(parts)]) for i, v, c in kept]
    return sorted([(i, c, "".join(f"{k:02x}" for _, k in x), sum(d for d, _ in x)) for i, c, x in found], key=str), books


@pytest.mark.parametrize("width", [8, 6, 1])
def test_codes_are_those_of_brute_force(spark, width):
    rows = vectors(width, 120, width) + [(1, [0.5] * (width + 1), 1)]
    got, books = vector_codes.codes(made(spark, rows).repartition(3), entries=20)
    want, want_books = brute_codes(rows, entries=20)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert books.tolist() == want_books
    errors = {}
    for _, c, _, e in want:
        errors[c] = errors.get(c, 0) + e
    summed = vector_codes.with_label_error(got).collect()
    assert len(summed) == len(want) and all(r["label_error"] == errors[r["label"]] for r in summed)


def test_codes_of_odd_tables(spark):
    got, books = vector_codes.codes(made(spark, [(1, None, 1)]))
    assert got.count() == 0 and books.size == 0 and got.columns == ["vec_id", "label", "code", "error"]
    got, _ = vector_codes.codes(made(spark, [(1, [0.5] * 4, None), (1, [0.5] * 4, None)]))  # fewer rows than entries
    assert [tuple(r) for r in got.collect()] == [(1, None, "00000000", 0)] * 2
    with pytest.raises(ValueError, match="2\\*\\*53"):
        vector_codes.codes(made(spark, [(1, [1e30] * 4, 1)]))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 5), st.integers(1, 400), st.integers(1, 3), st.integers(0, 10**6))
def test_bounds_leave_the_nearest_entry(n, width, spread, bits, seed):
    rng = np.random.default_rng(seed)
    entries, queries_ = rng.integers(-spread, spread, (n, width)), rng.integers(-2 * spread, 2 * spread, (50, width))
    cells = vector_codes.Cells(entries, bits)
    all_ = ((queries_[:, None] - entries) ** 2).sum(2)
    index, distance = cells.nearest(queries_)
    assert (index == all_.argmin(1)).all() and (distance == all_.min(1)).all()
    q, e = cells.candidates(queries_)
    assert len(q) <= 50 * n


def test_bounds_leave_few_candidates():
    rng = np.random.default_rng(1)
    entries, queries_ = rng.integers(-200, 200, (256, 16)), rng.integers(-200, 200, (500, 16))
    assert len(vector_codes.Cells(entries).candidates(queries_)[0]) < 0.25 * 500 * 256


# ---------------------------------------------------------------- token files


def documents():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß漢'3.!") for _ in range(rng.randrange(1, 9)))
    texts = [None, "", " \n\t", "one", "<|endoftext|> x<|startoftext|>y", "it's 2's", "x" * 9_000, "12" * 5_000, " ".join(word() for _ in range(30_000))] + [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = [((k * 37) % 1009 - 300, t) for k, t in enumerate(texts)]
    rows += [(5, "same id"), (5, "same id"), (5, "same id, other text"), (None, "no id"), (None, None)] + [(6, f"hot {k}") for k in range(120)]
    return rows


@functools.cache
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path(TOKENIZER)))


def want_ids(rows):
    t = library()
    return [(key, [*t.encode(text or "", add_special_tokens=False).ids, token_files.END]) for key, text in rows]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame([(k, t, "s", 1, 2, "z") for k, t in documents()], "doc_id long, text string, key string, start int, at int, ids string").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(("shard", "held", "read"), [(1 << 26, 1 << 20, 1 << 22), (600, 50, 300)])
def test_files_hold_the_ids_in_order_of_keys(spark, docs, monkeypatch, shard, held, read):
    monkeypatch.setattr(token_files, "BUCKET", 40)
    files = token_files.write(docs, shard_bytes=shard)
    for name, value in (("HELD_BYTES", held), ("READ_BYTES", read)):
        monkeypatch.setattr(token_files, name, value)
    want, start = [], 0
    for key, ids in sorted(want_ids(documents()), key=lambda r: (r[0] is None, r[0] or 0)):  # stable: rows of a key stay in order
        want.append((key, start, len(ids), struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    got = sorted((tuple(r) for r in token_files.read(token_files.TokenFiles.open(spark, files.where), docs).collect()), key=lambda r: r[1])
    assert [(k, s, n, bytes(x)) for k, s, n, x in got] == want
    some = token_files.read(files, spark.createDataFrame([(6,), (6,), (None,), (123456,), (-300,)], "doc_id long")).collect()
    assert sorted((r["key"] is None, r["key"], r["start"]) for r in some if r["key"] is not None) == sorted((False, k, s) for k, s, _, _ in want if k in (6, -300))
    assert sum(r["key"] is None for r in some) == 2
    for name in [r["name"] for r in files.shards.collect()]:  # a shard that was cut off is an error
        token_files.Shard(files.where, name)


def test_files_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    files = token_files.write(none)
    assert token_files.read(files, none).count() == 0
    assert token_files.read(token_files.TokenFiles.open(spark, files.where), spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_the_query_has_the_checksums(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want, start = {}, 0
    for key, ids in sorted(want_ids(rows)):
        want[key] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    got = {r[0]: tuple(r[1:]) for r in queries.QUERIES["op13_token_files"](spark, d).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    assert got == want


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=300))
def test_the_hash_is_perfect_and_minimal(keys):
    keys = np.array(sorted(keys), np.int64)
    levels = token_files.perfect(keys)
    assert sorted(token_files.numbers(levels, keys)) == list(range(len(keys)))
    assert sum(map(len, levels)) < 64 * 20 + 8 * len(keys)


def test_ids_do_not_depend_on_what_was_met_before(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT", 40)
    coder = token_files.encoder()
    texts = [t or "" for _, t in documents()]
    want = [ids[:-1] for _, ids in want_ids([(0, t) for t in texts])]
    for _ in range(2):
        got = list(coder.encoded(t.encode() for t in texts))
        assert [np.frombuffer(x, coder.kind).tolist() for x in got] == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abzABZéÉßÀÞÿŸø×÷'’.,;!&#<|>_`{~@[^019 \n\u0301\u0307漢ﬀΣς²ªµ"), max_size=12), min_size=1, max_size=4))
def test_ids_are_those_of_the_library(texts):
    want = [ids[:-1] for _, ids in want_ids([(0, t) for t in texts])]
    coder = token_files.encoder()
    assert [np.frombuffer(x, coder.kind).tolist() for x in coder.encoded(t.encode() for t in texts)] == want
