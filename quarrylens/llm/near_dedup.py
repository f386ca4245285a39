"""Operator 10: MinHash near-dedup by a signature-coordinate inverted join.

1. An Arrow pass gives each document its number of distinct five-word shingles, a 128-bit hash of the set,
   and a signature of ``COORDINATES`` MinHash values. Documents with equal sets form a class; only the
   class goes on (its smallest id stands for it), so copies are never paired.
2. Classes are posted under each (coordinate, value). Two sets with similarity 0.75 agree on 48 of 64
   coordinates on average; ``MATCHES`` = 30 lies 5 standard deviations below (a miss has a chance of about
   1e-6, far less above 0.75).
3. Prefix and skip: agreeing on 30 of 64 coordinates means to share one of any 35, so each class keeps
   only its 35 rarest postings (values nobody else has count among them, which leaves most classes with
   none). The most frequent lists are skipped for all classes that have enough rare ones.
4. In each list, members are first compared with a few hubs, not with each other: what a hub links is
   one component. After some rounds, lists within one component are done. In the others pairs from
   different components are counted: agreeing coordinates on the full signatures (at least ``MATCHES``)
   retain a pair.
5. Lists of more than ``LONG`` members hold near copies of one text whose signatures all agree about as much as
   links do. There the full sets decide who can be paired, without estimates: shingles are ranked from rare
   to frequent, and a pair needs a common one so early in both that enough can still follow.
6. Retained pairs are confirmed on the full shingle sets, and the smallest id of each component is found by
   repeated contraction of the links.

Pairs inside a component are never emitted, frequent keys are split by Spark as skewed joins, and no cap
drops any. Null, empty and blank texts have no shingles and no links; fewer than five words count as one
shingle. A row without an id is linked with nothing and kept. Ids may repeat: every row is judged by its own text, equal rows
get equal results, and the smallest id of a component is that of any of its rows. Columns besides id and text don't matter, and an
empty table gives an empty result. A very long text is read a part at a time; its shingles' hashes are held together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.kernels import SPACED, Words, blocks, lowered, mix, random_words
from quarrylens.llm.scratch import bounded, drop, files_for, saved, table, unused, with_row_key

SHINGLE, PERCENT = 5, 75
COORDINATES, MATCHES = 64, 30
HUB_ROUNDS = 3
LONG = 32
_VALUES, _SEED = lowered(10), 100
_XOR, _ODD = random_words(101, COORDINATES), random_words(102, COORDINATES) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of a block (repeats included), and their bounds by document."""
    w = Words(data, offsets, SPACED, _VALUES)
    hashes, _, bounds = w.grams(n, _SEED)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        c = random_words(_SEED + 1, n)
        own = [mix(_whole(w, d, c)) for d in short]
        hashes = np.insert(hashes, bounds[short], np.concatenate(own))
        bounds = bounds + np.concatenate([[0], np.cumsum(np.isin(np.arange(len(w.counts)), short))])
    return hashes, bounds


def _whole(w: Words, d: int, c: np.ndarray) -> np.ndarray:
    words = w.hash[w.bounds[d] : w.bounds[d + 1]]
    return (words * (c[: len(words)] | np.uint64(1))).sum(keepdims=True) + np.uint64(len(words))


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text, which is the last column, gives way to what is known of its shingles."""
    for batch in batches:
        size, high, low, values = [], [], [], []
        for lo, hi, data, offsets in blocks(batch.column(batch.num_columns - 1)):
            hashes, bounds = shingles(data, offsets)
            counts = np.diff(bounds)
            full = np.flatnonzero(counts)
            sig = np.zeros((hi - lo, COORDINATES), np.uint32)
            if len(full):
                starts = bounds[full]
                for k in range(COORDINATES):
                    sig[full, k] = np.minimum.reduceat((hashes ^ _XOR[k]) * _ODD[k], starts) >> np.uint64(32)
            one, two, n = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.int64)
            if len(full):
                order = np.lexsort((hashes, np.repeat(np.arange(hi - lo), counts)))
                h = hashes[order]
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                new[starts] = True
                n[full] = np.add.reduceat(new.astype(np.int64), starts)
                one[full] = np.add.reduceat(np.where(new, mix(h), np.uint64(0)), starts)
                two[full] = np.add.reduceat(np.where(new, mix(h ^ np.uint64(_SEED)), np.uint64(0)), starts)
            size.append(n)
            high.append(one)
            low.append(two)
            values.append(sig)
        if not size:
            continue
        flat = np.concatenate(values).view(np.int32).ravel()
        sig = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, COORDINATES, dtype=np.int32), pa.array(flat))
        known = [pa.array(np.concatenate(size)), pa.array(np.concatenate(high).view(np.int64)), pa.array(np.concatenate(low).view(np.int64)), sig]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *known], [*batch.schema.names[:-1], "n_shingles", "h1", "h2", "sig"])


def _set_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sorted distinct shingle hashes)."""
    for batch in batches:
        sets = []
        for lo, hi, data, offsets in blocks(batch.column(1)):
            hashes, bounds = shingles(data, offsets)
            sets += [np.unique(hashes[bounds[d] : bounds[d + 1]]).view(np.int64) for d in range(hi - lo)]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(flat))], ["node", "members"])


def _common(a: Column, b: Column) -> Column:
    """On how many coordinates two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)


def contract(links: DataFrame, files: int) -> DataFrame:
    """(id, root) for every end of ``links`` (a, b): root is the smallest id that can be reached.

    Each round points every node to its smallest neighbour, follows the pointers once more, and rewrites the links
    between the nodes pointed to; the rounds needed grow with the logarithm of the longest chain.
    """
    links = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links", files)
    steps: list[DataFrame] = []
    while links.count():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        step = least.alias("x").join(least.select(F.col("id").alias("k"), F.col("up").alias("upper")).alias("y"), F.col("x.up") == F.col("y.k"), "left").select("x.id", F.least("x.up", F.coalesce("y.upper", "x.up")).alias("up"))
        step = saved(step, "step", files)
        steps.append(step)
        further = links.join(step.select(F.col("id").alias("a"), F.col("up").alias("a2")), "a").join(step.select(F.col("id").alias("b"), F.col("up").alias("b2")), "b")
        done, links = links, saved(further.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).filter("a < b").distinct(), "links", files)
        drop(done)
    spark = links.sparkSession
    if not steps:
        return spark.createDataFrame([], "id long, root long")
    out = steps[0].withColumnRenamed("up", "root")
    for step in steps[1:]:
        out = out.join(step.select(F.col("id").alias("root"), F.col("up")), "root", "left").select("id", F.coalesce("up", "root").alias("root"))
    return out


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity asked for."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b")
    inter = F.size(F.array_intersect("ma", "mb"))
    return both.filter(100 * inter >= PERCENT * (F.size("ma") + F.size("mb") - inter)).select("a", "b")


def _held(lists: DataFrame, links: DataFrame | None, files: int) -> DataFrame:
    """``lists`` with where each member's component stands after the links found so far."""
    if links is None:
        return lists.withColumn("root", F.col("node"))
    roots = saved(contract(links, files).withColumnRenamed("id", "node"), "roots", files)  # read twice by each round
    return lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _ranked_pairs(classes: DataFrame, sets: DataFrame, files: int) -> DataFrame:
    """The pairs (a, b) of ``classes`` (node, root) from different components that the ranks of their shingles leave possible.

    With shingles ranked from rare to frequent, let a pair's first common one stand at places i and j: at most
    1 + min(size - place) are common. Similar sets of m and n need 0.75 / 1.75 * (m + n).
    """
    own = classes.join(sets, "node").withColumn("n", F.size("members"))
    each = own.select("node", F.explode("members").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count("*").alias("f")).filter("f > 1")
    ranked = each.join(shared, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "shingle"))).alias("s"))
    ranked = ranked.join(own.select("node", "root", "n"), "node")
    # shingles that no other set has come first
    placed = ranked.select("node", "root", "n", F.posexplode("s").alias("k", "s"), (F.col("n") - F.size("s") + 1).alias("from")).select("node", "root", "n", (F.col("from") + F.col("k")).alias("place"), "s.shingle")
    placed = saved(placed.filter(100 * (1 + F.col("n") - F.col("place")) >= PERCENT * F.col("n")), "placed", files)
    x = placed.select("shingle", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("place").alias("pa"))
    y = placed.select("shingle", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    enough = (100 + PERCENT) * (1 + F.least(x["na"] - x["pa"], y["nb"] - y["pb"])) >= PERCENT * (x["na"] + y["nb"])
    return x.join(y, (x["shingle"] == y["shingle"]) & (x["a"] < y["b"]) & (x["ra"] != y["rb"]) & enough).select("a", "b")


def grouped(rows: DataFrame) -> DataFrame:
    """(id, key, n_shingles, component_id, component) of ``rows`` (id, key, text); keys tell rows apart, ids needn't.

    component_id is the smallest id of a row's component, and component its number, which no other one has; null without id or words.

    A class of equal sets is known by its node, a number of its own, and its text is read from one row.
    """
    files = files_for(rows.count())
    kind = rows.schema["key"].dataType.simpleString()
    signed = saved(bounded(rows).select("id", "key", "text").mapInArrow(signatures, f"id long, key {kind}, n_shingles long, h1 long, h2 long, sig array<int>"), "signatures", files)
    filled = signed.filter("n_shingles > 0 and id is not null")
    classes = filled.groupBy("h1", "h2").agg(F.min(F.struct("id", "key", "sig", "n_shingles")).alias("r"))
    classes = classes.select("h1", "h2", F.monotonically_increasing_id().alias("node"), "r.id", "r.key", F.col("r.n_shingles").alias("n"), F.col("r.sig").alias("sig"))
    classes = saved(classes, "classes", files)

    # postings; the values that one class alone has only shorten prefixes
    posted = classes.select("node", F.posexplode("sig").alias("k", "v")).select("node", F.xxhash64("k", "v").alias("token"))
    shared = saved(posted.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "shared", files)
    mine = posted.join(shared, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    room = F.size("t") - (MATCHES - 1)
    popular = F.aggregate("t", F.lit(0).cast("long"), lambda n, t: n + t["n"])
    lists = saved(mine.withColumn("popular", popular).filter(room > 0).select("node", "popular", F.explode(F.slice("t", 1, room)).alias("t")).select("node", "popular", "t.token"), "lists", files)
    asked = classes.select("node", "key").join(lists.select("node").distinct(), "node", "left_semi")
    sets = saved(rows.select("key", "text").join(asked, "key").select("node", "text").mapInArrow(_set_pass, "node long, members array<long>"), "sets", files)
    slim = classes.select("node", "n", "sig")

    links = None
    for r in range(HUB_ROUNDS):
        held = _held(lists, links, files)
        # the hub: the member with the most frequent values, which is the closest to the others; then the first; then any
        first = [F.struct(-F.col("popular"), "node"), F.struct("node", F.col("node").alias("i")), F.struct(F.xxhash64("node", F.lit(r)), "node")][min(r, 2)]
        hubs = held.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min_by("node", first).alias("hub")).filter("r0 < r1").select("token", "hub")
        hubs = saved(hubs, "hubs", files)  # so that the join below can split frequent tokens
        pairs = held.join(hubs, "token").filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        pairs = pairs.join(slim.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a").join(slim.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
        found = _confirmed(pairs.filter(_alike()).select("a", "b"), sets)
        links = saved(found if links is None else links.unionByName(found), "links", files)
    held = _held(lists, links, files)
    open_lists = held.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("members")).filter("r0 < r1").select("token", "members")
    held = saved(held.select("node", "token", "root").join(open_lists, "token"), "open", files)
    short = held.filter(F.col("members") <= LONG).join(slim, "node")
    x = short.select("token", "root", F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    y = short.select("token", F.col("root").alias("root2"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    pairs = x.join(y, (x["token"] == y["token"]) & (x["a"] < y["b"]) & (x["root"] != y["root2"]) & _alike()).select("a", "b")
    pairs = pairs.unionByName(_ranked_pairs(held.filter(F.col("members") > LONG).select("node", "root").distinct(), sets, files)).distinct()
    roots = saved(contract(links.unionByName(_confirmed(pairs, sets)), files).withColumnRenamed("id", "node"), "roots", files)
    # the smallest id of each component of several classes
    linked = classes.select("h1", "h2", "node", "id").join(roots, "node")
    least = saved(linked.groupBy("root").agg(F.min("id").alias("least")), "least", files)
    named = linked.join(least, "root").select("node", "root", "least")
    named = classes.select("h1", "h2", "node", "id").join(named, "node", "left")
    named = saved(named.select("h1", "h2", F.coalesce("root", "node").alias("component"), F.coalesce("least", "id").alias("least")), "named", files)
    out = signed.select("id", "key", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    smallest = F.when(F.col("id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("id")))
    return out.select("id", "key", "n_shingles", smallest.alias("component_id"), F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.col("component")).alias("component"))


def _rows(docs: DataFrame, id_column: str, text_column: str, key: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(key).alias("key"), F.col(text_column).alias("text"))


def components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of each document."""
    key = unused(docs, "row")
    out = grouped(_rows(with_row_key(docs, key), id_column, text_column, key))
    return out.select(F.col("id").alias(id_column), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _alike() -> Column:
    """Of a pair's sizes and signatures: what similar sets must have."""
    sizes = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
    return sizes & (_common(F.col("sa"), F.col("sb")) >= MATCHES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, one of those with the smallest id; rows without an id or without words stay.

    Rows are told apart by where they are stored: repeated rows are copies of each other, and rows that share an id but not a text are
    documents of their own.
    """
    at = unused(docs, "row")
    rows = with_row_key(docs, at)
    found = grouped(_rows(rows, "doc_id", "text", at))
    found = saved(found.filter("component is not null").select("key", "id", "component"), "found", files_for(rows.count()))
    stays = found.groupBy("component").agg(F.min(F.struct("id", "key"))["key"].alias("key"))
    gone = found.join(stays.select("key"), "key", "left_anti").select(F.col("key").alias(at))
    return rows.join(gone, at, "left_anti").select(*docs.columns)
