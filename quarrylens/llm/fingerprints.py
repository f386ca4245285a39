"""Operator 2: document fingerprints by closed syncmers, in DataFrame operations only.

A text is read as words (runs without ASCII white space); a run of more than ``LONGEST`` characters is read as its single characters,
so that its anchors depend on what stands around them and not on how far they are from its start. A k-mer is ``K`` consecutive words,
and is chosen if the smallest of its inner pairs of words, by hash, is its first or its last: a choice that depends on the
k-mer alone, so equal passages yield equal anchors wherever they stand. ``anchors`` returns all anchors of a text with their places, and
``shared_passages`` matches texts by them: anchors in common whose places differ by the same shift.

The query's fingerprint is a digest of them: the sketch of the ``SKETCH`` smallest anchor hashes, as hexadecimal text; texts
without an anchor have one made of all their words. The likeness of two fingerprints is the share of common anchors among the
``SKETCH`` smallest of both together: an estimate of the Jaccard similarity of the anchors, exact where both have few. Equal
fingerprints have likeness 1, two empty ones too.

Null counts as the empty text, whose fingerprint is empty. Documents follow each other by id (null first), then by
a hash of the text; equal rows are one document here and get equal results. A lone document is its own next one. Other columns don't
matter, a very long text is an array of its words' hashes, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.llm.scratch import files_for, saved, table

K, SKETCH, LONGEST = 5, 64, 24
_RUN = r"[^\x20\x09-\x0D]"
WORD = rf"(?<!{_RUN}){_RUN}{{1,{LONGEST}}}+(?!{_RUN})|{_RUN}"


def _short(h: Column) -> Column:
    """The upper half of a hash, as an int."""
    return F.shiftright(h, 32).cast("int")


def _with_kmers(df: DataFrame, text_column: str) -> DataFrame:
    """``df`` with the hashes of a text's words (_w) and, for each k-mer, its hash where it is chosen (_k); for fewer than ``K`` words null or nulls."""
    df = df.withColumn("_w", F.transform(F.regexp_extract_all(text_column, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    n = F.size("_w")
    df = df.withColumn("_s", F.when(n >= K, F.transform(F.slice("_w", 1, F.greatest(n - 1, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_w", i + 1)))))

    def chosen(a: Column, i: Column) -> Column:
        b, c, d = F.get("_s", i + 1), F.get("_s", i + 2), F.get("_s", i + 3)
        return F.when(F.least(a, d) <= F.least(b, c), F.xxhash64(a, b, d))

    return df.withColumn("_k", F.transform(F.slice("_s", 1, F.greatest(F.size("_s") - (K - 2), F.lit(1))), chosen))


def anchors(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, at, anchor) of every anchor of every text; at: the place of its first word."""
    own = _with_kmers(docs.select(F.col(id_column).alias("_id"), F.coalesce(text_column, F.lit("")).alias("_text")), "_text")
    return own.select(F.col("_id").alias(id_column), F.posexplode("_k").alias("at", "anchor")).filter("anchor is not null")


def shared_passages(left: DataFrame, right: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(left, right, shift, anchors, first, last): what two sides of ``anchors`` share, by how far it is moved; places are those of the left side."""
    a = left.select(F.col(id_column).alias("left"), F.col("at").alias("_at"), "anchor")
    b = right.select(F.col(id_column).alias("right"), F.col("at").alias("_there"), "anchor")
    found = a.join(b, "anchor").withColumn("shift", F.col("_there") - F.col("_at"))
    return found.groupBy("left", "right", "shift").agg(F.count("*").alias("anchors"), F.min("_at").alias("first"), (F.max("_at") + K - 1).alias("last"))


def with_sketch(df: DataFrame, text_column: str, out: str) -> DataFrame:
    """``df`` with the sorted sketch of the anchors of a text, an array of ints."""
    df = _with_kmers(df, text_column)
    df = df.withColumn("_a", F.slice(F.sort_array(F.array_distinct(F.transform(F.filter("_k", lambda x: x.isNotNull()), _short))), 1, SKETCH))
    whole = F.when(F.size("_w") > 0, F.array(_short(F.xxhash64("_w")))).otherwise(F.array().cast("array<int>"))
    return df.withColumn(out, F.when(F.size("_a") > 0, F.col("_a")).otherwise(whole)).drop("_w", "_s", "_k", "_a")


def spelled(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(2**32 - 1))), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect(both, F.col(a)), F.col(b)))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.size(both)).cast("double")


def _next_keys(keys: DataFrame, files: int) -> DataFrame:
    """(id, t, n_chars, next_id, next_t) of each distinct key, in ascending order, the first after the last.

    Keys are range-partitioned; only the first key of each partition meets in one place.
    """
    spark = keys.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(keys.repartitionByRange(n, "id", "t").dropDuplicates(["id", "t"]).withColumn("p", F.spark_partition_id()), "keys", files)
    following = F.lead(F.struct("id", "t")).over(Window.partitionBy("p").orderBy("id", "t"))
    firsts = dealt.groupBy("p").agg(F.min(F.struct("id", "t")).alias("first"))
    order = Window.orderBy("p")
    edge = firsts.select("p", F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("edge"))
    full = dealt.withColumn("following", following).join(F.broadcast(edge), "p")  # one row a partition
    step = F.coalesce("following", "edge")
    return full.select("id", "t", "n_chars", step["id"].alias("next_id"), step["t"].alias("next_t"))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document.

    A text travels to the document before it, which takes its sketch and as much of its beginning as the edit needs;
    with the first half and the sketch of the document's own text that makes the edited text.
    """
    no_id = F.lit(-(2**63)).cast("long")
    own = docs.select(F.coalesce(F.col(id_column).cast("long"), no_id).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    own = own.withColumn("t", F.xxhash64("text")).withColumn("n_chars", F.char_length("text"))
    following = _next_keys(own.select("id", "t", "n_chars"), files_for(docs.count()))
    there = own.select(F.col("id").alias("next_id"), F.col("t").alias("next_t"), F.col("text").alias("next")).dropDuplicates(["next_id", "next_t"])
    ahead = with_sketch(there.join(following, ["next_id", "next_t"]), "next", "b").select("id", "t", "b", F.expr("substring(next, 1, cast(floor(n_chars / 2) as int))").alias("start"))
    here = with_sketch(own, "text", "a").select("id", "t", "n_chars", "a", F.expr("substring(text, 1, n_chars - cast(floor(n_chars / 2) as int))").alias("head"))
    both = with_sketch(here.join(ahead, ["id", "t"]).withColumn("edited", F.concat("head", "start")), "edited", "e")
    return both.select(
        F.nullif("id", no_id).alias(id_column), F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), spelled("a").alias("fingerprint"), spelled("e").alias("edited_fingerprint"), likeness("a", "e").alias("near_edited"), likeness("a", "b").alias("near_next")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")))
