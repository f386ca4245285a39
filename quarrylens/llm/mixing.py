"""Operator 7: mixing sources to target weights, in DataFrame operations only.

1. Sources are weighed and their targets found: a target stops at ``MOST`` times its source's size, and the excess is shared
   by weight among the rest until none is above.
2. The words of a source's documents, in a fixed pseudorandom order of documents, are packed into blocks of ``BLOCK`` words; what is
   left over makes one shorter block. A document's place in its source's stream is a sum within its bucket of
   documents plus the sum of the buckets before, so no task needs a whole source.
3. Each source owes a number of block slots: whole epochs (every block once) and part of one more, whose last slot is cut to the
   words still owed. Output shards hold ``SHARD`` slots each (the last one what is left). How many of a shard's slots each source
   gets is a multinomial draw given the sources' totals: all slots of all sources are dealt to the places of all
   shards by one pseudorandom permutation, so totals are exact and no counts have to be gathered.
4. A slot's place in its epoch is mapped to a block by a pseudorandom permutation of the source's blocks. The shorter block
   closes each epoch. Permutations are swap-or-not networks: bijections of any number of things, without a table.
5. Slots are joined with blocks by (source, block), and documents take their shares of the blocks that they lie in. ``mixture``
   returns these: of which document which words stand in which slot of which shard. The query counts them per document.

Targets are met to the word wherever a source has words, and no document is taken more than ``MOST`` times. All draws are hashes of
fixed seeds, so reruns agree. A null text has no words, a source of none has target 0, a null source is a source of its
own (last). Ids may be null or repeat: rows of one id, size and source can't be told apart, so they are counted and dealt out
anew as that many documents. Other columns don't matter, a long text is as many blocks as it fills, and an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.llm.scratch import files_for, saved, table

WEIGHTS = (1, 2, 3)
MOST, BLOCK, SHARD = 3, 256, 4_096
BUCKET, RANGE, ROUNDS, SEED = 512, 8_192, 16, 7
WORD = r"[^\x20\x09-\x0D]+"


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column], files: int) -> DataFrame:
    """``df`` with sums over all rows before, in ``order``: ranges of rows are summed apart, and only their totals meet in one place."""
    dealt = saved(df.repartitionByRange(_partitions(df), *order).withColumn("_p", F.spark_partition_id()), "ranges", files)
    zero = lambda c: F.coalesce(c, F.lit(0))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_p").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()]).select("_p", *[zero(F.sum(f"_{k}").over(earlier)).alias(f"_{k}") for k in sums])
    within = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(totals), "_p")  # one row a shuffle partition
    return joined.select(*df.columns, *[(F.col(f"_{k}") + zero(F.sum(c).over(within))).alias(k) for k, c in sums.items()])


def _sources(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(sid, source, rows, source_size, target): one row for each source."""
    by = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    files = files_for(sizes.agg(F.approx_count_distinct("source")).first()[0])
    by = _running(by, [F.col("source").asc_nulls_last()], {"sid": F.lit(1)}, files)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("sid", F.lit(len(weights))).cast("int") + 1))
    # the level at which targets stop: sources in order of how early they fill up
    by = _running(by.withColumn("fills", most * F.col("source_size") / F.col("weight")), [F.col("fills"), F.col("sid")], {"size_before": F.col("source_size"), "weight_before": F.col("weight")}, files)
    by = saved(by, "sources", files)
    total = by.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()  # two numbers
    level = (F.lit(total["size"]) - most * F.col("size_before")) / (F.lit(total["weight"]) - F.col("weight_before"))
    reached = by.withColumn("level", level).filter("fills >= level").agg(F.min(F.struct("fills", "sid", "level"))["level"].alias("level")).first()["level"]
    target = F.least(most * F.col("source_size"), F.lit(reached or 0.0) * F.col("weight")).cast("double")
    return by.select("sid", "source", "rows", "source_size", target.alias("target"))


def _permuted(place: Column, size: Column, *key: Column) -> Column:
    """The swap-or-not permutation of 0..size-1 that ``key`` chooses."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), *key, r), size) - x, size)
        swap = F.pmod(F.xxhash64(F.lit(SEED + 1), *key, r, F.greatest(x, partner)), F.lit(2)) == 0
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), place.cast("long"), step)


def slots(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(shard, place, sid, slot, block, words): every block that the mix holds, with how many of its first words; place: in the shard."""
    owed = F.floor(F.col("target") + 0.5)
    s = sources.filter("source_size > 0 and target > 0").select("sid", "source_size", owed.alias("owed"))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("full", F.floor(F.col("source_size") / block))
    s = s.withColumn("epochs", F.floor(F.col("owed") / F.col("source_size"))).withColumn("rest", F.col("owed") - F.col("epochs") * F.col("source_size"))
    s = s.withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block)).filter("slots > 0")
    files = files_for(s.count())
    s = saved(_running(s, [F.col("sid")], {"first": F.col("slots")}, files), "owed", files)
    total = s.agg(F.sum("slots")).first()[0] or 0
    # in ranges, so that a large source is not one task's
    ranges = s.withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / RANGE)))).repartition(_partitions(s), "sid", "range")
    each = ranges.withColumn("slot", F.explode(F.sequence(F.col("range") * RANGE, F.least((F.col("range") + 1) * RANGE, F.col("slots")) - 1)))
    dealt = _permuted(F.col("first") + F.col("slot"), F.lit(total), F.lit(-1).cast("long"))
    epoch, place = F.floor(F.col("slot") / F.col("blocks")), F.pmod("slot", "blocks")
    chosen = F.when(place < F.col("full"), _permuted(place, F.col("full"), F.col("sid"), epoch)).otherwise(F.col("full"))
    length = F.when(place < F.col("full"), F.lit(block)).otherwise(F.col("source_size") - F.col("full") * block)
    left = F.when(epoch < F.col("epochs"), length).otherwise(F.least(length, F.col("rest") - place * block))
    each = each.withColumn("dealt", dealt)
    return each.select(F.floor(F.col("dealt") / SHARD).alias("shard"), F.pmod("dealt", F.lit(SHARD)).cast("int").alias("place"), "sid", "slot", chosen.alias("block"), left.cast("long").alias("words"))


def mixture(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(shard, place, sid, slot, block, off, id, row, size, source_size, target, first, words): the mix, part by part.

    Slot ``slot`` of source ``sid``, which stands at ``place`` of ``shard``, holds ``words`` words of the document from its word ``first`` on, at
    the ``off``-th word of the slot; by (shard, place, off) the parts are in the order of the mix. ``row`` tells rows of one id
    apart. A document of which the mix takes nothing has one row or more without shard, place and slot and with 0 words.
    """
    sizes = saved(docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes", files_for(docs.count()))
    sources = _sources(sizes, weights, most)
    # rows that can't be told apart are counted, and numbered in ranges, so that many of them are not one task's
    kinds = sizes.groupBy("source", "id", "size").agg(F.count("*").alias("n"))
    kinds = kinds.withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RANGE)))).repartition(_partitions(docs), "id", "size", "range")
    copies = kinds.select("source", "id", "size", F.explode(F.sequence(F.col("range") * RANGE, F.least((F.col("range") + 1) * RANGE, F.col("n")) - 1)).alias("copy"))
    # every document's place in its source's stream
    known = sources.select(F.col("source").alias("_source"), "sid", "rows", "source_size", "target")
    placed = copies.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source")
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "id", "size", "copy"), F.ceil(F.col("rows") / BUCKET)))
    buckets = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    buckets = buckets.select("sid", "bucket", F.coalesce(F.sum("words").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = Window.partitionBy("sid", "bucket").orderBy("id", "size", "copy")
    placed = placed.join(buckets, ["sid", "bucket"]).withColumn("rn", F.row_number().over(within)).withColumn("off", F.col("start") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    parts = placed.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("off") / block), F.floor((F.col("off") + F.col("size") - 1) / block))).otherwise(F.array(F.lit(None).cast("long")))))
    parts = parts.withColumn("begin", F.greatest(F.col("off"), F.col("block") * block)).withColumn("end", F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * block))
    # each part with the slots that hold it; a cut slot may end before it
    # the planner takes all slots for as small as the table of sources that they come from, and would broadcast them
    held = slots(sources, block).withColumnRenamed("words", "held").hint("merge")
    joined = parts.join(held, ["sid", "block"], "left")
    words = F.greatest(F.lit(0), F.least("end", F.col("block") * block + F.col("held")) - F.col("begin"))
    joined = joined.withColumn("words", F.when(F.col("slot").isNotNull(), words).otherwise(0).cast("long"))
    some = F.col("words") > 0
    row = F.struct("sid", "bucket", "rn").alias("row")
    within_slot, within_text = F.col("begin") - F.col("block") * block, F.col("begin") - F.col("off")
    return joined.select(
        F.when(some, F.col("shard")).alias("shard"), F.when(some, F.col("place")).alias("place"), "sid", F.when(some, F.col("slot")).alias("slot"), F.when(some, F.col("block")).alias("block"), F.when(some, within_slot).alias("off"), F.col("id").alias(id_column), row, "size", "source_size", "target", F.when(some, within_text).alias("first"), "words"
    )


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(id, size, source_size, target, taken) of each document: how many of its words the mix holds."""
    out = mixture(docs, id_column, text_column, source_column, weights, most, block).groupBy("row", id_column, "size", "source_size", "target").agg(F.sum("words").alias("taken"))
    return out.select(id_column, "size", "source_size", "target", "taken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document: a row for each row, those without words or id too."""
    return mix(docs)
