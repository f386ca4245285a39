"""Renames: which of the files that go is which of those that come, by content."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens import config
from quarrylens.operators import graphs
from quarrylens.sources.tables import cut

#: pairs and files of a component that one group takes at most, and rounds that larger ones go through before they are looked at again
GROUP, ROUNDS = 100_000, 8


def _name(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def weighted_lines(blobs: DataFrame) -> DataFrame:
    """(blob_id, line, bytes) of the raw lines of each blob (blob_id, content): ``bytes`` that all copies of a line have, ends included."""
    rows = blobs.select("blob_id", F.explode(F.split("content", "\n")).alias("line"))
    own = F.struct(F.xxhash64("line").alias("x"), F.xxhash64(F.lit(1), "line").alias("y"))
    rows = rows.select("blob_id", own.alias("line"), (F.octet_length("line") + 1).alias("n"))
    return rows.groupBy("blob_id", "line").agg(F.sum("n").alias("bytes"))


def similar_blobs(gone: DataFrame, come: DataFrame, lines: DataFrame, key: list[str], least: float = config.RENAME_SHARE) -> DataFrame:
    """(key, old_blob, new_blob, score) of different blobs whose common lines hold at least ``least`` of the larger one's bytes.

    ``gone`` and ``come``: (key, blob), ``lines``: as ``weighted_lines`` gives them. Two blobs that are so alike share one of the rare lines that
    hold a little more than the rest of either, so only these are joined; candidates are confirmed on all lines. Blobs are paired, not files, so
    copies of a blob cost one row.
    """
    sides = gone.select(*key, "blob", F.lit(True).alias("old")).unionByName(come.select(*key, "blob", F.lit(False).alias("old"))).distinct()
    held = cut(sides.join(lines.withColumnRenamed("blob_id", "blob"), "blob"))
    both = held.groupBy(*key, "line").agg(F.count("*").alias("files"), F.count_if("old").alias("olds")).filter("olds > 0 and olds < files")
    size = lines.groupBy(F.col("blob_id").alias("blob")).agg(F.sum("bytes").alias("size"))
    own = held.join(size, "blob").join(both.select(*key, "line", "files"), [*key, "line"], "left")
    order = Window.partitionBy(*key, "blob", "old").orderBy(F.asc_nulls_first("files"), "line")
    before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rare = cut(own.withColumn("before", before).filter((F.col("before") <= F.col("size") * (1 - least)) & F.col("files").isNotNull()).select(*key, "blob", "old", "line", "size"))
    a = rare.filter("old").select(*key, "line", F.col("blob").alias("old_blob"), F.col("size").alias("old_size"))
    b = rare.filter("not old").select(*key, "line", F.col("blob").alias("new_blob"), F.col("size").alias("new_size"))
    near = a.join(b, [*key, "line"]).filter((F.col("old_blob") != F.col("new_blob")) & (F.least("old_size", "new_size") >= least * F.greatest("old_size", "new_size")))
    near = cut(near.select(*key, "old_blob", "new_blob", F.greatest("old_size", "new_size").alias("size")).distinct())
    side = lambda name: lines.select(F.col("blob_id").alias(name), "line", F.col("bytes").alias(f"_{name}"))
    shared = near.join(side("old_blob"), "old_blob").join(side("new_blob"), ["new_blob", "line"])
    shared = shared.groupBy(*key, "old_blob", "new_blob", "size").agg(F.sum(F.least("_old_blob", "_new_blob")).alias("common"))
    return shared.filter(F.col("common") >= least * F.col("size")).select(*key, "old_blob", "new_blob", (F.col("common") / F.col("size")).alias("score"))


def _paired(gone: DataFrame, come: DataFrame, pairs: DataFrame, key: list[str]) -> DataFrame:
    """(key, old_path, new_path, old_blob, new_blob): files of paired blobs, each blob being in one pair; those of one name first, then in order.

    The k-th file meets the k-th, so a blob that a thousand files hold is a thousand rows and not their square.
    """
    old = gone.join(pairs.select(*key, F.col("old_blob").alias("blob"), "new_blob"), [*key, "blob"]).withColumnRenamed("blob", "old_blob")
    new = come.join(pairs.select(*key, F.col("new_blob").alias("blob"), "old_blob"), [*key, "blob"]).withColumnRenamed("blob", "new_blob")
    pair = [*key, "old_blob", "new_blob"]

    def met(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
        place = lambda path: F.row_number().over(Window.partitionBy(*by).orderBy(path))
        return old.withColumn("k", place("old_path")).join(new.withColumn("k", place("new_path")), [*by, "k"]).select(*pair, "old_path", "new_path")

    old, new = old.withColumnRenamed("path", "old_path").withColumn("name", _name("old_path")), new.withColumnRenamed("path", "new_path").withColumn("name", _name("new_path"))
    same = cut(met(old, new, [*pair, "name"]))
    rest = met(old.join(same.select(*pair, "old_path"), [*pair, "old_path"], "left_anti"), new.join(same.select(*pair, "new_path"), [*pair, "new_path"], "left_anti"), pair)
    return same.unionByName(rest).select(*key, "old_path", "new_path", "old_blob", "new_blob")


def _assigned(pairs: pd.DataFrame, olds: dict[str, list[str]], news: dict[str, list[str]]) -> list[tuple[str, str, str, str]]:
    """(old_path, new_path, old_blob, new_blob) of one component: its pairs in order, each with the files that are left of its two blobs."""
    out = []
    for old, new in pairs.sort_values(["rank", "old_blob", "new_blob"])[["old_blob", "new_blob"]].itertuples(index=False):
        by_name: dict[str, list[str]] = {}
        for path in news[new]:
            by_name.setdefault(path.rsplit("/", 1)[-1], []).append(path)
        met, rest = [], []
        for path in olds[old]:
            same = by_name.get(path.rsplit("/", 1)[-1])
            met.append((path, same.pop(0))) if same else rest.append(path)
        taken = {b for _, b in met}
        met += zip(rest, [b for b in news[new] if b not in taken], strict=False)
        gone, come = {a for a, _ in met}, {b for _, b in met}
        olds[old], news[new] = [a for a in olds[old] if a not in gone], [b for b in news[new] if b not in come]
        out += [(a, b, old, new) for a, b in met]
    return out


def _settled(pairs: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """The renames of whole components, a group each; ``pairs``: (key, component, old_blob, new_blob, score), ``files``: (key, component, path, blob, old)."""
    names = ["old_path", "new_path", "old_blob", "new_blob"]
    schema = ", ".join([*[f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in key], *[f"{c} string" for c in names]])

    def settle(pairs: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        own = {side: {} for side in (True, False)}
        for path, blob, old in sorted(files[["path", "blob", "old"]].itertuples(index=False), key=lambda r: r[0].encode()):
            own[bool(old)].setdefault(blob, []).append(path)
        found = pd.DataFrame(_assigned(pairs.assign(rank=-pairs["score"]), own[True], own[False]), columns=names)
        for place, k in enumerate(key):
            found.insert(place, k, pairs[k].iloc[0])
        return found

    return pairs.groupBy(*key, "component").cogroup(files.groupBy(*key, "component")).applyInPandas(settle, schema)


def detect(gone: DataFrame, come: DataFrame, key: list[str], lines: DataFrame | None = None, least: float = config.RENAME_SHARE) -> DataFrame:
    """(key, old_path, new_path, old_blob, new_blob): one file that goes for one that comes; ``gone`` and ``come``: (key, path, blob).

    Equal blobs come first. Then, with ``lines`` (see ``weighted_lines``), blobs are assigned by similarity: in the order of score, then of blobs, each pair takes
    as many of the files that are left as both have. That order is found in rounds: a pair that is the best for both of its
    blobs among those that have files left is taken, and all such pairs at once. Copies that are all alike would take a round each, so
    components of pairs of up to ``GROUP`` rows are settled by a group each, and only larger ones in rounds. Empty files are renamed only for empty ones.
    """
    out = _paired(gone, come, gone.select(*key, F.col("blob").alias("old_blob")).distinct().withColumn("new_blob", F.col("old_blob")), key)
    if lines is None:
        return out
    out = cut(out)
    left = lambda files, side: files.join(out.select(*key, F.col(side).alias("path")), [*key, "path"], "left_anti")
    gone_left, come_left = cut(left(gone, "old_path")), cut(left(come, "new_path"))
    pairs = cut(similar_blobs(gone_left, come_left, lines, key, least))
    rank = F.struct((-F.col("score")).alias("score"), "old_blob", "new_blob")
    of = lambda files, side: files.join(pairs.select(*key, F.col(side).alias("blob")).distinct(), [*key, "blob"], "left_semi")
    while not pairs.isEmpty():
        gone_left, come_left = cut(of(gone_left, "old_blob")), cut(of(come_left, "new_blob"))
        member = graphs.components(pairs.select(*key, F.col("old_blob").alias("a"), F.col("new_blob").alias("b")), key).withColumnRenamed("node", "blob")
        own = cut(pairs.join(member.withColumnRenamed("blob", "old_blob"), [*key, "old_blob"]))
        files = cut(gone_left.withColumn("old", F.lit(True)).unionByName(come_left.withColumn("old", F.lit(False))).join(member, [*key, "blob"]))
        each = [*key, "component"]
        large = cut(own.select(*each).unionByName(files.select(*each)).groupBy(*each).agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).drop("n"))
        out = cut(out.unionByName(_settled(own.join(large, each, "left_anti"), files.join(large, each, "left_anti"), key)))
        pairs = cut(own.join(large, each, "left_semi").select(*pairs.columns))
        for _ in range(ROUNDS):
            if pairs.isEmpty():
                break
            ranked = pairs.withColumn("rank", rank)
            best = lambda side, ranked=ranked: ranked.groupBy(*key, side).agg(F.min("rank").alias(f"_{side}"))
            mutual = cut(ranked.join(best("old_blob"), [*key, "old_blob"]).join(best("new_blob"), [*key, "new_blob"]).filter("rank = _old_blob and rank = _new_blob").select(*key, "old_blob", "new_blob"))
            found = cut(_paired(gone_left, come_left, mutual, key))
            out = out.unionByName(found)
            gone_left = cut(of(gone_left, "old_blob").join(found.select(*key, F.col("old_path").alias("path")), [*key, "path"], "left_anti"))
            come_left = cut(of(come_left, "new_blob").join(found.select(*key, F.col("new_path").alias("path")), [*key, "path"], "left_anti"))
            pairs = pairs.join(gone_left.select(*key, F.col("blob").alias("old_blob")).distinct(), [*key, "old_blob"], "left_semi")
            pairs = cut(pairs.join(come_left.select(*key, F.col("blob").alias("new_blob")).distinct(), [*key, "new_blob"], "left_semi"))
    return out
