"""Churn: added lines that are deleted again within two weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens import config


def matches(events: DataFrame, keys: list[str], order: list[str], at: str = "at", added: str = "is_add", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each deletion with the addition that it undoes: the latest one of the same key that none has undone yet.

    Additions and deletions of a key are brackets; a deletion without an open addition is unmatched. The running depth (never
    below zero) gives every event a level, and on each level a deletion undoes the addition right before it, so a
    stack takes three window sums and no state. Within one place in ``order`` deletions come first; which of
    several additions there is undone is left open, how many are is not. Result: keys, the
    addition's ``at`` and ``carry`` columns (``add_*``), the deletion's (``del_*``).
    """
    by = [*order[:1], F.col(added).cast("int"), *order[1:]]
    d = _levels(events, keys, by, added)
    level = Window.partitionBy(*keys, "_level").orderBy("_n")
    d = d.withColumn("_open", F.lag(F.struct(added, at, *carry)).over(level))
    d = d.filter(~F.col(added) & (F.col("_level") > 0) & F.col(f"_open.{added}"))
    return d.select(*keys, *[F.col(f"_open.{c}").alias(f"add_{c}") for c in (at, *carry)], *[F.col(c).alias(f"del_{c}") for c in (at, *carry)])


def _levels(events: DataFrame, keys: list[str], by: list, added: str) -> DataFrame:
    # events of one place are numbered once: every window sorts anew, and spilled sorts need not bring ties in one order
    d = events.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    run = Window.partitionBy(*keys).orderBy("_n")
    all_before = run.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_d", F.when(F.col(added), 1).otherwise(-1)).withColumn("_cs", F.sum("_d").over(all_before))
    d = d.withColumn("_depth", F.col("_cs") - F.least(F.lit(0), F.min("_cs").over(all_before)))
    return d.withColumn("_level", F.when(F.col(added), F.col("_depth")).otherwise(F.lag("_depth", 1, 0).over(run)))


def open_additions(events: DataFrame, keys: list[str], order: list[str], added: str = "is_add") -> DataFrame:
    """The additions that no deletion has undone: on their level, nothing comes after them. A stream can go on from them."""
    by = [*order[:1], F.col(added).cast("int"), *order[1:]]
    d = _levels(events, keys, by, added)
    last = F.lead("_level").over(Window.partitionBy(*keys, "_level").orderBy("_n")).isNull()
    return d.withColumn("_last", last).filter(F.col(added) & F.col("_last")).drop("_n", "_d", "_cs", "_depth", "_level", "_last")


def _renamed(renames: DataFrame) -> DataFrame:
    """(repo_id, path, idx_from, lineage) of the names that a rename gives."""
    return lineages(renames, renames.select("repo_id", F.col("new_path").alias("path"), "idx").limit(0))


def named(events: DataFrame, renames: DataFrame) -> DataFrame:
    """``events`` (repo_id, idx, path, ...) with the lineage of their file: what the latest rename into its path says, or the path itself.

    ``renames``: (repo_id, idx, old_path, new_path). A rename holds from its commit on, for lines that the commit removes or adds under that name.
    """
    origin = _renamed(renames).groupBy("repo_id", "path").agg(F.array_sort(F.collect_list(F.struct("idx_from", "lineage"))).alias("_o"))  # the renames into one name
    last = F.try_element_at(F.filter("_o", lambda x: x["idx_from"] <= F.col("idx")), F.lit(-1))
    return events.join(origin, ["repo_id", "path"], "left").withColumn("lineage", F.coalesce(last["lineage"], "path")).drop("_o")


def names(renames: DataFrame) -> DataFrame:
    """(repo_id, path, lineage) of the names that files have after all renames."""
    return _renamed(renames).groupBy("repo_id", "path").agg(F.max_by("lineage", "idx_from").alias("lineage"))


def churned(found: DataFrame, window_ms: int = config.CHURN_WINDOW_MS, at: str = "at") -> DataFrame:
    """Matches within the window; one with a negative age (dates out of order) counts."""
    return found.filter(F.col(f"del_{at}") - F.col(f"add_{at}") <= window_ms)


def is_censored(committed_at: Column, now: Column) -> Column:
    """Whether the window after a commit hasn't closed yet, so that its churn is unknown."""
    return (now - committed_at) < config.CHURN_WINDOW_MS


def watermark(commits: DataFrame, now: Column, partition: list[str], order: str = "idx", at: str = "committed_at") -> DataFrame:
    """``commits`` with the latest believable time so far: times after ``now`` don't move it."""
    believable = F.when(F.col(at) <= now, F.col(at))
    return commits.withColumn("watermark", F.max(believable).over(Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def lineages(renames: DataFrame, paths: DataFrame) -> DataFrame:
    """(repo_id, path, idx_from, lineage): the first name of the file that a path names from a commit on.

    ``renames``: (repo_id, idx, old_path, new_path); ``paths``: (repo_id, path, idx) of first additions. A name is followed back by
    the latest rename into it before the one that was followed last, until no name moves. A rename is followed as far as it
    has come itself, so a chain of n takes about log2(n) joins.
    """
    from quarrylens.sources.tables import cut

    key = ["repo_id", "path", "idx_from", "renamed"]
    start = paths.select("repo_id", "path", F.col("idx").alias("idx_from"), F.lit(False).alias("renamed"), F.col("path").alias("lineage"))
    start = start.unionByName(renames.select("repo_id", F.col("new_path").alias("path"), F.col("idx").alias("idx_from"), F.lit(True).alias("renamed"), F.col("old_path").alias("lineage")))
    now = cut(start.withColumn("until", F.col("idx_from")))
    while True:
        edge = now.filter("renamed").select(F.col("repo_id").alias("_repo"), F.col("path").alias("_name"), F.col("idx_from").alias("_at"), F.col("lineage").alias("_older"), F.col("until").alias("_until"))
        step = now.join(edge, (F.col("repo_id") == F.col("_repo")) & (F.col("lineage") == F.col("_name")) & (F.col("_at") < F.col("until")), "left")
        step = cut(step.groupBy(*key, "lineage", "until").agg(F.max(F.when(F.col("_at").isNotNull(), F.struct("_at", "_until", "_older"))).alias("_to")))
        now = step.select(*key, F.coalesce("_to._older", "lineage").alias("lineage"), F.coalesce("_to._until", "until").alias("until"))
        if step.filter("_to is not null").isEmpty():
            return now.select("repo_id", "path", "idx_from", "lineage")
