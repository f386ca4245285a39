"""Results of runs on disk: metrics, clones and reports of each repository, and the small table of repositories."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens import config
from quarrylens.sources import sinks, snapshots
from quarrylens.sources.tables import cut


def _there(spark: SparkSession, path: str):
    """(file system, path, whether it exists)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, at, fs.exists(at)


def persist(root: str, repos: DataFrame, chain: DataFrame, stats: DataFrame, clones: DataFrame, runs: DataFrame, tries: int = 5) -> None:
    """Stores what a run computed, in one transaction (see ``snapshots``). ``chain``: (repo_id, sha) of the current histories; ``runs``: (repo_id, started_at, report).

    Results of repositories that are no longer among ``repos`` are dropped. Cached metrics stay where their commit is still in the chain and
    wasn't computed again; those of another version go. Clones (the ``CLONES_SHOWN`` shown) and the run are replaced. A run that
    fails at any point leaves all tables as they were; one that meets another run on the same repositories merges again.
    """
    spark = stats.sparkSession
    known = cut(repos.select(F.col("repo_id").cast("int").alias("repo_id")).distinct())
    stats, clones, runs = (cut(d.join(known, "repo_id", "left_semi")) for d in (stats, clones, runs))
    for left in reversed(range(tries)):
        base = snapshots.snapshot(spark, root)
        held = stored(spark, root)
        merged = stats
        if "commits" in base.schemas:
            # rows that commits of the current version left, but for the repositories that this run dropped
            old = snapshots.read(spark, root, "commits", base.version).filter(F.col("algo_version") == config.ALGO_VERSION).join(runs.select("repo_id").distinct(), "repo_id", "left_semi")
            merged = sinks.merged_metrics(old, stats, chain)
        tables = {"commits": merged.withColumn("algo_version", F.lit(config.ALGO_VERSION)), "clones": clones.filter(F.col("rank") <= config.CLONES_SHOWN), "runs": runs.withColumn("status", F.lit("OK"))}
        changed = runs.select("repo_id").unionByName(held.join(known, "repo_id", "left_anti"))
        try:
            snapshots.commit(spark, root, tables, changed, base)
            return
        except snapshots.Conflict:
            if not left:
                raise


def stored(spark: SparkSession, root: str) -> DataFrame:
    """(repo_id) of the repositories that have results."""
    return snapshots.entries(spark, root, snapshots.snapshot(spark, root)).select("repo_id").distinct()


def drop_cache(spark: SparkSession, root: str, repo_ids: list[int]) -> None:
    """Forgets all results of some repositories."""
    snapshots.commit(spark, root, {}, spark.createDataFrame([(r,) for r in repo_ids], "repo_id int"))


def cached(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(commit metrics of the current version, previous_run_at by repository) of one snapshot, for an incremental analysis."""
    version = snapshots.snapshot(spark, root).version
    metrics = snapshots.read(spark, root, "commits", version).filter(F.col("algo_version") == config.ALGO_VERSION)
    return metrics, snapshots.read(spark, root, "runs", version).groupBy("repo_id").agg(F.max("started_at").alias("previous_run_at"))


# the table of repositories: a few rows, written whole


def repositories(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _there(spark, path)[2] else spark.createDataFrame([], schema)


def replace_table(rows: DataFrame, path: str) -> None:
    """``rows`` in place of a table that they may have been read from: written beside it, then moved."""
    spark = rows.sparkSession
    aside = f"{path}-{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    fs, at, there = _there(spark, path)
    if there:
        fs.delete(at, True)
    fs.rename(_there(spark, aside)[1], at)


def created(repos: DataFrame, row: dict) -> DataFrame:
    """``repos`` with a new row, whose id is the next one; a remote that is already there is refused."""
    held = repos.collect()  # the table of an administration page
    if any(sinks._canonical(r["url"]) == sinks._canonical(row["url"]) for r in held):
        raise ValueError("this remote is already registered")
    row = row | {"repo_id": max((r["repo_id"] for r in held), default=0) + 1}
    return repos.sparkSession.createDataFrame([*held, tuple(row.get(c) for c in repos.columns)], repos.schema)


def updated(repos: DataFrame, repo_id: int, change: dict) -> tuple[DataFrame, bool]:
    """``repos`` after a change of one row, and whether its results have to go: only another remote drops them."""
    rows, moved = [], False
    for r in repos.collect():
        own = r.asDict()
        if own["repo_id"] == repo_id:
            own, moved = sinks.updated_repo(own, change)
        rows.append(tuple(own.get(c) for c in repos.columns))
    return repos.sparkSession.createDataFrame(rows, repos.schema), moved


def deleted(repos: DataFrame, repo_id: int) -> DataFrame:
    return repos.filter(F.col("repo_id") != repo_id)
