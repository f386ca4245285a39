"""What an incremental run has to compute again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens import config


def floors(commits: DataFrame, cached: DataFrame, previous: DataFrame, samples: DataFrame) -> DataFrame:
    """(repo_id, floor): the first commit to compute again.

    Its time is one churn window before the earlier of the oldest commit without cached metrics and one window before the previous
    run; and no sampled commit without statistics lies before it. Without a cache or a previous run it is 0.
    """
    key = ["repo_id", "sha"]
    missing = commits.join(cached.select(*key), key, "left_anti").groupBy("repo_id").agg(F.min("committed_at").alias("oldest"))
    gaps = samples.select("repo_id", "sha", "idx").join(cached.filter(F.col("loc").isNotNull()).select(*key), key, "left_anti").groupBy("repo_id").agg(F.min("idx").alias("gap"))
    have = cached.groupBy("repo_id").agg(F.count("*").alias("n"))
    own = commits.select("repo_id", "idx", "committed_at").join(missing, "repo_id", "left").join(previous, "repo_id", "left").join(gaps, "repo_id", "left").join(have, "repo_id", "left")
    since = F.least("oldest", F.col("previous_run_at") - config.CHURN_WINDOW_MS) - config.CHURN_WINDOW_MS
    last = F.max("idx") + 1
    by_time = F.coalesce(F.min(F.when(F.col("committed_at") >= since, F.col("idx"))), last)
    known = F.max(F.col("n").isNotNull() & F.col("previous_run_at").isNotNull())
    return own.groupBy("repo_id").agg(F.when(known, F.least(by_time, F.coalesce(F.min("gap"), last))).otherwise(0).cast("int").alias("floor"))


def suffix(rows: DataFrame, floor: DataFrame, lookback_ms: int = 0) -> DataFrame:
    """The rows from the floor on, or from so long before its commit."""
    held = rows.join(floor, "repo_id")
    if not lookback_ms:
        return held.filter(F.col("idx") >= F.col("floor")).drop("floor")
    begin = rows.join(floor, "repo_id").filter(F.col("idx") == F.col("floor")).select("repo_id", (F.col("committed_at") - lookback_ms).alias("_from"))
    return held.join(begin, "repo_id", "left").filter((F.col("idx") >= F.col("floor")) | (F.col("committed_at") >= F.col("_from"))).drop("floor", "_from")
