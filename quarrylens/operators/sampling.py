"""Which commits get the costly whole-tree statistics, where a trend starts, and chart buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens import config


def chain(commits: DataFrame, head: DataFrame, most: int = config.MAX_COMMITS) -> DataFrame:
    """The first-parent chain of each head, oldest first: (repo_id, sha, idx, truncated); at most the newest ``most``.

    ``commits``: (repo_id, sha, parent_sha), ``head``: (repo_id, sha). Pointers double in each round, so a chain of n commits takes
    log2(n) joins.
    """
    from quarrylens.sources.tables import cut

    c = commits.select("repo_id", "sha", "parent_sha")
    known = c.select(F.col("repo_id"), F.col("sha").alias("_s"))
    jump = cut(c.join(known.withColumnRenamed("_s", "parent_sha"), ["repo_id", "parent_sha"], "left_semi").select("repo_id", F.col("sha").alias("frm"), F.col("parent_sha").alias("to")))
    reached = cut(head.select("repo_id", "sha", F.lit(0).cast("long").alias("dist")))
    size = 1
    while size <= most:
        step = reached.join(jump.withColumnRenamed("frm", "sha"), ["repo_id", "sha"]).select("repo_id", F.col("to").alias("sha"), (F.col("dist") + size).alias("dist"))
        fresh = step.count()
        reached = cut(reached.unionByName(step))
        if not fresh:
            break
        jump = cut(jump.alias("a").join(jump.select("repo_id", F.col("frm").alias("to"), F.col("to").alias("further")).alias("b"), ["repo_id", "to"]).select("repo_id", "frm", F.col("further").alias("to")))
        size *= 2
    count = Window.partitionBy("repo_id")
    kept = reached.withColumn("_n", F.count("*").over(count)).filter(F.col("dist") < most)
    newest = Window.partitionBy("repo_id").orderBy(F.col("dist").desc())
    return kept.select("repo_id", "sha", (F.row_number().over(newest) - 1).alias("idx"), (F.col("_n") > most).alias("truncated"))


def day_firsts(commits: DataFrame, partition: list[str], at: str = "committed_at", order: str = "idx") -> DataFrame:
    """Rows whose day differs from the row's before: dates may go back, so a day can come again."""
    day = F.floor(F.col(at) / config.DAY_MS)
    before = F.lag(day).over(Window.partitionBy(*partition).orderBy(order))
    return commits.withColumn("day", day).withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.col("day"))).drop("_b")


def sampled(commits: DataFrame, partition: list[str], at: str = "committed_at", order: str = "idx", target: int = config.STATIC_SAMPLE_TARGET) -> DataFrame:
    """Every so-manieth of the day-first rows, so that about ``target`` are left, and the first and the last row."""
    days = day_firsts(commits, partition, at, order)
    run, whole = Window.partitionBy(*partition).orderBy(order), Window.partitionBy(*partition)
    days = days.withColumn("_r", F.row_number().over(run) - 1).withColumn("_step", F.greatest(F.lit(1), F.ceil(F.count("*").over(whole) / target)))
    picked = days.filter(F.pmod("_r", "_step") == 0).select(*partition, order)
    ends = commits.groupBy(*partition).agg(F.min(order).alias("_a"), F.max(order).alias("_b")).select(*partition, F.explode(F.array("_a", "_b")).alias(order))
    return commits.join(picked.union(ends).distinct(), [*partition, order], "left_semi")


def window_reference(rows: DataFrame, partition: list[str], days: int | Column, at: str = "committed_at", order: str = "idx", is_sampled: Column | None = None) -> DataFrame:
    """(partition, ref): the first sampled row, in order, not older than ``days`` (a number, or an aggregate) before the last row; else the oldest sampled one."""
    use = is_sampled if is_sampled is not None else F.lit(True)
    last = rows.groupBy(*partition).agg((F.max_by(at, order) - days * config.DAY_MS).alias("_cut"))
    held = rows.join(last, partition)
    inside = F.when(use & (F.col(at) >= F.col("_cut")), F.col(order))
    return held.groupBy(*partition).agg(F.coalesce(F.min(inside), F.min(F.when(use, F.col(order)))).alias("ref"))


def buckets(commits: DataFrame, partition: list[str], order: str = "idx", most: int = config.CHART_BUCKETS) -> DataFrame:
    """Chart buckets over non-import rows: ceil(n / most) rows each; churn over uncensored rows; whether the last is partial."""
    run, whole = Window.partitionBy(*partition).orderBy(order), Window.partitionBy(*partition)
    own = commits.filter(~F.col("import_commit")).withColumn("_size", F.ceil(F.count("*").over(whole) / most)).withColumn("bucket", F.floor((F.row_number().over(run) - 1) / F.col("_size")))
    open_ = ~F.col("churn_censored")
    return own.groupBy(*partition, "bucket").agg(
        F.count("*").alias("commits"), F.sum("added").alias("added"), F.sum("copied").alias("copied"), F.sum("moved").alias("moved"), F.sum(F.when(open_, F.col("added")).otherwise(0)).alias("churn_added"),
        F.sum(F.when(open_, F.col("churn")).otherwise(0)).alias("churn"), F.count_if(~open_).alias("censored"), (F.count("*") < F.first("_size")).alias("partial"),
    )
