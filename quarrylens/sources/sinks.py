"""Writers: partitioned metric tables, reports as JSON or pages, annotated TSV; and the small tables of repositories and runs."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens import config
from quarrylens.functions import text as X


def write_metrics(stats: DataFrame, path: str, version: int = config.ALGO_VERSION) -> None:
    """Replaces the partitions of the repositories in ``stats``, and no others."""
    rows = stats.withColumn("algo_version", F.lit(version))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("algo_version", "repo_id").parquet(path)


def read_metrics(spark: SparkSession, path: str, repo_id: int | None = None, version: int = config.ALGO_VERSION) -> DataFrame:
    """Cached metrics of the current version; both filters prune partitions."""
    rows = spark.read.parquet(path).filter(F.col("algo_version") == version)
    return rows.filter(F.col("repo_id") == repo_id) if repo_id is not None else rows


def merged_metrics(cached: DataFrame, fresh: DataFrame, chain: DataFrame) -> DataFrame:
    """What a run stores: fresh rows, and cached rows that are still in the chain and weren't recomputed."""
    key = ["repo_id", "sha"]
    stay = cached.join(chain.select(*key), key, "left_semi").join(fresh.select(*key), key, "left_anti")
    return stay.select(*fresh.columns).unionByName(fresh)


def vanished(cached: DataFrame, chain: DataFrame) -> DataFrame:
    """Cached commits that are no longer in the chain."""
    return cached.join(chain.select("repo_id", "sha"), ["repo_id", "sha"], "left_anti")


def write_report(report: DataFrame, path: str) -> None:
    report.select("repo_id", F.to_json(F.struct(*[c for c in report.columns if c != "repo_id"])).alias("report")).write.mode("overwrite").parquet(path)


def page(report_json: str, title: str) -> str:
    """A page of its own that holds a report's JSON."""
    safe = report_json.replace("</", "<\\/")
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><script id="report" type="application/json">{safe}</script><pre id="out"></pre><script>document.getElementById("out").textContent=JSON.stringify(JSON.parse(document.getElementById("report").textContent),null,1)</script></body></html>'


def write_annotated(cohort: DataFrame, path: str, dropped: dict[str, str], least_loc: int = 1_000) -> None:
    """A cohort's rows with included and excludeReason, as TSV files."""
    annotated(cohort, dropped, least_loc).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def annotated(cohort: DataFrame, dropped: dict[str, str], least_loc: int = 1_000) -> DataFrame:
    by_hand = F.create_map(*[F.lit(x) for kv in dropped.items() for x in kv]) if dropped else F.expr("cast(map() as map<string,string>)")
    reason = F.when(F.col("loc").isNull(), "probe failed").when(F.col("loc") < least_loc, f"under {least_loc} measured lines").otherwise(F.try_element_at(by_hand, F.col("repo")))
    return cohort.withColumn("excludeReason", reason).withColumn("included", F.when(F.col("excludeReason").isNull(), "yes").otherwise("no"))


# repositories and runs: small tables that whole rewrites keep


def updated_repo(current: dict, change: dict) -> tuple[dict, bool]:
    """A repository after an update, and whether its cached results go: only another remote drops them. A null token stays, an empty one clears it."""
    new = current | {k: v for k, v in change.items() if k != "token"}
    if change.get("token") is not None:
        new["token"] = change["token"] or None
    return new, _canonical(new.get("url")) != _canonical(current.get("url"))


def _canonical(url: str | None) -> str:
    bare = re.sub(r"^(\w[\w+.\-]*://)[^/@]*@", r"\1", (url or "").strip())
    m = re.match(r"^(\w[\w+.\-]*://[^/]*)(.*)$", bare)
    bare = m[1].lower() + m[2] if m else bare
    return re.sub(r"\.git$", "", bare.rstrip("/"))


def released(status: Column, at: Column, now: Column, minutes: int = 10) -> Column:
    """The status of a job, failed where it is queued or running and hasn't been renewed."""
    return F.when(status.isin("QUEUED", "RUNNING") & (at <= now - minutes * 60_000), "FAILED").otherwise(status)


def upserted(status: DataFrame, fresh: DataFrame) -> DataFrame:
    """The states of jobs (repo_id, status, at, …) with ``fresh`` ones in place of those they renew."""
    return status.join(fresh.select("repo_id"), "repo_id", "left_anti").unionByName(fresh)


def renewed(status: DataFrame, live: DataFrame, now: Column) -> DataFrame:
    """A heartbeat: jobs that are queued or running and among ``live`` (repo_id) are as of ``now``."""
    beat = status.join(live.select("repo_id").distinct().withColumn("_live", F.lit(True)), "repo_id", "left")
    return beat.withColumn("at", F.when(F.col("_live") & F.col("status").isin("QUEUED", "RUNNING"), now).otherwise(F.col("at"))).drop("_live")


def latest_ok(runs: DataFrame) -> DataFrame:
    """The latest run of each repository that went well."""
    return runs.filter(F.col("status") == "OK").groupBy("repo_id").agg(F.max_by(F.struct(*[F.col(c) for c in runs.columns if c != "repo_id"]), "started_at").alias("r")).select("repo_id", "r.*")


def with_reports(repos: DataFrame, runs: DataFrame) -> DataFrame:
    """Repositories in order of name, with whether a report is there; only ids of runs are read."""
    have = runs.filter(F.col("status") == "OK").select("repo_id").distinct().withColumn("has_report", F.lit(True))
    return repos.join(have, "repo_id", "left").na.fill(False, ["has_report"]).orderBy(F.lower("name"), "repo_id")


def redacted_repos(repos: DataFrame, is_admin: bool) -> DataFrame:
    out = repos.withColumn("url", X.redact(F.col("url")))
    return out.withColumn("status_message", F.col("status_message") if is_admin else F.lit("")) if "status_message" in repos.columns else out

