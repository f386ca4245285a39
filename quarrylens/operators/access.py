"""Who sees which repository, and which repositories a reference names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import text as X


def visible(repos: DataFrame, spaces: DataFrame) -> DataFrame:
    """The repositories that a user sees through any of their spaces (user, space_key); those without spaces are for administrators."""
    linked = repos.select("repo_id", F.explode("space_keys").alias("space_key"))
    seen = linked.join(spaces, "space_key").select("user", "repo_id").distinct()
    return seen.join(repos, "repo_id")


def unknown_spaces(asked: Column, existing: Column) -> Column:
    return F.array_except(asked, existing)


def candidates(repos: DataFrame) -> DataFrame:
    """(repo_id, ref): every form by which a repository may be named: id, name, remote, owner/name, and the bare name."""
    forms = F.array_distinct(F.filter(F.array(F.col("repo_id").cast("string"), F.lower(F.trim("name")), F.lower(X.canonical_remote(F.col("url"))), F.lower(X.owner_and_name(F.col("url"))), F.lower(X.repo_name(F.col("url")))), lambda x: x.isNotNull() & (x != "")))
    return repos.select("repo_id", F.explode(forms).alias("ref"))


def wanted(selection: DataFrame) -> DataFrame:
    """(…, ref): the references of a selection text, split at commas and line ends, in their normal form."""
    return selection.withColumn("ref", F.explode(F.split(F.coalesce("selection", F.lit("")), r"[,\n]"))).withColumn("ref", F.lower(X.canonical_remote(F.trim("ref")))).filter("ref <> ''")


def matched(repos: DataFrame, selection: DataFrame) -> DataFrame:
    """Repositories that a selection names: whole forms only, never parts; an empty selection names none."""
    return candidates(repos).join(wanted(selection), "ref").select("repo_id", "ref").distinct()


def unresolved(repos: DataFrame, selection: DataFrame) -> DataFrame:
    return wanted(selection).join(candidates(repos).select("ref").distinct(), "ref", "left_anti").select("ref").distinct()


def named(repos: DataFrame) -> DataFrame:
    """Names derived from remotes: the last segment, or owner/name where two share it."""
    from pyspark.sql.window import Window

    own = repos.withColumn("_n", X.repo_name(F.col("url")))
    return own.withColumn("derived", F.when(F.count("*").over(Window.partitionBy(F.lower("_n"))) > 1, X.owner_and_name(F.col("url"))).otherwise(F.col("_n"))).drop("_n")


def searched(repos: DataFrame, needle: str) -> DataFrame:
    return repos.filter(F.instr(F.lower("name"), needle.lower()) > 0)


def pending(repos: DataFrame) -> DataFrame:
    return repos.filter(F.col("status").isin("QUEUED", "RUNNING"))
