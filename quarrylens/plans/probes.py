"""Audits of many repositories at once, without a stored run: HEAD figures of a cohort, imports, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens import config
from quarrylens.functions import text as X
from quarrylens.operators import clones, lines
from quarrylens.plans import analysis
from quarrylens.sources.tables import cut, head_only

#: how many files of each repository a bundle audit names
BUNDLES_NAMED = 4


def _heads(tables: dict[str, DataFrame], globs: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(relevant files of each HEAD tree, views of their blobs)."""
    trees = tables["tree_files"].filter(X.is_relevant(F.col("path"), globs))
    at_head = head_only(tables["commits"])
    tree = cut(trees.join(at_head, "repo_id").filter(lines.tree_at(trees, F.col("idx"))).select("repo_id", "path", "blob_id"))
    blobs = tables["blobs"].dropDuplicates(["blob_id"]).join(tree.select("blob_id").distinct(), "blob_id", "left_semi")
    return tree, cut(lines.file_views(blobs))


def cohort(tables: dict[str, DataFrame], names: DataFrame, globs: tuple[str, ...] = config.DEFAULT_EXCLUDES) -> DataFrame:
    """(repo, files, loc, dupLines, ratioPct, clones, topExt, topExtFiles, mirrors) of every repository (repo_id, repo) at HEAD; a row without figures where nothing could be read."""
    tree, views = _heads(tables, globs)
    flagged, kept, found, by_file = analysis._duplicates(tree, views)
    held = kept.join(tree, ["repo_id", "path"]).join(views.select("blob_id", F.size("code").alias("n")), "blob_id")
    size = held.groupBy("repo_id").agg(F.count_if(F.col("n") > 0).cast("int").alias("files"), F.sum("n").cast("int").alias("loc"))
    dup = by_file.groupBy("repo_id").agg(F.sum("dup_lines").cast("int").alias("dupLines"))
    n = found.groupBy("repo_id").agg(F.count("*").cast("int").alias("clones"))
    top = lines.dominant_extension(kept, ["repo_id"]).select("repo_id", F.col("extension").alias("topExt"), F.col("files").cast("int").alias("topExtFiles"))
    twins = flagged.groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "mirror", "original"))), lambda m: F.concat(m["mirror"], F.lit(" (= "), m["original"], F.lit(")"))), ", ").alias("mirrors"))
    out = names.select("repo_id", "repo").join(size, "repo_id", "left").join(dup, "repo_id", "left").join(n, "repo_id", "left").join(top, "repo_id", "left").join(twins, "repo_id", "left")
    measured = F.col("loc").isNotNull()
    out = out.withColumns({c: F.when(measured, F.coalesce(c, F.lit(0))) for c in ("dupLines", "clones")}).withColumn("ratioPct", F.when(measured, X.half_up(100.0 * X.ratio(F.col("dupLines"), F.col("loc")), 2)))
    return out.select("repo", "files", "loc", "dupLines", "ratioPct", "clones", "topExt", "topExtFiles", F.coalesce("mirrors", F.lit("")).alias("mirrors"))


def imports(stats: DataFrame) -> DataFrame:
    """(repo_id, idx, sha, added, moved, parent_lines, share, subject): the commits that count as imports, by how much they bring in, with what decided it."""
    own = stats.filter("import_commit")
    return own.select("repo_id", "idx", X.short_sha(F.col("sha")).alias("sha"), "added", "moved", "parent_lines", X.half_up(X.ratio(F.col("added"), F.col("parent_lines")), 2).alias("share"), "subject").orderBy("repo_id", F.col("added").desc(), "idx")


def bundles(tables: dict[str, DataFrame], globs: tuple[str, ...] = config.DEFAULT_EXCLUDES, most: int = BUNDLES_NAMED) -> DataFrame:
    """The files of each HEAD tree that look most like bundles of others."""
    tree, views = _heads(tables, globs)
    _, kept, found, by_file = analysis._duplicates(tree, views)
    sizes = kept.join(tree, ["repo_id", "path"]).join(views.select("blob_id", F.size("norm").alias("norm_lines")), "blob_id").select("repo_id", "path", "norm_lines")
    return clones.bundles(by_file, sizes, found, ["repo_id"], most)
