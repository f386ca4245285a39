"""The whole analysis of repositories: from history tables to commit metrics, HEAD figures, grades, findings and a report."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens import config
from quarrylens.config import Thresholds
from quarrylens.functions import scanners
from quarrylens.functions import text as X
from quarrylens.operators import changes, churn, clones, findings, grading, identities, incremental, lines, metrics, mirrors, sampling
from quarrylens.sources.tables import cut
from quarrylens.sources.window_index import WindowIndex


@dataclass
class Outcome:
    """What an analysis yields, each a DataFrame by repo_id."""

    stats: DataFrame
    head: DataFrame
    authors: DataFrame
    clones: DataFrame
    bundles: DataFrame
    mirrors: DataFrame
    suspects: DataFrame
    grades: DataFrame
    findings: DataFrame
    caveats: DataFrame


class Cancelled(Exception):
    """A run was asked to stop."""


def _silent(phase: str, done: int, of: int) -> bool:
    return True


@contextlib.contextmanager
def _described(spark: SparkSession) -> Iterator[None]:
    """Gives the jobs that follow the description back that they had before."""
    name, context = "spark.job.description", spark.sparkContext
    before = context.getLocalProperty(name)
    try:
        yield
    finally:
        context.setLocalProperty(name, before)


def analyse(
    tables: dict[str, DataFrame],
    now_ms: int,
    thresholds: Thresholds | None = None,
    globs: tuple[str, ...] = config.DEFAULT_EXCLUDES,
    repos: DataFrame | None = None,
    cached: DataFrame | None = None,
    previous: DataFrame | None = None,
    progress: Callable[[str, int, int], bool] = _silent,
    index: WindowIndex | None = None,
) -> Outcome:
    """``tables``: as ``quarrylens.sources.git.tables`` makes them. ``now_ms``: the analysis clock.

    ``repos`` (repo_id, excludes, thresholds) may add globs and override thresholds for each repository. With ``cached`` metrics and
    ``previous`` (repo_id, previous_run_at) only the commits from the replay floor on are computed again; the figures are the
    same. ``progress`` is told of each phase as it begins; where it answers False the run ends with ``Cancelled``. ``runs.Run`` stops jobs too. ``index`` keeps the windows
    of blobs between runs, so that a run makes those of new blobs only.
    """
    with _described(tables["commits"].sparkSession):
        return _analyse(tables, now_ms, thresholds, globs, repos, cached, previous, progress, index)


def _analyse(tables, now_ms, thresholds, globs, repos, cached, previous, progress, index) -> Outcome:

    def phase(name: str) -> None:
        names = ("read", "replay", "authors", "duplicates", "grades")
        commits.sparkSession.sparkContext.setJobDescription(f"analysis: {name}")
        if progress(name, names.index(name) + 1, len(names)) is False:
            raise Cancelled(name)

    commits, base = tables["commits"], thresholds or Thresholds()
    t = base if repos is None else grading.RowThresholds()
    phase("read")
    views = cut(lines.file_views(tables["blobs"].dropDuplicates(["blob_id"])))
    own = None
    if repos is not None:
        own = repos.select("repo_id", X.globs_pattern(F.col("excludes")).alias("own_globs"))
    trees = cut(_relevant(tables["tree_files"], globs, own, "path"))
    samples = cut(sampling.sampled(commits, ["repo_id"]).select("repo_id", "idx", "sha"))
    floor = None
    if cached is not None and previous is not None:
        floor = cut(incremental.floors(commits, cached, previous, samples))
    phase("replay")
    mix, events, totals = _changes(tables, trees, views, globs, own, floor, index)
    stats = _stats(_from(commits, floor), mix, events, totals, trees, views, _from(samples, floor).select("repo_id", "idx"), now_ms)
    phase("authors")
    if floor is not None:
        place = commits.select("repo_id", "sha", F.col("idx").alias("_idx")).join(floor, "repo_id").filter("_idx < floor")
        held = cached.join(place, ["repo_id", "sha"]).withColumn("idx", F.col("_idx"))
        stats = held.select(*[F.col(f.name).cast(f.dataType) for f in stats.schema.fields]).unionByName(stats)
    who = cut(identities.keyed(commits.join(stats.select("repo_id", "idx", "added"), ["repo_id", "idx"]), identities.mailmap(tables["mailmaps"])))
    authors = cut(identities.merged(identities.rollup(who, ["repo_id"]), ["repo_id"]))
    stats = cut(stats.join(who.select("repo_id", "idx", "author_key"), ["repo_id", "idx"], "left"))
    raw = identities.raw_identities(commits, ["repo_id"])
    phase("duplicates")
    at_head = commits.groupBy("repo_id").agg(F.max("idx").alias("idx"))
    tree = cut(trees.join(at_head, "repo_id").filter(lines.tree_at(trees, F.col("idx"))).select("repo_id", "path", "blob_id"))
    flagged, kept, found, by_file = _duplicates(tree, views)
    held = tree.join(views, "blob_id").select("repo_id", tree["path"], "lang", F.size("code").alias("code_lines"), F.size("norm").alias("norm_lines"))
    measured = kept.join(held, ["repo_id", "path"]).groupBy("repo_id").agg(F.sum("code_lines").alias("dup_measured_lines"))
    duplicated = by_file.groupBy("repo_id").agg(F.sum("dup_lines").alias("dup_lines"), F.max(F.struct("dup_lines", "path")).alias("hottest"))
    total = lines.tree_totals(trees, views, at_head).drop("idx")
    language = lines.dominant(held.groupBy("repo_id", "lang").agg(F.sum("code_lines").alias("lines")), ["repo_id"]).select("repo_id", F.col("lang").alias("dominant_language"))
    head = total.join(measured, "repo_id", "left").join(duplicated, "repo_id", "left").join(found.groupBy("repo_id").agg(F.count("*").alias("dup_clones")), "repo_id", "left").join(language, "repo_id", "left")
    head = head.na.fill(0, ["dup_measured_lines", "dup_lines", "dup_clones"]).withColumn("handlers", F.col("bare") + F.col("broad") + F.col("swallow") + F.col("suppress"))
    head = head.join(stats.groupBy("repo_id").agg(F.max_by("committed_at", "idx").alias("committed_at"), F.min_by("committed_at", "idx").alias("first_at"), F.count("*").alias("commits")), "repo_id")
    phase("grades")
    if repos is not None:
        head = cut(grading.with_thresholds(head, repos, base))
        windows = stats.join(head.select("repo_id", F.col("t.windowDays").cast("long").alias("_days")), "repo_id")
        reference = sampling.window_reference(windows, ["repo_id"], F.max("_days"), is_sampled=F.col("loc").isNotNull())
    else:
        reference = sampling.window_reference(stats, ["repo_id"], base.windowDays, is_sampled=F.col("loc").isNotNull())
    old = metrics.older(stats).withColumn("_measured", F.when(F.col("dup_measured_lines") > 0, F.col("dup_measured_lines")).otherwise(F.col("loc")))
    reference = old.join(reference.withColumnRenamed("ref", "idx"), ["repo_id", "idx"]).select(
        "repo_id", F.col("committed_at").alias("ref_at"), F.col("dup_lines").alias("ref_dup_lines"), F.col("loc").alias("ref_loc"), F.col("calls").alias("ref_calls"),
        F.when((F.col("functions") > 0) & (F.col("total_lines") > 0), F.struct((100.0 * X.ratio(F.col("dup_lines"), F.col("_measured"))).alias("dup_pct"), "complexity", "comment_pct", "function_length")).alias("then"),
    )
    people = authors.groupBy("repo_id").agg(F.count("*").alias("authors"), F.max_by(F.struct("name", "commits"), F.struct("commits", F.col("author_key"))).alias("top"))
    all_ = metrics.headline(stats, ["repo_id"]).join(metrics.deltas(metrics.level(head), reference, ["repo_id"]), "repo_id").join(identities.bus_factor(authors, ["repo_id"]), "repo_id").join(people, "repo_id").join(raw, "repo_id")
    judged = cut(grading.states(metrics.older(all_), t))
    sizes = held.select("repo_id", "path", "norm_lines")
    bundle = cut(clones.bundles(by_file, sizes, found, ["repo_id"]))
    pairs = cut(identities.suspects(authors, ["repo_id"]))
    spike = metrics.churn_spike(stats, ["repo_id"])
    truncated = tables["heads"].select("repo_id", "truncated")
    shown = clones.shown(found, ["repo_id"])
    notes = findings.findings(judged, bundle, shown, pairs, spike, t)
    return Outcome(stats, judged, authors, shown, bundle, flagged, pairs, grading.grades(judged, ["repo_id"], t), grading.top_findings(notes, ["repo_id"]), findings.caveats(judged, flagged, truncated))


def _relevant(rows: DataFrame, globs: tuple[str, ...], own: DataFrame | None, *paths: str) -> DataFrame:
    """``rows`` with a relevant path; of two paths, those that aren't relevant are null, and one has to be left."""
    if own is not None:
        rows = rows.join(own, "repo_id", "left")
    extra = None if own is None else F.col("own_globs")
    ok = [F.col(p).isNotNull() & X.is_relevant(F.col(p), globs, extra) for p in paths]
    if len(paths) > 1:
        rows = rows.withColumns({p: F.when(c, F.col(p)) for p, c in zip(paths, ok, strict=True)}).filter(F.coalesce(*paths).isNotNull())
    else:
        rows = rows.filter(ok[0])
    return rows.drop("own_globs")


def _from(rows: DataFrame, floor: DataFrame | None) -> DataFrame:
    return rows if floor is None else incremental.suffix(rows, floor)


def _changes(tables: dict[str, DataFrame], trees: DataFrame, views: DataFrame, globs: tuple[str, ...], own: DataFrame | None, floor: DataFrame | None, index: WindowIndex | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(line mix of each commit, churn events, norm lines of each commit's parent tree), from the floor on where there is one."""
    key = ["repo_id", "idx"]
    norm = views.select("blob_id", "norm")
    none = F.expr("cast(array() as array<struct<line_no:int,text:string>>)")
    ch = _relevant(_from(tables["file_changes"], floor), globs, own, "old_path", "new_path")
    ch = ch.join(norm.select(F.col("blob_id").alias("old_blob"), F.col("norm").alias("before")), "old_blob", "left").join(norm.select(F.col("blob_id").alias("new_blob"), F.col("norm").alias("after")), "new_blob", "left")
    ch = ch.withColumn("before", F.when(F.col("old_path").isNotNull(), F.coalesce("before", none)).otherwise(none)).withColumn("after", F.when(F.col("new_path").isNotNull(), F.coalesce("after", none)).otherwise(none))
    ch = cut(ch.withColumn("edits", scanners.edits(F.transform("before", lambda x: x["text"]), F.transform("after", lambda x: x["text"]))))
    added, removed = changes.edited_lines(ch, ch.select(*key, F.col("old_path").alias("path"), F.col("before").alias("norm")), ch.select(*key, F.col("new_path").alias("path"), F.col("after").alias("norm")))
    added, removed = cut(added), cut(removed)
    # files of the parent tree that share a window with what the commit adds
    ours = lines.windows(added, config.RUN, [*key, "path", "edit"]).select(*key, "h").distinct()
    spread = lines.exploded(views, "norm", "blob_id")
    member = trees.select("repo_id", F.col("path").alias("src"), "blob_id", "valid_from", "valid_to")
    if index is None:
        theirs = lines.windows(spread, config.RUN, ["blob_id"]).select("blob_id", "h").distinct()
        held = ours.join(member.select("repo_id", "blob_id").distinct().join(theirs, "blob_id"), ["repo_id", "h"]).select(*key, "blob_id").distinct()
    else:
        index.add(member, views)
        held = index.blobs_with(ours, key)
    near = held.join(member, ["repo_id", "blob_id"]).filter((F.col("valid_from") < F.col("idx")) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("idx")))).select(*key, "src", "blob_id").distinct()
    # of files with one content the first by path wins every tie
    near = near.groupBy(*key, "blob_id").agg(F.min("src").alias("src"))
    parent = near.join(spread, "blob_id").select(*key, "src", "pos", "text")
    gone_lines = removed.select(*key, F.col("path").alias("src"), "pos", F.lit(True).alias("g1"))
    gone_paths = ch.filter("old_path is not null and (new_path is null or new_path <> old_path)").select(*key, F.col("old_path").alias("src"), F.lit(True).alias("g2")).distinct()
    parent = parent.join(gone_lines, [*key, "src", "pos"], "left").join(gone_paths, [*key, "src"], "left").select(*key, "src", "pos", "text", (F.coalesce("g1", F.lit(False)) | F.coalesce("g2", F.lit(False))).alias("gone"))
    parent = cut(parent)
    mix = cut(changes.line_mix(added, parent, removed.groupBy(*key, "path", "edit").agg(F.count("*").alias("lines"))))
    # one lineage through renames
    renames = ch.filter("old_path is not null and new_path is not null and old_path <> new_path").select("repo_id", "idx", "old_path", "new_path")
    side = lambda d, is_add: d.select(*key, "path", "pos", "text", F.lit(is_add).alias("is_add"))
    both = churn.named(side(added, True).unionByName(side(removed, False)), renames)  # a removed line of a renamed file still has its old path
    size = trees.join(views.select("blob_id", F.size("norm").alias("n")), "blob_id")
    steps = size.select("repo_id", F.col("valid_from").alias("idx"), "n").unionByName(size.filter("valid_to is not null").select("repo_id", F.col("valid_to").alias("idx"), (-F.col("n")).alias("n"))).groupBy("repo_id", "idx").agg(F.sum("n").alias("n"))
    commits = tables["commits"].select("repo_id", "idx")
    run = Window.partitionBy("repo_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    totals = commits.join(steps, key, "left").withColumn("parent_lines", F.coalesce(F.sum("n").over(run), F.lit(0))).select(*key, "parent_lines")
    return mix, both, totals


def _stats(commits: DataFrame, mix: DataFrame, events: DataFrame, totals: DataFrame, trees: DataFrame, views: DataFrame, sample: DataFrame, now_ms: int) -> DataFrame:
    key = ["repo_id", "idx"]
    at = commits.select(*key, F.col("committed_at").alias("at"))
    found = churn.churned(churn.matches(events.join(at, key), ["repo_id", "lineage", "text"], ["idx", "path", "pos"], carry=("idx",)))
    churned = found.groupBy("repo_id", F.col("add_idx").alias("idx")).agg(F.count("*").alias("churn"))
    out = commits.join(mix, key, "left").na.fill(0, ["added", "novel", "copied", "moved", "deleted"]).join(churned, key, "left").na.fill(0, ["churn"]).join(totals, key, "left")
    out = out.withColumn("import_commit", changes.is_import(F.col("parent_sha").isNull(), F.col("added"), F.col("moved"), F.col("parent_lines"))).withColumn("churn_censored", churn.is_censored(F.col("committed_at"), F.lit(now_ms)))
    static = cut(lines.tree_totals(trees, views, sample))
    member = trees.join(sample, "repo_id").filter(lines.tree_at(trees, F.col("idx")))
    rows = member.select(*key, "path", "blob_id").join(lines.exploded(views, "norm", "blob_id"), "blob_id").select(*key, "path", "pos", "line_no", "text")
    found, by_file = clones.exact(rows, key)
    dup = by_file.groupBy(*key).agg(F.sum("dup_lines").alias("dup_lines")).join(found.groupBy(*key).agg(F.count("*").alias("dup_clones")), key, "left")
    static = static.join(dup, key, "left").na.fill(0, ["dup_lines", "dup_clones"]).withColumn("dup_measured_lines", F.col("loc")).withColumn("err_swallow", F.col("bare") + F.col("broad") + F.col("swallow") + F.col("suppress"))
    return cut(out.join(static, key, "left").withColumn("subject", X.short_subject(F.col("subject"))))


def _duplicates(tree: DataFrame, views: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(mirrors, files outside them, clones, duplicated lines by file) of the trees at HEAD."""
    files = tree.join(views.select("blob_id", F.size("code").alias("code_lines"), F.size("norm").alias("norm_lines")), "blob_id").select("repo_id", "path", "code_lines", "norm_lines")
    rows = cut(tree.join(lines.exploded(views, "norm", "blob_id"), "blob_id").select("repo_id", "path", "pos", "line_no", "text"))
    flagged = cut(mirrors.detect(files, rows.select("repo_id", "path", "text")))
    dropped = mirrors.excluded(files, flagged).select("repo_id", "path").distinct()
    kept = cut(files.join(dropped, ["repo_id", "path"], "left_anti").select("repo_id", "path"))
    found, by_file = clones.exact(rows.join(kept, ["repo_id", "path"], "left_semi"), ["repo_id"])
    return flagged, kept, cut(found), cut(by_file)


def _series(stats: DataFrame) -> DataFrame:
    """(repo_id, copyPaste, refactor, churn, duplication, errorSwallow, connectivity): each card's values, in order."""
    key = ["repo_id"]
    gather = lambda d, **cols: d.groupBy("repo_id").agg(*[F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col(v).cast("double").alias("v")))), lambda x: x["v"]).alias(k) for k, v in cols.items()])
    out = gather(metrics.rolling(stats, key), copyPaste="rolling_copy_pct", refactor="rolling_refactor_pct")
    out = out.join(gather(metrics.churn_series(stats), churn="churn_pct"), key, "full")
    return out.join(gather(metrics.sampled_series(stats), duplication="dup_lines", errorSwallow="err_per_kloc", connectivity="calls_per_kloc"), key, "full")


def _cards(t: Thresholds | grading.RowThresholds) -> Column:
    """The six graded cards: value, unit, state, which way is better, series, change, and what they were judged by."""
    c = F.col
    num = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    moved = (c("direction") != config.FLAT) & (c("direction") != config.UNKNOWN)
    fixed = lambda warn, crit: {"warn": num(warn), "crit": num(crit), "basis": F.lit("fixed")}
    cards = (
        ("copyPaste", X.half_up(c("copy_pct"), 1), "percent", "state_copy", "lower", None, {"lines": c("copied"), "added": c("added")} | fixed(t.copyPasteWarn, t.copyPasteCrit)),
        ("refactor", X.half_up(c("refactor_pct"), 1), "percent", "state_refactor", "higher", None, {"moved": c("moved"), "copied": c("copied")} | fixed(t.refactorWarn, t.refactorCrit)),
        ("churn", X.half_up(c("churn_pct"), 1), "percent", "state_churn", "lower", None, {"lines": c("churn_lines"), "added": c("churn_added"), "censored": c("censored_commits")} | fixed(t.churnWarn, t.churnCrit)),
        (
            "duplication", c("dup_lines"), "lines", "state_level", "lower", F.when(moved, X.half_up(c("dup_delta_pct"), 1)),
            {"pct": X.half_up(c("dup_pct"), 2), "clones": c("dup_clones"), "then": c("ref_dup_lines"), "windowDays": c("reference_days"), "deltaLines": c("dup_delta_lines"), "level": c("state_level"), "direction": c("direction"), "levelApplicable": c("level_warn").isNotNull(),
             "language": c("dominant_language"), "basis": F.when(c("level_warn").isNotNull(), "cohort").otherwise(""), "levelWarn": F.coalesce("level_warn", F.lit(0.0)), "levelCrit": F.coalesce("level_crit", F.lit(0.0)), "floorLines": num(t.dupDeltaFloorLines)},
        ),
        ("errorSwallow", X.half_up(c("err_density"), 2), "perKloc", "state_err", "lower", None, fixed(t.errDensityWarn, t.errDensityCrit)),
        ("connectivity", X.half_up(c("conn_density"), 1), "perKloc", "state_conn", "higher", X.half_up(c("conn_delta_pct"), 1), {"then": X.half_up(c("conn_then"), 1), "windowDays": c("reference_days"), "approximate": F.lit(True)} | fixed(t.connDeltaWarn, t.connDeltaCrit)),
    )
    none = F.lit(None).cast("double")
    as_list = lambda x: F.parse_json(F.to_json(x))  # noqa: E731  the cards' details differ in shape
    return F.array(
        *[
            as_list(F.struct(F.lit(name).alias("key"), num(value).alias("value"), F.lit(unit).alias("unit"), c(state).alias("state"), F.lit(better).alias("direction"), c(f"series.{name}").alias("spark"), (none if delta is None else delta.cast("double")).alias("delta"), F.struct(*[v.alias(k) for k, v in detail.items()]).alias("detail")))
            for name, value, unit, state, better, delta, detail in cards
        ]
    )


def _older() -> Column:
    """The four ungraded figures with their changes since the reference; no change where there is none to compare with."""
    figures = (("duplicates", "dup_pct", "percent", 2), ("complexity", "complexity", "perFunction", 2), ("commentDensity", "comment_pct", "percent", 1), ("functionLength", "function_length", "lines", 1))
    return F.array(*[F.struct(F.lit(k).alias("key"), X.half_up(F.col(v), d).alias("value"), F.lit(u).alias("unit"), X.half_up(X.change(F.col(f"then.{v}"), F.col(v)), 1).alias("delta")) for k, v, u, d in figures])


def report(o: Outcome, repos: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """(repo_id, report): the nested report of each repository as JSON; ``repos``: repo_id, name, url."""
    gather = lambda d, name, cols, *order: d.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in cols if c not in order]))).alias(name))
    head = o.head.withColumn("span_days", F.greatest(F.lit(1), F.floor((F.col("committed_at") - F.col("first_at")) / config.DAY_MS)))
    series = _series(o.stats)
    head = head.join(series.select("repo_id", F.struct(*series.columns[1:]).alias("series")), "repo_id", "left")
    base = repos.select("repo_id", F.struct("name", X.browse_base(F.col("url")).alias("browse")).alias("repo")).join(head, "repo_id")
    t = grading.RowThresholds() if "t" in o.head.columns else thresholds or Thresholds()
    out = base.select("repo_id", F.struct("repo.*", "span_days", "commits", F.lit(config.ALGO_VERSION).alias("algo_version")).alias("repo"), _cards(t).alias("kpis"), _older().alias("legacy"))
    series = o.stats.select("repo_id", "idx", X.short_sha(F.col("sha")).alias("sha"), "committed_at", "subject", "import_commit", "added", "copied", "moved", "deleted", "churn", "churn_censored", "loc", "dup_lines", "calls", "err_swallow")
    by_commits = o.authors.withColumn("_minus", -F.col("commits"))
    parts = [
        gather(series, "series", series.columns[1:], "idx"), gather(o.grades, "grades", ["grade", "state", "axis", "reason"], "grade"), gather(o.findings, "findings", ["rank", "severity", "code", "params", "evidence", "findings_total"], "rank"),
        gather(o.caveats, "caveats", ["code", "params"], "code"), gather(o.clones, "clones", ["rank", "file_a", "line_a", "file_b", "line_b", "lines"], "rank"), gather(o.mirrors, "mirrors", ["rank", "original", "mirror", "shared_paths", "dropped_lines", "identical_share"], "rank"),
        gather(by_commits, "authors", ["_minus", "author_key", "name", "commits", "added_lines", "identities"], "_minus", "author_key").withColumn("authors", F.transform("authors", lambda a: a.dropFields("_minus"))),
    ]
    for p in parts:
        out = out.join(p, "repo_id", "left")
    return out.select("repo_id", F.to_json(F.struct(*out.columns[1:])).alias("report"))
