"""Ratios over the commit fact table: headline figures, series, deltas and the older metrics they replace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens import config
from quarrylens.functions import text as X


def headline(rows: DataFrame, partition: list[str]) -> DataFrame:
    """Sums and percentages over commits that aren't imports; censored ones leave churn alone. 0 where there is nothing to divide."""
    own, open_ = ~F.col("import_commit"), ~F.col("import_commit") & ~F.col("churn_censored")
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    out = rows.groupBy(*partition).agg(
        F.count_if(F.col("import_commit")).alias("import_commits"), F.count_if(own).alias("counted_commits"), F.count_if(own & F.col("churn_censored")).alias("censored_commits"),
        total("added", F.col("import_commit")).alias("imported_lines"), *[total(c, own).alias(c) for c in ("added", "novel", "copied", "moved")], total("added", open_).alias("churn_added"), total("churn", open_).alias("churn_lines"),
    )
    return (
        out.withColumn("copy_pct", 100.0 * X.ratio(F.col("copied"), F.col("added")))
        .withColumn("refactor_pct", 100.0 * X.ratio(F.col("moved"), F.col("moved") + F.col("copied")))
        .withColumn("churn_pct", 100.0 * X.ratio(F.col("churn_lines"), F.col("churn_added")))
    )


def churn_spike(rows: DataFrame, partition: list[str], order: str = "idx", least: int = 10) -> DataFrame:
    """The commit with the largest share of churn among those that add ``least`` lines; the earliest of equals."""
    own = rows.filter(~F.col("import_commit") & ~F.col("churn_censored") & (F.col("added") >= least)).withColumn("pct", 100.0 * X.ratio(F.col("churn"), F.col("added"))).filter("pct > 0")
    return own.withColumn("_r", F.row_number().over(Window.partitionBy(*partition).orderBy(F.col("pct").desc(), order))).filter("_r = 1").drop("_r")


def rolling(rows: DataFrame, partition: list[str], order: str = "idx", size: int = config.ROLLING) -> DataFrame:
    """Copied and moved shares over the trailing ``size`` non-import commits, as ratios of sums, to two places."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(1 - size, 0)
    own = rows.filter(~F.col("import_commit"))
    added, copied, moved = (F.sum(c).over(w) for c in ("added", "copied", "moved"))
    return own.withColumn("rolling_copy_pct", X.half_up(100.0 * X.ratio(copied, added), 2)).withColumn("rolling_refactor_pct", X.half_up(100.0 * X.ratio(moved, moved + copied), 2))


def churn_series(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("import_commit") & ~F.col("churn_censored")).withColumn("churn_pct", X.half_up(100.0 * X.ratio(F.col("churn"), F.col("added")), 2))


def sampled_series(rows: DataFrame) -> DataFrame:
    """Duplicated lines, handlers and calls per thousand lines of the sampled commits."""
    return rows.filter(F.col("loc").isNotNull()).withColumn("err_per_kloc", X.half_up(1000.0 * X.ratio(F.col("err_swallow"), F.col("loc")), 3)).withColumn("calls_per_kloc", X.half_up(1000.0 * X.ratio(F.col("calls"), F.col("loc")), 2))


def older(rows: DataFrame) -> DataFrame:
    """Complexity, comment share and function length of each row with statistics."""
    return (
        rows.withColumn("complexity", X.ratio(F.col("decisions") + F.col("functions"), F.col("functions")))
        .withColumn("comment_pct", 100.0 * X.ratio(F.col("comment_lines"), F.col("total_lines")))
        .withColumn("function_length", X.ratio(F.col("function_lines"), F.col("functions")))
    )


def level(head: DataFrame) -> DataFrame:
    """Of HEAD (dup_lines, dup_measured_lines, loc, handlers, calls): duplication in percent, handlers and calls per thousand lines."""
    measured = F.when(F.col("dup_measured_lines") > 0, F.col("dup_measured_lines")).otherwise(F.col("loc"))
    return head.withColumn("measured", measured).withColumn("dup_pct", 100.0 * X.ratio(F.col("dup_lines"), F.col("measured"))).withColumn("err_density", 1000.0 * X.ratio(F.col("handlers"), F.col("loc"))).withColumn("conn_density", 1000.0 * X.ratio(F.col("calls"), F.col("loc")))


def deltas(head: DataFrame, reference: DataFrame, partition: list[str]) -> DataFrame:
    """``head`` (of ``level``, and committed_at) against the reference row of its window; unknown is null, never 0.

    ``reference``: partition, ref_at, ref_dup_lines, ref_loc, ref_calls; none where nothing was sampled.
    """
    j = head.join(reference.filter("ref_loc > 0"), partition, "left")
    then = F.when(F.col("ref_loc") > 0, 1000.0 * F.col("ref_calls") / F.col("ref_loc"))
    j = j.withColumn("reference_days", F.coalesce(F.floor((F.col("committed_at") - F.col("ref_at")) / config.DAY_MS + 0.5), F.lit(0)).cast("int"))
    j = j.withColumn("dup_delta_lines", F.col("dup_lines") - F.col("ref_dup_lines")).withColumn("dup_delta_pct", X.change(F.col("ref_dup_lines").cast("double"), F.col("dup_lines").cast("double")))
    return j.withColumn("conn_then", then).withColumn("conn_delta_pct", X.change(then, F.col("conn_density")))


def percentiles(rows: DataFrame, value: str, partition: list[str], points: tuple[float, ...] = (0.25, 0.5, 0.75, 0.8, 0.85, 0.9)) -> DataFrame:
    """Percentiles by linear interpolation, one row for each point."""
    held = rows.groupBy(*partition).agg(F.count(value).alias("n"), F.percentile(value, F.array(*[F.lit(p) for p in points])).alias("v"))
    return held.select(*partition, "n", F.posexplode("v").alias("k", "value")).withColumn("p", F.element_at(F.array(*[F.lit(p) for p in points]), F.col("k") + 1)).drop("k")


def right_tail(rows: DataFrame, value: str, item: str, partition: list[str], most: int = 6) -> DataFrame:
    """The rows with the largest values, ranked; ties by item."""
    order = Window.partitionBy(*partition).orderBy(F.col(value).desc(), item)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def leave_one_out(rows: DataFrame, item: str, value: str, partition: list[str], points: tuple[float, ...] = (0.75, 0.85, 0.9)) -> DataFrame:
    """(partition, p, shift, culprit): by how much a percentile moves at most when one row is left out, and which.

    With the rows ranked, a percentile without row i is an interpolation between two ranks that skip i, so ranks are looked
    up instead of every row being paired with every other.
    """
    run, whole = Window.partitionBy(*partition).orderBy(value, item), Window.partitionBy(*partition)
    ranked = rows.filter(F.col(value).isNotNull()).select(*partition, item, F.col(value).cast("double").alias("v"), (F.row_number().over(run) - 1).alias("r"), F.count("*").over(whole).alias("n"))
    each = ranked.withColumn("p", F.explode(F.array(*[F.lit(p) for p in points])))
    at = lambda n: F.col("p") * (n - 1)
    spots = each.filter("n > 1").select(*partition, item, "p", "r", "n", at(F.col("n")).alias("x"), at(F.col("n") - 1).alias("y"))
    skip = lambda k: F.when(k >= F.col("r"), k + 1).otherwise(k)
    wanted = spots.select(*partition, item, "p", "x", "y", F.explode(F.array(F.struct(F.lit("a").alias("w"), F.floor("x").alias("q")), F.struct(F.lit("b").alias("w"), F.ceil("x").alias("q")), F.struct(F.lit("c").alias("w"), skip(F.floor("y")).alias("q")), F.struct(F.lit("d").alias("w"), skip(F.ceil("y")).alias("q")))).alias("s"))
    values = ranked.select(*[F.col(c).alias(f"_{c}") for c in partition], F.col("r").alias("_r"), F.col("v").alias("_v"))
    on = F.col("s.q") == F.col("_r")
    for c in partition:
        on = on & (F.col(c) == F.col(f"_{c}"))
    got = wanted.join(values, on).groupBy(*partition, item, "p", "x", "y").agg(*[F.max(F.when(F.col("s.w") == w, F.col("_v"))).alias(w) for w in "abcd"])
    full = F.col("a") + (F.col("x") - F.floor("x")) * (F.col("b") - F.col("a"))
    without = F.col("c") + (F.col("y") - F.floor("y")) * (F.col("d") - F.col("c"))
    got = got.withColumn("shift", F.abs(without - full))
    best = Window.partitionBy(*partition, "p").orderBy(F.col("shift").desc(), item)
    return got.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(*partition, "p", "shift", F.col(item).alias("culprit"))
