"""Grades: bands, directions, and the verdicts that combine them. All are CASE expressions."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens import config
from quarrylens.config import CRIT, FLAT, GOOD, IMPROVING, UNKNOWN, WARN, WORSENING, Thresholds
from quarrylens.functions import text as X


def lower_is_better(value: Column, warn: Column | float, crit: Column | float) -> Column:
    return F.when(value >= crit, CRIT).when(value >= warn, WARN).otherwise(GOOD)


def higher_is_better(value: Column, warn: Column | float, crit: Column | float) -> Column:
    return F.when(value <= crit, CRIT).when(value <= warn, WARN).otherwise(GOOD)


def rank(state: Column) -> Column:
    return F.when(state == CRIT, 3).when(state == WARN, 2).when(state == GOOD, 1).otherwise(0)


def worst(a: Column, b: Column) -> Column:
    """The worse of two states; the first of equals."""
    return F.when(rank(b) > rank(a), b).otherwise(a)


def bands(spark, thresholds: Thresholds) -> DataFrame:
    """(dominant_language, level_warn, level_crit): a row for each language with a positive band."""
    rows = [(k, *thresholds.band(k)) for k in thresholds.dupLevel if thresholds.band(k)]
    return spark.createDataFrame(rows, "dominant_language string, level_warn double, level_crit double")


class RowThresholds:
    """Thresholds that each row carries in a column ``t``, in place of one set for all."""

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return F.col("t")[name]


def with_thresholds(rows: DataFrame, repos: DataFrame, base: Thresholds) -> DataFrame:
    """``rows`` with ``t``: those of their repository (repo_id, thresholds: JSON), and of ``base`` for what it doesn't give or can't be read."""
    plain = {f.name: f.type for f in fields(Thresholds) if f.name != "dupLevel"}
    shape = ", ".join([*(f"{k} {'int' if v == 'int' else 'double'}" for k, v in plain.items()), "dupLevel map<string, struct<warn:double,crit:double>>"])
    own = repos.select("repo_id", F.from_json(F.coalesce("thresholds", F.lit("{}")), shape).alias("j"))
    band = lambda b: F.struct(F.lit(float(b[0])).alias("warn"), F.lit(float(b[1])).alias("crit"))
    levels = F.create_map(*[x for k, b in base.dupLevel.items() for x in (F.lit(k), band(b))])
    given = F.coalesce(F.col("j.dupLevel"), F.expr("cast(map() as map<string, struct<warn:double,crit:double>>)"))
    kept = F.map_filter(levels, lambda k, v: ~F.map_contains_key(given, k))
    values = [F.coalesce(F.col("j")[k], F.lit(getattr(base, k))).alias(k) for k in plain]
    joined = rows.join(own, "repo_id", "left")
    return joined.withColumn("t", F.struct(*values, F.map_concat(given, kept).alias("dupLevel"))).drop("j")


def states(a: DataFrame, t: Thresholds | RowThresholds) -> DataFrame:
    """``a`` (aggregates of one repository a row) with the state of every metric; unknown where it can't be judged."""
    if isinstance(t, RowThresholds):
        band = F.try_element_at(t.dupLevel, F.col("dominant_language"))
        positive = (band["warn"] > 0) & (band["crit"] > 0)
        a = a.withColumn("level_warn", F.when(positive, band["warn"])).withColumn("level_crit", F.when(positive, band["crit"]))
    else:
        a = a.join(F.broadcast(bands(a.sparkSession, t)), "dominant_language", "left")  # a row a language
    a = a.withColumn("state_copy", F.when(F.col("added") == 0, UNKNOWN).otherwise(lower_is_better(F.col("copy_pct"), t.copyPasteWarn, t.copyPasteCrit)))
    a = a.withColumn("state_refactor", F.when(F.col("moved") + F.col("copied") == 0, UNKNOWN).otherwise(higher_is_better(F.col("refactor_pct"), t.refactorWarn, t.refactorCrit)))
    a = a.withColumn("state_churn", F.when(F.col("churn_added") == 0, UNKNOWN).otherwise(lower_is_better(F.col("churn_pct"), t.churnWarn, t.churnCrit)))
    a = a.withColumn("state_level", F.when(F.col("level_warn").isNull(), UNKNOWN).otherwise(lower_is_better(F.col("dup_pct"), F.col("level_warn"), F.col("level_crit"))))
    delta = F.col("dup_delta_lines")
    a = a.withColumn("direction", F.when(delta.isNull(), UNKNOWN).when(F.abs(delta) < t.dupDeltaFloorLines, FLAT).when(delta > 0, WORSENING).otherwise(IMPROVING))
    by_ratio = lower_is_better(F.col("dup_delta_pct"), t.dupDeltaWarn, t.dupDeltaCrit)
    capped = F.when((by_ratio == CRIT) & (F.abs(delta) < t.dupDeltaCritLines), WARN).otherwise(by_ratio)
    a = a.withColumn("state_dup_delta", F.when(F.col("direction") == UNKNOWN, UNKNOWN).when(F.col("direction") != WORSENING, GOOD).when(F.col("dup_delta_pct").isNull(), WARN).otherwise(capped))
    a = a.withColumn("state_err", lower_is_better(F.col("err_density"), t.errDensityWarn, t.errDensityCrit))
    a = a.withColumn("state_conn", F.when(F.col("conn_delta_pct").isNull(), UNKNOWN).otherwise(higher_is_better(F.col("conn_delta_pct"), t.connDeltaWarn, t.connDeltaCrit)))
    return a.withColumn("state_bus", F.when(F.col("bus_factor") <= 1, CRIT).when(F.col("bus_factor") == 2, WARN).otherwise(GOOD))


def grades(s: DataFrame, partition: list[str], t: Thresholds | RowThresholds) -> DataFrame:
    """(partition, grade, state, axis, reason): duplication, maintainability and change safety, the worst axis named."""
    first = F.when(rank(F.col("state_level")) > rank(F.col("state_copy")), "level").otherwise("copyPaste")
    so_far = worst(F.col("state_copy"), F.col("state_level"))
    turned = (F.col("direction") != UNKNOWN) & (rank(F.col("state_dup_delta")) > rank(so_far))
    dup = F.struct(F.lit("duplication").alias("grade"), F.when(turned, F.col("state_dup_delta")).otherwise(so_far).alias("state"), F.when(turned, "direction").otherwise(first).alias("axis"))
    main = F.struct(F.lit("maintainability").alias("grade"), worst(F.col("state_err"), F.col("state_conn")).alias("state"), F.when(rank(F.col("state_err")) >= rank(F.col("state_conn")), "errorSwallow").otherwise("connectivity").alias("axis"))
    safe = F.struct(F.lit("changeSafety").alias("grade"), worst(F.col("state_churn"), F.col("state_bus")).alias("state"), F.when(rank(F.col("state_bus")) >= rank(F.col("state_churn")), "busFactor").otherwise("churn").alias("axis"))
    out = s.withColumn("g", F.explode(F.array(dup, main, safe)))
    axis, crit = F.col("g.axis"), F.col("g.state") == CRIT

    def metric(name: str, value: Column, unit: str, warn, limit) -> Column:
        pick = F.when(crit, limit).otherwise(warn).cast("double")
        return F.struct(F.lit("metric").alias("kind"), F.lit(name).alias("metric"), value.cast("double").alias("value"), F.lit(unit).alias("unit"), pick.alias("limit"))

    plain = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("metric"), value.cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("double").alias("limit"))
    reason = (
        F.when(F.col("g.state").isin(GOOD, UNKNOWN), F.lit(None)).when(axis == "busFactor", plain("bus", F.col("bus_factor"))).when(axis == "direction", plain("lines", F.col("dup_delta_lines")))
        .when(axis == "errorSwallow", metric("errorSwallow", X.half_up(F.col("err_density"), 2), "perKloc", t.errDensityWarn, t.errDensityCrit))
        .when(axis == "connectivity", metric("connectivity", X.half_up(F.col("conn_delta_pct"), 1), "percent", t.connDeltaWarn, t.connDeltaCrit))
        .when(axis == "churn", metric("churn", X.half_up(F.col("churn_pct"), 1), "percent", t.churnWarn, t.churnCrit))
        .when(axis == "copyPaste", metric("copyPaste", X.half_up(F.col("copy_pct"), 1), "percent", t.copyPasteWarn, t.copyPasteCrit))
        .when(axis == "level", metric("duplication", X.half_up(F.col("dup_pct"), 2), "percent", F.col("level_warn"), F.col("level_crit")))
    )
    return out.select(*partition, F.col("g.grade").alias("grade"), F.col("g.state").alias("state"), axis.alias("axis"), reason.alias("reason"))


def top_findings(findings: DataFrame, partition: list[str], most: int = config.FINDINGS_SHOWN) -> DataFrame:
    """The worst findings, by severity and then by the fixed order of codes (others last), with the number of all."""
    from pyspark.sql.window import Window

    place = F.array_position(F.array(*[F.lit(c) for c in config.FINDING_PRIORITY]), F.col("code"))
    place = F.when(place == 0, len(config.FINDING_PRIORITY) + 1).otherwise(place)
    whole = Window.partitionBy(*partition)
    order = whole.orderBy(rank(F.col("severity")).desc(), place, "code")
    return findings.withColumn("findings_total", F.count("*").over(whole)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
