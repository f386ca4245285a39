from pyspark.sql import functions as F

from quarrylens.sources.window_index import WindowIndex


def views(spark, blobs):
    line = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.struct(k.alias("line_no"), F.format_string("line %d of %d", k, F.col("id") % 7).alias("text")))
    return spark.range(blobs).select(F.format_string("b%d", "id").alias("blob_id"), line.alias("norm"))


def test_only_new_blobs_are_added_and_the_kept_side_is_not_shuffled(spark, tmp_path):
    v = views(spark, 30)
    member = v.select((F.substring("blob_id", 2, 9).cast("int") % 2).alias("repo_id"), "blob_id")
    index = WindowIndex(spark, str(tmp_path / "index"), 8)
    assert index.add(member.filter("blob_id <> 'b3'"), v) == 29 and index.rows().count() == 29 * 4
    spark.sql(f"DROP TABLE {index.name}")  # another session, whose catalog doesn't know the table
    index = WindowIndex(spark, str(tmp_path / "index"), 8)
    assert index.add(member, v) == 1 and index.rows().count() == 30 * 4 and index.add(member, v) == 0
    asked = index.rows().filter("blob_id = 'b3'").select("repo_id", "h").distinct().withColumn("idx", F.lit(5))
    asked.write.parquet(str(tmp_path / "asked"))
    asked = spark.read.parquet(str(tmp_path / "asked"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    found = index.blobs_with(asked, ["repo_id", "idx"])
    assert {r["blob_id"] for r in found.collect()} == {f"b{k}" for k in range(30) if k % 7 == 3 and k % 2 == 1}
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    for k, v in before.items():
        spark.conf.set(k, v)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    at = next(i for i, x in enumerate(lines) if index.name in x)
    above, here = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < here:
            above, here = [*above, x], depth(x)
    join = next(i for i, x in enumerate(above) if "Join" in x)
    assert "Bucketed: true" in lines[at] and not any("Exchange" in x for x in above[:join])
    assert any("Exchange" in x for x in lines if "asked" not in x)  # the other side is dealt to the buckets
