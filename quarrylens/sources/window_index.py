"""Windows of blobs that are kept between runs, in buckets by what they are joined on.

The table is written with Spark's bucketing: rows of a bucket are in files of their own, sorted. A join on (repo_id, h) reads them as they lie,
so only the windows of new commits are shuffled, and a run adds the windows of blobs that it hasn't seen yet and no others.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession

from quarrylens import config
from quarrylens.operators.lines import exploded, windows
from quarrylens.sources.store import _there
from quarrylens.sources.tables import cut

BUCKETS = 64


class WindowIndex:
    """(repo_id, blob_id, h) of the windows of ``config.RUN`` norm lines, in a table at ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path
        where = path if "://" in path else os.path.abspath(path)
        self.name = "windows_" + hashlib.sha256(where.encode()).hexdigest()[:16]
        # the catalog of a session forgets, the files don't: the table is told again where they lie
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (repo_id INT, h BIGINT, blob_id STRING) USING parquet CLUSTERED BY (repo_id, h) SORTED BY (repo_id, h) INTO {buckets} BUCKETS LOCATION '{where}/windows'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _seen(self) -> DataFrame:
        path = f"{self.path}/blobs"
        schema = "repo_id int, blob_id string"
        return self.spark.read.schema(schema).parquet(path) if _there(self.spark, path)[2] else self.spark.createDataFrame([], schema)

    def add(self, member: DataFrame, views: DataFrame) -> int:
        """Adds the windows of blobs that are new; ``member``: (repo_id, blob_id) of the files of all trees, ``views``: norm lines by blob. How many blobs were new.

        Blobs are listed as seen after their windows are there. If a run fails between the two, the next one adds these windows again, which a
        lookup doesn't notice, as it asks for distinct blobs.
        """
        new = cut(member.select("repo_id", "blob_id").distinct().join(self._seen(), ["repo_id", "blob_id"], "left_anti"))
        lines = exploded(views.join(new.select("blob_id").distinct(), "blob_id", "left_semi"), "norm", "blob_id")
        found = windows(lines, config.RUN, ["blob_id"]).select("blob_id", "h").distinct().join(new, "blob_id")
        count = new.count()
        if count:
            found.select("repo_id", "h", "blob_id").write.insertInto(self.name)
            self.spark.catalog.refreshTable(self.name)
            new.write.mode("append").parquet(f"{self.path}/blobs")
        return count

    def blobs_with(self, asked: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, blob_id): the blobs of a repository that hold one of the windows ``asked`` (keys with repo_id, h)."""
        return asked.join(self.rows(), ["repo_id", "h"]).select(*keys, "blob_id").distinct()
