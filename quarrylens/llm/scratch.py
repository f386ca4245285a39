"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``).

A written table cuts the lineage, survives lost executors and is read by later jobs in place of a
recomputation. The folder is read from the session; only where none is set and Spark runs in one process, as in tests, a
temporary one is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_BYTES = 4 << 20

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one; the JVM deletes it when it ends."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="quarrylens-"))
    where = f"{root.rstrip('/')}/tables-{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def files_for(rows: int, each: int = 40_000) -> int:
    """How many files a table should have whose rows number about ``rows``: small ones cost more to make than to read."""
    return max(4, -(-rows // each))


def saved(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df`` written as a Parquet table and read back; ``files``: dealt out to so many, as tasks are many and rows often few."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    (df if files is None else df.repartition(files)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column that tells all of its rows apart, equal ones too, and is the same whenever it is read: the file and the place in it.

    A frame that isn't a plain Parquet table is written as one first.
    """
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or not df.inputFiles():
        df = saved(df, "rows")
    at: Column = df.metadataColumn("_metadata")
    return df.withColumn(name, F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("row")))


def drop(df: DataFrame) -> None:
    """Deletes the table behind a frame that ``saved`` returned, once nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    for file in df.inputFiles()[:1]:
        path = sc._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends Python batches of at most ``ARROW_BYTES`` bytes (or one row), however long rows are.

    Plans read the setting when they run, so it stays; a smaller one is left alone.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(name)) > ARROW_BYTES:
        conf.set(name, str(ARROW_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
