"""Table readers and schemas, and tables that cut long plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "repos": "repo_id int, name string, url string, branch string, space_keys array<string>, excludes string, thresholds string",
    "commits": "repo_id int, idx int, sha string, parent_sha string, author_name string, author_email string, committed_at bigint, subject string",
    "blobs": "blob_id string, path string, content string",
    "tree_files": "repo_id int, path string, blob_id string, valid_from int, valid_to int",
    "file_changes": "repo_id int, idx int, old_path string, new_path string, old_blob string, new_blob string",
    "commit_stats": (
        "repo_id int, idx int, sha string, author_key string, author_name string, author_email string, committed_at bigint, subject string, import_commit boolean, added int, novel int, copied int, moved int, deleted int, "
        "churn int, churn_censored boolean, loc int, files int, dup_lines int, dup_clones int, dup_measured_lines int, err_swallow int, calls int, comment_lines int, total_lines int, functions int, decisions int, function_lines int"
    ),
    "cohort": "repo string, files int, loc int, dupLines int, ratioPct double, clones int, topExt string, topExtFiles int, mirrors string",
}

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder (``spark.checkpoint.dir``; a temporary one where it is unset and Spark runs in one process) and read back."""
    spark = df.sparkSession
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="quarrylens-"))
    where = f"{root.rstrip('/')}/plans-{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = f"{where}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(out)
    return spark.read.schema(df.schema).parquet(out)


def cohort(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a cohort's TSV with a header; short rows are left out."""
    return spark.read.csv(path, sep="\t", header=True, schema=SCHEMAS["cohort"], mode="DROPMALFORMED", enforceSchema=True)


def blob_files(spark: SparkSession, folder: str, most: int) -> DataFrame:
    """(blob_id, path, content) of the files below a folder, up to a size; the filter reaches the listing."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(F.col("length") <= most)
    return own.select(F.sha1("content").alias("blob_id"), "path", F.decode("content", "UTF-8").alias("content"))


def head_only(commits: DataFrame) -> DataFrame:
    """The last commit of each repository."""
    return commits.groupBy("repo_id").agg(F.max("idx").alias("idx"))
