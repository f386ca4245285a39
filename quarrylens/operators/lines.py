"""Line views of blobs, and windows over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens import config
from quarrylens.functions import scanners
from quarrylens.functions import text as X


def file_views(blobs: DataFrame) -> DataFrame:
    """``blobs`` (blob_id, path, content) with lang, code, norm, counts of lines, and every per-blob statistic.

    A blob that is missing, binary or over the size limit, or a data table, reads as an empty file.
    """
    usable = F.col("content").isNotNull() & (F.octet_length("content") <= config.MAX_FILE_BYTES) & ~F.col("content").contains("\x00")
    own = blobs.withColumn("lang", X.language_of(F.col("path"))).withColumn("content", F.when(usable, F.col("content")).otherwise(""))
    parsed = scanners.statics(scanners.parse_blobs(own)).drop("content")
    collapsed = F.transform("code", lambda x: F.struct(x["line_no"].alias("line_no"), X.collapse(x["text"]).alias("text")))
    parsed = parsed.withColumn("flat", collapsed)
    literal = F.size(F.filter("flat", lambda x: X.is_literal_only(x["text"])))
    parsed = parsed.withColumn("data_table", X.is_data_table(literal, F.size("flat")))
    norm = F.filter("flat", lambda x: X.is_norm(x["text"], F.col("lang")))
    empty = F.expr("cast(array() as array<struct<line_no:int,text:string>>)")
    parsed = parsed.withColumn("norm", F.when(F.col("data_table"), empty).otherwise(norm)).withColumn("code", F.when(F.col("data_table"), empty).otherwise(F.col("code"))).drop("flat")
    for name in ("comment_lines", "total_lines", "bare", "broad", "swallow", "suppress", "functions", "function_lines", "calls", "decisions"):
        parsed = parsed.withColumn(name, F.when(F.col("data_table"), 0).otherwise(F.col(name)))
    return parsed


def exploded(views: DataFrame, view: str, *keys: str) -> DataFrame:
    """(keys, pos, line_no, text) of one view."""
    return views.select(*keys, F.posexplode(view).alias("pos", "line")).select(*keys, "pos", F.col("line.line_no").alias("line_no"), F.col("line.text").alias("text"))


def split_lines(df: DataFrame, text_column: str, *keys: str) -> DataFrame:
    """(keys, line_no, text) of the raw lines of a text, without a carriage return at their ends."""
    return df.select(*keys, F.posexplode(F.split(text_column, "\n")).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1).withColumn("text", F.regexp_replace("text", "\r$", ""))


def norm_view(text: Column, lang: Column) -> Column:
    """The norm lines of a text as an array of (line_no, text), made within the row."""
    own = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), X.collapse(x).alias("text")))
    return F.filter(own, lambda x: X.is_norm(x["text"], lang))


def window_hashes(norm: str, size: int, tokens: int = 0) -> Column:
    """(pos, h, h2) of each window of ``size`` lines of an array column of norm lines, 128 bits for its content; only those that hold ``tokens`` tokens.

    Made within the row, so neither lines nor windows are shuffled to find their neighbours: what leaves the row is hashes.
    """
    text = lambda i, k: F.get(norm, i + k)["text"]
    starts = F.when(F.size(norm) >= size, F.sequence(F.lit(0), F.size(norm) - size)).otherwise(F.array().cast("array<int>"))
    if tokens:
        of_lines = F.transform(norm, lambda x: X.token_count(x["text"]))  # once for each line, however many windows hold it
        starts = F.transform(F.array(of_lines), lambda t: F.filter(starts, lambda i: sum((F.get(t, i + k) for k in range(1, size)), F.get(t, i)) >= tokens))[0]
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(*[text(i, k) for k in range(size)]).alias("h"), F.xxhash64(F.lit(1), *[text(i, k) for k in range(size)]).alias("h2")))


def covered(hits: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, lines): how many lines the windows at ``pos`` cover together; the distance to the next one, if that is less than a window."""
    step = F.lead("pos").over(Window.partitionBy(*keys).orderBy("pos")) - F.col("pos")
    return hits.withColumn("_n", F.least(F.coalesce(step, F.lit(size)), F.lit(size))).groupBy(*keys).agg(F.sum("_n").alias("lines"))


def windows(lines: DataFrame, size: int, partition: list[str], pos: str = "pos") -> DataFrame:
    """``lines`` with the hash of the window of ``size`` lines from each position on, where a whole one begins, and its text.

    Lines are numbered anew within their file, so a window is always of neighbours.
    """
    w = Window.partitionBy(*partition).orderBy(pos)
    parts = [F.col("text"), *[F.lead("text", k).over(w) for k in range(1, size)]]
    out = lines.withColumn("_last", parts[-1]).withColumn("window", F.concat_ws("\n", *parts)).filter(F.col("_last").isNotNull()).drop("_last")
    return out.withColumn("h", F.xxhash64("window"))


def hashed(w: DataFrame) -> DataFrame:
    """Windows with a second hash in place of their text: 128 bits tell them apart, and no text is shuffled."""
    return w.withColumn("h2", F.xxhash64(F.lit(1), "window")).drop("window")


def dominant(lines_by_language: DataFrame, partition: list[str], language: str = "lang", lines: str = "lines") -> DataFrame:
    """The language with most lines; ties go to the first by name."""
    ordered = Window.partitionBy(*partition).orderBy(F.col(lines).desc(), F.col(language))
    return lines_by_language.withColumn("_r", F.row_number().over(ordered)).filter("_r = 1").drop("_r")


def dominant_extension(files: DataFrame, partition: list[str]) -> DataFrame:
    """(partition, extension, files): the extension that most paths have, in lower case; ties go to the first by name."""
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")
    return dominant(files.groupBy(*partition, extension.alias("extension")).agg(F.count("*").alias("files")), partition, "extension", "files")


def first_norm_at(norm: DataFrame, wanted: DataFrame, partition: list[str]) -> DataFrame:
    """``wanted`` (partition, line) with pos, the first norm line at or after a line; null after the last. ``norm``: (partition, pos, line_no)."""
    held = wanted.withColumn("_w", F.monotonically_increasing_id())
    found = held.join(norm.select(*partition, "pos", "line_no"), partition).filter(F.col("line_no") >= F.col("line")).groupBy("_w").agg(F.min("pos").alias("pos"))
    return held.join(found, "_w", "left").drop("_w")


def tree_at(tree_files: DataFrame, idx: Column) -> Column:
    """Whether a row of an interval-encoded tree belongs to commit ``idx``."""
    return (F.col("valid_from") <= idx) & (F.col("valid_to").isNull() | (idx < F.col("valid_to")))


def tree_totals(tree_files: DataFrame, views: DataFrame, at: DataFrame) -> DataFrame:
    """Sums of the statistics of each tree in ``at`` (repo_id, idx): one pass over distinct blobs, then sums over membership."""
    names = ["comment_lines", "total_lines", "bare", "broad", "swallow", "suppress", "functions", "function_lines", "calls", "decisions"]
    per_blob = views.select("blob_id", F.size("code").alias("loc"), F.size("norm").alias("norm_lines"), *names)
    member = tree_files.join(at, "repo_id").filter(tree_at(tree_files, F.col("idx")))
    sums = [F.sum(c).alias(c) for c in ["loc", "norm_lines", *names]]
    return member.join(per_blob, "blob_id").groupBy("repo_id", "idx").agg(F.count_if(F.col("loc") > 0).alias("files"), *sums)
