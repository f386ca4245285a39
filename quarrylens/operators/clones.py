"""Duplicated blocks within a tree: exact and set-based, their partners, and files that look like bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens import config
from quarrylens.functions import text as X
from quarrylens.operators.lines import window_hashes
from quarrylens.sources.tables import cut


def repeated_windows(files: DataFrame, partition: list[str], file: str, size: int = config.DUP_MIN_LINES, tokens: int = config.DUP_MIN_TOKENS) -> DataFrame:
    """(partition, file, pos) of windows of ``size`` lines that occur twice in their partition and hold ``tokens`` tokens; ``files``: (partition, file, norm).

    A metric of its own: windows are judged alone, so it neither bounds nor is bounded by the exact one.
    """
    w = files.select(*partition, file, F.inline(window_hashes("norm", size, tokens)))
    twice = w.groupBy(*partition, "h", "h2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return w.join(twice, [*partition, "h", "h2"], "left_semi").select(*partition, file, "pos")


def sharing(files: DataFrame, file: str, size: int = config.DUP_MIN_LINES, tokens: int = config.DUP_MIN_TOKENS) -> DataFrame:
    """(file, partners, first_partner): how many other files share a window with each, and the smallest of them; ``files``: (file, norm).

    Files aren't paired. Windows that the same files hold are one group, known by the number and the hashes of its files, and files that are in
    the same groups are one class. The files of a group are bitmaps, 32,768 numbers each, and a class has as many files around it as there
    are bits in the union of its groups' bitmaps. So a header that is common to all files costs one bit for each of them, and the copies of a file cost one row.
    """
    w = files.select(file, F.inline(window_hashes("norm", size, tokens))).select(file, "h", "h2").distinct()
    own = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64(file)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), file)).alias("y"))
    of = w.groupBy("h", "h2").agg(own.alias("group")).filter("group.n > 1")
    member = cut(w.join(of, ["h", "h2"]).select(file, "group").distinct())
    held = member.groupBy(file).agg(F.array_sort(F.collect_list("group")).alias("groups"))
    held = held.select(file, F.struct(F.xxhash64("groups").alias("x"), F.xxhash64(F.lit(1), "groups").alias("y")).alias("class"))
    held = cut(held.withColumn("number", F.monotonically_increasing_id()))  # a bit for each file: few distinct buckets, as ids run on within a task
    numbered = member.join(held, file)
    bits = numbered.groupBy("group", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    around = numbered.groupBy("class", "group").agg(F.lit(1).alias("_")).drop("_").join(bits, "group").groupBy("class", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    counts = around.groupBy("class").agg(F.sum(F.bitmap_count("bits")).alias("around"))
    # the smallest other file: a group's two smallest are enough, as only the first can be the file itself
    first = member.groupBy("group").agg(F.min(file).alias("first"))
    second = member.join(first, "group").filter(F.col(file) != F.col("first")).groupBy("group").agg(F.min(file).alias("second"))
    least = member.join(first, "group").join(second, "group").groupBy(file).agg(F.min(F.when(F.col("first") == F.col(file), F.col("second")).otherwise(F.col("first"))).alias("first_partner"))
    return held.join(counts, "class").join(least, file).select(file, (F.col("around") - 1).alias("partners"), "first_partner")


def _runs(lines: DataFrame, partition: list[str], size: int, places: int) -> DataFrame:
    """Maximal runs of equal lines that begin with a candidate: (partition, a, b, shift, at, end, cands, upto).

    A candidate is a place in ``b`` and one of the first ``places`` earlier places, ``shift`` lines before it in ``a``, with the same window of
    lines. ``at`` and ``end`` are positions in ``b``, ``cands`` the positions of candidates, ``upto`` the tokens of ``b`` before each position from ``at`` to ``end``.
    """
    own = Window.partitionBy(*partition, "path").orderBy("pos")
    text = F.col("text")
    parts = [text, *[F.lead("text", k).over(own) for k in range(1, size)]]
    hashes = F.struct(F.xxhash64(*parts).alias("x"), F.xxhash64(F.lit(1), *parts).alias("y"))
    before = F.coalesce(F.sum("tokens").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = lines.withColumn("tokens", X.token_count(text)).select(*partition, "path", "pos", "tokens", before.alias("before"), F.xxhash64("text").alias("line"), F.when(parts[-1].isNotNull(), hashes).alias("h"))
    rows = cut(rows.withColumn("next", F.lead("line", size).over(own)))
    held = [*partition, "h"]
    w = rows.filter("h is not null").select(*partition, "path", "pos", "h", "next")
    w = cut(w.join(w.groupBy(*held).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), held, "left_semi"))

    first = w.withColumn("_k", F.row_number().over(Window.partitionBy(*held).orderBy("path", "pos"))).filter(F.col("_k") <= places)
    first = first.select(*held, F.col("path").alias("a"), F.col("pos").alias("q"), F.col("next").alias("next_a"))
    pairs = w.withColumnsRenamed({"path": "b", "pos": "p"}).join(first, held).filter("a < b or (a = b and q < p)")
    diagonal = [*partition, "a", "b", "shift"]
    pairs = cut(pairs.select(*partition, "a", "b", (F.col("p") - F.col("q")).alias("shift"), "p", F.col("next").eqNullSafe(F.col("next_a")) & F.col("next").isNotNull()).toDF(*diagonal, "p", "more"))

    # a window that isn't among the first places may still go on with a run: there the lines themselves tell how far
    along = Window.partitionBy(*diagonal).orderBy("p")
    pairs = pairs.withColumn("last", ~F.coalesce(F.lead("p").over(along) == F.col("p") + 1, F.lit(False)))
    files = cut(rows.join(w.select(*partition, "path").distinct(), [*partition, "path"], "left_semi").groupBy(*partition, "path").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "before", "tokens"))).alias("l")))
    ends = pairs.filter("last and more").select(*diagonal, "p")
    side = lambda name, at: files.select(*partition, F.col("path").alias(name), F.col("l.line").alias(at))
    ends = ends.join(side("b", "_b"), [*partition, "b"]).join(side("a", "_a"), [*partition, "a"])
    after = lambda c, at: F.slice(c, at + size + 1, F.size(c))
    same = F.zip_with(after("_b", F.col("p")), after("_a", F.col("p") - F.col("shift")), lambda x, y: F.coalesce(x == y, F.lit(False)))
    ends = ends.select(*diagonal, "p", (F.array_position(F.concat(same, F.array(F.lit(False))), False) - 1).cast("int").alias("further"))
    pairs = pairs.join(ends, [*diagonal, "p"], "left").withColumn("to", F.col("p") + size + F.coalesce("further", F.lit(0)))

    so_far = F.max("to").over(along.rowsBetween(Window.unboundedPreceding, -1))
    pairs = pairs.withColumn("run", F.sum(F.when(so_far > F.col("p"), 0).otherwise(1)).over(along))
    runs = pairs.groupBy(*diagonal, "run").agg(F.min("p").alias("at"), F.max("to").alias("end"), F.array_sort(F.collect_list("p")).alias("cands")).drop("run")
    tokens = files.select(*partition, F.col("path").alias("b"), F.concat("l.before", F.array(F.element_at("l.before", -1) + F.element_at("l.tokens", -1))).alias("_upto"))
    return runs.join(tokens, [*partition, "b"]).withColumn("upto", F.slice("_upto", F.col("at") + 1, F.col("end") - F.col("at") + 1)).drop("_upto")


def _opened(runs: DataFrame, size: int, tokens: int) -> DataFrame:
    """``runs`` with the first candidate that may be taken now (live) and the first that overlaps itself (waits); what is too short is gone."""
    rest = lambda p: F.element_at("upto", -1) - F.element_at("upto", (p - F.col("at") + 1).cast("int"))
    runs = runs.withColumn("cands", F.filter("cands", lambda p: (F.col("end") - p >= size) & (rest(p) >= tokens))).filter(F.size("cands") > 0)
    own = F.col("a") == F.col("b")
    live = F.filter("cands", lambda p: ~own | (F.col("end") - p <= F.col("shift")))
    waits = F.filter("cands", lambda p: own & (F.col("end") - p > F.col("shift")))
    return runs.withColumns({"live": F.get(live, F.lit(0)), "waits": F.get(waits, F.lit(0))})


def _rank(p: Column) -> Column:
    """Candidates in the order in which a walk over the tree meets them."""
    return F.struct(F.col("b"), p.alias("p"), F.col("a"), (p - F.col("shift")).alias("q"), (F.col("end") - p).alias("n"))


def exact(lines: DataFrame, partition: list[str], size: int = config.DUP_MIN_LINES, tokens: int = config.DUP_MIN_TOKENS, places: int = config.BUCKET_LOCATIONS) -> tuple[DataFrame, DataFrame]:
    """(clones, duplicated lines by file) of each tree; ``lines``: (partition, path, pos, line_no, text), positions from 0 on.

    The clones are those of a walk over the places of a tree in order: a place that no clone covers looks at the first ``places`` places with
    the same window; the first earlier one that isn't covered either, and whose common run (up to the next covered line) is long enough
    and doesn't overlap itself, makes a clone that covers both sides. ``seq`` is the order of the walk.

    It is computed in rounds over all trees: a candidate is taken if it is the earliest on all of its lines, since nothing that
    comes before it can then change it; what is taken cuts the other runs. Runs are rows, and of a run only its first candidate
    claims lines, so a round shuffles lines by line with a minimum, and no file, tree or component is a group in one task. A
    candidate that overlaps itself can only become one that is taken if an earlier one cuts its run: where none that may be taken touches its
    file before it, it is given up at once. Runs end within their file; the work is that of the pairs with the first ``places`` places.
    """
    diagonal = [*partition, "a", "b", "shift"]
    runs = cut(_opened(_runs(lines, partition, size, places), size, tokens))
    taken: DataFrame | None = None
    line = [*partition, "file", "line"]
    while not runs.isEmpty():
        touching = runs.filter("live is not null").select(*partition, F.explode(F.array_distinct(F.array("a", "b"))).alias("file"), _rank(F.col("live")).alias("rank"))
        early = touching.groupBy(*partition, "file").agg(F.min("rank").alias("early"))
        seen = runs.join(early.withColumnRenamed("file", "b"), [*partition, "b"], "left")
        # what waits behind no live candidate of its file will wait for ever
        before = lambda p: F.col("early").isNotNull() & (_rank(p) > F.col("early"))
        waiting = (F.col("a") == F.col("b")) & F.col("waits").isNotNull()
        kept = F.filter("cands", lambda p: (F.col("end") - p <= F.col("shift")) | before(p))
        seen = _opened(seen.withColumn("cands", F.when(waiting, kept).otherwise(F.col("cands"))).drop("early"), size, tokens)
        runs = cut(seen)

        head = F.explode(F.filter(F.array("live", "waits"), lambda p: p.isNotNull())).alias("head")
        claims = runs.select(*partition, "a", "b", "shift", "end", "live", head)
        claims = claims.withColumn("rank", F.struct(*[_rank(F.col("head"))[k].alias(k) for k in "bpaqn"], (F.col("head") == F.col("live")).alias("is_live")))
        both = F.array(F.struct(F.col("b").alias("file"), F.col("head").alias("from")), F.struct(F.col("a").alias("file"), (F.col("head") - F.col("shift")).alias("from")))
        on = claims.select(*partition, "rank", F.explode(both).alias("s")).select(*partition, "rank", F.col("s.file").alias("file"), F.explode(F.sequence(F.col("s.from"), F.col("s.from") + F.col("rank.n") - 1)).alias("line"))
        first = on.groupBy(*line).agg(F.min("rank").alias("rank"))
        won = cut(first.groupBy(*partition, "rank").agg(F.count("*").alias("lines")).filter("rank.is_live and lines = 2 * rank.n").select(*partition, "rank.*"))
        taken = won if taken is None else taken.unionByName(won)
        sides = won.select(*partition, F.explode(F.array(F.struct(F.col("b").alias("file"), F.col("p").alias("from"), "n"), F.struct(F.col("a").alias("file"), F.col("q").alias("from"), "n"))).alias("s")).select(*partition, "s.*")
        covered = sides.groupBy(*partition, "file").agg(F.collect_list(F.struct("from", (F.col("from") + F.col("n")).alias("to"))).alias("iv"))
        runs = cut(_opened(_cut_runs(runs.drop("live", "waits"), covered, partition, diagonal), size, tokens))

    if taken is None:
        taken = lines.select(*partition, F.col("path").alias("b"), F.col("pos").alias("p"), F.col("path").alias("a"), F.col("pos").alias("q"), F.lit(0).alias("n")).filter("false")
    taken = cut(taken)
    at = lines.select(*partition, "path", "pos", "line_no")
    number = lambda df, file, pos, name: df.join(at.withColumnsRenamed({"path": file, "pos": pos, "line_no": name}), [*partition, file, pos])
    hits = number(number(taken, "a", "q", "line_a"), "b", "p", "line_b").select(*partition, F.col("a").alias("file_a"), "line_a", F.col("b").alias("file_b"), "line_b", F.col("n").cast("int").alias("lines"))
    hits = cut(hits.withColumn("seq", F.row_number().over(Window.partitionBy(*partition).orderBy("file_b", "line_b")) - 1))
    by_file = hits.select(*partition, F.explode(F.array("file_a", "file_b")).alias("path"), "lines").groupBy(*partition, "path").agg(F.sum("lines").cast("int").alias("dup_lines"))
    return hits, by_file


def _cut_runs(runs: DataFrame, covered: DataFrame, partition: list[str], diagonal: list[str]) -> DataFrame:
    """What ``covered`` (partition, file, iv: stretches [from, to)) leaves of the runs."""
    side = lambda name: covered.withColumnsRenamed({"file": name, "iv": f"_{name}"})
    none = F.array().cast("array<struct<from: int, to: int>>")
    near = runs.join(side("b"), [*partition, "b"], "left").join(side("a"), [*partition, "a"], "left")
    shifted = F.transform(F.coalesce("_a", none), lambda x: F.struct((x["from"] + F.col("shift")).alias("from"), (x["to"] + F.col("shift")).alias("to")))
    on = F.filter(F.concat(F.coalesce("_b", none), shifted), lambda x: (x["from"] < F.col("end")) & (x["to"] > F.col("at")))
    near = near.withColumn("on", F.array_sort(on)).drop("_a", "_b")
    # what lies between stretches that are in order: from the furthest end so far to the next one's beginning
    edge = F.struct(F.col("end").alias("from"), F.col("end").alias("to"))
    start = F.struct(F.col("at").alias("upto"), F.array().cast("array<struct<at: int, end: int>>").alias("free"))

    def step(acc, x):
        return F.struct(F.greatest(acc["upto"], x["to"]).alias("upto"), F.when(x["from"] > acc["upto"], F.concat(acc["free"], F.array(F.struct(acc["upto"].alias("at"), x["from"].alias("end"))))).otherwise(acc["free"]).alias("free"))

    free = F.aggregate(F.concat("on", F.array(edge)), start, step)["free"]
    parts = near.select(*diagonal, "at", "cands", "upto", F.explode(F.when(F.size("on") > 0, free).otherwise(F.array(F.struct("at", "end")))).alias("f"))
    return parts.select(
        *diagonal, F.col("f.at").alias("at"), F.col("f.end").alias("end"), F.filter("cands", lambda p: (p >= F.col("f.at")) & (p < F.col("f.end"))).alias("cands"),
        F.slice("upto", F.col("f.at") - F.col("at") + 1, F.col("f.end") - F.col("f.at") + 1).alias("upto"),
    )


def shown(clones: DataFrame, partition: list[str], most: int = config.CLONES_SHOWN) -> DataFrame:
    """The clones of a report: of the first ``MAX_CLONE_PAIRS`` found, the longest, then by file and line."""
    first = clones.filter(F.col("seq") < config.MAX_CLONE_PAIRS)
    order = Window.partitionBy(*partition).orderBy(F.col("lines").desc(), "file_a", "line_a", "file_b", "line_b")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def partners(clones: DataFrame, partition: list[str]) -> DataFrame:
    """(partition, path, partners, examples): other files that share a clone, from all clones, and the first three of them."""
    both = clones.select(*partition, F.col("file_a").alias("path"), F.col("file_b").alias("other")).union(clones.select(*partition, "file_b", "file_a")).filter("path <> other")
    return both.groupBy(*partition, "path").agg(F.countDistinct("other").alias("partners"), F.slice(F.array_sort(F.collect_set("other")), 1, 3).alias("examples"))


def bundles(dup_by_file: DataFrame, sizes: DataFrame, clones: DataFrame, partition: list[str], most: int | None = None) -> DataFrame:
    """Files made of others: many norm lines (``sizes``: partition, path, norm_lines), half of them duplicated, with many partners.

    By partners, the most first; ``most``: so many of each tree (a probe shows four).
    """
    own = dup_by_file.join(sizes, [*partition, "path"]).join(partners(clones, partition), [*partition, "path"])
    own = own.filter((F.col("norm_lines") >= config.BUNDLE_MIN_LINES) & (F.col("dup_lines") >= config.BUNDLE_SHARE * F.col("norm_lines")) & (F.col("partners") >= config.BUNDLE_PARTNERS))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(F.col("partners").desc(), "path")))
    return ranked if most is None else ranked.filter(F.col("rank") <= most)
