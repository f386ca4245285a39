"""Author identities: mail maps, rollups, merging by display name, suspicious pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens import config
from quarrylens.functions import text as X


def mailmap(files: DataFrame) -> DataFrame:
    """(repo_id, commit_email, email, name) of the lines of ``.mailmap`` files (repo_id, content); e-mails in their normal form.

    ``Name <mail>`` names the author of a mail; ``Name <mail> [Name] <commit mail>`` maps one mail to another too.
    """
    line = F.trim(F.col("line"))
    rows = files.select("repo_id", F.explode(F.split("content", "\n")).alias("line")).filter((line != "") & ~line.startswith("#"))
    pattern = r"^([^<]*)<([^>]+)>(?:\s*([^<]*)<([^>]+)>)?\s*(?:#.*)?$"
    part = lambda k: F.trim(F.regexp_extract(line, pattern, k))
    rows = rows.filter(line.rlike(pattern)).select("repo_id", part(1).alias("name"), X.normal_email(part(2)).alias("email"), X.normal_email(part(4)).alias("commit_email"))
    return rows.select("repo_id", F.nullif("commit_email", F.lit("")).alias("commit_email"), "email", F.nullif("name", F.lit("")).alias("name"))


def keyed(commits: DataFrame, mails: DataFrame | None = None) -> DataFrame:
    """``commits`` with author_key and shown_name, through the mail map where there is one."""
    own = commits.withColumn("_mail", X.normal_email(F.col("author_email"))).withColumn("author_key", X.author_key(F.col("author_name"), F.col("author_email")))
    if mails is None:
        return own.withColumn("shown_name", F.col("author_name")).drop("_mail")
    to = mails.filter("commit_email is not null").groupBy("repo_id", F.col("commit_email").alias("_mail")).agg(F.max("email").alias("_to"))
    names = mails.filter("name is not null").groupBy("repo_id", F.col("email").alias("author_key")).agg(F.max("name").alias("_name"))
    own = own.join(to, ["repo_id", "_mail"], "left").withColumn("author_key", F.coalesce("_to", "author_key"))
    own = own.join(names, ["repo_id", "author_key"], "left")
    return own.withColumn("shown_name", F.coalesce("_name", "author_name")).drop("_mail", "_to", "_name")


def rollup(commits: DataFrame, partition: list[str], order: str = "idx") -> DataFrame:
    """(partition, author_key, name, email, commits, added_lines, identities): the first commit of a key names it."""
    identity = F.concat_ws("|", F.coalesce("author_name", F.lit("")), F.coalesce("author_email", F.lit("")))
    first = F.min_by(F.struct(F.col("shown_name").alias("name"), F.col("author_email").alias("email")), order)
    out = commits.groupBy(*partition, "author_key").agg(first.alias("f"), F.count("*").alias("commits"), F.sum("added").alias("added_lines"), F.array_sort(F.collect_set(identity)).alias("identities"))
    return out.select(*partition, "author_key", F.col("f.name").alias("name"), F.col("f.email").alias("email"), "commits", "added_lines", "identities")


def raw_identities(commits: DataFrame, partition: list[str]) -> DataFrame:
    identity = F.concat_ws("|", F.coalesce("author_name", F.lit("")), F.coalesce("author_email", F.lit("")))
    return commits.groupBy(*partition).agg(F.countDistinct(identity).alias("raw_identities"))


def merged(authors: DataFrame, partition: list[str]) -> DataFrame:
    """Authors with one display name are one: most commits wins, then the lowest key. Names without a letter or digit stay apart."""
    name = X.display_key(F.col("name"))
    group = F.when(name != "", name).otherwise(F.concat(F.lit("\x00"), F.col("author_key")))
    lead = F.min_by(F.struct(F.col("author_key"), F.col("name"), F.col("email")), F.struct(-F.col("commits"), F.col("author_key")))
    out = authors.groupBy(*partition, group.alias("_g")).agg(lead.alias("w"), F.sum("commits").alias("commits"), F.sum("added_lines").alias("added_lines"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("identities")))).alias("identities"))
    return out.select(*partition, F.col("w.author_key").alias("author_key"), F.col("w.name").alias("name"), F.col("w.email").alias("email"), "commits", "added_lines", "identities")


def suspects(authors: DataFrame, partition: list[str], most: int = config.SUSPECTS_SHOWN) -> DataFrame:
    """The first pairs of authors, by key, whose names or mail boxes are equal, or begin with the other's if that has four characters or more.

    Each text meets its own prefixes, so work follows matches and not the authors whose names begin alike. Of the authors with one text, and
    of those whose texts go on from it, the first few by key are enough: a pair with a later one has ``most`` pairs before it.
    """
    own = F.struct(F.col("author_key").alias("key"), "name")
    kinds = F.array(F.struct(F.lit("n").alias("kind"), X.display_key(F.col("name")).alias("v")), F.struct(F.lit("m").alias("kind"), X.local_part(F.col("email")).alias("v")))
    forms = authors.select(*partition, own.alias("who"), F.explode(kinds).alias("f")).select(*partition, "f.kind", "f.v", "who").filter("v <> ''")
    text = [*partition, "kind", "v"]

    def first(rows: DataFrame, n: int, name: str) -> DataFrame:
        ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*text).orderBy("who.key"))).filter(F.col("_r") <= n)
        return ranked.groupBy(*text).agg(F.array_sort(F.collect_list("who")).alias(name))

    alike = first(forms, most + 1, "own")
    starts = alike.filter(F.char_length("v") > 4).withColumn("n", F.explode(F.sequence(F.lit(4), F.char_length("v") - 1)))
    longer = starts.select(*partition, "kind", F.expr("substring(v, 1, n)").alias("v"), F.col("own").alias("more")).join(alike.select(*text), text, "left_semi")
    longer = first(longer.select(*text, F.explode("more").alias("who")), most, "longer")
    none = F.array().cast(longer.schema["longer"].dataType)
    met = alike.join(longer, text, "left").withColumn("longer", F.coalesce("longer", none))
    pair = lambda x, y: F.when(x["key"] < y["key"], F.struct(x.alias("a"), y.alias("b"))).otherwise(F.struct(y.alias("a"), x.alias("b")))
    pairs = F.flatten(F.transform("own", lambda x: F.concat(F.transform(F.filter("own", lambda y: y["key"] > x["key"]), lambda y: pair(x, y)), F.transform("longer", lambda y: pair(x, y)))))
    pairs = met.select(*partition, F.explode(pairs).alias("p")).select(*partition, F.col("p.a.key").alias("key_a"), F.col("p.b.key").alias("key_b"), F.col("p.a.name").alias("name_a"), F.col("p.b.name").alias("name_b"))
    pairs = pairs.distinct()
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy("key_a", "key_b"))).filter(F.col("rank") <= most)


def bus_factor(authors: DataFrame, partition: list[str]) -> DataFrame:
    """The fewest authors who made at least half of the commits."""
    run = Window.partitionBy(*partition).orderBy(F.col("commits").desc(), "author_key").rowsBetween(Window.unboundedPreceding, 0)
    ranked = authors.withColumn("running", F.sum("commits").over(run)).withColumn("n", F.count("*").over(run)).withColumn("total", F.sum("commits").over(Window.partitionBy(*partition)))
    return ranked.groupBy(*partition).agg(F.min(F.when(F.col("running") * 2 >= F.col("total"), F.col("n"))).cast("int").alias("bus_factor"))

