"""Operator 5: URL filters by propagation over the link graph, in DataFrame operations only.

A url's rule is the longest of the rules (host, path) whose host is the url's host or a parent of it and whose path begins the
url's path. Where no rule fits, the host's standing decides: trust spreads from the hosts of pages that rules allow, along the
links between hosts (personalised PageRank), and distrust from the hosts of pages that rules block, against them, since a page
answers for what it links to. Standing is trust / (trust + distrust), each as a share of the seeds' mean; a host is
blocked if its standing is below ``LEAST``, and allowed where neither reaches it. Ranks are summed walk by walk, so they only grow,
and spread until ``CUT`` steps reach no new host and add to none more than ``TOLERANCE`` of its rank; the mass that still moves
falls by ``DAMPING`` a step, so this comes about on any graph. A walk ends at a host without links: its mass isn't dealt out anew.

Links are absolute or scheme-relative urls in ``href`` and ``src`` attributes; links within a host don't count. A pair of hosts weighs as many
pages as link it. Hosts are split and counted by Spark before they meet; nothing of the graph is collected or broadcast
by hand. A null url, or one without ``://``, has an empty host and path and no rule, and its page no links; a null html
has none. Repeated pages count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.scratch import drop, files_for, saved, table

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DAMPING, TOLERANCE, LEAST = 0.85, 1e-6, 0.5
#: steps between written tables, so that plans stay short, and between tests of convergence
CUT = 5
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s<>]*)"""


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")


def with_host(df: DataFrame, url: str) -> DataFrame:
    """``df`` with host and path of a url."""
    df = df.withColumn("_rest", F.coalesce(_after_scheme(url), F.lit("")))
    return df.withColumn("host", _lower(F.regexp_extract("_rest", r"^[^/?#]*", 0))).withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)).drop("_rest")


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, its verdict): of the longest rule that fits, null without one."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (name, verdict) if name is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def host_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, weight) between different hosts; ``pages`` has host."""
    hosts = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1)), lambda link: _lower(F.regexp_extract(link, r"//([^/?#]*)", 1))))
    found = pages.filter(F.col("host") != "").select(F.col("host").alias("src"), F.explode(hosts).alias("dst"))
    return found.filter("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def spread(seeds: DataFrame, links: DataFrame, files: int | None = None) -> DataFrame:
    """(host, rank): personalised PageRank of ``seeds`` (host, share) over ``links`` (src, dst, weight), run until it converges."""
    out = links.groupBy(F.col("src").alias("s")).agg(F.sum("weight").alias("all"))
    shares = saved(links.join(out, F.col("src") == F.col("s")).select("src", "dst", (F.col("weight") / F.col("all")).alias("share")), "shares", files)
    start = saved(seeds.select("host", (F.col("share") * (1 - DAMPING)).alias("rank")), "seeds", files)
    if shares.isEmpty():
        return start
    before = start
    while True:
        rank = before
        for _ in range(CUT):
            moved = rank.join(shares, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (DAMPING * F.col("rank") * F.col("share")).alias("rank"))
            rank = moved.unionByName(start).groupBy("host").agg(F.sum("rank").alias("rank"))
        rank = saved(rank, "rank", files)
        known = before.select("host", F.col("rank").alias("known"))
        done = rank.join(known, "host", "left").filter(F.col("known").isNull() | (F.col("rank") - F.col("known") > TOLERANCE * F.col("rank"))).isEmpty()
        if before is not start:
            drop(before)
        if done:
            return rank
        before = rank


def judge(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", rules: tuple = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, standing) of each page."""
    own = with_host(pages.select(F.col(id_column), F.col(url_column).alias("url"), F.col(html_column).alias("html")), "url")
    files = files_for(pages.count())
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = own.withColumn("rule", name).withColumn("ruled", verdict)
    seeded = own.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").cast("double").alias("allow"), F.count_if(F.col("ruled") == "block").cast("double").alias("block"))
    seeded = saved(seeded.filter("allow + block > 0"), "seeded", files)
    links = saved(host_links(own), "links", files)
    totals = seeded.agg(F.sum("allow").alias("a"), F.sum("block").alias("b")).first()  # two numbers
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    trust = spread(seeded.filter("allow > 0").select("host", (F.col("allow") / (totals["a"] or 1.0)).alias("share")), links, files=files)
    distrust = spread(seeded.filter("block > 0").select("host", (F.col("block") / (totals["b"] or 1.0)).alias("share")), back, files=files)
    # both in pages, so that many seeds on one side don't outweigh the other by their number alone
    hosts = trust.select("host", (F.col("rank") * (totals["a"] or 0.0)).alias("t"), F.lit(0.0).alias("d")).unionByName(distrust.select("host", F.lit(0.0).alias("t"), (F.col("rank") * (totals["b"] or 0.0)).alias("d")))
    hosts = hosts.groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d")).select("host", F.when(F.col("t") + F.col("d") > 0, F.round(F.col("t") / (F.col("t") + F.col("d")), 9)).alias("standing"))
    out = own.drop("html", "url").join(hosts, "host", "left")
    by_host = F.when(F.col("standing") < LEAST, "block").otherwise("allow")
    return out.select(id_column, "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), "standing")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").withColumn("page_id", F.col("page_id").cast("long")))
