"""The blocks of a report over the driver's tables: customers are repositories, whose figures come from their orders."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quarrylens.config import Thresholds
from quarrylens.functions import text as X
from quarrylens.operators import churn, findings, incremental, metrics
from quarrylens.plans import analysis
from quarrylens.plans.proxies import _STATES, FACTS, facts, graded, query
from quarrylens.sources.tables import cut, table

# figures of a repository, in words of both SQL dialects; n, s and m are the number of its orders, the sum of their prices and the last key
_FIGURES = {
    "dup_lines": "cast(s % 300 as bigint)", "hot_lines": "cast(floor(s % 300 * (m % 100) / 100) as bigint)", "bare": "n % 4", "broad": "m % 3", "swallow": "s % 2", "suppress": "n % 2",
    "err_density": "cast(s % 500 as double) / 100", "state_err": "case when s % 500 >= 300 then 'crit' when s % 500 >= 100 then 'warn' else 'good' end",
    "reference_days": "m % 4", "conn_then": "cast(m % 7000 as double) / 10", "conn_density": "cast(s % 7000 as double) / 10", "conn_delta_pct": "case when m % 5 > 0 then cast(s % 250 as double) / 10 - 12 end",
    "state_conn": "case when m % 5 = 0 then 'unknown' when s % 250 <= 40 then 'crit' when s % 250 <= 100 then 'warn' else 'good' end",
    "raw_identities": "n % 9 + 1", "authors": "n % 7 + 1", "bus_factor": "n % 3 + 1", "top_name": "case when m % 6 > 0 then 'Name ' || cast(m % 50 as varchar(9)) end", "top_commits": "n",
    "churn_pct": "cast(s % 120 as double) / 10", "copy_pct": "cast(m % 200 as double) / 10", "state_copy": "case when m % 200 >= 150 then 'crit' when m % 200 >= 80 then 'warn' else 'good' end",
    "copied": "s % 90", "added": "s % 90 + m % 400", "refactor_pct": "cast(s % 333 as double) / 10", "dup_measured_lines": "s % 5000", "first_at": "cast(m as bigint) * 86400", "committed_at": "cast(m as bigint) * 86400 + cast(s as bigint) * 700",
    "censored_commits": "n % 5", "import_commits": "n % 3", "imported_lines": "s % 2000", "commits": "n",
}
_BASE = f"""b as (select c_custkey as repo_id, count(o_orderkey) as n, coalesce(sum(floor(o_totalprice)), 0)::bigint as s, coalesce(max(o_orderkey), 0) as m from customer left join orders on o_custkey = c_custkey group by c_custkey),
a as (select repo_id, n, s, m, {", ".join(f"{v} as {k}" for k, v in _FIGURES.items())} from b),
o as (select o_custkey as repo_id, o_orderkey as k, floor(o_totalprice)::bigint as p, row_number() over (partition by o_custkey order by o_orderkey) as rank from orders)"""


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(figures of each repository, its orders in order)."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("k"), F.floor("o_totalprice").alias("p"))
    sums = orders.groupBy("repo_id").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.max("k").alias("m"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo_id")).join(sums, "repo_id", "left").na.fill(0, ["n", "s", "m"])
    a = b.selectExpr("repo_id", "n", "s", "m", *[f"{v} as {k}" for k, v in _FIGURES.items()])
    a = a.withColumns({"hottest": F.struct(F.col("hot_lines").alias("dup_lines"), F.format_string("src/f%d.py", F.col("m") % 40).alias("path")), "top": F.struct(F.col("top_name").alias("name"), F.col("top_commits").alias("commits"))})
    return cut(a), orders.withColumn("rank", F.row_number().over(_by("k")))


def _inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    a, o = _base(spark, sf_dir)
    k, p = F.col("k"), F.col("p")
    bundles = o.filter("p % 40 = 0").withColumn("rank", F.row_number().over(_by("k"))).select("repo_id", "rank", F.format_string("b%d.js", "k").alias("path"), (p % 90 + 50).alias("dup_lines"), (p % 90 + 80).alias("norm_lines"), (k % 30 + 20).alias("partners"), F.array(F.lit("x.js"), F.format_string("y%d.js", k % 9)).alias("examples"))
    clones = o.select("repo_id", "rank", F.format_string("f%d.py", k % 5).alias("file_a"), (p % 77).cast("int").alias("line_a"), F.format_string("f%d.py", p % 5).alias("file_b"), (k % 99).cast("int").alias("line_b"), (p % 50 + 5).alias("lines"))
    suspects = o.filter("p % 25 = 1").select("repo_id", "rank", F.format_string("A%d", k % 60).alias("name_a"), F.format_string("B%d", p % 60).alias("name_b"))
    spikes = o.filter("rank = 1").select("repo_id", F.sha1(k.cast("string").cast("binary")).alias("sha"), F.format_string("change %d", "k").alias("subject"), (F.col("p") % 400 / 10.0).cast("double").alias("pct"), (p % 500 + 10).alias("added"), (p % 500).alias("churn"), (k * 1000).alias("committed_at"))
    mirrors = o.filter("p % 11 = 0").select("repo_id", F.format_string("src/m%d", "k").alias("original"), F.format_string("vendor/m%d", "k").alias("mirror"), (p % 3000).alias("dropped_lines"))
    return {"a": a, "bundles": bundles, "clones": clones, "suspects": suspects, "spikes": spikes, "mirrors": mirrors, "truncated": a.select("repo_id", (F.col("n") > 12).alias("truncated"))}


def _by(order: str) -> WindowSpec:
    return Window.partitionBy("repo_id").orderBy(order)


def _up(x: str, digits: int) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}" if digits else f"floor({x} + 0.5)"


def _map(**params: str) -> str:
    return f"map([{', '.join(repr(k) for k in params)}], [{', '.join(f'({v})::varchar' for v in params.values())}])"


_CLASH = "raw_identities > authors"
_SPIKE = "floor(p % 400)::double / 10.0::double"
_FINDINGS = f"""with {_BASE}, bu as (select *, row_number() over (partition by repo_id order by k) as r, count(*) over (partition by repo_id) - 1 as others from o where p % 40 = 0),
cl as (select *, count(*) over (partition by repo_id) as c, row_number() over (partition by repo_id order by rank) as r from o where 'f' || k % 5 <> 'f' || p % 5),
su as (select repo_id, count(*) as c, arg_min('A' || k % 60, rank) as x, arg_min('B' || p % 60, rank) as y, string_agg('A' || k % 60 || ' <-> B' || p % 60, ' · ' order by rank) as names from o where p % 25 = 1 group by repo_id),
f as (select repo_id, 'warn' as severity, 'bundleFile' as code, {_map(file="'b' || k || '.js'", dupLines="p % 90 + 50", fileLines="p % 90 + 80", partners="k % 30 + 20", others="others", examples="'x.js, y' || k % 9 || '.js'")} as params, 'b' || k || '.js' as evidence from bu where r = 1
union all select repo_id, case when c >= 3 then 'crit' else 'warn' end, 'crossFileClone', {_map(fileA="'f' || k % 5 || '.py'", lineA="p % 77", fileB="'f' || p % 5 || '.py'", lineB="k % 99", lines="p % 50 + 5", count="c")}, 'f' || k % 5 || '.py:' || p % 77 || ' <-> f' || p % 5 || '.py:' || k % 99 from cl where r = 1
union all select repo_id, case when 100.0::double * (hot_lines / dup_lines::double) >= 60 then 'warn' else 'good' end, 'cloneConcentration', {_map(file="'src/f' || m % 40 || '.py'", lines="hot_lines", share="floor(100.0::double * (hot_lines / dup_lines::double) + 0.5)", total="dup_lines")}, 'src/f' || m % 40 || '.py' from a where dup_lines > 0 and 100.0::double * (hot_lines / dup_lines::double) >= 40
union all select repo_id, state_err, 'errorHandling', {_map(bare="bare", broad="broad", swallow="swallow", suppress="suppress", density=_up("err_density", 2))}, '' from a
union all select repo_id, state_conn, 'connectivityDrift', {_map(**{"from": _up("conn_then", 1), "to": _up("conn_density", 1), "delta": _up("conn_delta_pct", 1), "windowDays": "reference_days"})}, '' from a where state_conn <> 'unknown' and reference_days >= 1
union all select repo_id, case when bus_factor <= 1 then 'crit' when {_CLASH} then 'warn' else 'good' end, case when {_CLASH} then 'busFactor' else 'busFactorClean' end, {_map(busFactor="bus_factor", authors="authors", identities="raw_identities", topName="coalesce(top_name, '')", topCommits="top_commits", collision=_CLASH)}, '' from a
union all select repo_id, 'warn', 'identitySuspects', {_map(nameA="x", nameB="y", pairs="c")}, names from su
union all select repo_id, case when pct >= 20 then 'crit' else 'warn' end, 'churnSpike', {_map(sha="left(sha, 8)", fullSha="sha", subject="'change ' || k", pct=_up("pct", 1), added="p % 500 + 10", churn="p % 500", at="k * 1000", average=_up("churn_pct", 1))}, left(sha, 8) from (select o.*, churn_pct, {_SPIKE} as pct, sha1(k::varchar) as sha from o join a using (repo_id) where rank = 1) where pct >= 10 and pct >= 2 * churn_pct
union all select repo_id, state_copy, 'copyPasteHigh', {_map(pct=_up("copy_pct", 1), lines="copied", added="added", refactorPct=_up("refactor_pct", 1))}, '' from a where state_copy in ('warn', 'crit'))"""
_PARAMS = "(select string_agg(k || '=' || params[k], ';' order by k) from (select unnest(map_keys(params)) as k))"


def _flat(rows: DataFrame) -> DataFrame:
    """``rows`` with their parameters as text, in order of their names."""
    entries = F.array_sort(F.map_entries(F.from_json("params", "map<string,string>")))
    return rows.withColumn("params", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _inputs(spark, sf_dir)
    return findings.findings(i["a"], i["bundles"], i["clones"], i["suspects"], i["spikes"], Thresholds())


@query(f"{_FINDINGS} select repo_id, severity, code, {_PARAMS} as params, evidence from f")
def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of every repository, of all ten codes."""
    return _flat(_found(spark, sf_dir)).select("repo_id", "severity", "code", "params", "evidence")


_CAVEATS = f"""with {_BASE}, mi as (select repo_id, count(*) as trees, sum(p % 3000)::bigint as lines, string_agg('vendor/m' || k || ' (= src/m' || k || ')', ', ' order by -(p % 3000), 'src/m' || k) as names from o where p % 11 = 0 group by repo_id),
f as (select repo_id, 'mirrorTrees' as code, {_map(trees="trees", lines="lines", names="names", measured="dup_measured_lines")} as params from mi join a using (repo_id)
union all select repo_id, 'historyTruncated', {_map(commits="20000", oldest="first_at")} from a where n > 12
union all select repo_id, 'rightCensoring', {_map(commits="censored_commits", days="14")} from a
union all select repo_id, 'importExcluded', {_map(commits="import_commits", lines="imported_lines")} from a
union all select repo_id, 'sampleSize', {_map(commits="commits", days="greatest(1, floor((committed_at - first_at) / 86400000.0)::bigint)", authors="authors")} from a
union all select repo_id, unnest(['approximation', 'aiAttribution', 'firstParent']), map([]::varchar[], []::varchar[]) from a)"""


@query(f"{_CAVEATS} select repo_id, code, coalesce({_PARAMS}, '') as params from f")
def report_caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caveats of every repository, of all eight codes."""
    i = _inputs(spark, sf_dir)
    return _flat(findings.caveats(i["a"], i["mirrors"], i["truncated"])).withColumn("params", F.coalesce("params", F.lit("")))


def _texts(language: str) -> str:
    """Messages as rows, and a body with all parameters put in."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(c)}, {quoted(t)}, {quoted(b)})" for c, (t, b) in findings.MESSAGES[language].items())
    names = sorted({n for _, b in findings.MESSAGES[language].values() for n in re.findall(r"{(\w+)}", b)})
    body = "body"
    for n in names:
        body = f"replace({body}, '{{{n}}}', coalesce(params['{n}'], '{{{n}}}'))"
    return f"t(code, title, body) as (values {rows})", body


@query(f"{_FINDINGS}, {_texts('ko')[0]} select repo_id, f.code, title, {_texts('ko')[1]} as body from f join t using (code)")
def finding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings in Korean."""
    return findings.texts(_found(spark, sf_dir), "ko").select("repo_id", "code", "title", "body")


@query(f"{_CAVEATS}, {_texts('en')[0]} select repo_id, f.code, title, {_texts('en')[1]} as body from f join t using (code)")
def caveat_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caveats in English."""
    i = _inputs(spark, sf_dir)
    return findings.texts(findings.caveats(i["a"], i["mirrors"], i["truncated"]), "en").select("repo_id", "code", "title", "body")


# ---------------------------------------------------------------- cards and series

_CARDS = f"""{_STATES},
v as (select *, 100.0::double * (copied::double / added::double) as copy_pct, 100.0::double * (moved::double / (moved + copied)::double) as refactor_pct, 100.0::double * (churn::double / churn_added::double) as churn_pct, 100.0 * (conn - conn_then) / conn_then as conn_pct from h join k using (repo_id) join n using (repo_id) join d using (repo_id)),
w as (select repo_id, arg_max(dup_lines, idx) as dup_lines from facts where loc is not null group by repo_id),
cards as (select repo_id, 'copyPaste' as key, {_up("copy_pct", 1)} as value, 'percent' as unit, case when copy_pct >= 15 then 'crit' when copy_pct >= 8 then 'warn' else 'good' end as state, 'lower' as direction, null::double as delta, 8.0 as warn, 15.0 as crit from v
union all select repo_id, 'refactor', {_up("refactor_pct", 1)}, 'percent', case when refactor_pct <= 8 then 'crit' when refactor_pct <= 15 then 'warn' else 'good' end, 'higher', null, 15.0, 8.0 from v
union all select repo_id, 'churn', {_up("churn_pct", 1)}, 'percent', case when churn_pct >= 20 then 'crit' when churn_pct >= 10 then 'warn' else 'good' end, 'lower', null, 10.0, 20.0 from v
union all select repo_id, 'duplication', dup_lines, 'lines', case when dup_pct >= 11.3 then 'crit' when dup_pct >= case when repo_id < '3' then 6.0 else 5.5 end then 'warn' else 'good' end, 'lower', case when abs(dup_delta_lines) >= 20 then {_up("dup_delta_pct", 1)} end, null, null from v join w using (repo_id)
union all select repo_id, 'errorSwallow', {_up("err", 2)}, 'perKloc', case when err >= 3 then 'crit' when err >= 1 then 'warn' else 'good' end, 'lower', null, 1.0, 3.0 from v
union all select repo_id, 'connectivity', {_up("conn", 1)}, 'perKloc', case when conn_pct <= -8 then 'crit' when conn_pct <= -2 then 'warn' else 'good' end, 'higher', {_up("conn_pct", 1)}, -2.0, -8.0 from v)"""


@query(f"{_CARDS}, s as (select repo_id, count(*) filter (where not import_commit) as a, count(*) filter (where not import_commit and not churn_censored) as b, count(*) filter (where loc is not null) as c from facts group by repo_id) select repo_id, key, round(value, 6) as value, unit, state, direction, round(delta, 6) as delta, warn::double as warn, crit::double as crit, case when key in ('copyPaste', 'refactor') then s.a when key = 'churn' then s.b else s.c end::int as points from cards join s using (repo_id)")
def report_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six graded cards of each repository, with the length of their series."""
    own = graded(spark, sf_dir)
    series = analysis._series(cut(facts(spark, sf_dir)))
    own = own.join(series.select("repo_id", F.struct(*series.columns[1:]).alias("series")), "repo_id").withColumn("dup_clones", F.lit(0))
    cards = own.select("repo_id", F.explode(analysis._cards(Thresholds())).alias("c"))
    get = lambda path, kind: F.try_variant_get("c", path, kind)
    return cards.select("repo_id", get("$.key", "string").alias("key"), F.round(get("$.value", "double"), 6).alias("value"), get("$.unit", "string").alias("unit"), get("$.state", "string").alias("state"), get("$.direction", "string").alias("direction"), F.round(get("$.delta", "double"), 6).alias("delta"), get("$.detail.warn", "double").alias("warn"), get("$.detail.crit", "double").alias("crit"), F.size(get("$.spark", "array<double>")).alias("points"))


@query(f"""with {FACTS}, x as (select repo_id, idx, committed_at, 100.0::double * (dup_lines::double / loc::double) as dup, case when functions > 0 then (decisions + functions)::double / functions else 0 end as cx, 100.0::double * (comment_lines::double / total_lines) as cm, case when functions > 0 then function_lines::double / functions else 0 end as fl, functions > 0 and total_lines > 0 as known from facts where loc is not null),
l as (select *, row_number() over (partition by repo_id order by idx desc) as r, row_number() over (partition by repo_id order by idx) as q from x), p as (select a.repo_id, a.dup, a.cx, a.cm, a.fl, b.known, b.dup as dup0, b.cx as cx0, b.cm as cm0, b.fl as fl0 from l a join l b on a.repo_id = b.repo_id and b.q = 1 where a.r = 1),
o as (select repo_id, 'duplicates' as key, dup as v, dup0 as b, 2 as digits, 'percent' as unit, known from p union all select repo_id, 'complexity', cx, cx0, 2, 'perFunction', known from p union all select repo_id, 'commentDensity', cm, cm0, 1, 'percent', known from p union all select repo_id, 'functionLength', fl, fl0, 1, 'lines', known from p)
select repo_id, key, round(floor(v * pow(10, digits) + 0.5) / pow(10, digits), 6) as value, unit, round(case when known and b <> 0 then floor(100.0 * (v - b) / b * 10.0 + 0.5) / 10.0 end, 6) as delta from o""")
def report_older_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four ungraded figures of the last commit with statistics, against the first one."""
    own = metrics.older(cut(facts(spark, sf_dir)).filter("loc is not null")).withColumn("dup_pct", 100.0 * X.ratio(F.col("dup_lines"), F.col("loc")))
    row = F.struct("dup_pct", "complexity", "comment_pct", "function_length", ((F.col("functions") > 0) & (F.col("total_lines") > 0)).alias("known"))
    both = own.groupBy("repo_id").agg(F.max_by(row, "idx").alias("now"), F.min_by(row, "idx").alias("first"))
    head = both.select("repo_id", "now.dup_pct", "now.complexity", "now.comment_pct", "now.function_length", F.when(F.col("first.known"), F.col("first").dropFields("known")).alias("then"))
    return head.select("repo_id", F.inline(analysis._older())).select("repo_id", "key", F.round("value", 6).alias("value"), "unit", F.round("delta", 6).alias("delta"))


# ---------------------------------------------------------------- replay from a cached prefix

_FOLD = """with l as (select l_orderkey, l_partkey % 40 as part, l_suppkey % 7 as file, l_linenumber as pos, l_returnflag <> 'R' as is_add from lineitem),
o as (select o_orderkey, o_custkey % 12 as repo_id, epoch_us(o_orderdate) // 1000 as ts, row_number() over (partition by o_custkey % 12 order by o_orderdate, o_orderkey) - 1 as idx from orders),
e as (select repo_id, idx, ts, file, part, pos, is_add from l join o on o_orderkey = l_orderkey),
c as (select *, sum(case when is_add then 1 else -1 end) over w as cs from e window w as (partition by repo_id, file, part order by idx, is_add::int, pos rows unbounded preceding)),
d as (select *, cs - least(0, min(cs) over (partition by repo_id, file, part order by idx, is_add::int, pos rows unbounded preceding)) as depth from c),
v as (select *, case when is_add then depth else lag(depth, 1, 0) over (partition by repo_id, file, part order by idx, is_add::int, pos) end as level from d),
m as (select *, lag(is_add) over x as p_add, lag(ts) over x as p_ts, lag(idx) over x as p_idx from v window x as (partition by repo_id, file, part, level order by idx, is_add::int, pos))
"""


def _replayed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(commits, changed lines) of twelve repositories: orders and their items."""
    at = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz))")
    place = Window.partitionBy("repo_id").orderBy("o_orderdate", "o_orderkey")
    commits = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 12).alias("repo_id"), at.alias("committed_at"), "o_orderdate")
    commits = commits.withColumn("idx", (F.row_number().over(place) - 1).cast("int")).select("o_orderkey", "repo_id", "idx", F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("sha"), "committed_at")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 40).alias("part"), (F.col("l_suppkey") % 7).alias("file"), F.col("l_linenumber").alias("pos"), (F.col("l_returnflag") != "R").alias("is_add"))
    return commits, items.join(commits.select(F.col("o_orderkey").alias("l_orderkey"), "repo_id", "idx", F.col("committed_at").alias("at")), "l_orderkey")


def _fold(events: DataFrame, opened: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((repo_id, idx, churn) of commits that churned, additions that are open at the end); ``opened``: those that an earlier run left."""
    keys, order = ["repo_id", "file", "part"], ["idx", "pos"]
    cols = [*keys, *order, "at", "is_add"]
    events = cut(events.select(*cols) if opened is None else events.select(*cols).unionByName(opened.select(*cols)))
    found = churn.churned(churn.matches(events, keys, order, carry=("idx",)))
    return found.groupBy("repo_id", F.col("add_idx").alias("idx")).agg(F.count("*").alias("churn")), churn.open_additions(events, keys, order)


@query(f"{_FOLD} select repo_id, p_idx::int as idx, count(*) as churn from m where not is_add and level > 0 and p_add and ts - p_ts <= 1209600000 group by repo_id, p_idx")
def replayed_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn of every commit, where an earlier run has seen two thirds of each history: its counts and its open additions are kept, and later commits alone are replayed."""
    commits, events = _replayed(spark, sf_dir)
    commits, events = cut(commits), cut(events)
    last = commits.groupBy("repo_id").agg(F.floor(F.max("idx") * 2 / 3).alias("seen"))
    before, opened = _fold(events.join(last, "repo_id").filter("idx < seen"))
    cached = cut(commits.join(last, "repo_id").filter("idx < seen").select("repo_id", "sha", "idx", F.lit(1).alias("loc")))
    floor = incremental.floors(commits, cached, commits.groupBy("repo_id").agg((F.max("committed_at") + 10**12).alias("previous_run_at")), commits.limit(0))
    # the state of the earlier run stands for everything before the first commit that it hasn't seen, which is never before the floor
    new = events.join(last, "repo_id").join(floor, "repo_id").filter("idx >= seen and idx >= floor")
    after, _ = _fold(new, cut(opened))
    return before.unionByName(after).groupBy("repo_id", "idx").agg(F.sum("churn").alias("churn"))
