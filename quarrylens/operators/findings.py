"""Findings and caveats of a report, and their texts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens import config
from quarrylens.config import CRIT, GOOD, UNKNOWN, WARN, Thresholds
from quarrylens.functions import text as X


def _row(source: DataFrame, severity: Column | str, code: Column | str, params: dict[str, Column], evidence: Column | str = "") -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return source.select("repo_id", lit(severity).alias("severity"), lit(code).alias("code"), F.to_json(F.struct(*[v.alias(k) for k, v in params.items()])).alias("params"), F.coalesce(lit(evidence), F.lit("")).alias("evidence"))


def findings(a: DataFrame, bundles: DataFrame, clones: DataFrame, suspects: DataFrame, spikes: DataFrame, t: Thresholds) -> DataFrame:
    """(repo_id, severity, code, params, evidence): a row for each finding; params are JSON. ``a``: graded aggregates, ``clones``: as shown."""
    c = F.col
    n = bundles.groupBy("repo_id").agg((F.count("*") - 1).alias("others"))
    out = [_row(bundles.filter("rank = 1").join(n, "repo_id"), WARN, "bundleFile", {"file": c("path"), "dupLines": c("dup_lines"), "fileLines": c("norm_lines"), "partners": c("partners"), "others": c("others"), "examples": F.array_join("examples", ", ")}, c("path"))]
    cross = clones.filter("file_a <> file_b").groupBy("repo_id").agg(F.count("*").alias("count"), F.min_by(F.struct("file_a", "line_a", "file_b", "line_b", "lines"), "rank").alias("f")).select("repo_id", "count", "f.*")
    place = F.format_string("%s:%d <-> %s:%d", "file_a", "line_a", "file_b", "line_b")
    out.append(_row(cross, F.when(c("count") >= 3, CRIT).otherwise(WARN), "crossFileClone", {"fileA": c("file_a"), "lineA": c("line_a"), "fileB": c("file_b"), "lineB": c("line_b"), "lines": c("lines"), "count": c("count")}, place))
    share = 100.0 * X.ratio(c("hottest.dup_lines"), c("dup_lines"))
    out.append(_row(a.filter((c("dup_lines") > 0) & (share >= 40)), F.when(share >= 60, WARN).otherwise(GOOD), "cloneConcentration", {"file": c("hottest.path"), "lines": c("hottest.dup_lines"), "share": X.half_up(share, 0), "total": c("dup_lines")}, c("hottest.path")))
    out.append(_row(a, c("state_err"), "errorHandling", {k: c(k) for k in ("bare", "broad", "swallow", "suppress")} | {"density": X.half_up(c("err_density"), 2)}))
    out.append(_row(a.filter((c("state_conn") != UNKNOWN) & (c("reference_days") >= 1)), c("state_conn"), "connectivityDrift", {"from": X.half_up(c("conn_then"), 1), "to": X.half_up(c("conn_density"), 1), "delta": X.half_up(c("conn_delta_pct"), 1), "windowDays": c("reference_days")}))
    clash = c("raw_identities") > c("authors")
    bus = {"busFactor": c("bus_factor"), "authors": c("authors"), "identities": c("raw_identities"), "topName": F.coalesce(c("top.name"), F.lit("")), "topCommits": c("top.commits"), "collision": clash}
    out.append(_row(a, F.when(c("bus_factor") <= 1, CRIT).when(clash, WARN).otherwise(GOOD), F.when(clash, "busFactor").otherwise("busFactorClean"), bus))
    pairs = suspects.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("rank", "name_a", "name_b"))).alias("p"))
    named = F.array_join(F.transform("p", lambda x: F.concat(x["name_a"], F.lit(" <-> "), x["name_b"])), " · ")
    out.append(_row(pairs, WARN, "identitySuspects", {"nameA": c("p")[0]["name_a"], "nameB": c("p")[0]["name_b"], "pairs": F.size("p")}, named))
    s = spikes.select("repo_id", "sha", "subject", "pct", F.col("added").alias("s_added"), F.col("churn").alias("s_churn"), F.col("committed_at").alias("s_at")).join(a.select("repo_id", "churn_pct", *(["t"] if "t" in a.columns else [])), "repo_id").filter((c("pct") >= t.churnWarn) & (c("pct") >= 2 * c("churn_pct")))
    spike = {"sha": X.short_sha(c("sha")), "fullSha": c("sha"), "subject": c("subject"), "pct": X.half_up(c("pct"), 1), "added": c("s_added"), "churn": c("s_churn"), "at": c("s_at"), "average": X.half_up(c("churn_pct"), 1)}
    out.append(_row(s, F.when(c("pct") >= t.churnCrit, CRIT).otherwise(WARN), "churnSpike", spike, X.short_sha(c("sha"))))
    out.append(_row(a.filter(c("state_copy").isin(WARN, CRIT)), c("state_copy"), "copyPasteHigh", {"pct": X.half_up(c("copy_pct"), 1), "lines": c("copied"), "added": c("added"), "refactorPct": X.half_up(c("refactor_pct"), 1)}))
    whole = out[0]
    for d in out[1:]:
        whole = whole.unionByName(d)
    return whole


def caveats(a: DataFrame, mirrors: DataFrame, truncated: DataFrame) -> DataFrame:
    """(repo_id, code, params): what a reader should know about the figures."""
    c = F.col
    none = F.lit(None).cast("string")
    m = mirrors.groupBy("repo_id").agg(F.count("*").alias("trees"), F.sum("dropped_lines").alias("lines"), F.array_sort(F.collect_list(F.struct((-c("dropped_lines")).alias("d"), "original", "mirror"))).alias("m")).join(a.select("repo_id", "dup_measured_lines"), "repo_id")
    names = F.array_join(F.transform("m", lambda x: F.concat(x["mirror"], F.lit(" (= "), x["original"], F.lit(")"))), ", ")
    out = [_row(m, GOOD, "mirrorTrees", {"trees": c("trees"), "lines": c("lines"), "names": names, "measured": c("dup_measured_lines")})]
    out.append(_row(a.join(truncated.filter("truncated"), "repo_id"), GOOD, "historyTruncated", {"commits": F.lit(config.MAX_COMMITS), "oldest": c("first_at")}))
    out.append(_row(a, GOOD, "rightCensoring", {"commits": c("censored_commits"), "days": F.lit(14)}))
    out.append(_row(a, GOOD, "importExcluded", {"commits": c("import_commits"), "lines": c("imported_lines")}))
    out.append(_row(a, GOOD, "sampleSize", {"commits": c("commits"), "days": F.greatest(F.lit(1), F.floor((c("committed_at") - c("first_at")) / config.DAY_MS)), "authors": c("authors")}))
    out += [_row(a, GOOD, code, {"_": none}) for code in ("approximation", "aiAttribution", "firstParent")]
    whole = out[0]
    for d in out[1:]:
        whole = whole.unionByName(d)
    return whole.select("repo_id", "code", "params")


#: (title, body) by code and language; parameters by name
MESSAGES = {
    "en": {
        "bundleFile": ("A file looks like a bundle of others", "{file}: {dupLines} of {fileLines} lines are found in {partners} other files ({examples}); {others} more files look alike."),
        "crossFileClone": ("A block is repeated across files", "{lines} lines of {fileA}:{lineA} are also at {fileB}:{lineB}; {count} such blocks."),
        "cloneConcentration": ("Duplication sits in one file", "{file} holds {lines} of {total} duplicated lines ({share} %)."),
        "errorHandling": ("Handlers that hide errors", "{bare} bare, {broad} broad, {swallow} swallowing, {suppress} suppressing: {density} per thousand lines."),
        "connectivityDrift": ("Calls per thousand lines have moved", "From {from} to {to} ({delta} %) in {windowDays} days."),
        "busFactor": ("Few people, several identities", "{busFactor} of {authors} people made half of the commits; {identities} identities; {topName} made {topCommits}."),
        "busFactorClean": ("How many people know the code", "{busFactor} of {authors} people made half of the commits; {topName} made {topCommits}."),
        "identitySuspects": ("Two authors may be one", "{nameA} and {nameB}; {pairs} such pairs."),
        "churnSpike": ("A commit was soon rewritten", "{sha} ({subject}): {churn} of {added} lines ({pct} %) went within two weeks; the average is {average} %."),
        "copyPasteHigh": ("Much of what is added is copied", "{lines} of {added} lines ({pct} %) are copies; {refactorPct} % of reused lines were moved."),
        "mirrorTrees": ("Mirrored folders are left out", "{trees} folders with {lines} lines: {names}. {measured} lines are measured."),
        "historyTruncated": ("The history is cut", "The newest {commits} commits are read."),
        "rightCensoring": ("The latest churn isn't known yet", "{commits} commits are younger than {days} days."),
        "importExcluded": ("Imports don't count", "{commits} commits with {lines} lines bring in code wholesale."),
        "sampleSize": ("How much was read", "{commits} commits in {days} days by {authors} people."),
        "approximation": ("Scanners read lines", "Handlers and calls are found by patterns, not by a parser."),
        "aiAttribution": ("Authorship by tools isn't measured", "The figures don't tell who or what wrote a line."),
        "firstParent": ("One line of history", "Merged branches count through their merges."),
    },
    "ko": {
        "bundleFile": ("다른 파일을 묶은 것으로 보이는 파일", "{file}: {fileLines}줄 중 {dupLines}줄이 다른 파일 {partners}개에 있습니다({examples}). 비슷한 파일 {others}개."),
        "crossFileClone": ("여러 파일에 반복되는 블록", "{fileA}:{lineA}의 {lines}줄이 {fileB}:{lineB}에도 있습니다. 모두 {count}개."),
        "cloneConcentration": ("중복이 한 파일에 몰려 있음", "{file}에 중복 {total}줄 중 {lines}줄({share} %)이 있습니다."),
        "errorHandling": ("오류를 숨기는 처리기", "무조건 {bare}, 넓은 {broad}, 삼킴 {swallow}, 억제 {suppress}: 천 줄당 {density}."),
        "connectivityDrift": ("천 줄당 호출 수의 변화", "{windowDays}일 동안 {from}에서 {to}로({delta} %)."),
        "busFactor": ("적은 인원, 여러 신원", "{authors}명 중 {busFactor}명이 커밋의 절반을 했습니다. 신원 {identities}개, {topName} {topCommits}개."),
        "busFactorClean": ("코드를 아는 사람 수", "{authors}명 중 {busFactor}명이 커밋의 절반을 했습니다. {topName} {topCommits}개."),
        "identitySuspects": ("같은 사람일 수 있는 작성자", "{nameA}, {nameB}. 모두 {pairs}쌍."),
        "churnSpike": ("곧 다시 쓰인 커밋", "{sha} ({subject}): {added}줄 중 {churn}줄({pct} %)이 2주 안에 사라졌습니다. 평균 {average} %."),
        "copyPasteHigh": ("추가된 코드 중 복사가 많음", "{added}줄 중 {lines}줄({pct} %)이 복사본입니다. 재사용 중 {refactorPct} %가 이동입니다."),
        "mirrorTrees": ("거울 폴더 제외", "폴더 {trees}개, {lines}줄: {names}. 측정 {measured}줄."),
        "historyTruncated": ("이력이 잘림", "최근 커밋 {commits}개만 읽습니다."),
        "rightCensoring": ("최근 변동은 아직 모름", "{days}일이 지나지 않은 커밋 {commits}개."),
        "importExcluded": ("일괄 반입 제외", "커밋 {commits}개, {lines}줄."),
        "sampleSize": ("읽은 양", "{days}일 동안 {authors}명의 커밋 {commits}개."),
        "approximation": ("줄 단위 검사", "처리기와 호출은 구문 분석이 아닌 패턴으로 찾습니다."),
        "aiAttribution": ("도구의 기여는 측정하지 않음", "누가 썼는지는 알 수 없습니다."),
        "firstParent": ("한 갈래 이력", "병합된 가지는 병합 커밋으로만 셉니다."),
    },
}


def localised(code: str, params: str, language: str) -> tuple[str, str]:
    """(title, body) of a finding or caveat; an unknown code is an error."""
    title, body = MESSAGES[language][code]
    given = json.loads(params or "{}")
    return title, body.format(**given)


def texts(rows: DataFrame, language: str) -> DataFrame:
    """``rows`` (code, params as JSON, …) with their title and body in a language; null for a code that the language doesn't have.

    The messages are one map, as there are as many as codes; a placeholder is replaced by the parameter of its name.
    """
    entries = [x for code, (title, body) in MESSAGES[language].items() for x in (F.lit(code), F.struct(F.lit(title).alias("title"), F.lit(body).alias("body")))]
    given = F.map_entries(F.coalesce(F.from_json("params", "map<string,string>"), F.expr("cast(map() as map<string,string>)")))
    put = rows.withColumn("_m", F.try_element_at(F.create_map(*entries), F.col("code")))
    body = F.aggregate(given, F.col("_m.body"), lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))
    return put.withColumns({"title": F.col("_m.title"), "body": body}).drop("_m")
