import os
import random
import re
import subprocess
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarrylens import config
from quarrylens.config import Thresholds
from quarrylens.functions import text as X
from quarrylens.operators import access, changes, churn, clones, findings, grading, identities, incremental, metrics, mirrors, sampling
from quarrylens.sources import git, sinks


def test_churn_is_a_stack(spark):
    rng = random.Random(1)
    rows, want = [], Counter()
    for key in range(40):
        stack, at = [], 0
        for k in range(30):
            at += rng.choice([0, 0, 3, 5]) * config.DAY_MS
            is_add = rng.random() < 0.5
            rows.append((key, k, at, is_add))
            if is_add:
                stack.append((k, at))
            elif stack:
                began, since = stack.pop()
                if at - since <= config.CHURN_WINDOW_MS:
                    want[(key, began, k)] += 1
    df = spark.createDataFrame(rows, "key int, idx int, at bigint, is_add boolean")
    got = churn.churned(churn.matches(df, ["key"], ["idx"], carry=("idx",)))
    assert Counter((r["key"], r["add_idx"], r["del_idx"]) for r in got.collect()) == want and want


def test_lineages_follow_all_earlier_renames(spark):
    renames = [(1, 5, "a", "b"), (1, 9, "x", "a"), (2, 1, "a", "b"), (2, 2, "b", "a"), (2, 3, "a", "b")] + [(3, k, f"n{k - 1}", f"n{k}") for k in range(1, 71)]
    paths = [(1, "a", 0), (1, "x", 6), (2, "a", 0), (3, "n0", 0)]
    got = churn.lineages(spark.createDataFrame(renames, "repo_id int, idx int, old_path string, new_path string"), spark.createDataFrame(paths, "repo_id int, path string, idx int"))
    got = {(r["repo_id"], r["path"], r["idx_from"]): r["lineage"] for r in got.collect()}
    assert len(got) == len(renames) + len(paths)
    assert got[1, "b", 5] == "a" and got[1, "a", 9] == "x" and got[2, "b", 3] == "a" and got[2, "a", 2] == "a"
    assert {v for k, v in got.items() if k[0] == 3} == {"n0"}


def test_future_dates_do_not_move_the_watermark(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 1, 10_000), (1, 2, 7), (1, 3, 20)], "repo int, idx int, committed_at bigint")
    assert [r["watermark"] for r in churn.watermark(df, F.lit(100), ["repo"]).orderBy("idx").collect()] == [10, 10, 10, 20]


def brute_mix(added, parent):
    """Greedy classification of one run of added lines against files (path -> [(line, gone)])."""
    i = copied = moved = 0
    while i < len(added):
        best = None
        for path in sorted(parent):
            text = parent[path]
            for j in range(len(text)):
                n = 0
                while i + n < len(added) and j + n < len(text) and added[i + n] == text[j + n][0]:
                    n += 1
                if n >= 3 and (best is None or n > best[0]):
                    best = (n, all(g for _, g in text[j : j + n]))
        if best is None:
            i += 1
            continue
        moved, copied = (moved + best[0], copied) if best[1] else (moved, copied + best[0])
        i += best[0]
    return copied, moved


def test_line_mix_is_the_greedy_longest_match(spark):
    rng = random.Random(4)
    added, parent, want = [], [], {}
    for idx in range(30):
        own = [rng.choice("abcd") for _ in range(14)]
        tree = {f"p{k}": [(rng.choice("abcd"), rng.random() < 0.6) for _ in range(12)] for k in range(3)}
        added += [(1, idx, "new", 0, k, t) for k, t in enumerate(own)]
        parent += [(1, idx, p, k, t, g) for p, ls in tree.items() for k, (t, g) in enumerate(ls)]
        want[idx] = brute_mix(own, tree)
    a = spark.createDataFrame(added, "repo_id int, idx int, path string, edit int, pos int, text string")
    p = spark.createDataFrame(parent, "repo_id int, idx int, src string, pos int, text string, gone boolean")
    none = spark.createDataFrame([], "repo_id int, idx int, lines int")
    got = {r["idx"]: (r["copied"], r["moved"]) for r in changes.line_mix(a, p, none).collect()}
    assert got == want and any(c for c, _ in want.values()) and any(m for _, m in want.values())


def mirror_tree(spark, other):
    rows = [(1, f"{root}/pkg/F{k}.java", 30, 30) for root in ("guava", other) for k in range(40)]
    text = [(1, p, f"line {k} of {p.rsplit('/', 1)[1]}") for _, p, _, _ in rows for k in range(30)]
    return spark.createDataFrame(rows, "repo_id int, path string, code_lines int, norm_lines int"), spark.createDataFrame(text, "repo_id int, path string, text string")


def test_mirrors(spark):
    files, text = mirror_tree(spark, "android/guava")
    got = mirrors.detect(files, text).collect()
    assert [(r["original"], r["mirror"], r["shared_paths"], r["dropped_lines"], r["identical_share"]) for r in got] == [("guava", "android/guava", 40, 1200, 1.0)]
    different = text.withColumn("text", F.when(F.col("path").startswith("guava"), F.concat(F.lit("x"), "text")).otherwise(F.col("text")))
    assert mirrors.detect(files, different).count() == 0
    assert mirrors.detect(files.filter("path like '%F1%'"), text).count() == 0


def test_identities(spark):
    commits = spark.createDataFrame([(1, 0, "Ann", "A@x.com", 5), (1, 1, "Ann Lee", "7+ann@users.noreply.github.com", 1), (1, 2, "Ann", "a@x.com", 2), (1, 3, "Bob", "", 1), (1, 4, "ann", "other@y.com", 9)], "repo_id int, idx int, author_name string, author_email string, added int")
    mails = identities.mailmap(spark.createDataFrame([(1, "# c\nAnn Lee <a@x.com> <9+ann@users.noreply.github.com>\nBobby <bob@z.com>\nnonsense")], "repo_id int, content string"))
    keyed = identities.keyed(commits, mails)
    people = {r["author_key"]: r for r in identities.rollup(keyed, ["repo_id"]).collect()}
    assert set(people) == {"a@x.com", "name:bob", "other@y.com"} and people["a@x.com"]["commits"] == 3 and people["a@x.com"]["name"] == "Ann Lee" and people["a@x.com"]["added_lines"] == 8
    assert identities.raw_identities(commits, ["repo_id"]).first()["raw_identities"] == 5
    authors = spark.createDataFrame([(1, "a", "Ann", "a@x", 2, 1, ["a"]), (1, "b", "A.N.N", "b@x", 5, 1, ["b"]), (1, "c", "--", "c@x", 1, 1, ["c"]), (1, "d", "!!", "d@x", 1, 1, ["d"]), (1, "e", "Annabel", "anna@x", 1, 1, ["e"])], "repo_id int, author_key string, name string, email string, commits int, added_lines int, identities array<string>")
    merged = {r["author_key"]: r["commits"] for r in identities.merged(authors, ["repo_id"]).collect()}
    assert merged == {"b": 7, "c": 1, "d": 1, "e": 1} and identities.bus_factor(authors, ["repo_id"]).first()["bus_factor"] == 1
    assert [(r["key_a"], r["key_b"]) for r in identities.suspects(authors, ["repo_id"]).collect()] == [("a", "b")]


def test_sampling_and_reference(spark):
    day = config.DAY_MS
    rows = [(1, k, at * day, 1 if k % 2 else None) for k, at in enumerate([0, 0, 1, 0, 2, 2, 3])]
    df = spark.createDataFrame(rows, "repo_id int, idx int, committed_at bigint, loc int")
    assert [r["idx"] for r in sampling.day_firsts(df, ["repo_id"]).orderBy("idx").collect()] == [0, 2, 3, 4, 6]
    assert [r["idx"] for r in sampling.sampled(df, ["repo_id"], target=2).orderBy("idx").collect()] == [0, 4, 6]
    ref = lambda days: sampling.window_reference(df, ["repo_id"], days, is_sampled=F.col("loc").isNotNull()).first()["ref"]
    assert (ref(1), ref(3), ref(0)) == (5, 1, 1)


def test_chain(spark):
    commits = spark.createDataFrame([(1, f"c{k}", f"c{k - 1}" if k else None) for k in range(23)] + [(1, "side", "c3")], "repo_id int, sha string, parent_sha string")
    head = spark.createDataFrame([(1, "c20")], "repo_id int, sha string")
    got = sorted((r["idx"], r["sha"], r["truncated"]) for r in sampling.chain(commits, head).collect())
    assert got == [(k, f"c{k}", False) for k in range(21)]
    assert [r["sha"] for r in sampling.chain(commits, head, 4).orderBy("idx").collect()] == ["c17", "c18", "c19", "c20"]


def test_leave_one_out_and_percentiles(spark):
    import numpy as np

    rng = random.Random(3)
    v = [rng.random() * 20 for _ in range(17)]
    df = spark.createDataFrame([(1, f"r{k:02}", x) for k, x in enumerate(v)], "g int, repo string, x double")
    got = {r["p"]: (r["shift"], r["culprit"]) for r in metrics.leave_one_out(df, "repo", "x", ["g"]).collect()}
    for p, (shift, culprit) in got.items():
        each = [abs(np.quantile(np.delete(v, k), p) - np.quantile(v, p)) for k in range(len(v))]
        assert shift == pytest.approx(max(each)) and each[int(culprit[1:])] == pytest.approx(max(each))
    assert {round(r["p"], 2): r["value"] for r in metrics.percentiles(df, "x", ["g"]).collect()}[0.9] == pytest.approx(np.quantile(v, 0.9))


def test_imports(spark):
    cases = [(True, 1, 0, 0), (False, 250, 0, 300), (False, 250, 200, 300), (False, 600, 0, 0), (False, 2100, 0, 300), (False, 700, 0, 1200), (False, 700, 0, 300), (False, 200, 0, 0)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, root boolean, added int, moved int, parent int")
    assert [r["x"] for r in df.orderBy("k").select(changes.is_import(F.col("root"), F.col("added"), F.col("moved"), F.col("parent")).alias("x")).collect()] == [True, False, False, True, True, True, False, False]


def test_grades(spark):
    row = dict(repo_id=1, dominant_language="JAVA", added=100, copied=20, moved=0, copy_pct=20.0, refactor_pct=0.0, churn_added=0, churn_pct=0.0, dup_pct=7.0, dup_delta_lines=60, dup_delta_pct=30.0, err_density=0.5, conn_delta_pct=None, bus_factor=2)
    kinds = "repo_id int, dominant_language string, added int, copied int, moved int, copy_pct double, refactor_pct double, churn_added int, churn_pct double, dup_pct double, dup_delta_lines int, dup_delta_pct double, err_density double, conn_delta_pct double, bus_factor int"
    s = grading.states(spark.createDataFrame([tuple(row.values())], kinds), Thresholds())
    r = s.first()
    assert (r["state_copy"], r["state_refactor"], r["state_churn"], r["state_level"], r["direction"], r["state_dup_delta"], r["state_conn"]) == ("crit", "crit", "unknown", "warn", "worsening", "warn", "unknown")
    g = {r["grade"]: (r["state"], r["axis"], r["reason"]) for r in grading.grades(s, ["repo_id"], Thresholds()).collect()}
    assert g["duplication"][:2] == ("crit", "copyPaste") and g["duplication"][2]["limit"] == 15.0 and g["maintainability"][:2] == ("good", "errorSwallow") and g["maintainability"][2] is None and g["changeSafety"][:2] == ("warn", "busFactor")


def test_access(spark):
    repos = spark.createDataFrame([(1, "Alpha", "https://h/team/alpha.git", ["A"]), (2, "beta", "git@h:other/alpha", []), (3, "gamma", "https://h/x/gamma", ["B", "A"])], "repo_id int, name string, url string, space_keys array<string>")
    spaces = spark.createDataFrame([("u", "A"), ("v", "B"), ("u", "B")], "user string, space_key string")
    assert sorted((r["user"], r["repo_id"]) for r in access.visible(repos, spaces).collect()) == [("u", 1), ("u", 3), ("v", 3)]
    pick = lambda text: spark.createDataFrame([(text,)], "selection string")
    assert {r["repo_id"] for r in access.matched(repos, pick("team/alpha, https://H/x/gamma.git, nothing, gam")).collect()} == {1, 3}
    assert access.matched(repos, pick("")).count() == 0 and {r["ref"] for r in access.unresolved(repos, pick("alpha,gam")).collect()} == {"gam"}
    assert [r["derived"] for r in access.named(repos).orderBy("repo_id").collect()] == ["team/alpha", "other/alpha", "gamma"]


def test_messages_cover_every_code():
    codes = {*config.FINDING_PRIORITY, "busFactorClean", "mirrorTrees", "historyTruncated", "rightCensoring", "importExcluded", "sampleSize", "approximation", "aiAttribution", "firstParent"}
    assert set(findings.MESSAGES["en"]) == set(findings.MESSAGES["ko"]) == codes
    params = defaultdict(lambda: "7")
    for language in findings.MESSAGES:
        for title, body in findings.MESSAGES[language].values():
            assert title and "{" not in body.format_map(params)
    with pytest.raises(KeyError):
        findings.localised("unheardOf", "{}", "en")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "repo_id int, sha string, added int")
    path = str(tmp_path / "m")
    sinks.write_metrics(rows, path)
    sinks.write_metrics(spark.createDataFrame([(1, "d", 9)], rows.schema), path)
    assert sorted((r["repo_id"], r["sha"]) for r in sinks.read_metrics(spark, path).collect()) == [(1, "d"), (2, "c")]
    assert sinks.updated_repo({"url": "https://H/a.git", "token": "t"}, {"url": "https://h/a", "token": None}) == ({"url": "https://h/a", "token": "t"}, False)
    assert sinks.updated_repo({"url": "https://h/a", "token": "t"}, {"url": "https://h/b", "token": ""}) == ({"url": "https://h/b", "token": None}, True)
    assert "<\\/script>" in sinks.page('{"a": "</script>"}', "t")


def test_probe_errors(spark):
    kinds = {
        "Authentication failed": "notAuthorized", "https://h/x.git: git-upload-pack not permitted on 'x'": "notAuthorized", "access to this repository was not granted": "notAuthorized", "The requested URL returned error: 403": "notAuthorized",
        "could not read Username for 'https://h': terminal prompts disabled": "notAuthorized", "'/x' does not appear to be a git repository": "notGitRepository", "not a git repository": "notGitRepository", "repository 'x' not found": "notFound", "error: 404": "notFound",
        "operation timed out": "timeout", "Could not resolve host: auth.example.com": "unreachable", "Connection refused by author.example.org": "unreachable", "port 14031 refused": "unreachable", "odd": "unreachable", None: "unreachable",
    }
    assert {m: git.error_kind(m) for m in kinds} == kinds
    assert {r["m"]: r["k"] for r in spark.createDataFrame([(m,) for m in kinds], "m string").select("m", X.probe_error(F.col("m")).alias("k")).collect()} == kinds


def commit(repo, files, message, at, name="Ann", mail="ann@x.com"):
    for path, text in files.items():
        p = os.path.join(repo, path)
        if text is None:
            os.remove(p)
            continue
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as f:
            f.write(text)
    env = os.environ | {"GIT_AUTHOR_NAME": name, "GIT_AUTHOR_EMAIL": mail, "GIT_COMMITTER_NAME": name, "GIT_COMMITTER_EMAIL": mail, "GIT_AUTHOR_DATE": f"{at} +0000", "GIT_COMMITTER_DATE": f"{at} +0000"}
    subprocess.run(["git", "-C", repo, "add", "-A"], check=True, env=env)
    subprocess.run(["git", "-C", repo, "commit", "-qm", message], check=True, env=env)


def body(seed, n):
    return "".join(f"value_{seed}_{k} = compute_{seed}(argument_{k}, other_{k} + {k})\n" for k in range(n))


def test_analysis_of_a_history(spark, tmp_path):
    from quarrylens.plans import analysis

    repo = str(tmp_path / "r")
    os.makedirs(repo)
    subprocess.run(["git", "init", "-q", repo], check=True)
    now, day = 1_700_000_000, 86_400
    commit(repo, {"src/a.py": body("a", 12)}, "root", now - 60 * day)
    commit(repo, {"src/b.py": body("b", 8) + body("a", 12)}, "copies a", now - 50 * day, "Bob", "bob@x.com")
    commit(repo, {"src/b.py": body("b", 7) + body("a", 12)}, "drops a line of b", now - 45 * day)
    commit(repo, {"src/a.py": None, "src/c.py": body("a", 12) + body("c", 30)}, "moves a", now - 30 * day)
    commit(repo, {"src/d.py": body("d", 5) + "try:\n    go_on_with_it()\nexcept Exception:\n    pass\n"}, "fresh", now - 2 * day)
    o = analysis.analyse(git.tables(spark, [(1, repo, "")]), now * 1000)
    s = {r["idx"]: r for r in o.stats.collect()}
    assert [s[k]["import_commit"] for k in range(5)] == [True, False, False, False, False]
    assert (s[1]["added"], s[1]["copied"], s[1]["novel"], s[1]["churn"]) == (20, 12, 8, 1)
    assert (s[2]["added"], s[2]["deleted"]) == (0, 1) and s[4]["churn_censored"] and not s[3]["churn_censored"]
    assert s[3]["copied"] + s[3]["moved"] in (0, 12) and s[0]["loc"] == 12
    h = o.head.first()
    assert h["dup_lines"] == 24 and h["swallow"] == 1 and h["authors"] == 2 and h["dominant_language"] == "PYTHON"
    codes = {r["code"] for r in o.findings.collect()}
    assert "crossFileClone" in codes and {r["code"] for r in o.caveats.collect()} >= {"rightCensoring", "importExcluded", "firstParent"}
    import json

    made = json.loads(analysis.report(o, spark.createDataFrame([(1, "r", "git@h:t/r.git")], "repo_id int, name string, url string")).first()["report"])
    assert made["repo"]["browse"] == "https://h/t/r" and len(made["kpis"]) == 6 and len(made["series"]) == 5


def test_replay_floor(spark):
    day = config.DAY_MS
    c = spark.createDataFrame([(1, k, f"s{k}", k * 4 * day) for k in range(12)], "repo_id int, idx int, sha string, committed_at bigint")
    cached = c.filter("idx < 11").withColumn("loc", F.lit(1))
    previous = spark.createDataFrame([(1, 42 * day)], "repo_id int, previous_run_at bigint")
    floor = lambda *a: incremental.floors(*a).first()["floor"]
    assert floor(c, cached, previous, c.limit(0)) == 4 and floor(c, cached.limit(0), previous, c.limit(0)) == 0
    assert floor(c, cached.withColumn("loc", F.when(F.col("idx") != 2, 1)), previous, c.filter("idx in (2, 8)")) == 2
