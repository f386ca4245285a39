import json
import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from quarrylens import config
from quarrylens.config import Thresholds
from quarrylens.operators import changes, clones, graphs, grading, lines, mirrors
from quarrylens.plans import analysis, probes
from quarrylens.sources import git, sinks, store
from quarrylens.sources.window_index import WindowIndex

DAY = 86_400
NOW = 1_700_000_000


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


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    """Twenty commits that add, copy, rename and delete lines."""
    rng = random.Random(5)
    folder = str(tmp_path_factory.mktemp("history") / "r")
    os.makedirs(folder)
    subprocess.run(["git", "init", "-q", folder], check=True)
    files = {f"src/m{k}.py": [f"value_{k}_{n} = compute_{k}(argument_{n}, other_{n})" for n in range(25)] for k in range(4)}
    commit(folder, {p: "\n".join(t) + "\n" for p, t in files.items()}, "root", NOW - 200 * DAY)
    for c in range(1, 20):
        touched = {}
        path = rng.choice(sorted(files))
        text = files[path]
        kind = c % 4
        if kind == 0:
            new = f"src/n{c}.py"
            files[new] = files.pop(path)
            touched |= {path: None, new: files[new]}
        elif kind == 1:
            other = rng.choice(sorted(files))
            text[3:3] = files[other][2:12]
        elif kind == 2:
            del text[2 : 2 + rng.randrange(1, 8)]
        else:
            text[1:1] = [f"fresh_{c}_{n} = call_{c}(some_argument_{n})" for n in range(6)]
        if files.get(path) is text:
            touched[path] = text
        commit(folder, {p: None if t is None else "\n".join(t) + "\n" for p, t in touched.items()}, f"change {c}", NOW - 200 * DAY + c * 9 * DAY, *(("Bob", "bob@x.com") if c % 3 else ()))
    return folder


def plain(df, *drop):
    rows = [r.asDict(recursive=True) for r in df.drop(*drop).collect()]
    return sorted(json.dumps(r, sort_keys=True, default=str) for r in rows)


def test_incremental_run_has_the_figures_of_a_full_one(spark, repo, tmp_path):
    now = NOW * 1000
    old = subprocess.run(["git", "-C", repo, "rev-parse", "HEAD~3"], check=True, capture_output=True, text=True).stdout.strip()
    index = str(tmp_path / "index")  # kept between the runs: the second one adds the windows of new blobs
    before = analysis.analyse(git.tables(spark, [(1, repo, old)]), now - 27 * DAY * 1000, index=WindowIndex(spark, index, 4))
    first = WindowIndex(spark, index).rows().count()
    tables = git.tables(spark, [(1, repo, "")])
    full = analysis.analyse(tables, now)
    root = str(tmp_path / "store")
    repos = spark.createDataFrame([(1, "r", "https://h/r.git")], "repo_id int, name string, url string")
    chain = before.stats.select("repo_id", "sha")
    report = analysis.report(before, repos).withColumn("started_at", F.lit(now - 27 * DAY * 1000))
    store.persist(root, repos, chain, before.stats, before.clones, report)
    cached, previous = store.cached(spark, root)
    assert cached.count() == 17 and store.stored(spark, root).count() == 1
    seen = []
    part = analysis.analyse(tables, now, cached=cached, previous=previous, progress=lambda name, k, n: seen.append((name, k, n)), index=WindowIndex(spark, index))
    assert WindowIndex(spark, index).rows().count() > first > 0
    assert plain(part.stats) == plain(full.stats) and plain(part.grades) == plain(full.grades) and plain(part.authors) == plain(full.authors)
    assert [s[0] for s in seen] == ["read", "replay", "authors", "duplicates", "grades"]
    floor = analysis.incremental.floors(tables["commits"], cached, previous, analysis.sampling.sampled(tables["commits"], ["repo_id"])).first()["floor"]
    assert 0 < floor < 17
    store.persist(root, repos, tables["commits"], part.stats.filter(f"idx >= {floor}"), part.clones, report)
    assert store.cached(spark, root)[0].count() == 20
    store.persist(root, repos.limit(0), tables["commits"], part.stats, part.clones, report)
    assert store.stored(spark, root).count() == 0
    spark.sparkContext.setJobDescription("mine")
    with pytest.raises(analysis.Cancelled):
        analysis.analyse(tables, now, progress=lambda name, k, n: name != "authors")
    assert spark.sparkContext.getLocalProperty("spark.job.description") == "mine"
    spark.sparkContext.setJobDescription(None)


def test_repositories_have_their_own_globs_and_thresholds(spark, repo):
    repos = spark.createDataFrame([(1, "# none\nsrc/m?.py, **/zz*", '{"copyPasteWarn": 1.5, "windowDays": 30, "dupLevel": {"PYTHON": {"warn": 0.5, "crit": 0.9}}}')], "repo_id int, excludes string, thresholds string")
    tables = git.tables(spark, [(1, repo, "")])
    o = analysis.analyse(tables, NOW * 1000, repos=repos)
    head = o.head.first()
    assert head["files"] == len([p for p in os.listdir(os.path.join(repo, "src")) if p.startswith("n")]) > 0
    assert (head["t"]["copyPasteWarn"], head["t"]["copyPasteCrit"], head["t"]["windowDays"], head["level_warn"], head["level_crit"]) == (1.5, 15.0, 30, 0.5, 0.9)
    made = json.loads(analysis.report(o, spark.createDataFrame([(1, "r", "git@h:t/r.git")], "repo_id int, name string, url string")).first()["report"])
    cards = {k["key"]: k for k in made["kpis"]}
    assert list(cards) == ["copyPaste", "refactor", "churn", "duplication", "errorSwallow", "connectivity"]
    assert cards["copyPaste"]["detail"]["warn"] == 1.5 and cards["duplication"]["detail"]["levelCrit"] == 0.9 and len(cards["churn"]["spark"]) > 3
    assert [m["key"] for m in made["legacy"]] == ["duplicates", "complexity", "commentDensity", "functionLength"]
    commits = [a["commits"] for a in made["authors"]]
    assert commits == sorted(commits, reverse=True) and sum(commits) == 20


def test_thresholds_of_rows(spark):
    texts = [None, "not json", '{"churnCrit": 33}', '{"dupLevel": {"JAVA": {"warn": 0, "crit": 1}, "GO": {"warn": 2, "crit": 3}}}']
    repos = spark.createDataFrame(list(enumerate(texts)), "repo_id int, thresholds string")
    got = {r["repo_id"]: r["t"].asDict(recursive=True) for r in grading.with_thresholds(repos.select("repo_id"), repos, Thresholds()).collect()}
    for k, text in enumerate(texts):
        want = Thresholds.from_json(text)
        for name in ("copyPasteWarn", "churnCrit", "dupDeltaFloorLines", "windowDays", "connDeltaCrit"):
            assert got[k][name] == getattr(want, name)
        assert {lang: (b["warn"], b["crit"]) for lang, b in got[k]["dupLevel"].items()} == want.dupLevel


def test_own_globs(spark):
    from quarrylens.functions import text as X

    paths = ["a/b.py", "a.b/c.py", "x/y/z.py", "gen/a.py", "q/gen/a.py", "a+b(1).py", "axb(1).py"]
    for globs in ("", "gen/**", "**/gen/**", "a?b/*.py\n# note\n*/*/z.py , a+b(1).py", "**"):
        df = spark.createDataFrame([(p, globs) for p in paths], "p string, g string")
        got = {r["p"]: r["x"] for r in df.select("p", F.coalesce(F.rlike("p", X.globs_pattern(F.col("g"))), F.lit(False)).alias("x")).collect()}
        want = {r["p"]: r["x"] for r in df.select("p", X.is_excluded(F.col("p"), X.extra_globs(globs)).alias("x")).collect()}
        assert got == want


def test_changes_of_trees_agree_with_git(spark, repo):
    tables = git.tables(spark, [(1, repo, "")])
    row = lambda r: (r["idx"], r["old_path"], r["new_path"], r["old_blob"], r["new_blob"])
    known = {row(r) for r in tables["file_changes"].collect()}
    found = {row(r) for r in changes.tree_changes(tables["tree_files"]).collect()}
    assert found == known and any(o and n and o != n for _, o, n, _, _ in known)


def test_cohort_of_heads(spark, repo):
    tables = git.tables(spark, [(1, repo, ""), (2, repo, "HEAD~10")])
    got = {r["repo"]: r for r in probes.cohort(tables, spark.createDataFrame([(1, "one"), (2, "two"), (3, "gone")], "repo_id int, repo string")).collect()}
    full = analysis.analyse(git.tables(spark, [(1, repo, "")]), NOW * 1000)
    h = full.head.first()
    assert (got["one"]["files"], got["one"]["loc"], got["one"]["dupLines"], got["one"]["clones"]) == (h["files"], h["loc"], h["dup_lines"], h["dup_clones"]) and got["one"]["topExt"] == "py"
    assert got["gone"]["loc"] is None and got["gone"]["ratioPct"] is None and got["two"]["loc"] > 0
    found = probes.imports(full.stats.join(full.head.select("repo_id"), "repo_id")).collect()
    assert found[0]["idx"] == 0 and found[0]["added"] == 100
    assert probes.bundles(tables).count() == 0


def test_clones_and_remotes_on_disk(repo, tmp_path):
    root = tmp_path / "clones"
    at = git.sync(repo, str(root / "7"))
    assert git.stale(at, repo) is None and git.stale(at, repo + "/other") == "another remote" and git.stale(str(root / "8"), repo) == "unreadable"
    subprocess.run(["git", "-C", at, "config", "remote.origin.url", "https://tok@h.com/a.git"], check=True)
    assert git.stale(at, "https://h.com/a") == "secret"
    (root / "9").mkdir()
    os.symlink(repo, root / "10")
    assert git.sweep(str(root), {"7"}) == ["9"] and sorted(os.listdir(root)) == ["10", "7"]
    found = git.probe(repo)
    assert found["reachable"] and found["anonymous"] and not found["token_verified"] and found["branches"]
    assert git.probe(str(tmp_path / "nowhere"), "t")["error"] and git._public("ssh://git:pw@h/x") == "ssh://git@h/x" and git._public("https://u:p@h/x/y") == "https://h/x/y"


def test_repositories_and_jobs(spark, tmp_path):
    schema = "repo_id int, name string, url string, token string"
    path = str(tmp_path / "repos")
    repos = store.created(store.repositories(spark, path, schema), {"name": "a", "url": "https://h/a.git", "token": "t"})
    store.replace_table(repos, path)
    with pytest.raises(ValueError):
        store.created(store.repositories(spark, path, schema), {"url": "https://H/a/"})
    two = store.created(store.repositories(spark, path, schema), {"name": "b", "url": "https://h/b"})
    store.replace_table(two, path)
    changed, moved = store.updated(store.repositories(spark, path, schema), 2, {"url": "https://h/c", "token": "x"})
    assert moved and changed.filter("repo_id = 2").first()["token"] == "x"
    store.replace_table(store.deleted(changed, 1), path)
    assert [r["name"] for r in store.repositories(spark, path, schema).collect()] == ["b"]
    jobs = spark.createDataFrame([(1, "RUNNING", 0), (2, "OK", 0), (3, "QUEUED", 0)], "repo_id int, status string, at bigint")
    jobs = sinks.renewed(jobs, jobs.filter("repo_id < 3").select("repo_id"), F.lit(700_000))
    assert sorted((r["repo_id"], r["at"]) for r in jobs.collect()) == [(1, 700_000), (2, 0), (3, 0)]
    after = jobs.withColumn("status", sinks.released(F.col("status"), F.col("at"), F.lit(700_000)))
    assert sorted((r["repo_id"], r["status"]) for r in after.collect()) == [(1, "RUNNING"), (2, "OK"), (3, "FAILED")]
    assert sorted((r["repo_id"], r["status"]) for r in sinks.upserted(after, spark.createDataFrame([(3, "QUEUED", 9), (4, "QUEUED", 9)], jobs.schema)).collect()) == [(1, "RUNNING"), (2, "OK"), (3, "QUEUED"), (4, "QUEUED")]


def test_components(spark):
    rng = random.Random(1)
    links = [("t", f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(45)] + [("u", f"n{k:02}", f"n{k + 1:02}") for k in range(40)]
    got = {(r["g"], r["node"]): r["component"] for r in graphs.components(spark.createDataFrame(links, "g string, a string, b string"), ["g"]).collect()}
    up = {}
    for g, a, b in links:
        up.setdefault((g, a), a)
        up.setdefault((g, b), b)
    for _ in range(100):
        for g, a, b in links:
            up[g, a] = up[g, b] = min(up[g, a], up[g, b])
    assert got == up


def test_similar_files_and_sharing(spark):
    rng = random.Random(9)
    rows, base = [], [f"line {k}" for k in range(30)]
    for f in range(25):
        text = [t if rng.random() > 0.05 else f"other {rng.random()}" for t in base] if f < 12 else [f"own {f} {k}" for k in range(20)] + base[:6]
        rows += [(f % 2, f, k, t) for k, t in enumerate(text + ["same everywhere"] * 2)]
    df = spark.createDataFrame(rows, "tree int, f int, pos int, text string")
    from collections import Counter, defaultdict

    bags, of = defaultdict(Counter), {}
    for tree, f, _, t in rows:
        bags[f][t] += 1
        of[f] = tree
    want = {(of[a], a, b, sum((bags[a] & bags[b]).values())) for a in bags for b in bags if a < b and of[a] == of[b] and sum((bags[a] & bags[b]).values()) >= 0.9 * max(sum(bags[a].values()), sum(bags[b].values()))}
    assert {tuple(r) for r in mirrors.similar(df, ["tree"], "f").collect()} == want and want
    wins = {f: {tuple(t for _, g, _, t in rows if g == f)[k : k + 5] for k in range(sum(g == f for _, g, _, _ in rows) - 4)} for f in bags}
    near = {f: sorted(g for g in wins if g != f and wins[f] & wins[g]) for f in wins}
    got = {r["f"]: (r["partners"], r["first_partner"]) for r in clones.sharing(df.groupBy("f").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: F.struct(x["pos"].alias("line_no"), x["text"].alias("text"))).alias("norm")), "f", tokens=1).collect()}
    assert got == {f: (len(x), x[0]) for f, x in near.items() if x}


def test_first_norm_and_extension(spark):
    norm = spark.createDataFrame([(1, 0, 3), (1, 1, 7), (1, 2, 9)], "repo_id int, pos int, line_no int")
    asked = spark.createDataFrame([(1, 1), (1, 4), (1, 9), (1, 10)], "repo_id int, line int")
    assert sorted(((r["line"], r["pos"]) for r in lines.first_norm_at(norm, asked, ["repo_id"]).collect())) == [(1, 0), (4, 1), (9, 2), (10, None)]
    files = spark.createDataFrame([(1, "a/B.PY"), (1, "c.py"), (1, "d.java"), (1, "e.java"), (2, "Makefile")], "repo_id int, path string")
    assert sorted(tuple(r) for r in lines.dominant_extension(files, ["repo_id"]).select("repo_id", "extension", "files").collect()) == [(1, "java", 2), (2, "", 1)]


def test_secrets(spark):
    from quarrylens.functions import text as X

    urls = {"https://u:p@h/x": ("https://h/x", "u", "p"), "https://tok@h/x": ("https://h/x", None, "tok"), "ssh://git@h/x": ("ssh://git@h/x", "git", None), "ssh://git:pw@h/x": ("ssh://git@h/x", "git", "pw"), "git@h:x/y": ("git@h:x/y", None, None), "https://h/x": ("https://h/x", None, None)}
    got = {r["u"]: tuple(r["p"]) for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", X.remote_parts(F.col("u")).alias("p")).collect()}
    assert got == urls
    key, other = F.lit(b"0123456789abcdef"), F.lit(b"fedcba9876543210")
    r = spark.range(1).select(X.sealed(F.lit("secret"), key).alias("s")).select("s", X.opened(F.col("s"), key).alias("a"), X.opened(F.col("s"), other).alias("b")).first()
    assert r["a"] == "secret" and r["b"] is None and "secret" not in r["s"]


def test_a_window_of_all_files_is_a_bit_for_each(spark, monkeypatch):
    n = 2_000
    text = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.struct(k.cast("int").alias("line_no"), F.when(k < 5, F.format_string("header line number %d", k)).otherwise(F.format_string("own %d %d", "id", k)).alias("text")))
    files = spark.range(n).select(F.col("id").alias("f"), text.alias("norm")).unionByName(spark.range(3).select((F.col("id") + n).alias("f"), F.slice(text, 6, 2).alias("norm")))
    seen, cut = [], clones.cut
    monkeypatch.setattr(clones, "cut", lambda df: (out := cut(df), seen.append(out.count()))[0])
    got = clones.sharing(files, "f", tokens=1)
    assert got.groupBy("partners", "first_partner").count().orderBy("count").collect() == [(n - 1, 1, 1), (n - 1, 0, n - 1)]
    assert max(seen) <= n
