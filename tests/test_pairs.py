import random

from pyspark.sql import functions as F

from quarrylens.operators import identities, mirrors

AUTHORS = "repo_id int, author_key string, name string, email string, commits int, added_lines int, identities array<string>"


def test_mirrors_are_accepted_in_order(spark):
    """Random pairs of nested folders against the walk over them."""
    rng = random.Random(4)
    folders = ["/".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    rows, want = [], []
    for repo in range(5):
        pairs = {tuple(sorted(rng.sample(folders, 2))) for _ in range(40)}
        pairs = sorted((a, b, rng.choice([a, b])) for a, b in pairs if a != b)
        rows += [(repo, *p) for p in pairs]
        gone = []
        nested = lambda x, y: x == y or x.startswith(y + "/") or y.startswith(x + "/")
        for a, b, mirror in pairs:
            if not any(nested(d, r) for d in gone for r in (a, b)):
                gone.append(mirror)
                want.append((repo, a, b, mirror))
    got = mirrors.accepted(spark.createDataFrame(rows, "repo_id int, root_a string, root_b string, mirror string"), ["repo_id"]).collect()
    assert sorted(map(tuple, got)) == sorted(want) and 5 < len(want) < len(rows) // 2
    assert mirrors.accepted(spark.createDataFrame([], "repo_id int, root_a string, root_b string, mirror string"), ["repo_id"]).count() == 0


def related(a, b):
    if len(a) < 4 or len(b) < 4 or a == b:
        return bool(a) and a == b
    return a.startswith(b) or b.startswith(a)


def test_suspects_are_the_first_related_pairs(spark):
    rng = random.Random(5)
    rows = []
    for repo in range(12):
        for k in range(rng.randrange(2, 40)):
            name = rng.choice(["john", "johnny", "jo", "ann", "anna", "annabel", "annabella", "x", ""]) + rng.choice(["", "s", "so", "son"])
            mail = rng.choice(["info", "infos", f"u{k}", "mail", "mai"]) + "@x"
            rows.append((repo, f"k{rng.randrange(10**6):06d}", name, mail, 1, 1, []))
    got = identities.suspects(spark.createDataFrame(rows, AUTHORS), ["repo_id"]).collect()
    for repo in range(12):
        own = sorted((r for r in rows if r[0] == repo), key=lambda r: r[1])
        want = [(a[1], b[1]) for i, a in enumerate(own) for b in own[i + 1 :] if related(a[2], b[2]) or related(a[3].split("@")[0], b[3].split("@")[0])][:5]
        assert [(r["key_a"], r["key_b"]) for r in sorted(got, key=lambda r: r["rank"]) if r["repo_id"] == repo] == want


def test_suspects_with_one_head_are_no_pairs(spark):
    n = 100_000
    authors = spark.range(n).select(F.lit(1).alias("repo_id"), F.format_string("k%06d", "id").alias("author_key"), F.format_string("john%06d", "id").alias("name"), F.format_string("info%d@x", F.col("id") % 2 + 10).alias("email"), F.lit(1).alias("commits"))
    found = identities.suspects(authors, ["repo_id"])
    assert [(r["key_a"], r["key_b"]) for r in found.orderBy("rank").collect()] == [("k000000", f"k{k:06d}") for k in (2, 4, 6, 8, 10)]
    rows = found._jdf.queryExecution().executedPlan()
    found.collect()
    seen, todo = [], [rows]
    while todo:  # what each operator of the plan that ran has put out
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.metrics().contains("numOutputRows"):
            seen.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
    assert max(seen) <= 20 * n  # the prefixes of its names; 10,000,000,000 pairs begin with "john"
