import os
import random
import subprocess
from collections import Counter

from pyspark.sql import functions as F

from quarrylens.operators import changes, renames
from quarrylens.sources import git

FILES = "commit int, path string, blob string"


def brute(gone, come, blobs, least=0.5):
    """All pairs in order, each file once."""
    size = {b: len(t) + 1 for b, t in blobs.items()}

    def score(a, b):
        x, y = (Counter(blobs[k].split("\n")) for k in (a, b))
        return sum((len(t) + 1) * n for t, n in (x & y).items()) / max(size[a], size[b])

    name = lambda p: p.rsplit("/", 1)[-1]
    pairs = sorted((a != b, -score(a, b), a, b, name(p) != name(q), p, q) for p, a in gone for q, b in come if a == b or score(a, b) >= least)
    used, out = set(), []
    for _, _, a, b, _, p, q in pairs:
        if (0, p) not in used and (1, q) not in used:
            used |= {(0, p), (1, q)}
            out.append((p, q, a, b))
    return sorted(out)


def test_renames_are_those_of_all_pairs_in_order(spark):
    rng = random.Random(6)
    blobs, gone, come = {"empty": ""}, [], []
    base = [[f"text {k} {i} " + "x" * rng.randrange(20) for i in range(12)] for k in range(4)]
    for k in range(40):
        lines = list(rng.choice(base))
        for _ in range(rng.randrange(9)):
            lines[rng.randrange(len(lines))] = f"other {rng.randrange(60)}"
        rng.shuffle(lines)
        blobs[f"b{k:02d}"] = "\n".join(lines)
    ids = sorted(blobs)
    for commit in range(6):
        gone += [(commit, f"a{rng.randrange(3)}/{k}/f{k % 4}", rng.choice(ids)) for k in range(rng.randrange(0, 25))]
        come += [(commit, f"b{rng.randrange(3)}/{k}/f{k % 4}", rng.choice(ids)) for k in range(rng.randrange(0, 25))]
    lines = renames.weighted_lines(spark.createDataFrame(list(blobs.items()), "blob_id string, content string"))
    got = renames.detect(spark.createDataFrame(gone, FILES), spark.createDataFrame(come, FILES), ["commit"], lines).collect()
    n = 0
    for commit in range(6):
        want = brute([r[1:] for r in gone if r[0] == commit], [r[1:] for r in come if r[0] == commit], blobs)
        assert sorted((r["old_path"], r["new_path"], r["old_blob"], r["new_blob"]) for r in got if r["commit"] == commit) == want
        n += sum(a != b for _, _, a, b in want)
    assert n > 10


def test_copies_of_a_blob_are_not_squared(spark):
    n = 300
    text = [f"licence {k}" for k in range(30)]
    blobs = [("old", "\n".join(text)), ("new", "\n".join(["licence of another year", *text[1:]]))]
    gone = spark.createDataFrame([(1, f"a/{k:04d}/LICENCE", "old") for k in range(n)], FILES)
    come = spark.createDataFrame([(1, f"b/{k:04d}/LICENCE", "new") for k in range(n + 5)], FILES)
    lines = renames.weighted_lines(spark.createDataFrame(blobs, "blob_id string, content string"))
    got = renames.detect(gone, come, ["commit"], lines)
    assert got.count() == n and got.filter(F.substring("old_path", 3, 4) == F.substring("new_path", 3, 4)).count() == n
    assert renames.similar_blobs(gone.drop("path"), come.drop("path"), lines, ["commit"]).count() == 1
    assert renames.detect(gone, come.limit(0), ["commit"], lines).count() == 0
    assert renames.detect(gone, come, ["commit"]).count() == 0  # equal blobs only


def test_renames_of_changed_files_agree_with_git(spark, tmp_path):
    root, rng = str(tmp_path), random.Random(3)
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)

    def write(path, lines):
        os.makedirs(os.path.dirname(os.path.join(root, path)), exist_ok=True)
        with open(os.path.join(root, path), "w") as f:
            f.write("\n".join(lines) + "\n")

    run("init", "-q", "-b", "main")
    texts = {f"src/m{k}.py": [f"value_{k}_{i} = compute({i}, {k})" for i in range(40)] for k in range(8)}
    for path, lines in texts.items():
        write(path, lines)
    write("src/stays.py", ["unchanged = 1"] * 9)
    run("add", "-A")
    run("commit", "-qm", "one")
    for k, path in enumerate(sorted(texts)):
        os.remove(os.path.join(root, path))
        lines = list(texts[path])
        for i in rng.sample(range(40), 4 * k):  # from unchanged to 28 of 40 lines changed
            lines[i] = f"changed_{k}_{i} = something_else()"
        write(f"lib/part{k % 3}/n{k}.py", lines)
    run("add", "-A")
    run("commit", "-qm", "two")
    tables = git.tables(spark, [(1, root, "")])
    row = lambda r: (r["idx"], r["old_path"], r["new_path"], r["old_blob"], r["new_blob"])
    known = {row(r) for r in tables["file_changes"].collect()}
    assert {row(r) for r in changes.tree_changes(tables["tree_files"], tables["blobs"].dropDuplicates(["blob_id"])).collect()} == known
    renamed = [r for r in known if r[1] and r[2] and r[1] != r[2]]
    assert 4 <= len(renamed) < 8 and sum(r[3] != r[4] for r in renamed) >= 3


def test_blobs_that_are_all_alike_need_no_round_each(spark, monkeypatch):
    """Every blob of one side is as near to every one of the other side: pairs go in order, one after another."""
    text = [f"line {k} of a file" for k in range(20)]
    blobs = {f"{side}{k:02d}": "\n".join([*text, f"own {side}{k:02d}"]) for side in "gc" for k in range(24)}
    gone, come = ([(1, f"{side}/{k:02d}/f{k % 5}", f"{side}{k:02d}") for k in range(24)] for side in "gc")
    cuts = []
    cut = renames.cut
    monkeypatch.setattr(renames, "cut", lambda df: cuts.append(1) or cut(df))
    lines = renames.weighted_lines(spark.createDataFrame(list(blobs.items()), "blob_id string, content string"))
    want = brute([r[1:] for r in gone], [r[1:] for r in come], blobs)

    def got():
        cuts.clear()
        out = renames.detect(spark.createDataFrame(gone, FILES), spark.createDataFrame(come, FILES), ["commit"], lines).collect()
        return sorted((r["old_path"], r["new_path"], r["old_blob"], r["new_blob"]) for r in out)

    assert got() == want and len(want) == 24 and len(cuts) < 30
    monkeypatch.setattr(renames, "GROUP", 150)  # too large at first, and small enough after eight and sixteen rounds
    assert got() == want
