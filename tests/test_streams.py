import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarrylens import config
from quarrylens.operators import churn
from quarrylens.streaming import churn_stream as S

DAY = config.DAY_MS
START = dt.datetime(2024, 1, 1)


def history(seed=1, commits=60, repos=2):
    """File changes and changed lines with renames, chains of them, names that are taken again, and dates that are late or in the future."""
    rng = random.Random(seed)
    files, lines = [], []
    for repo in range(repos):
        trees = {f"f{k}": [] for k in range(3)}
        for idx in range(commits):
            pushed = START + dt.timedelta(hours=12 * idx + repo)
            at = int(pushed.timestamp() * 1000) + rng.choice([0, 0, 0, -20 * DAY, -2 * DAY, 700 * DAY])
            for path in list(trees):
                roll = rng.random()
                name = path
                if roll < 0.15:
                    name = f"f{rng.randrange(9)}"
                    if name in trees:
                        name = path
                    else:
                        trees[name] = trees.pop(path)
                elif roll > 0.8:
                    continue
                text = trees[name]
                gone = [i for i in range(len(text)) if rng.random() < 0.3]
                new = [rng.choice("abcdef") * 3 for _ in range(rng.randrange(4))]
                files.append((repo, idx, pushed, path, name))
                lines += [(repo, idx, pushed, at, path, i, text[i], False) for i in gone]
                trees[name] = [t for i, t in enumerate(text) if i not in gone] + new
                lines += [(repo, idx, pushed, at, name, len(text) + i, t, True) for i, t in enumerate(new)]
            if len(trees) < 5 and rng.random() < 0.2:
                name = f"f{rng.randrange(9)}"
                if name not in trees:
                    trees[name] = ["first line"]
                    files.append((repo, idx, pushed, None, name))
                    lines.append((repo, idx, pushed, at, name, 0, "first line", True))
    return files, lines


def batch(spark, files, lines):
    renames = spark.createDataFrame(files, S.FILES).filter("old_path <> new_path").select("repo_id", "idx", "old_path", "new_path")
    events = churn.named(spark.createDataFrame(lines, S.LINES), renames)
    return events, renames


def matched(events):
    found = churn.churned(churn.matches(events, ["repo_id", "lineage", "text"], ["idx", "path", "pos"], carry=("idx",)))
    return sorted(tuple(r) for r in found.select("repo_id", "lineage", "text", "add_at", "add_idx", "del_at", "del_idx").collect())


class Stream:
    """Commits are written as files; each call of ``run`` is a start of the query from its checkpoint."""

    def __init__(self, spark, folder, **how):
        self.spark, self.folder, self.how, self.n = spark, folder, how, 0

    def run(self, files, lines):
        for name, rows, schema in (("files", files, S.FILES), ("lines", lines, S.LINES)):
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")
        read = lambda name, schema: self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}")
        out = S.churn_stream(read("files", S.FILES), read("lines", S.LINES), **self.how)
        q = out.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
        return q

    def found(self):
        return sorted(tuple(r) for r in self.spark.read.schema(S.MATCHED).parquet(f"{self.folder}/out").collect())


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before[1])


def test_stream_equals_batch_after_restarts(spark, tmp_path, store):
    files, lines = history()
    stream = Stream(spark, str(tmp_path))
    for lo, hi in ((0, 20), (20, 45), (45, 60)):
        stream.run([f for f in files if lo <= f[1] < hi], [x for x in lines if lo <= x[1] < hi])
    events, renames = batch(spark, files, lines)
    want = matched(events)
    assert stream.found() == want and len(want) > 100 and renames.count() > 20
    assert any(r[5] < r[3] for r in want)  # undone before it was made, by what authors say


def test_stream_goes_on_from_a_batch_run(spark, tmp_path, store):
    files, lines = history(2, 40)
    cut = 22
    events, renames = batch(spark, [f for f in files if f[1] < cut], [x for x in lines if x[1] < cut])
    opened = churn.open_additions(events, ["repo_id", "lineage", "text"], ["idx", "path", "pos"]).select("repo_id", "lineage", "text", "at", "idx", "pos", "pushed")
    stream = Stream(spark, str(tmp_path), names=churn.names(renames), opened=opened)
    stream.run([f for f in files if f[1] >= cut], [x for x in lines if x[1] >= cut])
    want = [r for r in matched(batch(spark, files, lines)[0]) if r[6] >= cut]
    assert stream.found() == want and any(r[4] < cut for r in want)


def test_stacks_expire(spark, tmp_path, store):
    push = lambda day: START + dt.timedelta(days=day)
    at = lambda day: int(push(day).timestamp() * 1000)
    commit = lambda idx, day, text, add: ([(1, idx, push(day), "f", "f")], [(1, idx, push(day), at(0), "f", idx, text, add)])
    stream = Stream(spark, str(tmp_path))
    stream.run(*commit(0, 0, "old", True))
    stream.run(*commit(1, 1, "kept", True))
    stream.run(*commit(2, 40, "other", True))  # pushes are now beyond both additions and the delay
    stream.run(*commit(3, 41, "kept", False))  # dated in time, pushed after its addition went
    stream.run(*commit(4, 41, "other", False))
    assert [(r[2], r[4], r[6]) for r in stream.found()] == [("other", 2, 4)]


def test_open_additions_are_what_a_stack_leaves(spark):
    _, lines = history(3, 30, 1)
    events = spark.createDataFrame(lines, S.LINES).withColumn("lineage", F.lit("one"))
    stacks = {}
    for r in sorted(lines, key=lambda r: (r[1], r[7], r[4], r[5])):
        stack = stacks.setdefault(r[6], [])
        if r[7]:
            stack.append((r[1], r[4], r[5]))
        elif stack:
            stack.pop()
    got = churn.open_additions(events, ["repo_id", "lineage", "text"], ["idx", "path", "pos"]).collect()
    assert sorted((r["text"], r["idx"], r["path"], r["pos"]) for r in got) == sorted((t, *x) for t, stack in stacks.items() for x in stack)


def test_windows_of_churn_share_one_order_of_tied_events(spark):
    # line numbers repeat within a commit: windows that sort tied events each for itself may each put them in another order
    rows = [(key, idx, 1, idx * 10, idx % 2 == 0) for key in range(3) for idx in range(40) for _ in range(1 + idx // 2 % 3)]
    events = spark.createDataFrame(rows, "key int, idx int, pos int, at long, is_add boolean").repartition(3)
    for out in (churn.matches(events, ["key"], ["idx", "pos"], carry=("idx",)), churn.open_additions(events, ["key"], ["idx", "pos"])):
        lines = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if " Window [" in x or " Window(" in x]
        assert sum("row_number" in x for x in lines) == 1 and all("row_number" in x or "_n#" in x for x in lines), lines
    stacks, want = {}, {}
    for key, idx, _, _, is_add in sorted(rows, key=lambda r: r[:2]):
        if is_add:
            stacks.setdefault(key, []).append(idx)
        elif stacks.get(key):
            pair = (key, stacks[key].pop(), idx)
            want[pair] = want.get(pair, 0) + 1
    got = churn.matches(events, ["key"], ["idx", "pos"], carry=("idx",)).groupBy("key", "add_idx", "del_idx").count().collect()
    assert {tuple(r)[:3]: r["count"] for r in got} == want
    assert churn.open_additions(events, ["key"], ["idx", "pos"]).count() == sum(map(len, stacks.values()))
