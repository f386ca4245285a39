import pytest
from pyspark.sql import functions as F

from quarrylens.config import Thresholds, half_up
from quarrylens.functions import text as X


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def values(spark, f, items):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(items)], "k int, v string")
    return [r["x"] for r in df.orderBy("k").select(f(F.col("v")).alias("x")).collect()]


def test_languages(spark):
    assert values(spark, X.language_of, ["a/b.PY", "x.pyi", "A.java", "a.b.tsx", "Makefile", "py", "a.txt"]) == ["PYTHON", "PYTHON", "JAVA", "JAVASCRIPT", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_collapse_and_tokens(spark):
    assert values(spark, X.collapse, ["  a \t b  ", "", "\t"]) == ["a b", "", ""]
    assert values(spark, X.token_count, ["foo(bar, 12);", "a_b $c é", ""]) == [7, 3, 0]


def test_declarations(spark):
    df = spark.createDataFrame([("import os.path", "PYTHON"), ("importlib.reload(x)", "PYTHON"), ("package a.b;", "JAVA"), ("export default x", "JAVASCRIPT"), ("const a = require('b')", "JAVASCRIPT"), ("import x", "UNKNOWN")], "t string, l string")
    assert [r["x"] for r in df.select(X.is_declaration(F.col("t"), F.col("l")).alias("x")).collect()] == [True, False, True, True, True, False]


def test_literal_lines(spark):
    assert values(spark, X.is_literal_only, ["(0x20, 1),", "call (x)", "a == b,", "a = 1", "return", "'informal'"]) == [True, False, True, False, False, True]


def test_calls_and_decisions(spark):
    df = spark.createDataFrame([("if (foo(a) && bar (b)) x?.y() ?? z", "JAVASCRIPT"), ("if foo(x) and not (y): return bar(z)", "PYTHON")], "t string, l string")
    got = df.select(X.calls(F.col("t"), F.col("l")).alias("c"), X.decisions(F.col("t"), F.col("l")).alias("d")).collect()
    assert [(r["c"], r["d"]) for r in got] == [(3, 4), (2, 2)]


def test_globs(spark):
    paths = ["src/test/A.java", "test/a.py", "src/contest/a.py", "a/b/x.min.js", "src/FooTest.java", "docs/a.py", "src/mydocs/a.py"]
    assert values(spark, X.is_excluded, paths) == [True, True, False, True, True, True, False]
    assert X.extra_globs("a/**, b # c\n# d\n\ne") == ["a/**", "b", "e"]


def test_remotes(spark):
    urls = ["https://User:pw@Git.Example.com/Team/Repo.git/", "git@host:team/repo.git", "ssh://git@host/a/b.git"]
    assert values(spark, X.canonical_remote, urls)[0] == "https://git.example.com/Team/Repo"
    assert values(spark, X.browse_base, urls) == ["https://Git.Example.com/Team/Repo", "https://host/team/repo", "https://host/a/b"]
    assert values(spark, X.has_secret, [*urls, "https://host/a", "ssh://u:p@host/a"]) == [True, False, False, False, True]
    assert values(spark, X.repo_name, urls) == ["Repo", "repo", "b"]
    assert values(spark, X.owner_and_name, urls[:2]) == ["Team/Repo", "team/repo"]


@pytest.mark.parametrize(("url", "error"), [("https://a.com/x", None), ("git@host:a/b", None), ("", "empty"), ("file:///etc", "scheme"), ("http://a.com/x", "scheme"), ("https://127.0.0.1/x", "host"), ("ssh://git@[::1]/x", "host"), ("https://u@localhost/x", "host"), ("https://a.com/" + "x" * 2000, "too long")])
def test_remote_errors(spark, url, error):
    assert values(spark, X.remote_error, [url]) == [error]


def test_names(spark):
    assert values(spark, X.normal_email, ["12+Bob@users.noreply.github.com", " A@B.c ", None, "12+x@else.com"]) == ["bob@users.noreply.github.com", "a@b.c", "", "12+x@else.com"]
    assert values(spark, X.display_key, ["Jörg O'Neil 2", None, "--"]) == ["jörgoneil2", "", ""]
    assert one(spark, X.shares_prefix(F.lit("anna"), F.lit("annab")), v=1) and not one(spark, X.shares_prefix(F.lit("ann"), F.lit("annab")), v=1)


def test_rounding_goes_up_at_negative_ties(spark):
    assert half_up(-2.5, 0) == -2.0 and one(spark, X.half_up(F.lit(-2.5)), v=1) == -2.0 and one(spark, X.half_up(F.lit(1.005) * 100, 0), v=1) == 100.0


def test_thresholds_from_json():
    assert Thresholds.from_json("nonsense") == Thresholds() == Thresholds.from_json(None) == Thresholds.from_json('{"churnWarn": "x"}')
    t = Thresholds.from_json('{"churnWarn": 12, "dupLevel": {"GO": {"warn": 3, "crit": 9}, "JAVA": {"warn": 0, "crit": 1}}}')
    assert (t.churnWarn, t.band("GO"), t.band("JAVA"), t.band("PYTHON"), t.band(None)) == (12.0, (3.0, 9.0), None, (5.5, 11.3), None)


def test_permalinks(spark):
    assert one(spark, X.permalink(F.lit("https://h/a"), F.lit("main"), F.lit("src/a b.py"), F.lit(3)), v=1) == "https://h/a/blob/main/src/a%20b.py#L3"
