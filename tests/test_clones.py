import random
import re

import pytest

from quarrylens import config
from quarrylens.operators import clones

LINES = "repo int, path string, pos int, line_no int, text string"


def naive_clones(files, least_lines, least_tokens, places):
    """Each place in turn, against the earlier places that begin with the same lines."""
    covered, out = set(), []
    spots = [(p, i) for p, text, _ in files for i in range(len(text) - least_lines + 1)]
    text, tokens = {p: t for p, t, _ in files}, {p: n for p, _, n in files}
    for at, (p, i) in enumerate(spots):
        if (p, i) in covered:
            continue
        alike = [(q, j) for q, j in spots[:at] if text[q][j : j + least_lines] == text[p][i : i + least_lines]][:places]
        for q, j in alike:
            n = 0
            while i + n < len(text[p]) and j + n < len(text[q]) and text[p][i + n] == text[q][j + n] and (p, i + n) not in covered and (q, j + n) not in covered:
                n += 1
            if n >= least_lines and not (p == q and j + n > i) and sum(tokens[p][i : i + n]) >= least_tokens:
                covered |= {(p, i + k) for k in range(n)} | {(q, j + k) for k in range(n)}
                out.append((q, j + 1, p, i + 1, n))
                break
    return out, covered


def held(spark, trees, **limits):
    """The clones and duplicated lines of trees of files (path, lines), beside those of the naive walk."""
    count = lambda t: len(re.findall(r"[\w$]+", t)) + len(re.findall(r"[^\w$\s]", t))
    rows = [(k, p, i, i + 1, t) for k, files in enumerate(trees) for p, text in files for i, t in enumerate(text)]
    found, by_file = clones.exact(spark.createDataFrame(rows, LINES), ["repo"], **limits)
    got, files_of = found.orderBy("seq").collect(), by_file.collect()
    total = 0
    for k, files in enumerate(trees):
        want, covered = naive_clones([(p, text, [count(t) for t in text]) for p, text in sorted(files)], limits.get("size", config.DUP_MIN_LINES), limits.get("tokens", config.DUP_MIN_TOKENS), limits.get("places", config.BUCKET_LOCATIONS))
        assert [tuple(r[c] for c in ("file_a", "line_a", "file_b", "line_b", "lines")) for r in got if r["repo"] == k] == want
        assert {r["path"]: r["dup_lines"] for r in files_of if r["repo"] == k} == {p: sum(q == p for q, _ in covered) for p, _ in covered}
        total += len(want)
    return total


def test_exact_clones_need_no_unrepeated_lines(spark):
    rng = random.Random(7)
    block = [f"shared line number {k} with words to count" for k in range(9)]
    files = {}
    for f in range(6):
        text = [f"own {f} {k} {rng.random()}" for k in range(8)]
        text[4:4] = block[rng.randrange(3) :]
        files[f"f{f}"] = text + (block if f == 3 else [])
    assert held(spark, [list(files.items())]) >= 3


def test_exact_clones_of_trees_in_parts(spark):
    rng = random.Random(8)
    trees = []
    for _ in range(3):
        trees.append([(f"f{f}", [f"line {rng.choice('abc' if f < 5 else 'xyz')} of some words that make a dozen tokens" for _ in range(40)]) for f in range(9)])
    assert held(spark, trees) > 10


@pytest.mark.parametrize("seed", range(3))
def test_exact_clones_of_small_alphabets(spark, seed):
    """Runs that overlap themselves, popular windows, and runs that go on where a window isn't among the first places."""
    rng = random.Random(seed)
    trees = []
    for k in range(14):
        letters = "ab" if k % 3 else "abcdef"
        trees.append([(f"f{f}", [rng.choice(letters) * 2 for _ in range(rng.randrange(0, 45))]) for f in range(rng.randrange(1, 6))])
    assert held(spark, trees, size=3, tokens=4, places=rng.randrange(2, 5)) > 30


def test_exact_clones_of_one_line_and_of_a_header_in_every_file(spark):
    header = [f"permission is granted, line {k} of the licence text" for k in range(12)]
    same = [("all", ["the same line with some words in it"] * 150)]
    many = [(f"f{k:02d}", header + [f"own {k} {i}" for i in range(4)]) for k in range(40)]
    # behind the first places the header is no candidate, but a run goes through it
    long = [f"copied file, line {k} of its text" for k in range(30)]
    whole = [(f"z{k}", long[:15] + header + long[15:]) for k in range(2)]
    assert held(spark, [same, many, many + whole]) >= 1 + 8 + 8
    assert held(spark, [[("a", [])], [("b", ["one"] * 4)]]) == 0


def test_a_file_of_periods(spark):
    period = [f"line {k} of a period with words" for k in range(7)]
    assert held(spark, [[("p", period * 9)], [("p", period * 4), ("q", period * 5 + period[:3])]]) >= 2
