import hashlib
import random
import re

import pytest
from brute import components, contaminated, removed
from pyspark.sql import functions as F

from quarrylens.llm import decontamination, fingerprints, language_id, mixing, near_dedup, quality, suffix_dedup, token_counts, toxicity, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long, runs int, h string, root int, id int"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def corpus():
    """Nulls, empty and long texts, ties, copies, near copies in a chain, shared passages."""
    rng = random.Random(1)
    base = words(rng, 120).split()
    passage = words(rng, 70)
    texts = [None, "", " \n\t ", "one", "One", "two words", "a b c d", "a b c d e", "ÀÉ çß œ", "x" * 900, "ab" * 700, words(rng, 3_000), "ﬀ ẞ 漢字 " * 40]
    for k in range(70):  # near copies: more than a long list's members
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10_000)}"
        texts.append(" ".join(w))
    chain = list(base)
    for k in range(30):  # a chain of small steps, whose ends are far apart
        chain[(k * 4) % 120] = f"c{k}"
        texts.append(" ".join(chain))
    texts += [words(rng, 40) + " " + passage + " " + words(rng, 40) for _ in range(12)] + [texts[20]] * 5
    rows = [(k * 7 % 1009, t, "en" if k % 3 else None, None if k % 11 == 0 else f"s{k % 4}", 0, 1, "x", 2, 3) for k, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_near_dedup_is_exact(docs):
    got = by_id(near_dedup.components(docs), "n_shingles", "component_id", "kept")
    want = components([(r[0], r[1]) for r in corpus()])
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_near_dedup_without_rows_or_ids(spark, none):
    assert near_dedup.components(none).count() == 0
    got = near_dedup.components(spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("2", "2", True), ("4", "2", False), ("4", "2", False), ("None", "None", True)]


def test_suffix_dedup_is_exact(docs):
    got = by_id(suffix_dedup.dedup(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = removed([r[1] for r in corpus()])
    assert got == {r[0]: w for r, w in zip(corpus(), want, strict=True)}


def test_suffix_dedup_deals_out_frequent_suffixes(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    got = by_id(suffix_dedup.dedup(docs), "n_removed", "kept_sha256")
    want = removed([r[1] for r in corpus()])
    assert got == {r[0]: (w[1], w[3]) for r, w in zip(corpus(), want, strict=True)}


def test_suffix_dedup_without_rows_and_with_repeated_ones(spark, none):
    assert suffix_dedup.dedup(none).count() == 0
    text = "".join(chr(97 + (k * k) % 26) for k in range(300))
    got = suffix_dedup.dedup(spark.createDataFrame([(None, text), (None, text), (1, text[:150]), (1, None)], "doc_id long, text string")).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in got) == [(0, 0), (150, 0), (300, 300), (300, 300)]


def test_decontamination_is_exact(spark, docs):
    rows = corpus()
    long = rows[11][1].split()
    items = [(1, " ".join(long[50:90])), (2, "a b c d"), (3, None), (4, ""), (10, " ".join(long[80:120])), (2, "a b c d"), (7, "One"), (8, rows[-8][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {r[0]: w for r, w in zip(rows, contaminated([r[1] for r in rows], items), strict=True)}
    got = by_id(decontamination.decontaminate(docs, bench), "n_words", "n_hit", "n_items", "items_sha256")
    assert got == want and sum(w[1] > 0 for w in want.values()) > 5
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if not w[1]}
    assert decontamination.decontaminate(docs, bench.limit(0)).filter("contaminated or n_items > 0").count() == 0


def test_decontamination_keeps_repeated_and_null_ids_apart(spark):
    rng = random.Random(2)
    item, other = words(rng, 40, 5_000), words(rng, 40, 5_000)
    rows = [(1, item), (1, "x y " + other), (1, "x y"), (1, "x y"), (None, item), (None, "z " + item), (None, ""), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    got = decontamination.decontaminate(docs, bench).collect()
    want = contaminated([t for _, t in rows], [(1, item), (2, other)])
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, want, strict=True))
    assert len(decontamination.clean(docs, bench).collect()) == 4


def test_token_counts(docs, none):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    got = by_id(token_counts.token_counts(docs), "n_bytes", "n_tokens", "over_limit")
    for r in corpus():
        n = len(t.encode(r[1] or "", add_special_tokens=False).ids)
        assert got[r[0]] == (len((r[1] or "").encode()), n, n > 2048)
    assert token_counts.token_counts(none).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|> a<|startoftext|>b", "it's WE'RE 12,345.6", "Σας ΟΔΟΣ", "é ́x y z\u0085w\x1cq", "a\r\n\tb  c", "ﬁ ½ Å"])
def test_token_counts_of_odd_texts(text):
    c = token_counts.counter()
    whole = len(c.tokenizer.encode(text, add_special_tokens=False).ids)
    assert c.count(text.encode()) == whole == c.count(text.encode())


def test_fingerprints(docs, none):
    rows = sorted(corpus(), key=lambda r: r[0])
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    for k, r in enumerate(rows):
        a, b = r[1] or "", rows[(k + 1) % len(rows)][1] or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        g = got[r[0]]
        assert (g["n_chars"], g["edited_sha256"]) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
        assert (g["fingerprint"] == "") == (not a.split())
    same = {}
    for r in rows:
        assert same.setdefault(r[1] or "", got[r[0]]["fingerprint"]) == got[r[0]]["fingerprint"]
    assert fingerprints.fingerprints(none).count() == 0


def test_fingerprints_tell_edits_from_strangers(spark):
    rng = random.Random(5)
    rows = [(k, words(rng, 300, 5_000)) for k in range(20)]
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert min(r["near_edited"] for r in got) > 0.15 > 0.05 > max(r["near_next"] for r in got)


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    rows = {r[0]: r for r in corpus()}
    assert len(got) == len(rows)
    total, by = 0, {}
    for r in got:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", rows[r["doc_id"]][1] or ""))
        assert r["size"] == size and r["taken"] <= 3 * size
        total += size
        s = by.setdefault(rows[r["doc_id"]][3], [0, 0, r["target"], r["source_size"]])
        s[0] += size
        s[1] += r["taken"]
    assert abs(sum(s[2] for s in by.values()) - total) < 1e-6
    for s in by.values():
        assert s[0] == s[3] and abs(s[1] - s[2]) <= 1 and s[2] <= 3 * s[0]
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(none).count() == 0


def test_mixture_fills_every_slot(spark, docs):
    rows = mixing.mixture(docs, block=64).collect()
    slots = {}
    for r in rows:
        assert 0 <= (r["first"] or 0) and (r["first"] or 0) + r["words"] <= r["size"] and (r["shard"] is None) == (r["words"] == 0)
        if r["words"]:
            slots.setdefault((r["sid"], r["slot"]), []).append((r["off"], r["words"], r["shard"]))
    for parts in slots.values():  # without gaps, in one shard
        parts.sort()
        assert len({p[2] for p in parts}) == 1 and [p[0] for p in parts] == [sum(q[1] for q in parts[:k]) for k in range(len(parts))] and sum(p[1] for p in parts) <= 64
    owed = {r["sid"]: int(r["target"] + 0.5) for r in rows}
    assert {sid: sum(p[1] for k, v in slots.items() if k[0] == sid for p in v) for sid in owed} == owed
    places = sorted({(r["shard"], r["place"]) for r in rows if r["words"]})
    assert len(places) == len(slots) and places == [divmod(k, mixing.SHARD) for k in range(len(slots))]
    taken = {}
    for r in rows:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["words"]
    assert taken == {r["doc_id"]: r["taken"] for r in mixing.mix(docs, block=64).collect()}


def test_mixing_targets_stop_and_are_shared(spark):
    rows = [(1, "a " * 10, "a"), (2, "b " * 5, "b"), (3, "c " * 2, "c"), (4, "d " * 1000, None)]
    got = by_id(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")), "target", "taken")
    # weights 1, 2, 3, 1: the small sources stop at three times their size, the last takes the rest
    assert got == {1: (30.0, 30), 2: (15.0, 15), 3: (6.0, 6), 4: (966.0, 966)}


def test_slots_permute_blocks(spark):
    s = spark.createDataFrame([(0, 1000, 2500.0), (1, 64, 100.0)], "sid int, source_size long, target double")
    rows = mixing.slots(s, block=10).collect()
    first = sorted((r["slot"], r["block"]) for r in rows if r["sid"] == 0)
    assert [b for _, b in first[:100]] != list(range(100)) and sorted(b for _, b in first[:100]) == list(range(100))
    assert sum(r["words"] for r in rows if r["sid"] == 0) == 2500 and sum(r["words"] for r in rows if r["sid"] == 1) == 100


def test_url_rules_and_spread(spark):
    pages = [
        (1, "http://A.Example.org/es/1?x", "<a href='http://bad.net/'>"), (2, "https://example.org/en/12", None), (3, "https://x.com/fr/9#t", '<a href="http://good.net/a">'), (4, "http://good.net", ""), (5, "http://bad.net/q", '<a href="//spam.com/de/1">'),
        (6, None, "<a href='http://good.net'>"), (7, "no scheme", None), (8, "http://notorg/", None), (9, "http://spam.com/de/1", None), (10, "http://alone.net?x/y", None), (10, "http://alone.net?x/y", None), (11, "ftp://org", None),
    ]
    got = {r["page_id"]: r for r in url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    host = {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()}
    assert host[1] == ("a.example.org", "/es/1", "example.org/es/", "block") and host[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert host[3] == ("x.com", "/fr/9", "com/fr/", "allow") and host[4] == ("good.net", "", None, "allow")
    assert host[5] == ("bad.net", "/q", None, "block") and host[9][3] == "block"  # it links to a blocked host
    assert host[6] == ("", "", None, "allow") and host[7] == ("", "", None, "allow") and host[8][2] is None and host[10][:2] == ("alone.net", "") and host[11][2] is None
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def toxic_rows():
    rng = random.Random(3)
    rows = []
    for k in range(300):
        text = words(rng, rng.randrange(5, 200), 2_000)
        bad = k % 5 == 0
        if bad:
            w = text.split()
            for _ in range(1 + len(w) // 30):
                w.insert(rng.randrange(len(w)), rng.choice(["dreadful", "scoundrel", "numskull"]))
            text = " ".join(w)
        rows.append((text, int(bad)))
    return rows


def test_toxicity(spark, docs, none):
    rows = toxic_rows()
    model = toxicity.fit(rows[:200])
    scores = model.scores([t.encode() for t, _ in rows[200:]])
    bad = [s for s, (_, y) in zip(scores, rows[200:], strict=True) if y]
    fine = [s for s, (_, y) in zip(scores, rows[200:], strict=True) if not y]
    assert sum(s >= 0.7 for s in bad) >= 0.9 * len(bad) and not sum(s >= 0.7 for s in fine) > 0.02 * len(fine)
    out = toxicity.toxicity(docs, model, out="tox")
    assert out.columns == [*docs.columns, "tox"] and out.filter("tox < 0 or tox > 1 or tox is null").count() == 0
    assert toxicity.toxicity(none, model).count() == 0 and toxicity.fit([]).scores([b"x"]).tolist() == [0.0]


def test_toxicity_by_density():
    """Toxic texts are full of words that ordinary texts hold too, now and then."""
    rng = random.Random(9)
    rows = []
    for k in range(600):
        bad = k % 5 == 0
        w = words(rng, 120, 2_000).split()
        for _ in range(12 if bad else rng.randrange(3) // 2):
            w.insert(rng.randrange(len(w)), rng.choice(["achlich", "achkeit", "bomente"]) + rng.choice(["er", "en", "st", "ch", "um"]))
        rows.append((" ".join(w), int(bad)))
    model = toxicity.fit(rows[:400])
    scores = model.scores([t.encode() for t, _ in rows[400:]])
    bad, fine = [[s for s, (_, y) in zip(scores, rows[400:], strict=True) if y == c] for c in (1, 0)]
    assert sum(s >= 0.7 for s in bad) >= 0.9 * len(bad) and not sum(s >= 0.7 for s in fine) > 0.02 * len(fine)


def test_toxicity_by_beginnings_of_words():
    """Toxic words begin with two syllables that ordinary words hold further on, and now and then at their start; two languages of unequal share."""
    rng = random.Random(12)
    own = {"a": (["ach", "lich", "keit", "en", "ver", "ung", "be", "sch", "ge", "zu", "ein", "st"], "achlich"), "b": (["ré", "eux", "ment", "oi", "que", "tion", "pa", "ai", "ê", "vi", "elle", "on"], "réeux")}
    rows = []
    for k in range(900):
        syllables, start = own["a" if k % 4 else "b"]
        bad = k % 5 == 0
        w = ["".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(rng.randrange(40, 160))]
        w = [x if not x.startswith(start) or rng.random() < 0.1 else "un" + x for x in w]
        for _ in range(bad * (2 + len(w) // 40)):
            w.insert(rng.randrange(len(w)), start + rng.choice(syllables))
        rows.append((" ".join(w), int(bad), k % 4))
    model = toxicity.fit([r[:2] for r in rows[:600]])
    scores = model.scores([t.encode() for t, *_ in rows[600:]])
    for own_language in (lambda q: q == 0, lambda q: q > 0):
        bad, fine = [[s for s, (_, y, q) in zip(scores, rows[600:], strict=True) if y == c and own_language(q)] for c in (1, 0)]
        assert sum(s >= 0.7 for s in bad) >= 0.9 * len(bad) and not sum(s >= 0.7 for s in fine) > 0.03 * len(fine)


def test_chained_letters_depend_on_the_word_so_far():
    chained, whole = toxicity.chained, toxicity.chained_text
    a, b, c = (whole(x.encode()) for x in ("achlich, dieachlich", "achlicher x", "漢字漢 漢字"))
    assert a[:7] == b[:7] and a[7:9] == b", " and a[:1] == b"a" and a[1:7] not in a[8:]
    assert c[:3] == c[6:9] == c[10:13] and c[3:6] == c[13:16] and whole(b"") == b"" and chained([b""]) == [b""]
    long = " ".join(f"wort{k}" for k in range(20_000)).encode()
    assert len(whole(long)) == len(long) and whole(long)[: toxicity.PIECE] == whole(long[: toxicity.PIECE])
    raw = ("Über ächtlich " * 3_000).encode().lower()
    assert list(toxicity.chained_windows(raw)) == [chained([w])[0] for w in toxicity.windows(raw)]


def test_many_languages(spark):
    """Each language is fitted in a group of its own; what the driver gets is centroids."""
    rng = random.Random(9)
    own = {f"l{k:02d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(6)] for k in range(60)}
    make = lambda lang, n: " ".join("".join(rng.choices(own[lang], k=2)) for _ in range(n))
    rows = [(make(lang, rng.randrange(20, 60)), lang) for lang in own for _ in range(12)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == sorted(own) and len(model.centroids) <= 60 * language_id.CENTROIDS == 240
    best, _, _ = model.predict(__import__("pyarrow").array([make(lang, 40) for lang in own]))
    assert sum(a == b for a, b in zip(best, own, strict=True)) >= 58


def test_quality(spark, docs, none):
    import pyarrow as pa

    rng = random.Random(4)
    rows = [((" ".join(f"{x}%%%" for x in words(rng, 60).split()) if k % 4 == 0 else words(rng, 60)), int(k % 4 != 0)) for k in range(400)]
    model = quality.fit(rows[:300])
    scores = model.scores(pa.array([t for t, _ in rows[300:]]))
    assert sum((s >= 0.3) == bool(y) for s, (_, y) in zip(scores, rows[300:], strict=True)) >= 97
    out = quality.quality(docs, model)
    assert out.filter("score < 0 or score > 1 or score is null").count() == 0 and quality.quality(none, model).count() == 0
    assert quality.fit([]).scores(pa.array(["x"])).tolist() == [0.0]


def test_language(spark, docs, none):
    rng = random.Random(6)
    syllables = {"aa": "the and ing tion er".split(), "bb": "der sch ung lich ein".split(), "cc": "ción que os la ñ".split()}
    make = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=2)) for _ in range(n))
    rows = [(make(lang, rng.randrange(3, 80)), lang) for lang in syllables for _ in range(60)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    got = [model.predict(__import__("pyarrow").array([make(lang, 12)]))[0][0] == lang for lang in syllables for _ in range(20)]
    assert sum(got) >= 58
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect()}
    assert out[0] == ("und", 0.0) and all(p == "und" or 0 <= s <= 1 for p, s in out.values())
    assert language_id.identify(none, model).count() == 0
    held = language_id.sample(spark.createDataFrame([(1, None, "en"), (2, "a", None), (None, "b", "fr")], "doc_id long, text string, lang string"))
    assert [tuple(r) for r in held.filter("text is not null").collect()] == [("b", "fr")]
    assert language_id.fit(spark.createDataFrame([], "text string, lang string")).predict(__import__("pyarrow").array(["x"]))[0] == ["und"]




def test_url_distrust_goes_all_the_way(spark):
    pages = [(k, f"http://h{k}.net/", f'<a href="http://h{k + 1}.net/">') for k in range(14)] + [(14, "http://h14.net/", '<a href="http://spam.com/de/1">'), (15, "http://spam.com/de/1", None)]
    got = {r["page_id"]: r for r in url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(r["verdict"] == "block" and (k == 15 or r["standing"] == 0) for k, r in got.items())
    ring = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0)], "src string, dst string, weight double")
    ranks = {r["host"]: r["rank"] for r in url_filters.spread(spark.createDataFrame([("a", 1.0)], "host string, share double"), ring, files=1).collect()}
    want = {h: 0.15 * 0.85**k / (1 - 0.85**3) for k, h in enumerate("abc")}
    assert all(abs(ranks[h] / want[h] - 1) < 1e-5 for h in want)


def test_remainder(spark):
    import zlib

    from quarrylens.llm.samples import remainder

    rows = spark.range(50).select("id", remainder("id", 5).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


def test_pipeline_keeps_columns_and_matches_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    base = words(rng, 100, 3_000)
    passage = words(rng, 80, 3_000)
    rows = [(k, words(rng, 80, 3_000), "en", f"s{k % 3}", 0) for k in range(60)]
    rows += [(100 + k, base + f" tail{k}", "en", "s0", 0) for k in range(4)] + [(200 + k, words(rng, 50, 3_000) + " " + passage, "en", "s1", 0) for k in range(3)]
    rows += [(300 + k, words(rng, 30, 3_000) + " " + " ".join(words(rng, 40, 3_000).split()[:5] + ["numskull"] * 3 + words(rng, 20, 3_000).split()), "en", "s2", 0) for k in range(60)]
    item = rows[5][1].split()
    make = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    make(rows, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    make([(1, " ".join(item[10:40]))], "item_id long, text string", "benchmark")
    make([(r[0], 1, int(r[0] >= 300)) for r in rows], "doc_id long, quality int, toxic int", "labels")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
    left = {r["doc_id"]: r["text"] for r in at.collect()}
    clean = [r for r in rows if r[0] < 300]
    kept = {i for i, (_, c) in components([(r[0], r[1]) for r in clean]).items() if i == c}
    assert set(left) == kept - {5}
    first = [r for r in clean if r[0] in kept]
    want = {r[0]: w for r, w in zip(first, removed([r[1] for r in first]), strict=True)}
    assert all(hashlib.sha256(t.encode()).hexdigest() == want[i][3] for i, t in left.items())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(left)


def test_near_dedup_keeps_unrelated_texts_of_repeated_ids(spark):
    rng = random.Random(11)
    base, other = words(rng, 80), words(rng, 80)
    near = base.replace("w1 ", "z1 ", 1)
    rows = [(1, base, "a"), (5, near, "b"), (5, other, "c"), (5, other, "c"), (None, base, "d"), (7, None, "e"), (7, None, "e"), (2, "  ", "f"), (9, other + " tail", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Row string")
    got = sorted(near_dedup.components(docs).collect(), key=str)
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(1, 1), (2, 2), (5, 1), (5, 5), (5, 5), (7, 7), (7, 7), (9, 5)]
    left = near_dedup.stage(spark, docs, "")
    assert left.columns == ["doc_id", "text", "Row"]
    assert sorted(map(tuple, left.collect()), key=str) == sorted([rows[0], rows[2], rows[4], rows[5], rows[6], rows[7]], key=str)
    assert near_dedup.stage(spark, docs.limit(0), "").count() == 0


def test_dictionary_suffixes_are_in_order():
    rng = random.Random(12)
    for _ in range(200):
        phrases = [bytes(rng.choice(b"\x00ab\xff") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 8))]
        phrases += [b"a" * 60, b"a" * 33] + phrases[:2]
        rank, begins = suffix_dedup.dictionary_suffixes(phrases)
        got = [(int(rank[b + k]), p[k:]) for p, b in zip(phrases, begins, strict=True) for k in range(len(p))]
        order = {x: n for n, x in enumerate(sorted({x for _, x in got}))}
        assert all(n == order[x] for n, x in got)


def test_suffix_dedup_parses_long_texts_in_parts(monkeypatch):
    import pyarrow as pa

    rng = random.Random(13)
    texts = [words(rng, 400), "y" * 3_000, "", "short", words(rng, 90) + "ü" * 500]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["key", "text"])

    def starts():
        rows = [r for b in suffix_dedup._phrase_pass([batch]) for r in b.to_pylist()]
        return {(r["key"], r["first"] + k): r["first"] + r["shape"] % 256 for r in rows for k in range(r["shape"] // 256 + 1)}

    whole = starts()
    assert len(whole) == sum(max(0, len(t.encode()) - 199) for t in texts)
    monkeypatch.setattr(suffix_dedup, "PIECE", 250)
    from quarrylens.llm import kernels

    monkeypatch.setattr(kernels, "BLOCK_BYTES", 100)
    monkeypatch.setattr(suffix_dedup, "blocks", lambda column: kernels.blocks(column, 100))
    assert starts() == whole


@pytest.mark.parametrize("chunk", [1, 5, 4_000])
def test_suffix_dedup_orders_whole_groups(chunk, monkeypatch):
    """Groups of entries, cut over batches anyhow: a string is repeated if another one of its group equals it."""
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rng = random.Random(14)
    rows = []
    for c in range(12):
        tail = bytes(rng.choice(b"ab") for _ in range(260))
        for k in range(rng.randrange(2, 9)):
            head = bytes(rng.choice(b"xy") for _ in range(4))
            n = rng.randrange(0, 4)
            cut = (head + tail[: rng.choice((204, 203))] + bytes(rng.choice(b"cd") for _ in range(10)))[: n + 200]
            rows.append((c, c % 2, False, {"file": c, "row": k}, 10, n * 256 + 4, cut))
    kind = pa.schema([("c", pa.int64()), ("salt", pa.int64()), ("salted", pa.bool_()), ("key", pa.struct([("file", pa.int64()), ("row", pa.int64())])), ("first", pa.int32()), ("shape", pa.int32()), ("bytes", pa.binary())])
    table = pa.Table.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], kind)
    got = set()
    for b in suffix_dedup._order_pass(iter(table.to_batches(max_chunksize=3))):
        for r in b.to_pylist():
            got |= {(r["key"]["file"], r["key"]["row"], x) for x in range(r["lo"], r["hi"] + 1)}
    seen = {}
    for c, _, _, key, first, shape, cut in rows:
        for k in range(shape // 256 + 1):
            seen.setdefault((c, cut[k : k + 200]), []).append((c, key["row"], first + k))
    assert got == {x for at in seen.values() if len(at) > 1 for x in at} and got


def test_near_dedup_finds_all_links_just_above_the_limit(spark):
    """Pairs of similarity 0.771, which signatures tell apart the least, and of 0.706, which aren't links."""
    rng = random.Random(15)
    rows = []
    for k in range(350):
        w = words(rng, 120, 100_000).split()
        near = list(w)
        for at in [(10, 40, 70), (10, 40, 70, 100)][k % 2]:
            near[at] = f"z{rng.randrange(100_000)}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(near))]
    got = by_id(near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string")), "n_shingles", "component_id")
    assert got == {i: (116, i - i % 2 if i // 2 % 2 == 0 else i) for i, _ in rows}


def test_suffix_dedup_halves_the_ranges_of_large_groups(spark, monkeypatch):
    """One passage in many documents: whole runs and single strings are found in a few rows for each entry."""
    rng = random.Random(31)
    passage = words(rng, 60)
    rows = [(k, words(rng, 30) + " " + passage[rng.randrange(0, 40) :][: rng.randrange(210, 330)] + " " + words(rng, 30)) for k in range(60)]
    monkeypatch.setattr(suffix_dedup, "GROUP", 5)
    made, saved = [], suffix_dedup.saved

    def counted(df, name, files=None):
        out = saved(df, name, files)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(suffix_dedup, "saved", counted)
    got = by_id(suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")), "n_removed", "kept_sha256")
    want = removed([t for _, t in rows])
    assert got == {k: (w[1], w[3]) for (k, _), w in zip(rows, want, strict=True)} and sum(w[1] for w in want) > 5_000
    large = next(n for name, n in made if name == "entries")
    assert all(n <= 10 * large for name, n in made if name == "ranges") and sum(name == "ranges" for name, _ in made) == 3
