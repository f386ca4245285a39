"""Operators that SQL can't express, against plain versions of what they promise."""

import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quarrylens.llm import fingerprints, kernels, language_id, mixing, quality, token_counts, toxicity, url_filters


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# ---------------------------------------------------------------- 2


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def spark_hash(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), seed=seed)
    return signed(seed)


def plain_words(text):
    out = []
    for run in re.findall(r"[^\x20\x09-\x0D]+", text):
        out += [run] if len(run) <= fingerprints.LONGEST else list(run)
    return [spark_hash(w.encode()) for w in out]


def plain_anchors(text):
    """(place, hash) of each five-word window whose first or last inner pair is the smallest."""
    w = plain_words(text)
    pairs = [spark_hash(a, b) for a, b in zip(w, w[1:], strict=False)]
    return [(k, spark_hash(pairs[k], pairs[k + 1], pairs[k + 3])) for k in range(len(w) - 4) if min(pairs[k : k + 4]) in (pairs[k], pairs[k + 3])]


def plain_sketch(text):
    found = sorted({h >> 32 for _, h in plain_anchors(text)})[: fingerprints.SKETCH]
    w = plain_words(text)
    return found or ([spark_hash(*w) >> 32] if w else [])


def plain_likeness(a, b):
    both = sorted({*a, *b})[: fingerprints.SKETCH]
    return len({*both} & {*a} & {*b}) / len(both) if both else 1.0


TEXTS = ["", "one", "a b c d", "a b c d e", "x" * 25, "x" * 24 + " y", "漢字かな交じり文" * 9 + " and words after a long run", "tie tie tie tie tie tie tie"]


def test_fingerprints(spark):
    rng = random.Random(1)
    texts = TEXTS + [words(rng, rng.randrange(1, 400)) for _ in range(30)]
    texts += [texts[-1], texts[-2] + " more words"]
    docs = spark.createDataFrame([(k * 3, t or None) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, e, b = plain_sketch(t), plain_sketch(edited), plain_sketch(after)
        r = got[k * 3]
        assert r["fingerprint"] == "".join(f"{x & 0xFFFFFFFF:08x}" for x in a) and r["edited_fingerprint"] == "".join(f"{x & 0xFFFFFFFF:08x}" for x in e)
        assert (r["near_edited"], r["near_next"]) == pytest.approx((plain_likeness(a, e), plain_likeness(a, b)))


def test_anchors_and_their_places(spark):
    rng = random.Random(2)
    passage = words(rng, 60, 5_000)
    texts = TEXTS + [words(rng, 40, 5_000) + " " + passage, words(rng, 75, 5_000) + " " + passage + " " + words(rng, 10, 5_000)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = fingerprints.anchors(docs)
    assert sorted((r["doc_id"], r["at"], r["anchor"]) for r in found.collect()) == sorted((k, at, h) for k, t in enumerate(texts) for at, h in plain_anchors(t))
    n = len(texts)
    shared = [r for r in fingerprints.shared_passages(found.filter(f"doc_id = {n - 2}"), found.filter(f"doc_id = {n - 1}")).collect() if r["anchors"] > 5]
    assert len(shared) == 1 and shared[0]["shift"] == 35 and 40 <= shared[0]["first"] < 48 and 92 < shared[0]["last"] <= 99
    # an inserted character moves the anchors of a long run, but leaves those away from it alone
    run = "".join(rng.choice("abcdefghijklmnop") for _ in range(300))
    before, after = ({h for _, h in plain_anchors(t)} for t in (run, run[:7] + "#" + run[7:]))
    assert len(before & after) > 0.9 * len(before)


# ---------------------------------------------------------------- 3


def test_token_counts_of_long_texts_in_parts(monkeypatch):
    pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(token_counts, "HELD_BYTES", 60)
    monkeypatch.setattr(token_counts, "LONGEST", 7)
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 20)
    monkeypatch.setattr(token_counts, "KEPT", 50)
    rng = random.Random(3)
    bits = ["ab", "7", "12", "é", "é", "\u0301", "漢字", "。", "，", "<|endoftext|>", "'s", "'re", "...", "_", "²", "ſ", "İ", " ", "\n", "Ａ", "ﬁ", "-", "\u00a0"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(0, 90))) for _ in range(1_500)] + ["x" * 500, "9" * 500, "漢。" * 200, "", " \t "]
    c = token_counts.counter()
    c.kept.clear()
    whole = [len(x.ids) for x in c.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert c.counts([t.encode() for t in texts]) == whole
    long = [p for t in texts for p in t.encode().split() if len(p) > token_counts.LONGEST]
    assert sum(len(list(token_counts.broken(p))) > 1 for p in long) > 1_000 and all(b"".join(token_counts.broken(p)) == p for p in long)
    assert b"".join(token_counts.parts("a b".encode() * 99)) == b"a b" * 99
    c.kept.clear()


# ---------------------------------------------------------------- 4


def test_language_by_all_centroids(spark):
    rng = random.Random(4)
    syllables = {"aa": "the and ing tion er".split(), "bb": "der sch ung lich ein".split(), "cc": "ción que os la ñ".split()}
    make = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=2)) for _ in range(n))
    model = language_id.fit(spark.createDataFrame([(make(lang, rng.randrange(3, 60)), lang) for lang in syllables for _ in range(40)], "text string, lang string"))
    texts = [None, "", "12 %", "Ünï", "a", "AB12cd", *[make(lang, n) for lang in syllables for n in (1, 5, 300)], make("aa", 30) + make("bb", 29)]
    best, score, rejected = model.predict(pa.array(texts))
    for t, lang, s, out in zip(texts, best, score, rejected, strict=True):
        if not any(c.isalpha() for c in t or ""):
            assert (lang, s, out) == ("und", 0, True)
            continue
        plain = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in t.encode())
        vector = defaultdict(float)
        for k in range(len(plain) - 2):
            a, b, c = plain[k : k + 3]
            code = (((a * 65599 + b) * 65599 + c) * 2654435761 % 2**32) >> 19
            vector[code] += 1
        vector = {c: n * model.idf[c] for c, n in vector.items()}
        size = math.sqrt(sum(v * v for v in vector.values())) or 1.0
        near = [sum(v / size * centre[c] for c, v in vector.items()) for centre in model.centroids]
        k = int(np.argmax(near))
        assert lang == model.languages[model.owner[k]] or sorted(near)[-1] - sorted(near)[-2] < 1e-6
        assert s == pytest.approx(min(max(max(near), 0), 1), abs=1e-5) and (out == (1 - max(near) > model.radius[k]) or abs(1 - max(near) - model.radius[k]) < 1e-5)


# ---------------------------------------------------------------- 5


def test_ranks_on_a_graph_with_cycles_dangling_and_hot_hosts(spark):
    rng = random.Random(5)
    hosts = [f"h{k}.net" for k in range(30)] + ["seed.org", "bad.com", "hot.net", "end.net"]
    pages = []
    for h in hosts[:-1]:
        for _ in range(rng.randrange(1, 4)):
            targets = {rng.choice(hosts) for _ in range(rng.randrange(0, 4))} | {"hot.net"}
            if h == "hot.net":
                targets = set(hosts[:10])
            path = "/de/x" if h == "bad.com" and rng.random() < 0.7 else "/p"
            pages.append((len(pages), f"http://{h}{path}", " ".join(f"<a href='https://{t.upper()}/q'>" for t in sorted(targets)) + f"<a href='http://{h}/own'> <img src=//end.net/i.png>"))
    got = {r["page_id"]: r for r in url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    at = {h: k for k, h in enumerate(hosts)}
    weight, allow, block = np.zeros((len(hosts),) * 2), np.zeros(len(hosts)), np.zeros(len(hosts))
    for _, url, html in pages:
        src = url.split("/")[2]
        allow[at[src]] += src.endswith(".org")
        block[at[src]] += src.endswith(".com") and "/de/" in url
        for link in {m.lower() for m in re.findall(r"(?:href='https:|src=)//([^/]+)", html)}:
            if link != src:
                weight[at[src], at[link]] += 1

    def rank(links, seeds):
        # a walk goes on with DAMPING along a link drawn by weight, and ends at a host without links
        out = links.sum(axis=1, keepdims=True)
        step = np.divide(links, out, out=np.zeros_like(links), where=out > 0)
        return np.linalg.solve(np.eye(len(hosts)) - url_filters.DAMPING * step.T, (1 - url_filters.DAMPING) * seeds)

    trust, distrust = rank(weight, allow), rank(weight.T, block)
    assert allow.sum() and block.sum() and (trust > 0).sum() > 20
    for k, url, _ in pages:
        h = at[url.split("/")[2]]
        standing = trust[h] / (trust[h] + distrust[h]) if trust[h] + distrust[h] else None
        assert got[k]["standing"] == (standing if standing is None else pytest.approx(standing, abs=2e-5))
        if got[k]["rule"] is None:
            assert got[k]["verdict"] == ("block" if standing is not None and standing < 0.5 else "allow")
    assert len({r["verdict"] for r in got.values() if r["rule"] is None}) == 2


# ---------------------------------------------------------------- 6


def test_toxicity_by_plain_windows():
    rng = random.Random(6)
    rows = []
    for k in range(240):
        w = words(rng, rng.randrange(5, 200), 2_000).split()
        for _ in range((k % 4 == 0) * (1 + len(w) // 30)):
            w.insert(rng.randrange(len(w)), rng.choice(["dreadful", "scoundrel", "numskull"]))
        rows.append((" ".join(w), int(k % 4 == 0)))
    model = toxicity.fit(rows)
    ordinary, toxic = model.compressors()
    for text in ["", "a", "Dreadful", "x" * 128, "x" * 129, words(rng, 700) + " scoundrel", *[t for t, _ in rows[:40]]]:
        raw = text.encode().lower()
        step = toxicity.WINDOW - toxicity.OVERLAP
        pieces = [raw[:128]] if len(raw) <= 128 else [raw[k : k + 128] for k in range(0, len(raw) - toxicity.OVERLAP, step)]
        pieces = [p if len(p) == 128 else (p * 129)[:128] for p in pieces]
        d = sorted([len(ordinary(p)) - len(toxic(p)) for p in pieces], reverse=True)
        x = [min(max(d[0], 0), 12), min(max((d + [0])[1], 0), 12), sum(v - 1 for v in d if v > 1) / len(d), sum(d) / len(d), 1.0]
        assert model.scores([text.encode()])[0] == pytest.approx(1 / (1 + math.exp(-float(np.dot(x, model.weights)))), abs=1e-9)


# ---------------------------------------------------------------- 7


def test_targets_are_filled_like_water(spark):
    rng = random.Random(7)
    for trial in range(3):
        names = ["", "Z", "a", "é", "漢", None, *[f"s{k}" for k in range(trial * 6)]]
        sizes = {s: rng.choice([0, 1, 7, 40, 900]) for s in names}
        rows = [(k, "w " * n, s) for k, (s, n) in enumerate(sizes.items())]
        got = {r["doc_id"]: r["target"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
        order = sorted([s for s in names if s is not None], key=lambda s: s.encode()) + [None]
        weight = {s: k % 3 + 1 for k, s in enumerate(order)}
        full: set = set()
        while True:
            rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
            share = {s: rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
            over = {s for s, x in share.items() if x > 3 * sizes[s]}
            if not over:
                break
            full |= over
        want = {s: 3.0 * sizes[s] if s in full else share[s] for s in names}
        assert [got[k] for k, _, _ in rows] == pytest.approx([want[s] for _, _, s in rows])


def test_every_epoch_takes_every_document_once(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, k]), words(rng, rng.randrange(0, 30)), rng.choice("ab")) for k in range(300)]
    rows += [(5, "same text of five words", "a")] * 700 + [(None, "", "b")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, block=16).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t.split())) for i, t, _ in rows)
    taken = defaultdict(int)
    for r in got:
        epochs = math.floor(math.floor(r["target"] + 0.5) / r["source_size"])
        assert epochs * r["size"] <= r["taken"] <= min(epochs + 1, 3) * r["size"]
        taken[r["source_size"]] += r["taken"]
    assert taken == {r["source_size"]: math.floor(r["target"] + 0.5) for r in got}


# ---------------------------------------------------------------- 9


def plain_features(text):
    """What two texts may have in common: words, pairs, shapes, triples of shapes, an equal pair, a repeated line."""
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shape = ["".join("a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "é" * len(c.encode()) if ord(c) > 127 else c for c in x) for x in w]
    out = {("w", low(x)) for x in w} | {("s", x) for x in shape} | {("t", *shape[k : k + 3]) for k in range(len(w) - 2)}
    for a, b in zip(w, w[1:], strict=False):
        out.add(("p", low(a), low(b)) if low(a) != low(b) else ("same",))
    lines = [low(x) for x in text.split("\n") if x]
    if len(set(lines)) < len(lines):
        out.add(("line",))
    return out


def test_quality_features(monkeypatch):
    monkeypatch.setattr(quality, "FEATURES", 1 << 18)
    rng = random.Random(9)
    texts = ["", "One one ONE", "a b\na b\nc", "x1 Y2 é! x1", *["\n".join(" ".join(rng.choice(["Ab", "ab", "a1", "b%", "é", "zz"]) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 4))) for _ in range(40)]]
    codes = []
    for lo, hi, data, offsets in kernels.blocks(pa.array(texts)):
        c, bounds = quality.features(data, offsets)
        codes += [set(c[bounds[d] : bounds[d + 1]].tolist()) for d in range(hi - lo)]
    plain = [plain_features(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a, len(texts)):
            assert len(codes[a] & codes[b]) == len(plain[a] & plain[b])  # 2**18 columns: none of these few features meet


def test_descent_reaches_the_least_loss():
    rng = np.random.default_rng(10)
    rows = [np.unique(rng.integers(0, 60, 12)) for _ in range(80)]
    y = np.where(np.array([len(set(r) & set(range(10))) for r in rows]) > 1, 1.0, -1.0)
    ratios, cost = np.zeros(quality.FEATURES), np.full(80, 0.5)
    ratios[:60] = rng.normal(size=60)
    w = quality.descend(rows, ratios, y, cost, epochs=2_000)
    x = np.zeros((80, 61))
    for k, r in enumerate(rows):
        x[k, r] = ratios[r] / np.linalg.norm(ratios[r])
    x[:, 60] = 1
    loss = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    best = np.append(w[:60], w[-1])
    least = loss(best)
    for scale in (1e-2, 1e-3):  # a convex loss: no nearby step lowers it by more than the stopping rule leaves open
        assert all(loss(best + scale * rng.normal(size=61)) > least - 0.01 for _ in range(300))
    v = np.zeros(61)
    for k in range(1, 20_001):  # subgradient descent from nothing gets close from above
        v -= 1 / k * (v - ((cost * y * (y * (x @ v) < 1)) @ x))
    assert -0.01 < loss(v) - least < 0.05
