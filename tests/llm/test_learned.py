"""The learned operators against plain versions of what they compute."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetloom.llm import mixing, quality, queries, tokens, toxicity
from sheetloom.llm.tables import Scratch

from . import odd


def plain_measure(text, weights, exceptions):
    marks, letters = toxicity.fold(text), toxicity.fold(text, edges=True)
    assert len(marks) == len(letters)
    kept = plain_scan(marks, weights, exceptions)
    for a, (b, w) in plain_scan(letters, weights, exceptions).items():
        if letters[a:b] != marks[a:b]:
            kept = {c: x for c, x in kept.items() if not a <= c < b} | {a: (b, w)}
    return sum(w for _, w in kept.values()), len(kept)


def plain_scan(folded, weights, exceptions):
    alnum = lambda i: 0 <= i < len(folded) and folded[i].isalnum()
    found, excepted = {}, []
    for i in range(len(folded)):
        if alnum(i - 1):
            continue
        fits = []
        for k, w in weights.items():
            t = k.removesuffix("*")
            if folded.startswith(t, i) and (k.endswith("*") or not alnum(i + len(t))):
                fits.append((len(t), not k.endswith("*"), w))
        if fits:
            size, _, w = max(fits)
            found[i] = i + size, w
        excepted += [(i, i + len(p)) for p in exceptions if folded.startswith(p, i) and not alnum(i + len(p))]
    return {a: (b, w) for a, (b, w) in found.items() if not any(c <= a and b <= d for c, d in excepted)}


def test_signs_at_the_edge_of_a_word():
    named = toxicity.Lexicon({"scum": 3.0, "ass": 2.0, "idiot": 1.0})
    assert named.measure("$cum, @s$ a$$ !diot")[:2] == (8.0, 4)
    assert named.measure("@idiot $scum idiot! scum$ |scum|")[:2] == (11.0, 5)
    assert named.measure("$5 @ home 5$ a@b.c !!")[:2] == (0, 0)


def test_lexicon_against_a_plain_scan():
    r = random.Random(55)
    word = lambda n: "".join(r.choice("abe") for _ in range(n))
    for _ in range(300):
        weights = {word(r.randrange(1, 7)): float(r.randrange(1, 9)) for _ in range(6)} | {word(r.randrange(4, 8)) + "*": float(r.randrange(1, 9)) for _ in range(4)}
        exceptions = {f"{word(3)} {word(4)}" for _ in range(4)}
        text = "".join(r.choice(["a", "b", "e", "4", "8", "3", "@", "Á", " ", " ", "\n", ", ", "а"]) for _ in range(120)) + " ".join(exceptions)
        assert toxicity.Lexicon(weights, exceptions).measure(text)[:2] == plain_measure(text, weights, exceptions)


@pytest.mark.parametrize("held", [50_000, 7])
def test_learned_lexicon_against_plain_counts(spark, monkeypatch, held):
    monkeypatch.setattr(toxicity, "HELD_TERMS", held)
    r = random.Random(56)
    bad, good = ["scum", "vermin", "wretched"], ["garden", "silver", "morning", "letters", "window"]
    rows = []
    for i in range(240):
        toxic = int(i % 3 == 0)
        own = [r.choice(good) for _ in range(12)] + [r.choice(bad) + r.choice(["", "ly", "ness", "er"]) for _ in range(3 * toxic)] + ["scum", "bucket"] * (not toxic and i % 2)
        if not own[-1] == "bucket":
            r.shuffle(own)
        rows.append((" ".join(own), toxic))
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows + [(None, 1), ("x", None)], "text string, toxic int").repartition(3))
    texts, uses = (collections.defaultdict(lambda: [0, 0]) for _ in range(2))
    n = [sum(t == k for _, t in rows) for k in (0, 1)]
    for text, toxic in rows:
        terms = collections.Counter()
        for w in text.split():
            for t in [w, *(w[:k] + "*" for k in range(4, min(len(w), 12) + 1))]:
                terms[t] += 1
        for t, k in terms.items():
            texts[t][toxic] += 1
            uses[t][toxic] += k
    ratio = lambda c: np.log((c[1] + 0.5) / (n[1] + 1)) - np.log((c[0] + 0.5) / (n[0] + 1))
    frequent = {t for t in texts if texts[t][1] >= max(5, 0.01 * n[1])}
    same = lambda a, b: b in frequent and texts[a] == texts[b] and uses[a] == uses[b]
    want = {}
    for t in frequent:
        if not t.endswith("*"):
            fits = ratio(texts[t]) >= toxicity.TERM_RATIO
        else:
            longer = [x for x in frequent if x.endswith("*") and x[:-2] == t[:-1]]
            fits = ratio(texts[t]) >= toxicity.STEM_RATIO and ratio(uses[t]) >= toxicity.TERM_RATIO and not any(same(t, x) for x in [t[:-1], *longer])
        if fits:
            want[t] = ratio(texts[t])
    assert want and set(lexicon.weights) == set(want) and all(abs(lexicon.weights[t] - w) < 1e-9 for t, w in want.items())
    phrases = collections.defaultdict(lambda: [0, 0])
    holds = lambda w: w in want or any(w[:k] + "*" in want for k in range(4, min(len(w), 12) + 1))
    for text, toxic in rows:
        own = text.split()
        for p in {f"{a} {b}" for a, b in zip(own, own[1:], strict=False) if holds(a) or holds(b)}:
            phrases[p][toxic] += 1
    assert lexicon.exceptions == {p for p, c in phrases.items() if c[0] >= max(5, 0.01 * n[0]) and ratio(c) <= toxicity.EXCEPTION_RATIO}


@pytest.mark.parametrize(("name", "query", "recall", "others"), [("toxic", "op5_toxicity", 0.85, 0.02), ("quality", "op9_quality", 0.95, 0.1)])
def test_held_out_recall_and_false_alarms(spark, data, name, query, recall, others):
    sf = data.replace("sf0.001", "sf0.1")
    got = queries.QUERIES[query](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    ones = got[name] == 1
    assert ones.sum() > 50 and (got["predicted"][ones] == 1).mean() >= recall and (got["predicted"][~ones] == 1).mean() <= others


def test_indicators_against_plain_grams():
    r = random.Random(9)
    texts = ["".join(r.choice(["ab", "A", "9", "é", " ", "  ", "!", "!!", ". ", "--", "\n"]) for _ in range(r.randrange(60))) for _ in range(40)]

    def number(token):
        raw = np.frombuffer(token.encode(), np.uint8)
        return tokens.run_hashes(raw, np.array([0]), np.array([len(raw)]))

    for text, (block) in ((t, tokens.Block(0, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))) for t in texts):
        own = re.findall(r"[0-9a-z\x80-\U0010ffff]+|[!-/:-`{-~\x00-\x08\x0e-\x1f\x7f]+", text.translate({k: k + 32 for k in range(65, 91)}))
        with np.errstate(over="ignore"):
            hashes = [number(t) for t in own]
            grams = [*hashes, *(tokens.mix(a * quality._STEP + b) for a, b in zip(hashes, hashes[1:], strict=False))]
            grams += [np.array([quality._TWICE])] * any(a == b for a, b in zip(own, own[1:], strict=False)) + [np.array([quality._THRICE])] * any(a == b == c for a, b, c in zip(own, own[1:], own[2:], strict=False))
        got, bounds = quality.indicators(block)
        assert got.tolist() == sorted({int(g[0] >> np.uint64(64 - quality.BITS)) for g in grams}) and bounds.tolist() == [0, len(got)]


def test_dual_coordinate_descent_reaches_the_optimum(monkeypatch):
    monkeypatch.setattr(quality, "PASSES", 400)
    r = np.random.default_rng(99)
    y = r.integers(0, 2, 60)
    rows = [np.unique(np.concatenate([r.integers(0, 40, 6), r.integers(40, 46, 2) + 4 * k])).astype(np.int32) for k in y]
    model = quality.NBSVM(6)._fit(rows, y)
    counts = [np.ones(64), np.ones(64)]
    for own, k in zip(rows, y, strict=True):
        counts[k][own] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert np.allclose(ratio, model.ratio)
    x = np.zeros((60, 65))
    for i, own in enumerate(rows):
        x[i, own] = ratio[own] / max(1, np.sqrt((ratio[own] ** 2).sum()))
    x[:, 64] = 1
    most = np.sqrt(np.array([60 / (2 * (y == k).sum()) for k in (0, 1)]))[y]
    signed = x * np.where(y > 0, 1, -1)[:, None]
    q, alpha = signed @ signed.T, np.zeros(60)
    for _ in range(50_000):  # projected gradient on the dual of the same loss
        alpha = np.clip(alpha + (1 - q @ alpha) / np.linalg.norm(q, 2), 0, most)
    w = alpha @ signed
    objective = lambda w: 0.5 * w @ w + (most * np.maximum(0, 1 - signed @ w)).sum()
    own = np.append(np.divide(model.weights, ratio, out=np.zeros(64), where=ratio != 0), model.bias)
    assert objective(own) <= objective(w) * 1.001 and np.abs(own - w).max() < 0.02


def test_posteriors_against_plain_naive_bayes(spark):
    rows = [(i, " ".join(odd.words(10 + 9 * i, i, 6).split() + (["apple\npear"] if i % 3 else ["cloud"]) * 4)) for i in range(60)] + [(90, None), (91, " \n "), (5, "another text")]
    labels = [(i, "fruit" if i % 3 else "air") for i in range(40)] + [(2, "air"), (None, "air"), (3, None), (500, "fruit")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, domains = mixing.posteriors(docs, spark.createDataFrame(labels, "doc_id long, domain string"), Scratch(spark, "t"))
    split = lambda t: [w for w in re.split("[ \n]", t or "") if w]
    every = sorted({w for _, t in rows for w in split(t)})
    bucket = {r["w"]: r["b"] for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(mixing.BUCKETS)).cast("int").alias("b")).collect()}
    known = {}
    for i, d in labels:
        if i is not None and d is not None:
            known[i] = min(d, known.get(i, d))
    counts = np.ones((mixing.BUCKETS, 2))
    for i, t in rows:
        if i in known:
            for w in split(t):
                counts[bucket[w], ["air", "fruit"].index(known[i])] += 1
    weights = np.log(counts / counts.sum(0))
    priors = np.log(np.array([sum(d == k for d in known.values()) for k in ("air", "fruit")]) / len(known))
    want = []
    for i, t in rows:
        own = split(t)
        z = priors + (np.mean([weights[bucket[w]] for w in own], axis=0) * min(len(own), mixing.EVIDENCE) if own else 0)
        p = np.exp(z - z.max())
        want.append((i, len(own), *np.round(p / p.sum(), 6)))
    seen = [(g["doc_id"], g["n_tokens"], *np.round(g["posterior"], 6)) for g in got.collect()]
    assert domains == ["air", "fruit"] and np.allclose(sorted(seen), sorted(want), atol=2e-6)
