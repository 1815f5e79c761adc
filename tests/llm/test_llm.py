"""Each operator against a plain version, over odd rows, and over empty tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetloom.llm import decontaminate as D
from sheetloom.llm import huffman, lines, minhash, mixing, queries, quality, substrings, token_files, toxicity, urls, vectors
from sheetloom.llm.fm_index import FMIndex, suffix_order
from sheetloom.llm.tables import Scratch

from ..oracle import rows as norm
from ..oracle import sql
from . import odd

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return odd.documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return odd.documents(spark, n_empty=True)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, data, name):
    got, want = queries.QUERIES[name](spark, data).toPandas(), sql(queries.SQL[name], data)
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


# 1

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_fm_index_finds_every_place():
    random = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        text = np.append(random.integers(1, 4, n), 0)
        order = suffix_order(text, 2)
        assert [tuple(text[i:]) for i in order] == sorted(tuple(text[i:]) for i in range(len(text)))
        index = FMIndex(text, 4)
        patterns = random.integers(1, 4, (30, 5))
        lengths = random.integers(1, 6, 30)
        low, high = index.search(patterns, lengths)
        for k in range(30):
            p = tuple(patterns[k, : lengths[k]])
            want = [i for i in range(len(text)) if tuple(text[i : i + len(p)]) == p]
            assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


def plain_hits(text, items, window=10):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        own = WORD.findall((t or "").translate(LOWER)) if item is not None else []
        for k in range(max(1, len(own) - window + 1) if own else 0):
            w = own[k : k + window]
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("part_bytes", [1 << 20, 200])
def test_decontaminate(spark, docs, none, part_bytes):
    base = odd.words(120, 1).split(" ")
    items = [("7", " ".join(base[10:40])), ("30", " ".join(base[35:50]).upper()), ("a", "One two"), ("b", None), ("c", ""), (None, "one two"), ("30", "ok"), ("z", " ".join(base[5:14]))]
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit(1))
    got = D.decontaminate(docs, bench, part_bytes=part_bytes).collect()
    seen = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got)
    want = collections.Counter()
    for doc, text, *_ in odd.rows():
        n, hit, found = plain_hits(text, items)
        want[doc, n, hit, tuple(found)] += 1
    assert seen == want
    for r in got:
        assert sum(s["last_word"] - s["first_word"] + 1 for s in r["spans"]) == r["n_hit"]
        assert all(a["last_word"] + 1 < b["first_word"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))
    assert D.decontaminate(none, bench).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_drop_contaminated(spark, docs, none, part_bytes):
    base = odd.words(120, 1).split(" ")
    items = [("1", " ".join(base[10:40])), ("2", "One two"), (None, "ok"), ("3", None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = D.drop_contaminated(docs, bench, part_bytes=part_bytes)
    want = [str(r[0]) for r in odd.rows() if not plain_hits(r[1], items)[1]]
    assert got.columns == docs.columns and sorted(str(r["doc_id"]) for r in got.collect()) == sorted(want)
    assert D.drop_contaminated(none, bench).count() == 0 and D.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_components_of_chains_and_stars(spark):
    import random

    from sheetloom.llm.components import connected_components

    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(80)] + [(7, 7), (None, 3)]
    got = connected_components(spark.createDataFrame(pairs, "u long, v long"), Scratch(spark, "t"))
    want = plain_components([p for p in pairs if None not in p], {x for p in pairs for x in p if x is not None and p[0] != p[1] and None not in p})
    assert {g["node"]: g["component"] for g in got.collect()} == want and got.count() == len(want)
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


# 2


def test_near_vectors(spark):
    random = np.random.default_rng(5)
    base = random.normal(size=(30, 8))
    data = [(i, (base[i % 30] + random.normal(size=8) * (0.03 if i % 2 else 0.3)).tolist(), i % 3) for i in range(240)]
    data += [(600 + i, data[9][1], 0) for i in range(70)] + [(100, data[9][1], 0), (700, data[7][1], 2), (2, data[9][1], None), (699, [1.0, None] * 4, 2)]
    data += [(500, None, 1), (501, [0.0] * 8, 1), (502, [1.0, None] * 4, 1), (503, [float("nan")] * 8, 1), (504, data[3][1], None), (505, [], 1), (506, [float("inf")] * 8, 0), (507, base[0].tolist()[:4], 0), (None, data[1][1], 1), (3, data[3][1], 0), (3, data[6][1], 0), (508, (np.array(data[9][1]) * 1e200).tolist(), 0), data[5], data[5], (None, data[1][1], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumns({"row": F.lit(1), "pivot": F.lit(2)})
    distinct = list(dict.fromkeys((i, None if e is None else tuple(e), lab) for i, e, lab in data))
    good = [k for k, (i, e, lab) in enumerate(distinct) if i is not None and lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    unit = {k: np.array(distinct[k][1]) / np.abs(distinct[k][1]).max() for k in good}
    links = collections.defaultdict(set)
    for a in good:
        for b in good:
            x, y = unit[a], unit[b]
            if a != b and distinct[a][2] == distinct[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a].add(b)
    root = {i: i for i, *_ in distinct}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in links:
        for b in links[a]:
            x, y = sorted((find(distinct[a][0]), find(distinct[b][0])))
            root[y] = x
    times = collections.Counter((i, None if e is None else tuple(e), lab) for i, e, lab in data)
    want = sorted((str(i), len(links[k]), str(find(i)) if i is not None else "None") for k, (i, e, lab) in enumerate(distinct) for _ in range(times[i, e, lab]))
    for cell, block in ((2000, 2048), (10, 16)):
        got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in vectors.near_vectors(df, cell=cell, block=block).collect())
        assert [g for g in got if g[0] != "None"] == [w for w in want if w[0] != "None"]
        assert len(got) == len(want)
    assert vectors.near_vectors(df.limit(0)).count() == 0


# 3


def test_urls(spark, data):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "t.org", "/")]
    odd_urls = [None, "", "nothing", "http://A.Example.COM/en/8", "http://a.example.com/en/7x?y=/en/9", "x://com", "x://com/en/", "x://xcom/en/", "x://h?q", "x://h#f://com/en/1", "http://b.t.org", "http://b.t.org/q#z", "x://é.com/en/", "x://y/" + "a/" * 5000, "http://one://com/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(odd_urls)] + [(None, "x://q.com/en/1", None)] * 2, "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge_urls(pages, rules).collect()}
    assert urls.judge_urls(pages, rules).count() == len(odd_urls) + 2
    shown = {odd_urls[k]: (r["host"], r["path"][:9], r["rule"], r["verdict"]) for k, r in got.items() if k is not None}
    assert shown[None] == shown["nothing"] == ("", "", None, "allow")
    assert shown["http://A.Example.COM/en/8"] == ("a.example.com", "/en/8", "com/en/", "block")
    assert shown["http://a.example.com/en/7x?y=/en/9"] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert shown["x://com"] == ("com", "", None, "allow") and shown["x://com/en/"][2:] == ("com/en/", "block") and shown["x://xcom/en/"][2] is None
    assert shown["x://h?q"][:2] == ("h", "") and shown["x://h#f://com/en/1"][:2] == ("h", "")
    assert shown["http://b.t.org"][2] is None and shown["http://b.t.org/q#z"][2:] == ("t.org/", "block")
    assert urls.judge_urls(pages.limit(0), rules).count() == 0


def plain_wildcard(x):
    stem, end = re.fullmatch(r"(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?", x, re.S).groups()
    return ("" if x == "" else "{n}" if re.fullmatch("[0-9]+", stem) else "{w}" if re.fullmatch("[A-Za-z]+", stem) else "{x}") + (end or "")


def plain_templates(rows, at, template, out):
    """rows: (segments, key, pages, labelled, blocked) of one node; fills out with key: template."""
    total, values = sum(r[2] for r in rows), collections.Counter()
    for r in rows:
        values[r[0][at]] += r[2]
    branches = collections.defaultdict(list)
    for r in rows:
        x = r[0][at]
        branches["/" + (x if values[x] >= 4 and values[x] >= total * urls.LEAST_SHARE else plain_wildcard(x))].append(r)
    rest = lambda r: "".join("/" + plain_wildcard(x) for x in r[0][at + 1 :])
    seen = {}
    for b, own in branches.items():
        shapes = collections.Counter()
        for r in own:
            shapes[rest(r)] += r[2]
        seen[b] = [sum(r[k] for r in own) for k in (2, 3, 4)] + [shapes]

    def alike(b, c):
        (n, lab, bad, x), (m, lab2, bad2, y) = seen[b], seen[c]
        if lab and lab2 and abs(bad / lab - bad2 / lab2) > urls.PURITY_APART:
            return False
        return 1 - sum(min(v * m, y[k] * n) for k, v in x.items()) / (n * m) <= urls.APART + 1 / n**0.5

    roots, joined = [], {}
    for b in sorted((b for b in seen if seen[b][0] >= 4 and seen[b][0] >= total * urls.LEAST_SHARE), key=lambda b: (-seen[b][0], b)):
        joined[b] = next((r for r in roots if alike(b, r)), b)
        roots += [b] * (joined[b] == b)
    nodes = collections.defaultdict(list)
    for b, own in branches.items():
        nodes[joined.get(b, b)] += own
    for root, own in nodes.items():
        more = []
        for r in own:
            if len(r[0]) <= at + 1:
                out[r[1]] = template + root
            elif sum(x[2] for x in own) < 4:
                out[r[1]] = template + root + rest(r)
            elif len(own) == 1:
                out[r[1]] = template + root + "".join("/" + x for x in r[0][at + 1 :])
            else:
                more.append(r)
        if more:
            plain_templates(more, at + 1, template + root, out)


def test_template_tree_of_deep_paths(spark):
    import random

    r = random.Random(33)
    kinds = [lambda: r.choice(["a", "b", "c"]), lambda: str(r.randrange(50)), lambda: f"x{r.randrange(9)}.html", lambda: r.choice(["shop", "news", ""])]
    data = []
    for i in range(900):
        depth = r.choice([1, 3, 6, 9])
        path = "/" + "/".join(kinds[(i + k // 2) % 4]() for k in range(depth))
        data.append((i, f"http://h{r.choice([0, 0, 0, 1, 2])}.net{path}"))
    data += [(2000 + i, "http://h1.net/" + "deep/" * 300) for i in range(6)]
    rules = [("block", "h0.net", "/a"), ("allow", "h0.net", "/b"), ("block", "h1.net", "/shop"), ("block", "h2.net", "/1")]
    pages = spark.createDataFrame(data, "page_id long, url string")
    got = {x["page_id"]: x for x in urls.judge_urls(pages, rules).collect()}
    seen = collections.defaultdict(lambda: [0, 0, 0])
    for x in got.values():
        for k, v in enumerate((1, x["rule"] is not None, x["rule"] is not None and x["verdict"] == "block")):
            seen[x["host"], x["path"]][k] += v
    want = {}
    for host in {h for h, _ in seen}:
        plain_templates([(re.sub("^/", "", p).split("/"), (h, p), *v) for (h, p), v in seen.items() if h == host], 0, "", want)
    paths = spark.createDataFrame([(h, p, *v) for (h, p), v in seen.items()], "host string, path string, n long, labelled long, blocked long")
    tree = {(x["host"], x["path"]): x["template"] for x in urls.template_tree(paths, Scratch(spark, "t")).collect()}
    assert tree == want and max(t.count("/") for t in want.values()) > 4
    rate = sum(v[2] for v in seen.values()) / sum(v[1] for v in seen.values())
    for x in got.values():
        if x["rule"] is None:
            mine = [v for k, v in seen.items() if k[0] == x["host"] and want[k] == want[x["host"], x["path"]]]
            n, lab, bad = (sum(v[k] for v in mine) for k in range(3))
            hl, hb = (sum(v[k] for key, v in seen.items() if key[0] == x["host"]) for k in (1, 2))
            purity = (bad + 4 * (hb + 4 * rate) / (hl + 4)) / (lab + 4)
            assert x["verdict"] == ("block" if lab and lab >= 0.2 * n and purity >= 0.8 else "allow")


def test_pages_without_a_rule_are_rejected_in_mostly_blocked_templates(spark, data):
    got = queries.op3_urls(spark, data.replace("sf0.001", "sf0.1")).filter("rule is null and verdict = 'block'")
    assert got.count() > 100
    few = [(i, f"http://s.net/{'en' if i % 3 else 'de'}/{i}") for i in range(300)]
    bad = urls.judge_urls(spark.createDataFrame(few, "page_id long, url string"), [("block", "s.net", "/en")])
    assert bad.filter("path like '/de%' and verdict = 'block'").count() == 100
    good = urls.judge_urls(spark.createDataFrame(few, "page_id long, url string"), [("allow", "s.net", "/en")])
    assert good.filter("verdict = 'block'").count() == 0


# 4


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def plain_set(text):
    words = [w for w in re.split(r"[ \t-\r]+", (text or "").translate(LOWER)) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_near_duplicates(spark, docs, none):
    import random

    r = random.Random(4)
    base = [odd.words(100 + 20 * k, 50 + k).split(" ") for k in range(3)]
    data = [(x[0], x[1]) for x in odd.rows()]
    for i in range(150):  # copies with zero to five words changed: some linked, some not, some by a chain
        w = list(base[i % 3])
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"q{r.randrange(5)}"
        data.append((1000 + i, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"component": F.lit(1), "rep": F.lit(2)})
    sets = [(i, plain_set(t)) for i, t in data]
    ids = {i for i, _ in data if i is not None}
    pairs = [(a, b) for a, x in sets for b, y in sets if a is not None and b is not None and a < b and x and y and 100 * len(x & y) >= 85 * len(x | y)]
    want = plain_components(pairs, ids)
    got = minhash.near_duplicates(df).collect()
    assert sorted((str(i), len(s)) for i, s in sets) == sorted((str(g["doc_id"]), g["n_shingles"]) for g in got)
    assert all(g["component_id"] == want.get(g["doc_id"]) and g["kept"] == (g["doc_id"] is None or want[g["doc_id"]] == g["doc_id"]) for g in got)
    assert minhash.near_duplicates(none).count() == 0


# 5 and 9


def test_folding():
    assert toxicity.fold("ІDІОТ 1d10t ｉｄｉｏｔ id!ot ïdïot i\u200bdiot m0r0n") == "idiot idiot idiot idiot idiot idiot moron"


def test_lexicon_and_exceptions(spark):
    rows = [(i, "you idiot go", 1) for i in range(60)] + [(100 + i, f"good day {i}", 0) for i in range(60)] + [(200 + i, f"an idiot savant {i}", 0) for i in range(9)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn_lexicon(labelled)
    assert "idiot" in lexicon.weights or "you" in lexicon.weights
    named = toxicity.Lexicon({"idiot": 3.0}, {"idiot savant"})
    assert named.measure("an 1diot and idiots")[:2] == (3.0, 1) and named.measure("an idiot savant")[:2] == (0, 0) and named.measure("")[1] == 0


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_held_out(spark, data, name):
    n = "op5_toxicity" if name == "toxic" else "op9_quality"
    sf = data.replace("sf0.001", "sf0.01")
    got = queries.QUERIES[n](spark, sf).toPandas()
    want = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(got, on="doc_id")
    want = want[want["held_out"]]
    assert (got["score"].between(0, 1)).all() and (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert (want[name] == want["predicted"]).mean() > 0.93


def test_scores_of_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 19)] + [(None, 1, 1), (1, None, None), (1, 0, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    for score in (lambda d, x: toxicity.score_toxicity(d, x).withColumnRenamed("toxicity", "score"), quality.score_quality):
        got = score(docs, labels)
        assert got.count() == docs.count() and got.filter("score is null or score < 0 or score > 1").count() == 0
        assert score(none, labels).count() == 0 and score(docs, labels.limit(0)).count() == docs.count()
    assert set(toxicity.score_toxicity(docs, labels).columns) == {*docs.columns, "toxicity"}


def test_dual_coordinate_descent_parts_classes():
    random = np.random.default_rng(2)
    y = random.integers(0, 2, 300)
    rows = [np.unique(np.concatenate([random.integers(0, 50, 8), random.integers(60, 70, 3) + 10 * k])).astype(np.int32) for k in y]
    model = quality.NBSVM(8).fit(rows, y)
    flat, bounds = np.concatenate(rows), np.append(0, np.cumsum([len(r) for r in rows]))
    assert ((model.score(flat, bounds) >= 0.5) == y).mean() > 0.95


# 6


def plain_removal(texts, length):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone |= set(range(i, i + length))
        out.append((len(t), len(gone), sum(g - 1 not in gone for g in gone), hashlib.sha256(bytes(b for k, b in enumerate(t) if k not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("group", [8192, 1])
def test_remove_repeats(spark, docs, none, group):
    got = substrings.remove_repeats(docs, group=group).select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("h")).collect()
    texts = [(t or "").encode() for _, t, *_ in odd.rows()]
    want = [(str(d[0]), *p) for d, p in zip(odd.rows(), plain_removal(texts, 200), strict=True)]
    assert sorted((str(g[0]), *g[1:]) for g in got) == sorted(want)
    assert substrings.remove_repeats(none).count() == 0


def test_column_wise_construction():
    r = np.random.default_rng(66)
    texts = [bytes(r.integers(97, 100, n).astype(np.uint8)) for n in r.integers(1, 30, 40)]
    first, group = r.integers(-6, 7, 40), np.sort(r.integers(0, 3, 40))
    sizes = np.array([len(t) for t in texts])
    columns = {c: rest for c, *rest in substrings.insert_columns(group, first, sizes, texts)}
    for c in range(first.min(), (first + sizes).max()):
        held = [k for k in range(40) if first[k] <= c < first[k] + sizes[k]]
        if not held:
            continue
        order, common, symbols = columns[c]
        suffix = [texts[k][c - first[k] :] for k in order]
        assert sorted(order.tolist()) == held and [(group[k], s) for k, s in zip(order, suffix, strict=True)] == sorted((group[k], s) for k, s in zip(order, suffix, strict=True))
        assert common[0] == 0 and all(common[i] == (plain_common(suffix[i - 1], suffix[i]) if group[order[i]] == group[order[i - 1]] else 0) for i in range(1, len(order)))
        assert symbols.tolist() == [texts[k][c - first[k] - 1] if c > first[k] else 0 for k in order]


def test_remove_repeats_in_random_text(spark):
    import random

    r = random.Random(9)
    pieces = ["".join(r.choice("abé ") for _ in range(r.randrange(20, 90))) for _ in range(12)]
    data = [(i, "".join(r.choice(pieces) for _ in range(r.randrange(12)))) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for length, group in ((40, 8192), (40, 2), (100, 1)):
        got = substrings.remove_repeats(df, length, group).select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("h")).orderBy("doc_id").collect()
        assert [tuple(g[1:]) for g in got] == plain_removal([t.encode() for _, t in data], length)


# 7


def test_mixing_meets_targets(spark, docs, none):
    rows = [(i, ("red apple " if i % 4 else "blue sky ") * (5 + i % 7) + odd.words(5, i)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rate", F.lit(9))
    labels = spark.createDataFrame([(i, "fruit" if i % 4 else "air") for i in range(100)] + [(None, "air"), (3, None)], "doc_id long, domain string")
    got = mixing.mix(df, labels, {"fruit": 0.5, "air": 0.5}).toPandas()
    tokens = got["n_tokens"] * got["rate"]
    assert abs((tokens * got["p_air"]).sum() / got["n_tokens"].sum() - 0.5) < 0.01 and (got["rate"] >= 0).all() and len(got) == 200
    kept = mixing.sample(df, mixing.mix(df, labels, {"fruit": 0.5, "air": 0.5}))
    assert kept.columns == df.columns and 100 < kept.count() < 300
    everything = mixing.mix(docs, labels, {"fruit": 0.7, "air": 0.3})
    assert everything.count() == docs.count() and everything.filter("rate is null or rate < 0").count() == 0
    assert mixing.mix(none, labels, {"fruit": 1.0}).count() == 0 and mixing.mix(docs, labels.limit(0), {"fruit": 1.0}).count() == docs.count()


def test_rates_solve_the_least_squares(spark):
    random = np.random.default_rng(6)
    p = random.dirichlet([0.3, 0.3, 0.3], 80)
    n = random.integers(1, 50, 80)
    members = spark.createDataFrame([(i, 1, int(n[i]), p[i].tolist()) for i in range(80)], "doc_id long, rows long, n_tokens long, posterior array<double>")
    got = mixing.solve_rates(members, [0.6, 0.3, 0.1], Scratch(spark, "t")).orderBy("doc_id").toPandas()["rate"].to_numpy()
    rate = np.ones(80)
    weigh = 1 / np.maximum([0.6, 0.3, 0.1], 0.02)
    for _ in range(20000):  # the same objective, small steps
        residual = (rate * n) @ p / n.sum() - [0.6, 0.3, 0.1]
        rate = np.maximum(0, rate - 0.05 * (p @ (weigh * residual) + mixing.PULL * (rate - 1)))
    assert np.abs((got * n) @ p / n.sum() - [0.6, 0.3, 0.1]).max() < 0.01 and np.abs(got - rate).max() < 0.25


# 8


def test_huffman_round_trip():
    random = np.random.default_rng(8)
    for n, longest in ((1, 20), (2, 20), (40, 6), (3000, 14)):
        counts = np.zeros(n + 5, np.int64)
        counts[:n] = np.maximum(1, (1e6 / (1 + np.arange(n)) ** 2).astype(int))
        lengths = huffman.code_lengths(counts, longest)
        assert lengths.max() <= longest and sum(2.0 ** -int(x) for x in lengths if x) <= 1
        ids = [random.integers(0, n, k) for k in (5000, 1, 1024, 1025)]
        packed = [huffman.pack(x, lengths, huffman.canonical(lengths)) for x in ids]
        back = huffman.Table(lengths).unpack([p[0] for p in packed], [p[1] for p in packed], [len(x) for x in ids])
        assert all((a == b).all() for a, b in zip(ids, back, strict=True))


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    special = spark.createDataFrame([(70, "a<|endoftext|>b <|ENDOFTEXT|> it's DON'T x,y;\u2003ΣΑΣ İx e\u0301 %%a.b")], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(special)
    path = str(tmp_path / "f")
    token_files.write_tokens(table, queries.tokenizer_path(), path, block_ids=500)
    got = token_files.read_tokens(spark, path).collect()
    library = Tokenizer.from_file(queries.tokenizer_path())
    want = collections.Counter()
    for r in table.collect():
        want[r["doc_id"], tuple([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2])] += 1
    assert collections.Counter((g["doc_id"], tuple(np.frombuffer(g["ids"], "<u4").tolist())) for g in got) == want
    got.sort(key=lambda g: g["start"])
    assert [g["start"] for g in got] == np.append(0, np.cumsum([g["n_tokens"] for g in got]))[:-1].tolist()
    ids = [g["doc_id"] for g in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert all(g["ids_crc32"] == zlib.crc32(g["ids"]) and g["n_tokens"] * 4 == len(g["ids"]) for g in got)
    token_files.write_tokens(none, queries.tokenizer_path(), str(tmp_path / "e"))
    assert token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0


# 10


def plain_common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def plain_lines(data, least):
    order = sorted({(i if i is not None else -(1 << 63), t) for i, t in data if t is not None}, key=lambda x: x[0])
    first, gone = {}, collections.defaultdict(set)
    for key in order:
        own = [x.strip(" \t\r") for x in key[1].split("\n")]
        own = [x for x in own if x]
        for i in range(len(own)):
            ends = [j for j in range(i + 1, len(own) + 1) if sum(map(len, own[i:j])) >= least]
            if ends:
                other, at = first.setdefault(tuple(own[i : ends[0]]), (own, i))
                if (other, at) != (own, i) or other is not own:
                    gone[key] |= set(range(i, i + plain_common(own[i:], other[at:])))
    return gone


@pytest.mark.parametrize("least", [1, 5, 40])
def test_lines(spark, docs, none, least):
    data = [(r[0], r[1]) for r in odd.rows() if r[0] not in (18,)] + [(40 + i, "\n".join(f"l{(i * k) % 5}" for k in range(9))) for i in range(12)]
    data += [(60, "\n".join(odd.words(6, 80 + k) for k in range(30))), (61, "x\n" + "\n".join(odd.words(6, 80 + k) for k in range(3, 28)) + "\nend"), (62, "\n".join(["again"] * 40))]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"pos": F.lit(1), "rank": F.lit(1)})
    gone = plain_lines(data, least)
    got = lines.remove_repeated_lines(df, least).collect()
    want = []
    for i, t in data:
        drop = gone[i if i is not None else -(1 << 63), t] if t is not None else set()
        kept, k = [], -1
        for x in t.split("\n") if t is not None else []:
            if x.strip(" \t\r"):
                k += 1
                if k in drop:
                    continue
            kept.append(x)
        want.append((str(i), len(t.split("\n")) if t is not None else 0, len(drop), "\n".join(kept) if t is not None else None))
    key = lambda x: (x[0], x[1], x[2], x[3] or "")
    assert sorted(((str(g["doc_id"]), g["n_lines"], g["n_removed"], g["kept"]) for g in got), key=key) == sorted(want, key=key)
    assert lines.remove_repeated_lines(none, least).count() == 0


def test_suffix_array_of_lines(spark):
    r = np.random.default_rng(10)
    texts = {i: [f"v{k}" for k in r.integers(0, 3, 25)] for i in range(5)} | {9: ["v0", "v1"] * 20}
    df = spark.createDataFrame([(i, "\n".join(t), 0) for i, t in texts.items()], "doc_id long, text string, row long")
    scratch = Scratch(spark, "t")
    rounds = lines.line_ranks(scratch.write(lines.line_table(df, 1), "l"), scratch)
    suffixes = [(d, p) for d, t in texts.items() for p in range(len(t))]
    for j, ranks in enumerate(rounds):
        got = {(x["doc"], x["pos"]): x["rank"] for x in ranks.collect()}
        run = lambda s, n=1 << j: tuple(texts[s[0]][s[1] : s[1] + n])
        count = collections.Counter(run(s) for s in suffixes if len(run(s)) == 1 << j)
        assert set(got) == {s for s in suffixes if count[run(s)] > 1}
        assert len(set(got.values())) == len({run(s) for s in got}) == len({(got[s], run(s)) for s in got})
        if j:  # order by the first half, then by the second
            assert all((got[a] < got[b]) == (half[a] < half[b] or (half[a] == half[b] and half[a[0], a[1] + (1 << j - 1)] < half[b[0], b[1] + (1 << j - 1)])) for a in list(got)[:30] for b in got if got[a] != got[b])
        half = got
    assert 1 << len(rounds) > max(plain_common(texts[a][i:], texts[b][k:]) for a, i in suffixes for b, k in suffixes if (a, i) != (b, k))
    pairs = [(*suffixes[a], 0, *suffixes[b], 0) for a, b in r.integers(0, len(suffixes), (200, 2)).tolist()]
    found = lines.common_lines(spark.createDataFrame(pairs, "doc long, pos int, row long, doc2 long, pos2 int, row2 long"), rounds, scratch)
    assert all(x["common"] == plain_common(texts[x["doc"]][x["pos"] :], texts[x["doc2"]][x["pos2"] :]) or (x["doc"], x["pos"]) == (x["doc2"], x["pos2"]) for x in found.collect())


# the pipeline


def test_pipeline(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    source = spark.read.parquet(f"{data}/documents.parquet")
    columns, docs, scratch = source.columns, source, Scratch(spark, "t")
    after = {}
    for name, stage in P.STAGES:
        before = docs
        docs = scratch.write(stage(spark, docs, data), name)
        after[name] = docs
        if name != "token_files":
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "minhash":
            sets = {r["doc_id"]: plain_set(r["text"]) for r in before.collect()}
            pairs = [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and x and y and 100 * len(x & y) >= P.SIMILAR * len(x | y)]
            want = {a for a, b in plain_components(pairs, sets).items() if a == b}
            assert {r["doc_id"] for r in docs.collect()} == want
        if name == "decontaminate":
            items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            want = {r["doc_id"] for r in before.collect() if not plain_hits(r["text"], items)[1]}
            assert {r["doc_id"] for r in docs.collect()} == want
    library = Tokenizer.from_file(queries.tokenizer_path())
    start = 0
    rows = sorted(after["mixing"].collect(), key=lambda r: r["doc_id"])
    for r, g in zip(rows, sorted(docs.collect(), key=lambda g: g["start"]), strict=True):
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    toxic = spark.read.parquet(f"{data}/labels.parquet")
    before = source.join(toxic, "doc_id").filter("toxic = 1").count()
    assert after["toxicity"].join(toxic, "doc_id").filter("toxic = 1").count() <= 0.3 * before
    clean = source.join(toxic, "doc_id").filter("toxic = 0 and quality = 1").count()
    assert after["toxicity"].join(toxic, "doc_id").filter("toxic = 0 and quality = 1").count() >= 0.97 * clean


def test_toxic_stems(spark):
    from sheetloom.llm.toxicity import Lexicon, learn_lexicon

    lexicon = Lexicon({"scum": 2.0, "achlich*": 1.0, "achliche*": 3.0}, {"no scum"})
    assert lexicon.measure("scum scums achlichs Achlichen machlich") == (6.0, 3, 5)
    assert lexicon.measure("no scum")[:2] == (0.0, 0)
    assert lexicon.measure("no achlich")[:2] == (1.0, 1)
    ends = ["al", "bo", "cu", "da", "er", "fi", "go", "ha", "il", "ju"]
    toxic = [(f"plain w{a} vrak{a}{b} and vrak{b}{a}", 1) for a in ends for b in ends if a != b]
    clean = [(f"plain w{a} words{b} and more", 0) for a in ends for b in ends]
    weights = learn_lexicon(spark.createDataFrame(toxic + clean, "text string, toxic int")).weights
    assert "vrak*" in weights and not any(w.startswith(("plain", "w", "and")) for w in weights)
