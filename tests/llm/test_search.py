"""Clustering, inner products and lexical search against plain versions, over odd rows and empty tables."""

import collections
import hashlib
import math
import re

import numpy as np
from pyspark.sql import functions as F

from sheetloom.llm import clusters, lexical, products

from . import odd

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VECTORS = "vec_id long, embedding array<double>, label int, cluster int, row long, n long, dims int"


def vectors(spark, n, dims, seed, odd_rows=True, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dims)) * spread
    data = [(i, (centres[i % 12] + r.normal(size=dims) * 0.2).tolist(), i % 3) for i in range(n)]
    if odd_rows:
        same = data[5][1]
        data += [(1000 + i, same, 1) for i in range(60)] + [data[7], data[7], (data[8][0], data[9][1], 1), (None, data[3][1], 1), (-40, data[4][1], None)]
        data += [(2000, None, 1), (2001, [], 1), (2002, [None] * dims, 1), (2003, [float("nan")] * dims, 1), (2004, [float("inf")] + [0.0] * (dims - 1), 1), (2020, [0.0] * dims, 1), (2040, same[:4], 1), (2041, same[:4], 1)]
    return data, spark.createDataFrame([(*d, 9, 9, 9, 9) for d in data], VECTORS)


def ints(v, scale):
    return [math.floor(scale * x) for x in v]


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def plain_clusters(data, dims, k=8, rounds=10):
    rows = [(i, ints(v, 1024)) for i, v, *_ in data if good(v) and len(v) == dims]
    first = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in rows)[:k]
    centroids = [v for _, v in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        held = collections.defaultdict(list)
        for _, v in rows:
            held[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(held[n]) for x in zip(*held[n], strict=True)] if n in held else c for n, c in enumerate(centroids)]
    out = [(i, *nearest(v)) for i, v in rows]
    own = collections.Counter()
    for _, d, c in out:
        own[c] += d
    return collections.Counter((i, c, d, own[c], sum(own.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in out)


def test_clusters(spark):
    for dims, spread in ((64, 1.0), (8, 3.0)):
        data, df = vectors(spark, 150, dims, dims, spread=spread)
        got = clusters.cluster_vectors(df.repartition(3), dims=dims, segments=min(dims, 16)).collect()
        assert collections.Counter(map(tuple, got)) == plain_clusters(data, dims)
        assert got[0].asDict().keys() == {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"}
    assert clusters.cluster_vectors(df.limit(0)).count() == 0
    few = clusters.cluster_vectors(df.filter("vec_id in (1, 2, 7)"), dims=8, segments=4).collect()
    assert collections.Counter(map(tuple, few)) == plain_clusters([d for d in data if d[0] in (1, 2, 7)], 8)


def test_segment_norms_screen_centroids_and_lose_none():
    r = np.random.default_rng(4)
    c = (r.normal(size=(32, 16, 4)) * (r.random((32, 16, 1)) < 0.3) * 1000).astype(np.int64).reshape(32, 64)  # each has length in some segments
    x = c[r.integers(0, 32, 400)] + r.integers(-99, 100, (400, 64))
    which, distance, exact = clusters.nearest(x, clusters.segment_norms(x, 16), c)
    every = ((x[:, None] - c) ** 2).sum(2)
    assert (which == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert exact < every.size / 8
    wide = np.array([[3_000_000] * 4, [-3_000_001] * 4])
    assert (clusters.segment_norms(wide, 4) == abs(wide)).all() and clusters.segment_norms(np.array([[1, 1, 0, 0]]), 2).tolist() == [[2, 0]]


def plain_products(data, ask, k, scale=64):
    rows = sorted({(i, tuple(ints(v, scale))) for i, v, *_ in data if i is not None and good(v)})
    out = collections.Counter()
    for q, v in rows:
        if ask(q):
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))
            out.update((q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k]))
    return out


def test_products(spark):
    data, df = vectors(spark, 160, 16, 3)
    for size, head in ((4096, 1024), (13, 5), (40, 60)):
        got = products.top_products(df.repartition(4), F.col("vec_id") % 20 == 0, candidates=size, queries=7 if size < 100 else 4096, head=head)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert collections.Counter(map(tuple, got.collect())) == plain_products(data, lambda i: i % 20 == 0, 20)
    assert products.top_products(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = products.top_products(df.filter("vec_id in (20, 21, 22)"), F.col("vec_id") == 20)
    assert collections.Counter(map(tuple, few.collect())) == plain_products([d for d in data if d[0] in (20, 21, 22)], lambda i: i == 20, 20)


def test_lengths_and_axes_prune_products_and_lose_none():
    r = np.random.default_rng(8)
    shape = np.linalg.qr(r.normal(size=(32, 32)))[0]
    raw = (r.normal(size=(3000, 32)) * 0.6 ** np.arange(32)) @ shape * r.lognormal(0, 1, size=(3000, 1))
    x = np.floor(64 * raw).astype(np.int64)
    q, ids = x[::20], np.arange(3000)
    least = np.full(len(q), np.iinfo(np.int64).min)
    at, found, score, computed = products.best_products(q, ids[::20], least, x, ids, products.axes(x.astype(np.float64)), 20)
    assert computed < len(q) * len(x) / 5
    every = q @ x.T
    every[np.arange(len(q)), ids[::20]] = np.iinfo(np.int64).min + 1
    for n in range(len(q)):
        want = sorted(zip((-every[n]).tolist(), ids.tolist(), strict=True))[:20]
        assert list(zip((-score[at == n]).tolist(), found[at == n].tolist(), strict=True)) == want
    huge = x * (1 << 22)  # sums beyond what floats hold
    at, found, score, _ = products.best_products(huge[:3] + 1, ids[:3], least[:3], huge, ids, None, 5)
    for n in range(3):
        exact = sorted((-sum(int(a) * int(b) for a, b in zip(huge[n] + 1, v, strict=True)), i) for i, v in enumerate(huge[:3000]) if i != n)[:5]
        assert list(zip((-score[at == n]).tolist(), found[at == n].tolist(), strict=True)) == exact


def plain_ranks(docs, items, k=10):
    of = lambda t: TERM.findall((t or "").translate(LOWER))
    texts = [(d, of(t)) for d, t in docs]
    n, total = sum(1 for _, w in texts if w), sum(len(w) for _, w in texts)
    df = collections.Counter(t for _, w in texts for t in set(w))
    asked = collections.defaultdict(list)
    for i, t in items:
        if i is not None:
            asked[i] += of(t)
    out = collections.Counter()
    for i, own in asked.items():
        scores = []
        for d, w in texts:
            tf, score = collections.Counter(w), 0
            for t in own:
                if tf[t]:
                    m = 100 - 75 + (75 * len(w) * n) // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score:
                scores.append((-score, d is not None, d or 0))
        out.update((i, r + 1, d if there else None, -s) for r, (s, there, d) in enumerate(sorted(scores)[:k]))
    return out


def test_ranked_search(spark):
    base = odd.words(120, 1).split(" ")
    items = [(7, " ".join(base[10:40])), (30, " ".join(base[35:50]).upper() + " one ONE"), (30, "ok naïve"), (4, None), (5, ""), (None, "one two"), (8, "nowhere-to-be-found"), (9, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "term": F.lit("x"), "uid": F.lit(2)})
    docs = odd.documents(spark)
    want = plain_ranks([(d, t) for d, t, *_ in odd.rows()], items)
    for bytes_ in (lexical.BROADCAST_BYTES, 10):  # postings of the wanted terms, and of all
        got = lexical.rank_documents(docs.repartition(3), bench, broadcast_bytes=bytes_)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert collections.Counter(map(tuple, got.collect())) == want
    assert lexical.rank_documents(docs.limit(0), bench).count() == 0 and lexical.rank_documents(docs, bench.limit(0)).count() == 0


def test_search_counts_a_very_long_text_and_a_term_of_most_documents(spark):
    texts = [(i, "common " + odd.words(6, i)) for i in range(900)] + [(5000, "common tail " * 400_000 + "rare")]
    items = [(1, "common"), (2, "rare tail"), (3, odd.words(6, 17))]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_ranks(texts, items)
    for bytes_ in (lexical.BROADCAST_BYTES, 10):
        assert collections.Counter(map(tuple, lexical.rank_documents(docs, bench, broadcast_bytes=bytes_).collect())) == want


def test_terms_of_one_hash_are_told_apart():
    data = np.frombuffer(b"one two one six two", np.uint8)
    starts, ends = np.array([0, 4, 8, 12, 16]), np.array([3, 7, 11, 15, 19])
    at, code = lexical._codes(data, starts, ends, np.ones(5, np.uint64))
    assert [data[starts[at[c]] : ends[at[c]]].tobytes() for c in code] == [b"one", b"two", b"one", b"six", b"two"]
