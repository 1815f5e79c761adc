"""A benchmark in several parts gives the same rows as one in a single part."""

import collections

import numpy as np

from sheetloom.llm import components, tables, toxicity, vectors
from sheetloom.llm import decontaminate as D

from . import odd


def test_repeated_rows_come_out_each(spark):
    docs = odd.documents(spark)
    docs = docs.union(docs.filter("doc_id in (1, 8) or doc_id is null")).union(docs.filter("doc_id is null"))
    base = odd.words(120, 1).split(" ")
    items = [("7", " ".join(base[10:40])), ("30", " ".join(base[35:50])), ("a", "One two"), ("z", " ".join(base[60:74]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = {
        size: collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), str(r["spans"])) for r in D.decontaminate(docs, bench, part_bytes=size).collect())
        for size in (1 << 20, 200, 40)
    }
    assert sum(rows[1 << 20].values()) == docs.count()
    assert rows[200] == rows[1 << 20] and rows[40] == rows[1 << 20]


def test_minimizers_are_told_apart_by_all_bits():
    """Minima crowd near zero, so that 41 bits would bring different grams together; the whole hash does not."""
    import numpy as np

    from sheetloom.llm import substrings
    from sheetloom.llm.tokens import Block

    data = np.random.default_rng(12).integers(32, 127, 600_000).astype(np.uint8)
    block = Block(0, data, np.array([0, len(data)]))
    _, start, n, minimizer, _, distance = substrings.segments(block, 200)
    grams = {bytes(data[a : a + 16]) for a in (start + distance).tolist()}
    assert len(np.unique(minimizer)) == len(grams) > 5000
    # at a width narrowed by 46 bits, hashes still tell the grams apart, where the leading bits of minima no longer do
    low, high = minimizer & np.uint64((1 << 18) - 1), minimizer >> np.uint64(46)
    assert len(np.unique(low)) > 0.95 * len(grams) and len(np.unique(high)) < 0.6 * len(grams)


def test_lines_of_one_hash_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sheetloom.llm import lines

    shared = "a line that repeats and is long enough to count by itself"
    data = [(i, f"line number {i} of its own, longer than forty characters\n{shared}\n{i} other words, also of more than forty characters") for i in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    whole = lines.line_hashes
    monkeypatch.setattr(lines, "line_hashes", lambda text: (F.lit(7).cast("long"), whole(text)[1]))
    got = {r["doc_id"]: r["n_removed"] for r in lines.remove_repeated_lines(df).collect()}
    assert got == {i: int(i > 0) for i in range(30)}


def test_fits_do_not_hang_on_the_order_of_rows(spark):
    """Equal texts with different labels, and rows that share an id."""
    from sheetloom.llm import quality, toxicity

    from . import odd

    texts = [odd.words(30, i, 40) + (" vile" * (i % 3)) for i in range(40)]
    data = [(i % 60, texts[i % 40] if i < 110 else texts[0]) for i in range(120)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(60)], "doc_id long, quality int, toxic int")
    seen = set()
    for n in (1, 3, 7):
        rows = docs.repartition(n, "text" if n == 3 else "doc_id")
        q = quality.quality_model(rows, labels.repartition(n))
        lexicon, curve = toxicity.toxicity_model(rows, labels)
        seen.add((q.weights.round(12).tobytes(), round(q.bias, 12), tuple(sorted((k, round(v, 12)) for k, v in lexicon.weights.items())), tuple(curve.round(9))))
    assert len(seen) == 1
    assert quality.sum_until([(1, 5), (3, 5), (9, 5)], 11) == 3 and quality.sum_until([], 5) == 0 and quality.sum_until([(4, 50)], 5) == 4


def test_mixing_starts_no_python_workers(spark, data):
    from sheetloom.llm import mixing
    from sheetloom.llm.tables import Scratch

    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    plans = []

    class Seen(Scratch):
        def write(self, df, *args, **more):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().write(df, *args, **more)

    mixing.posteriors(docs, mixing.label_domains(labels), Seen(spark, "t"))
    assert plans and not any(w in p for p in plans for w in ("ExistingRDD", "Python", "Arrow", "BroadcastExchange"))


def test_components_of_nodes_with_many_links(spark, monkeypatch):
    monkeypatch.setattr(components, "LEAST_HEAVY", 20)
    monkeypatch.setattr(tables, "LEAST_HEAVY", 20)
    hub, late = [(500, k) for k in range(501, 900)], [(k, 2000) for k in range(1000, 1300)]
    chain = [(k, k + 1) for k in range(3000, 3020)]
    pairs = [*hub, *late, (700, 3010), *chain, (3, 900), (7, 7), (None, 4), (5000, 4999), (4999, 5000)]
    seen = []
    whole = components.spread_join
    monkeypatch.setattr(components, "spread_join", lambda *a, **k: seen.append(1) or whole(*a, **k))
    got = components.connected_components(spark.createDataFrame(pairs, "u long, v long"), tables.Scratch(spark, "test")).collect()
    near = {}
    for u, v in pairs:
        if u is not None and u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo.extend(near[x])
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want
    assert seen


def test_vectors_against_pivots_in_slices(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = r.normal(size=(12, 6))[r.integers(0, 12, 300)] + 0.05 * r.normal(size=(300, 6))
    rows = spark.createDataFrame([(k, str(k % 2), v.tolist()) for k, v in enumerate(x)], "vec_id long, label string, embedding array<double>")
    whole = sorted(vectors.near_vectors(rows, cell=20).collect())
    monkeypatch.setattr(vectors, "DISTANCES", 40)
    assert sorted(vectors.near_vectors(rows, cell=20).collect()) == whole
    assert any(row["n_links"] for row in whole)


def test_signs_at_an_edge_teach_both_readings():
    assert sorted(toxicity._words("pay $crew or c@t $")) == sorted(["pay", "crew", "or", "cat", "screw"])
    assert list(toxicity._words("plain words")) == ["plain", "words"]
