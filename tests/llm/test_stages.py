"""Stages of the pipeline over odd, repeated and no rows; very long texts; words that a linear hash cannot tell apart."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sheetloom.llm import decontaminate, lines, minhash, quality, queries, substrings, token_files

from . import odd

EXTRA = ["lang", "source", "n_chars", "row", "rate", "weight", "copies", "key", "spans"]


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stage_over_odd_and_repeated_rows(spark, data, name):
    stage = dict(P.STAGES)[name]
    docs = odd.documents(spark).cache()
    twice = docs.union(docs)
    for given in (docs, twice):
        got = stage(spark, given, data)
        before = collections.Counter((r["doc_id"], r["text"]) for r in given.collect())
        if name == "token_files":
            assert collections.Counter(r["doc_id"] for r in got.collect()) == collections.Counter(r["doc_id"] for r in given.collect())
            continue
        assert got.columns == given.columns
        after = collections.Counter((r["doc_id"], r["text"]) for r in got.collect())
        assert set(after) <= set(before)
        if name in ("toxicity", "decontaminate"):
            assert all(after[k] == before[k] for k in after)
        if name == "minhash":
            texts = [(k, t) for k, t in after.elements() if k is not None]
            assert len(texts) == len(set(texts)) and all(after[k] == before[k] for k in before if k[0] is None)
            assert {k for k, _ in texts} >= {1, 4, 5, 6, 9, 18} and not {k for k, _ in texts} & {2, 3}
    none = stage(spark, docs.limit(0), data)
    assert none.count() == 0 and (name == "token_files" or none.columns == docs.columns)


def test_mixing_stage_meets_its_shares(spark, data):
    sf = data.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = P.mix_domains(spark, docs, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 0")
    tokens = F.sum(F.size(F.split("text", r"\s+")))
    share = {r["quality"]: r["n"] for r in got.join(labels, "doc_id").groupBy("quality").agg(tokens.alias("n")).collect()}
    before = {r["quality"]: r["n"] for r in docs.join(labels, "doc_id").groupBy("quality").agg(tokens.alias("n")).collect()}
    low = lambda x: x.get(0, 0) / (x.get(0, 0) + x[1])
    assert low(share) < max(0.05, 0.5 * low(before)) and share[1] > 0.9 * before[1]


def thue_morse(n):
    bits = np.zeros(1, np.uint8)
    while len(bits) < n:
        bits = np.concatenate([bits, 1 - bits])
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_a_polynomial_hash_confuses(spark, tmp_path):
    x, y = thue_morse(1024)
    docs = spark.createDataFrame([(0, x), (1, y), (2, " ".join([x] * 3)), (3, f"q {y} r")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([("i", x)], "item_id string, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.decontaminate(docs, bench).collect()} == {0: 1, 1: 0, 2: 3, 3: 0}
    assert all(r["kept"] for r in minhash.near_duplicates(docs).collect())
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    token_files.write_tokens(docs, queries.tokenizer_path(), str(tmp_path / "t"))
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect()}
    assert got == {r["doc_id"]: [*library.encode(r["text"], add_special_tokens=False).ids, 2] for r in docs.collect()}
    ends = spark.createDataFrame([(i, "s" * 16 + t) for i, t in enumerate((x[:300], y[:300], x[:300]))], "doc_id long, text string")
    removed = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(ends).collect()}
    from .test_llm import plain_removal

    assert removed == {i: p[1] for i, p in enumerate(plain_removal([("s" * 16 + t).encode() for t in (x[:300], y[:300], x[:300])], 200))}


def test_whole_texts_where_words_cannot_be_cut(spark, tmp_path):
    """A tokenizer that keeps white space and capitals, so ids of words do not make up those of texts."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    plain = Tokenizer(models.WordLevel({"[UNK]": 0, "A": 1, "a": 2, "▁": 3, "b": 4}, unk_token="[UNK]"))
    plain.pre_tokenizer = pre_tokenizers.Metaspace()
    plain.save(str(tmp_path / "t.json"))
    encoder = token_files.WordIds((tmp_path / "t.json").read_text(), 2)
    assert not encoder.by_words
    texts = ["A a  b", "", "b", "a.a"]
    import pyarrow as pa

    from sheetloom.llm.tokens import blocks

    ids, size = encoder.encode(next(blocks(pa.array(texts))))
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_a_very_long_text(spark, tmp_path):
    r = np.random.default_rng(20)
    vocabulary = np.array([f"w{k:x}q" for k in range(20_000)])
    own = vocabulary[r.integers(0, 20_000, 3_300_000)].tolist()
    long, head = " ".join(own), " ".join(own[:40])
    text = "\n".join([long, head])
    assert len(text) > 20_000_000
    docs = spark.createDataFrame([(1, text), (2, text), (3, head), (4, " ".join(own[:200_000]))], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([("a", head), ("b", " ".join(own[-30:]))], "item_id string, text string")
    assert {x["doc_id"]: (x["n_words"], x["n_hit"]) for x in decontaminate.decontaminate(docs, bench).drop("spans").collect()} == {1: (3_300_040, 110), 2: (3_300_040, 110), 3: (40, 40), 4: (200_000, 40)}
    near = {x["doc_id"]: (x["component_id"], x["n_shingles"] > 30) for x in minhash.near_duplicates(docs).collect()}
    assert near == {1: (1, True), 2: (1, True), 3: (3, True), 4: (4, True)}
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, quality int")
    assert quality.score_quality(docs, labels).filter("score between 0 and 1").count() == 4
    removed = {x["doc_id"]: x["n_removed"] for x in substrings.remove_repeats(docs).drop("kept").collect()}
    assert removed[1] == removed[2] == len(text) and removed[3] == len(head) and removed[4] == len(" ".join(own[:200_000]))
    assert {x["doc_id"]: x["n_removed"] for x in lines.remove_repeated_lines(docs).drop("kept").collect()} == {1: 0, 2: 2, 3: 1, 4: 0}
    token_files.write_tokens(docs, queries.tokenizer_path(), str(tmp_path / "long"))
    got = {x["doc_id"]: x["n_tokens"] for x in token_files.read_tokens(spark, str(tmp_path / "long")).drop("ids").collect()}
    assert got[1] == got[2] > 3_300_000 and got[3] > 40
