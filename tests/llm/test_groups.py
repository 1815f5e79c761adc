"""A passage that many documents share, each in surroundings of its own."""

import collections
import random
import uuid

from pyspark.sql import functions as F

from sheetloom.llm import substrings

from .test_llm import plain_removal


def test_no_group_grows_with_the_documents_of_a_passage(spark, tmp_path, monkeypatch):
    r = random.Random(21)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, other = text(700), text(90)
    data = [(i, text(r.randrange(150, 300)) + passage + (other if i % 3 else "") + text(r.randrange(150, 300))) for i in range(60)]
    whole, sizes = substrings._build, tmp_path / "sizes"
    sizes.mkdir()

    def spied(length):
        build, folder = whole(length), str(sizes)

        def each(batches):
            batches = list(batches)
            n = collections.Counter(k for b in batches for k in b.column("key").to_pylist())
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(max(n.values(), default=0)))
            yield from build(iter(batches))

        return each

    monkeypatch.setattr(substrings, "_build", spied)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = substrings.remove_repeats(df, group=8).select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("h")).orderBy("doc_id").collect()
    assert [tuple(g[1:]) for g in got] == plain_removal([t.encode() for _, t in data], 200)
    assert max(int(f.read_text()) for f in sizes.iterdir()) <= 8
