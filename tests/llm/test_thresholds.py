"""Near copies at thresholds other than that of op4."""

import math
import random

import pytest

from sheetloom.llm import minhash

from . import odd
from .test_llm import plain_components, plain_set


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_shared_coordinates_keep_the_miss_rate(percent):
    for n in (minhash.COORDINATES, minhash.SKETCH):
        p, least = percent / 100, minhash.least_shared(n, percent)
        fewer = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least))
        assert fewer <= 1e-9 < fewer + math.comb(n, least) * p**least * (1 - p) ** (n - least)


def test_near_duplicates_at_a_low_threshold(spark):
    r = random.Random(11)
    data = []
    for k in range(40):  # pairs of similarity about 0.4 to 0.7, each of words of its own
        base = odd.words(200, 300 + k).split(" ")
        other = list(base)
        for at in r.sample(range(200), 8 + k % 10):
            other[at] = f"q{k}x{at}"
        data += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    sets = [(i, plain_set(t)) for i, t in data]
    pairs = [(a, b) for a, x in sets for b, y in sets if a < b and 100 * len(x & y) >= 50 * len(x | y)]
    want = plain_components(pairs, [i for i, _ in data])
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert 10 < len(pairs) < 40
    assert {g["doc_id"]: g["component_id"] for g in minhash.near_duplicates(df, percent=50).collect()} == want
