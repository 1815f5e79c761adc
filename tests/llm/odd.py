"""Documents with every kind of odd row, and columns whose names clash with the operators' own."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, rate double, weight double, copies int, key string, spans string"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join("w" + "".join(r.choice("abcdefgh") for _ in range(3)) + str(r.randrange(vocabulary)) for _ in range(n))


def rows():
    base = words(120, 1)
    cut = base.split(" ")
    near = " ".join([*cut[:60], "changed", *cut[61:]])
    texts = {
        1: base, 2: base, 3: near, 4: None, 5: "", 6: " \n\t ", 7: "one two", 8: "One  TWO", 9: words(3000, 2), 10: "aaaa " * 200, 11: "x" * 5000,
        12: "é" * 150 + base[:300] + "ü", 13: words(40, 3) + "\n" + base + "\n" + words(40, 4), 14: "naïve Ünïcode\u00a0text \u200b ok",
        15: "line one is here\nline two is here\n\nline three is here", 16: "other\nline one is here\nline two is here\nlast", 17: "you 1d10t and m0ron, what an idіot\nyou " + words(10, 5),
    }
    out = [(k, t) for k, t in texts.items()]
    out += [(1, base), (18, words(80, 6)), (18, words(80, 7)), (None, base), (None, None), (-5, words(70, 8))]
    return [(k, t, "en", None, None, 1, 0.5, None, 2, "k", "s") for k, t in out]


def documents(spark, n_empty=False):
    return spark.createDataFrame([] if n_empty else rows(), SCHEMA)
