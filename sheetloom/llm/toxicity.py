"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text, with exception phrases."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, labelled_sample

#: A term or phrase is learned if it stands in this share of the toxic texts at least.
SUPPORT = 0.01
#: Least log ratio of a term's rates in toxic and other texts; an exception's at most.
TERM_RATIO, EXCEPTION_RATIO = 2.0, -1.0
#: Shortest and longest stem (beginning of words). A stem is learned if the log ratio of its occurrences reaches
#: TERM_RATIO and that of the texts that hold it STEM_RATIO.
STEM, LONGEST_STEM, STEM_RATIO = 4, 12, 0.7
#: Terms that a task counts before it hands their sums on, so that its memory does not grow with its texts.
HELD_TERMS = 50_000
#: Labelled documents that lexicon and curve are learned from, at most (about), by hash of the id.
FIT_ROWS = 20_000

# fixed values: letters that look like a Latin letter, and digits and signs that stand for one
LOOKALIKES = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y"}
GREEK = {"α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}


def _folding() -> dict[int, str]:
    """Lower case, no accents, compatibility forms (wide, mathematical) as letters, and the fixed values above."""
    table: dict[int, str] = {}
    for low, high in ((0x41, 0x5B), (0xC0, 0x250), (0x1E00, 0x1F00), (0x2100, 0x2190), (0x24B6, 0x24EA), (0xFF10, 0xFF5B), (0x1D400, 0x1D800)):
        for c in range(low, high):
            plain = unicodedata.normalize("NFKD", chr(c)).lower()[:1]
            if plain.isascii() and plain.isalnum():
                table[c] = DIGITS.get(plain, plain)
    for c in range(0x300, 0x370):
        table[c] = ""
    for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):
        table[c] = ""
    for k, v in (LOOKALIKES | GREEK | DIGITS).items():
        table[ord(k)] = table[ord(k.upper())] = v
    return table


_FOLD = _folding()
# patterns begin with the signs, so that texts are searched for these only
_SIGN = re.compile(r"[@$!|€](?<=[^\W_].)(?=[^\W_])")
#: Signs at a word's beginning or end, and several in a row within it, which may be letters or marks.
_EDGE = re.compile(r"[@$€!][@$€]*")
_WORD = re.compile(r"[^\W_]+")


def _lettered(m: re.Match) -> str:
    """Signs beside a letter as letters; ! only where it begins a word after white space."""
    signs, before, after = m[0], m.string[max(0, m.start() - 1) : m.start()], m.string[m.end() : m.end() + 1].isalpha()
    if signs == "!":
        return "i" if after and not before.strip() else "!"
    mark = signs[: signs[0] == "!"]
    return mark + "".join(SIGNS[s] for s in signs[len(mark) :]) if after or before.isalpha() and not mark else signs


def fold(text: str, edges: bool = False) -> str:
    """Text with look-alikes, accents, digits and signs within words brought to plain lower-case letters; with `edges`
    signs at the edge of a word too. Both readings have the same length."""
    if edges:
        text = _EDGE.sub(_lettered, text)
    if any(s in text for s in SIGNS):
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return text.translate(_FOLD)


def _words(text: str) -> Iterator[str]:
    """Folded words, and those that signs at an edge make when these are read as letters."""
    folded = fold(text)
    yield from _WORD.findall(folded)
    lettered = fold(text, edges=True) if any(s in text for s in "@$€!") else folded
    if lettered != folded:
        yield from (m[0] for m in _WORD.finditer(lettered) if folded[m.start() : m.end()] != m[0])


def _stems(word: str) -> list[str]:
    """The beginnings of a word that may be stems, shortest first, each with a closing *."""
    return [word[:k] + "*" for k in range(STEM, min(len(word), LONGEST_STEM) + 1)]


class Lexicon:
    """Weights of terms and exception phrases (two folded words, in which a term does not count). A term is a folded word,
    or with a closing * the beginning of words; of the terms that fit a word the longest counts."""

    def __init__(self, weights: dict[str, float], exceptions: set[str] = frozenset()):
        self.weights, self.exceptions = weights, set(exceptions)
        self._automaton = None

    def __getstate__(self):
        return self.weights, self.exceptions

    def __setstate__(self, state):
        self.__init__(*state)

    def holds(self, word: str) -> bool:
        return word in self.weights or any(s in self.weights for s in _stems(word))

    def _build(self):
        import ahocorasick

        entries: dict[str, list] = {}  # key: weight as a word, weight as a stem, whether it is an exception
        for k, w in self.weights.items():
            entries.setdefault(k.removesuffix("*"), [None, None, False])[k.endswith("*")] = w
        for k in self.exceptions:
            entries.setdefault(k, [None, None, False])[2] = True
        automaton = ahocorasick.Automaton()
        for k, (word, stem, exception) in entries.items():
            automaton.add_word(k, (len(k), word, stem, exception))
        automaton.make_automaton()
        return automaton

    def measure(self, text: str) -> tuple[float, int, int]:
        """Weight of the terms found, their number, and words of the text. A sign at the edge of a word is read as a mark, and
        also as a letter: a term that needs the letter counts in place of those within it."""
        if self._automaton is None:
            self._automaton = self._build()
        folded = fold(text)
        n_words = folded.count(" ") + folded.count("\n") + 1
        if not self.weights:
            return 0.0, 0, n_words
        found = self._scan(folded)
        lettered = fold(text, edges=True) if any(s in text for s in "@$€!") else folded
        if lettered != folded:
            for start, (end, weight) in self._scan(lettered).items():
                if lettered[start : end + 1] != folded[start : end + 1]:
                    for a in range(start, end + 1):
                        found.pop(a, None)
                    found[start] = end, weight
        return sum(w for _, w in found.values()), len(found), n_words

    def _scan(self, folded: str) -> dict[int, tuple[int, float]]:
        """The terms in folded text, but those within an exception: start, and end and weight."""
        found: dict[int, tuple[int, float]] = {}
        excepted = []
        for end, (size, word, stem, exception) in self._automaton.iter(folded):
            start = end - size + 1
            if start and folded[start - 1].isalnum():
                continue
            closed = not folded[end + 1 : end + 2].isalnum()
            if exception and closed:
                excepted.append((start, end))
            weight = word if word is not None and closed else stem
            if weight is not None:
                found[start] = end, weight  # ends ascend, so the longest stays
        if excepted:
            excepted.sort()
            starts, furthest = [b for b, _ in excepted], [-1, *accumulate((c for _, c in excepted), max)]
            found = {a: x for a, x in found.items() if x[0] > furthest[bisect_right(starts, a)]}
        return found


def learn_lexicon(labelled: DataFrame) -> Lexicon:
    """labelled: text, toxic (0 or 1). Words that far more toxic texts hold, stems that occur far more often in toxic texts,
    both weighted by the logarithm of the ratio of the shares of texts that hold them, and two-word phrases around a
    term that are rarer in toxic texts than elsewhere. A stem tells of inflected and compound words each of which is
    rare. All rows given are counted: candidates are what enough toxic texts hold, and then every text is counted for these."""
    rows = labelled.filter("text is not null and toxic is not null").select("text", F.col("toxic").cast("int").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = total.get(1, 0), total.get(0, 0)
    if not n_toxic or not n_other:
        return Lexicon({})
    least = max(5, SUPPORT * n_toxic)
    columns = ["toxic", "other", "toxic_uses", "other_uses"]  # texts that hold a term, and its occurrences

    def count(keep):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, list[int]] = {}

            def so_far() -> pa.RecordBatch:
                rows = list(zip(*sums.values(), strict=True)) or [[]] * len(columns)
                return pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), *(pa.array(x, pa.int64()) for x in rows)], ["term", *columns])

            for batch in batches:
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                    if toxic in (0, 1):
                        for term, n in keep(text).items():
                            own = sums.setdefault(term, [0, 0, 0, 0])
                            own[1 - toxic] += 1
                            own[3 - toxic] += n
                    if len(sums) > HELD_TERMS:
                        yield so_far()
                        sums.clear()
            yield so_far()

        return each

    def counted(df: DataFrame, keep) -> DataFrame:
        return df.mapInArrow(count(keep), "term string, " + ", ".join(f"{c} long" for c in columns)).groupBy("term").agg(*(F.sum(c).alias(c) for c in columns))

    def ratio(toxic: int, other: int) -> float:
        return float(np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1)))

    def terms(text: str, among: set[str] | None = None) -> Counter:
        uses: Counter = Counter()
        for word, n in Counter(_words(text)).items():
            for t in (word, *_stems(word)):
                if among is None or t in among:
                    uses[t] += n
        return uses

    # a text holds each candidate once, so there are few: SUPPORT of the toxic texts hold it
    frequent = {r["term"] for r in counted(rows.filter("toxic = 1"), terms).filter(F.col("toxic") >= least).collect()}
    found = {r["term"]: tuple(r[c] for c in columns) for r in counted(rows, lambda t: terms(t, frequent)).collect()}
    longer: dict[str, list[str]] = {}
    for t in found:
        if t.endswith("*"):
            longer.setdefault(t[:-2] + "*", []).append(t)
    weights = {}
    for t, n in found.items():
        weight = ratio(n[0], n[1])
        if not t.endswith("*"):
            fits = weight >= TERM_RATIO
        else:  # a stem with the counts of a word or of a longer stem tells nothing more
            fits = weight >= STEM_RATIO and ratio(n[2], n[3]) >= TERM_RATIO and all(found.get(x) != n for x in (t[:-1], *longer.get(t, ())))
        if fits:
            weights[t] = weight
    lexicon = Lexicon(weights)

    def phrases(text: str) -> dict[str, int]:
        text = fold(text)
        words = _WORD.findall(text)
        held = {w for w in set(words) if lexicon.holds(w)}
        pairs = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a in held or b in held}
        return dict.fromkeys((p for p in pairs if p in text), 1)

    exceptions: set[str] = set()
    if weights:
        mild = counted(rows, phrases).filter(F.col("other") >= max(5, SUPPORT * n_other))
        exceptions = {r["term"] for r in mild.collect() if ratio(r["toxic"], r["other"]) <= EXCEPTION_RATIO}
    return Lexicon(weights, exceptions)


def _features(weight, found, n_words) -> np.ndarray:
    """Of weight, number and words: weight for each hundred words, its logarithm, and the logarithm of the weight."""
    weight, n_words = np.asarray(weight, float), np.maximum(1, np.asarray(n_words, float))
    density = 100 * weight / n_words
    return np.stack([np.ones_like(density), np.log1p(density), np.log1p(weight), (np.asarray(found) > 0).astype(float)], 1)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def measure(documents: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """Adds weight, found and n_words to the columns named by `keep`."""
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)
    source = documents.select(*keep, *["text"] * ("text" not in keep))
    schema = source.select(*keep, F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("found"), F.lit(0).cast("long").alias("n_words")).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value.measure(t or "") for t in batch.column("text").to_pylist()]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], [*keep, "weight", "found", "n_words"])

    return source.mapInArrow(each, schema)


def toxicity_model(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and curve from about `fit_rows` labelled documents at most; equal texts are one, with the largest label."""
    scratch = Scratch(documents.sparkSession, "toxicity")
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    labelled = labelled_sample(documents, known, fit_rows).groupBy(F.xxhash64("text").alias("hash")).agg(F.max(F.struct("toxic", "doc_id", "text")).alias("r"))
    labelled = scratch.write(labelled.select("r.doc_id", "r.text", "r.toxic"), "labelled")
    lexicon = learn_lexicon(labelled)
    rows = measure(labelled, lexicon, ["toxic"]).toPandas()
    scratch.drop("labelled")
    if rows.empty:
        return lexicon, np.array([-5.0, 0, 0, 0])
    return lexicon, fit_curve(_features(rows["weight"], rows["found"], rows["n_words"]), rows["toxic"].to_numpy(float))


def score_toxicity(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The columns of `documents` and toxicity (0 to 1, of the whole text alone), learned from the labels given.

    labels: doc_id, toxic; rows with a null in either teach nothing, and of several rows for an id the largest label
    counts. Terms (words and stems) weigh the logarithm of their rate ratio; the sum is set against the length of the text, and a curve
    gives the probability of the label. A null text scores as an empty one. Repeated rows are scored each. A column
    called toxicity is replaced, and others keep their names and values. Of terms that fit at one place the longest counts,
    a word before a stem. Without labels of both kinds nothing is learned and all texts score alike. An empty table gives
    no rows. Texts are scored one at a time, so a long one needs memory for itself alone."""
    lexicon, curve = toxicity_model(documents, labels, fit_rows)
    keep = [c for c in documents.columns if c != "toxicity"]
    if "text" not in keep:
        raise ValueError("documents need a column text")
    clash = [c for c in keep if c in ("weight", "found", "n_words")]
    documents = documents.drop("toxicity").withColumnsRenamed({c: f"{c}__own" for c in clash})
    measured = measure(documents, lexicon, [f"{c}__own" if c in clash else c for c in keep])
    density = F.log1p(100 * F.col("weight") / F.greatest(F.col("n_words"), F.lit(1)))
    z = curve[0] + curve[1] * density + curve[2] * F.log1p("weight") + curve[3] * (F.col("found") > 0).cast("double")
    return measured.withColumn("toxicity", 1 / (1 + F.exp(-z))).drop("weight", "found", "n_words").withColumnsRenamed({f"{c}__own": c for c in clash})
