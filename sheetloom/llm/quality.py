"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, labelled_sample
from .tokens import ALNUM, NON_SPACE, Block, blocks, mix, words
from .toxicity import fit_curve

BITS = 18
#: Labelled rows that the model is fitted on, at most (about), by hash of the id.
FIT_ROWS = 8_000
#: Bytes of their n-grams that the driver fits on at most.
FIT_BYTES = 128 << 20
PASSES = 10
COST = 1.0
MARKS = NON_SPACE & ~ALNUM
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TWICE, _THRICE = mix(np.array([2, 3], np.uint64))


def indicators(block: Block, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the distinct hashed n-grams (one and two in a row) of its words and marks, and where each begins.
    Any token that follows itself, once or twice, is an n-gram too."""
    a_start, _, _, a_hash = words(block, ALNUM)
    m_start, _, _, m_hash = words(block, MARKS)
    starts = np.concatenate([a_start, m_start])
    by = np.argsort(starts, kind="stable")
    token = np.concatenate([a_hash, m_hash])[by]
    first = np.searchsorted(starts[by], block.bounds)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = mix(token[:-1] * _STEP + token[1:]) if len(token) > 1 else token[:0]
    same = text[1:] == text[:-1]
    again = same & (token[1:] == token[:-1])
    twice = text[:-1][again]
    thrice = text[:-2][again[1:] & again[:-1]]
    gram = np.concatenate([token, pair[same], np.full(len(twice), _TWICE), np.full(len(thrice), _THRICE)]) >> np.uint64(64 - bits)
    key = np.unique(np.concatenate([text, text[:-1][same], twice, thrice]).astype(np.int64) << bits | gram.astype(np.int64))
    return (key & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(key, np.arange(len(first)) << bits)


class NBSVM:
    """Weights of hashed n-grams and the curve from margin to probability."""

    def __init__(self, bits: int = BITS):
        self.bits, self.weights, self.bias, self.curve = bits, np.zeros(1 << bits), 0.0, np.array([0.0, 1.0])

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> NBSVM:
        """Class log-count ratios scale the indicators; dual coordinate descent fits the hinge loss; a fifth of the
        rows, not fitted on, gives the curve."""
        if not len(y) or y.min() == y.max():
            self.curve = np.array([np.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.0])
            return self
        rest = np.arange(len(y)) % 5 == 0
        margin = self._fit([r for r, k in zip(rows, rest, strict=True) if not k], y[~rest])._margins([r for r, k in zip(rows, rest, strict=True) if k])
        self.curve = fit_curve(np.stack([np.ones_like(margin), margin], 1), y[rest].astype(float), 1e-3)
        self._fit(rows, y)
        return self

    def _fit(self, rows: list[np.ndarray], y: np.ndarray) -> NBSVM:
        size = 1 << self.bits
        counts = [np.ones(size), np.ones(size)]
        for r, label in zip(rows, y, strict=True):
            counts[int(label)][r] += 1
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        sign = np.where(y > 0, 1.0, -1.0)
        values = [ratio[r] / max(1.0, np.sqrt((ratio[r] ** 2).sum())) for r in rows]
        norm = np.array([v @ v for v in values]) + 1.0
        alpha, w, bias = np.zeros(len(y)), np.zeros(size), 0.0
        share = np.array([len(y) / (2 * max(1, (y == k).sum())) for k in (0, 1)]) ** 0.5
        most = COST * share[y.astype(int)]
        random = np.random.default_rng(7)
        for _ in range(PASSES):
            for i in random.permutation(len(y)):
                gradient = sign[i] * (values[i] @ w[rows[i]] + bias) - 1
                now = min(max(alpha[i] - gradient / norm[i], 0.0), most[i])
                if now != alpha[i]:
                    step = (now - alpha[i]) * sign[i]
                    w[rows[i]] += step * values[i]
                    bias += step
                    alpha[i] = now
        self.ratio, self.weights, self.bias = ratio, w * ratio, bias
        return self

    def _margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() / max(1.0, np.sqrt((self.ratio[r] ** 2).sum())) + self.bias for r in rows])

    def score(self, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        add = lambda x: np.diff(np.append(0, np.cumsum(x))[bounds])
        ratio = getattr(self, "ratio", self.weights)
        margin = add(self.weights[flat]) / np.maximum(1.0, np.sqrt(np.maximum(0, add(ratio[flat] ** 2)))) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * margin, -30, 30)))


def sum_until(sizes: list[tuple[int, int]], most: int) -> int:
    """The last place up to which sizes add up to `most` at most; the first one in any case."""
    held, total = sizes[0][0] if sizes else 0, 0
    for place, n in sizes:
        total += n
        if total > most:
            break
        held = place
    return held


def quality_model(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> NBSVM:
    scratch = Scratch(documents.sparkSession, "quality")
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    # of several rows of an id the text of the smallest hash, so that the sample is bounded however often an id repeats
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")
    labelled = labelled_sample(documents, known, fit_rows).groupBy("doc_id", "quality").agg(first).select("doc_id", "quality", "first.text")
    labelled = scratch.write(labelled, "labelled")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                flat, bounds = indicators(block)
                rows = [flat[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                part = batch.slice(block.first, len(rows))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(rows, pa.binary())], ["doc_id", "quality", "grams"])

    grams = scratch.write(labelled.mapInArrow(each, "doc_id long, quality int, grams binary").withColumn("place", F.xxhash64("doc_id")), "grams")
    # in the order of hashes, as many as FIT_BYTES hold
    held = sum_until([(r["place"], r["n"]) for r in grams.groupBy("place").agg(F.sum(F.octet_length("grams")).alias("n")).orderBy("place").collect()], fit_bytes)
    rows = grams.filter(F.col("place") <= held).orderBy("place", "doc_id", "quality", "grams").toPandas()
    scratch.drop("labelled")
    scratch.drop("grams")
    return NBSVM().fit([np.frombuffer(g, np.int32) for g in rows["grams"]], rows["quality"].to_numpy().clip(0, 1))


def score_quality(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id and score (0 to 1, of the whole text alone) of each row of `documents`, learned from the labels given.

    labels: doc_id, quality; rows with a null in either teach nothing, and of several rows for an id the largest label
    counts. About `fit_rows` labelled rows at most are fitted on, one an id, and of these as many as FIT_BYTES of n-grams hold,
    by hash of the id. A null text scores as an empty one, repeated rows are
    scored each, and a null id stays null. Without labels of both kinds all texts score alike. N-grams of one hash bucket
    count as one. An empty table gives no rows. Ids are taken as long. A text is held whole by its task. Other columns are
    ignored."""
    shared = documents.sparkSession.sparkContext.broadcast(quality_model(documents, labels, fit_rows))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                score = shared.value.score(*indicators(block))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, len(score)), pa.array(score, pa.float64())], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, score double")
