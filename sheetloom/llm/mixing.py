"""Mixing to target weights: soft domain membership, and document rates by projected-gradient least squares."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, labelled_sample

#: Hash buckets of words, and the words that a text's average evidence counts for at most.
BUCKETS, EVIDENCE = 4096, 50
#: Labelled documents that the classifier is fitted on, at most (about), by hash of the id.
FIT_ROWS = 20_000
#: Pull of every rate towards 1; steps at most; residual (share of all tokens) at which they end.
PULL, STEPS, CLOSE = 1e-3, 60, 1e-4
#: Steps after which the rates are written, so that no plan grows long.
CUT = 15


def _words(text):
    """Parts between spaces and line feeds; empty ones are to be left out. Splitting at a plain space is the quickest."""
    return F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), " ")


def _bucket(word):
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def posteriors(documents: DataFrame, labelled: DataFrame, scratch: Scratch, column: str = "text") -> tuple[DataFrame, list[str]]:
    """(doc_id, text_hash, n_tokens, posterior array) of each different row, and the domains in order. labelled: doc_id,
    domain. Naive Bayes over hashed words: counts of about FIT_ROWS labelled rows at most give each bucket's weights,
    BUCKETS numbers a domain, which the plan holds; a text's average weight counts for EVIDENCE words at most, so that long texts stay soft."""
    known = labelled.filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    fitted = labelled_sample(documents.select("doc_id", F.col(column).alias("text")), known, FIT_ROWS)
    words = fitted.select("domain", F.explode(_words(F.col("text"))).alias("word")).filter("word <> ''")
    counts = words.groupBy(_bucket(F.col("word")).alias("bucket"), "domain").agg(F.count("*").alias("n")).collect()  # BUCKETS rows a domain at most
    share = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(share)
    table = np.ones((BUCKETS, max(1, len(domains))))
    for r in counts:
        table[r["bucket"], domains.index(r["domain"])] += r["n"]
    weights = np.log(table / table.sum(0))
    priors = np.log(np.array([share[d] for d in domains]) / sum(share.values())) if domains else np.zeros(1)
    names = [f"w{k}" for k in range(weights.shape[1])]
    # one list of BUCKETS numbers a domain, which the optimizer turns into a literal; no rows are made in Python
    lists = {n: F.from_json(F.lit(json.dumps(weights[:, k].tolist())), "array<double>") for k, n in enumerate(names)}
    # the hash is taken below the explode, which then carries no text
    split = documents.select("doc_id", F.xxhash64(column).alias("text_hash"), _words(F.col(column)).alias("words"))
    every = split.select("doc_id", "text_hash", F.posexplode("words").alias("at", "word")).withColumn("bucket", F.when(F.col("word") != "", _bucket(F.col("word"))))
    sums = (
        every.select("doc_id", "text_hash", "at", "bucket", *(F.get(own, F.col("bucket")).alias(n) for n, own in lists.items()))
        .groupBy("doc_id", "text_hash")
        .agg(F.count_if(F.col("at") == 0).alias("rows"), F.count("bucket").alias("n"), *(F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names))
    )
    length = F.least(F.col("n"), F.lit(EVIDENCE) * F.col("rows"))
    scale = F.when(F.col("n") > 0, length / F.col("rows") / F.col("n")).otherwise(0.0)
    z = [F.col(n) * scale + float(p) for n, p in zip(names, priors, strict=True)]
    top = F.greatest(*z) if len(z) > 1 else z[0]
    raw = sums.select("doc_id", "text_hash", "rows", (F.col("n") / F.col("rows")).cast("long").alias("n_tokens"), F.array(*(F.exp(x - top) for x in z)).alias("raw"))
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    return scratch.write(raw.select("doc_id", "text_hash", "rows", "n_tokens", F.transform("raw", lambda x: x / total).alias("posterior")), "posteriors"), domains


def solve_rates(members: DataFrame, targets: list[float], scratch: Scratch, pull: float = PULL, steps: int = STEPS) -> DataFrame:
    """Adds a rate >= 0 to each row of members (rows, n_tokens, posterior): the rates that bring the expected tokens of
    each domain, sum of rate * tokens * posterior, closest to its target share of all tokens, with a small pull to 1. Each
    step sums one gradient entry a domain over all rows and moves every rate along it, cut at 0."""
    share = np.array(targets, float) / sum(targets)
    k = len(share)
    p = [F.get("posterior", F.lit(i)) for i in range(k)]
    tokens = F.col("n_tokens") * F.col("rows")
    moments = members.agg(F.sum(tokens), *(F.sum(tokens * p[i] * p[j]) for i in range(k) for j in range(k))).first()
    every = float(moments[0] or 0)
    rates = members.withColumn("rate", F.lit(1.0))
    if not every:
        return rates
    # domains weigh by the inverse of their target, so that small ones converge as fast
    weigh = 1 / np.maximum(share, 0.02)
    square = np.array(moments[1:], float).reshape(k, k) / every
    step = 1 / (np.linalg.eigvalsh(np.sqrt(weigh)[:, None] * square * np.sqrt(weigh)).max() + pull)
    for n in range(steps):
        sums = rates.agg(*(F.sum(F.col("rate") * tokens * x) for x in p)).first()
        residual = np.array(sums, float) / every - share
        if np.abs(residual).max() < CLOSE:
            break
        along = F.lit(0.0)
        for i in range(k):
            along = along + float(residual[i] * weigh[i]) * p[i]
        rates = rates.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") * (1 - step * pull) + step * pull - step * along))
        if n % CUT == CUT - 1:
            rates = scratch.write(rates, f"rates-{n}")
    return rates


def mix(documents: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """doc_id, text_hash, n_tokens, p_<domain> and rate of each row of `documents`, so that sampling each at its rate
    gives the domains their target shares of tokens (as expected by the posteriors).

    labelled: doc_id, domain; nulls teach nothing, and of several domains for an id the first in order counts. A domain
    without a target has target 0; one without labelled rows is left out. A null text has no tokens and the priors as
    its posterior; null ids stay null; repeated rows have one rate and count each. An empty table gives no rows; without
    labels, or with targets of 0 alone, all rates are 1. Ids are taken as long. Other columns are ignored.
    DataFrame functions alone."""
    scratch = Scratch(documents.sparkSession, "mixing")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    members, domains = posteriors(docs, labelled, scratch)
    wanted = [float(targets.get(d, 0.0)) for d in domains]
    rates = solve_rates(members, wanted, scratch) if sum(wanted) else members.withColumn("rate", F.lit(1.0))
    shown = [F.get("posterior", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)]
    rated = rates.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy"), "doc_id", "text_hash", "n_tokens", *shown, "rate")
    return rated.drop("copy")


def label_domains(labels: DataFrame, with_toxic: bool = True) -> DataFrame:
    """Domains of labelled documents: toxic, low (quality 0) or good."""
    domain = F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    if with_toxic:
        domain = F.when(F.col("toxic") == 1, "toxic").otherwise(domain)
    return labels.select("doc_id", domain.alias("domain"))


def sample(documents: DataFrame, rates: DataFrame) -> DataFrame:
    """Each row of `documents` as often as its rate says: its whole part, and once more for a share of rows, by hash, equal
    to the rest. rates: doc_id, text_hash, rate (rows of one key alike)."""
    one = rates.groupBy("doc_id", "text_hash").agg(F.first("rate").alias("rate__")).withColumnsRenamed({"doc_id": "id__", "text_hash": "hash__"})
    keyed = documents.withColumn("key__", F.xxhash64("text"))
    joined = keyed.join(one, F.col("doc_id").eqNullSafe(F.col("id__")) & (F.col("key__") == F.col("hash__")))
    uniform = F.pmod(F.xxhash64(F.col("key__"), F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate__") + F.when(uniform < F.col("rate__") - F.floor("rate__"), 1).otherwise(0)).cast("int")
    return joined.withColumn("copies__", copies).filter("copies__ > 0").withColumn("copy__", F.explode(F.sequence(F.lit(1), F.col("copies__")))).select(*documents.columns)
