"""Ranked lexical search: postings bucketed by term, joined with the terms of items, scored in integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .tables import Scratch, ascii_lower, spread_join
from .tokens import ALNUM, LOWER, blocks, equal_runs, words

#: Terms of items of fewer bytes than this are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: A bucket of terms is dealt over SLOTS files by document, so that a frequent term is not one task's.
SLOTS = 8
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text):
    """The terms of a text in order, with repeats; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def _codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the first of each different word, and for each word which of these it equals byte by byte."""
    _, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    other = np.flatnonzero(~equal_runs(data, starts, ends, at[back]))  # words of one hash that are not the same
    seen: dict[bytes, int] = {}
    for k in other.tolist():
        word = data[starts[k] : ends[k]].tobytes()
        if word not in seen:
            seen[word] = len(at)
            at = np.append(at, k)
        back[k] = seen[word]
    return at, back


def _read_terms(wanted: np.ndarray | None):
    """Of each document a row without a term, with the number of its terms, and one for each different term with its
    number. wanted: ascending hashes; terms of other hashes are counted but not listed."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, doc_ids = batch.column("uid"), batch.column("doc_id")
            for block in blocks(batch.column("text")):
                starts, ends, first, hashes = words(block, ALNUM)
                size = np.diff(first)
                own = slice(block.first, block.first + len(size))
                yield pa.RecordBatch.from_arrays([ids[own], doc_ids[own], pa.nulls(len(size), pa.string()), pa.array(size.astype(np.int64))], ["uid", "doc_id", "term", "n"])
                doc = np.repeat(np.arange(len(size)), size)
                if wanted is not None:
                    at = np.minimum(np.searchsorted(wanted, hashes), max(0, len(wanted) - 1))
                    keep = np.flatnonzero(wanted[at] == hashes) if len(wanted) else np.zeros(0, np.int64)
                    starts, ends, hashes, doc = starts[keep], ends[keep], hashes[keep], doc[keep]
                if not len(doc):
                    continue
                data = LOWER[block.data]
                at, code = _codes(data, starts, ends, hashes)
                posting, count = np.unique(doc * len(at) + code, return_counts=True)
                raw = data.tobytes()
                names = pa.array([raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], pa.string())
                owner = pa.array(posting // len(at) + block.first)
                yield pa.RecordBatch.from_arrays([ids.take(owner), pa.nulls(len(posting), doc_ids.type), names.take(pa.array(posting % len(at))), pa.array(count.astype(np.int64))], ["uid", "doc_id", "term", "n"])

    return each


def _hashes(names: list[str]) -> np.ndarray:
    """Ascending hashes of terms, as documents' words are hashed."""
    found = [words(block, ALNUM)[3] for block in blocks(pa.array(names, pa.string()))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def write_postings(documents: DataFrame, scratch: Scratch, wanted: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings (bucket, term, uid, n: occurrences) and documents (uid, doc_id, n: all terms), as one written table whose
    folders are buckets of terms, each sorted by term. A uid is a row's own, so rows that share a doc_id are documents of
    their own. wanted: only these terms have postings; None: all have. No document is left out in either case."""
    spark = documents.sparkSession
    rows = documents.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.col("text").cast("string").alias("text"))
    shape = StructType([StructField("uid", LongType()), StructField("doc_id", documents.schema["doc_id"].dataType), StructField("term", StringType()), StructField("n", LongType())])
    read = rows.mapInArrow(_read_terms(None if wanted is None else _hashes(wanted)), shape)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = read.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(n))).cast("int"))
    slot = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("uid"), F.lit(n * SLOTS))).otherwise(F.col("bucket") * SLOTS + F.pmod(F.xxhash64("uid"), F.lit(SLOTS)))
    whole = scratch.write(placed.repartition(slot).sortWithinPartitions("bucket", "term", "uid"), "postings", by="bucket")
    return whole.filter("bucket >= 0").select("bucket", "term", "uid", "n"), whole.filter("bucket = -1").select("uid", "doc_id", "n")


def rank_documents(documents: DataFrame, items: DataFrame, k: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The k documents of the highest scores for each item: item_id, rank (from 1), doc_id, score.

    Terms are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. N counts the documents with a
    term, L all their terms, n those of one document, df the documents that hold a term, tf its occurrences in one. A term
    weighs w = floor(1000 ln((2N + 2) / (2 df + 1))); a document has m = 100 - 75 + (75 n N) div L and scores the sum of
    w * ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, repeats included.

    Postings are written once, in buckets of terms. The terms of items are joined with their buckets; each match is scored
    and summed by item and document. Matches are dealt by document before they meet the items, so that the sums need no
    further shuffle, and each task hands on k rows an item. Where the items' terms exceed `broadcast_bytes`, all terms have
    postings and items are joined by term, with frequent terms dealt over tasks; rows are the same.

    Equal scores go by ascending doc_id, null ids first. Documents of score 0 are not listed, nor are items without a term
    in any document. Rows of documents count one by one, also where they repeat or share an id. Items that share an id are
    one, with the terms of all; those with a null id are left out. Null and empty texts have no terms; texts are read
    whole. Without documents or items there are no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "lexical")
    asked = items.filter("item_id is not null").select("item_id", F.explode(terms(F.col("text"))).alias("term"))
    asked = scratch.write(asked.groupBy("item_id", "term").agg(F.count("*").alias("times")), "asked")
    small = (asked.agg(F.sum(F.octet_length("term") + 48)).first()[0] or 0) <= broadcast_bytes
    wanted = [r["term"] for r in asked.select("term").distinct().collect()] if small else None  # bounded by the check before
    postings, lengths = write_postings(documents, scratch, wanted)
    total = lengths.filter("n > 0").agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    frequency = scratch.write(postings.groupBy("bucket", "term").agg(F.count("*").alias("df")), "frequency")
    weight = F.floor(1000 * F.log((2.0 * total["n"] + 2) / (2.0 * F.col("df") + 1))).alias("w")
    weights = frequency.join(asked.select("term").distinct(), "term", "left_semi").select("bucket", "term", weight)
    counts = frequency.select("term", F.col("df").alias("n"))
    if small:
        found = postings.join(F.broadcast(weights), ["bucket", "term"])
    else:
        found = spread_join(postings, weights.drop("bucket"), ["term"], counts=counts)
    found = found.select("uid", "term", F.col("n").alias("tf"), "w")
    by_document = found.join(lengths.hint("shuffle_hash"), "uid")
    m = F.lit(25).cast("long") + F.expr(f"(75 * n * {total['n']}L) div {max(1, total['l'])}L")
    scored = by_document.withColumn("m", m).select("uid", "doc_id", "term", F.expr("w * ((1000000000L * tf) div (1000 * tf + 8 * m))").alias("score"))
    met = scored.join(F.broadcast(asked), "term") if small else spread_join(scored, asked, ["term"], counts=counts)
    sums = met.groupBy("item_id", "uid", "doc_id").agg(F.sum(F.col("score") * F.col("times")).alias("score")).filter("score > 0")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "uid")
    return sums.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
