"""Benchmark decontamination: an FM-index for each training shard, searched for every benchmark window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .tokens import ALNUM, blocks, words

WINDOW = 10
#: Benchmark text that is searched for at once, in bytes; a larger benchmark is dealt into as many parts as it needs.
PART_BYTES = 16 << 20
SHARD_BYTES = 4 << 20
OTHER = 1

SCHEMA = (
    "doc_id long, n_words long, n_hit long, items array<string>,"
    " spans array<struct<first_word:long,last_word:long,first_byte:long,end_byte:long>>"
)


class Phrases:
    """The windows of a part of the benchmark over its own vocabulary: symbols from 2 on, 1 for any other word; and the items
    (numbers of `names`, in order of text) that own each, one run of numbers after the other."""

    def __init__(self, items: list[str], texts: list[str | None], window: int):
        self.names = sorted(set(items))
        number = np.searchsorted(np.array(self.names, object), np.array(items, object)) if items else np.zeros(0, np.int64)
        hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for block in blocks(pa.array(texts, pa.string())):
            _, _, first, own = words(block, ALNUM)
            hashes.append(own)
            sizes.append(np.diff(first))
        flat, size = np.concatenate(hashes), np.concatenate(sizes)
        self.vocabulary = np.unique(flat)
        self.n_symbols = len(self.vocabulary) + 2
        n_windows = np.where(size > 0, np.maximum(1, size - window + 1), 0)
        item = np.repeat(np.arange(len(size)), n_windows)
        starts = np.arange(len(item)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + (np.cumsum(size) - size)[item]
        lengths = np.minimum(size, window)[item]
        at = np.arange(window, dtype=np.int32)
        symbols = np.append(self.symbols(flat), np.zeros(window, np.int32))
        patterns = np.where(at < lengths[:, None], symbols[starts[:, None] + at], np.int32(0))
        self.patterns, back = np.unique(patterns, axis=0, return_inverse=True) if len(patterns) else (patterns, item)
        self.lengths = np.count_nonzero(self.patterns, axis=1)
        owned = np.unique(np.stack([back.ravel(), number[item]], 1).astype(np.int64), axis=0)
        self.owners, self.owned_from = owned[:, 1], np.searchsorted(owned[:, 0], np.arange(len(self.patterns) + 1))

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(len(hashes), OTHER, np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, OTHER).astype(np.int32)


def _shard(block, phrases: Phrases):
    """For each text: its words, hit words, items found and merged spans."""
    starts, ends, first, hashes = words(block, ALNUM)
    n_texts, n = len(first) - 1, len(hashes)
    hit = np.zeros(n + 1, np.int64)
    found = np.zeros((0, 2), np.int64)
    if n and len(phrases.lengths):
        # a separator closes each text; a run of words that no phrase holds is one separator
        symbol = np.insert(phrases.symbols(hashes), first[1:], OTHER)
        word = np.insert(np.arange(n), first[1:], -1)
        keep = np.ones(len(symbol), bool)
        keep[1:] = (symbol[1:] != OTHER) | (symbol[:-1] != OTHER)
        symbol, word = symbol[keep], word[keep]
        index = FMIndex(np.append(symbol, 0), phrases.n_symbols)
        low, high = index.search(phrases.patterns, phrases.lengths)
        some = np.flatnonzero(high > low)
        counts = high[some] - low[some]
        if counts.sum():
            which = np.repeat(some, counts)
            rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[some], counts)
            at = word[index.locate(rows)]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + phrases.lengths[which], -1)
            found = np.unique(np.stack([np.searchsorted(first, at, "right") - 1, which], 1), axis=0)
    covered = np.cumsum(hit)[:n] > 0
    before = np.concatenate([[0], np.cumsum(covered)])
    items: list[list[str]] = [[] for _ in range(n_texts)]
    n_owners = np.diff(phrases.owned_from)[found[:, 1]]
    owner = np.arange(n_owners.sum()) - np.repeat(np.cumsum(n_owners) - n_owners - phrases.owned_from[found[:, 1]], n_owners)
    for text, k in np.unique(np.stack([np.repeat(found[:, 0], n_owners), phrases.owners[owner]], 1), axis=0).tolist():
        items[text].append(phrases.names[k])
    opens = covered.copy()
    opens[1:] &= ~covered[:-1]
    shuts = covered.copy()
    shuts[:-1] &= ~covered[1:]
    inner = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < n)]
    opens[inner] = covered[inner]  # a span ends with its text
    shuts[inner - 1] = covered[inner - 1]
    spans: list[list[dict]] = [[] for _ in range(n_texts)]
    for a, b in zip(np.flatnonzero(opens).tolist(), np.flatnonzero(shuts).tolist(), strict=True):
        text = int(np.searchsorted(first, a, "right")) - 1
        base = int(block.bounds[text])
        spans[text].append({"first_word": a - int(first[text]), "last_word": b - int(first[text]), "first_byte": int(starts[a]) - base, "end_byte": int(ends[b]) - base})
    return np.diff(first), before[first[1:]] - before[first[:-1]], items, spans


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Words of each document that lie in an occurrence of a benchmark window, with the items found and merged spans.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. An item's windows
    are all its runs of `window` words, or all its words if they are fewer. Each block of texts (SHARD_BYTES, whole
    texts) is a shard with an FM-index of its own: phrases are searched backward through wavelet-tree ranks, their
    places found from sampled suffix positions, and overlapping places merged. Only the benchmark travels to the
    shards; where it exceeds `part_bytes`, its items are dealt into parts and each part searched for in turn.

    Returns one row for each row of `documents`: doc_id, n_words, n_hit, items (ids as text, sorted) and spans (in
    words, and bytes of the UTF-8 text). A null text has no words; a null id stays null; rows that share an id are
    judged one by one, with a benchmark in parts too: rows alike in id and text are counted there and come out as often.
    Items with a null id, a null text or no words have no windows; rows that share an item id pool their windows; a
    window that several items hold counts for each. Ids of documents are taken as long. An empty table of documents gives
    no rows, an empty benchmark no hits. A text is held whole by its task. Other columns are ignored.
    """
    items = _parts(benchmark, part_bytes)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if len(items) == 1:
        return _search(docs, items[0], window)
    parts = [_search(docs, part, window, keyed=True) for part in items]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_set("spans"))),  # rows alike have the same in each part
        F.array().cast("array<struct<first_word:long,last_word:long,first_byte:long,end_byte:long>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x.first_word <= F.element_at(done, -1).last_word + 1),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1).first_word.alias("first_word"), F.greatest(F.element_at(done, -1).last_word, x.last_word).alias("last_word"), F.element_at(done, -1).first_byte.alias("first_byte"), F.greatest(F.element_at(done, -1).end_byte, x.end_byte).alias("end_byte"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return (
        every.groupBy("doc_id", "text_hash", "n_words")
        .agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), merged.alias("spans"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.expr(f"n div {len(items)}"))))
        .select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.last_word - s.first_word + 1).alias("n_hit"), "items", "spans")
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of `documents`, with all their columns, in which no benchmark window occurs; see decontaminate. Parts of a
    large benchmark are searched for one after the other, so no row is moved."""
    kept = documents
    for items in _parts(benchmark, part_bytes):
        phrases = documents.sparkSession.sparkContext.broadcast(_phrases(items, window))

        def clean(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch.column("text"), SHARD_BYTES):
                    n_hit = _shard(block, phrases.value)[1]
                    yield batch.slice(block.first, len(n_hit)).filter(pa.array(n_hit == 0))

        kept = kept.mapInArrow(clean, documents.schema)
    return kept


def _parts(benchmark: DataFrame, part_bytes: int) -> list[DataFrame]:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // part_bytes))
    return [items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _phrases(items: DataFrame, window: int) -> Phrases:
    rows = items.collect()  # at most a part's bytes
    return Phrases([r[0] for r in rows], [r[1] for r in rows], window)


def _search(docs: DataFrame, items: DataFrame, window: int, keyed: bool = False) -> DataFrame:
    phrases = docs.sparkSession.sparkContext.broadcast(_phrases(items, window))
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([(k, pa.int64()) for k in ("first_word", "last_word", "first_byte", "end_byte")])))])
    if keyed:
        docs = docs.withColumn("text_hash", F.xxhash64("text"))
        out = out.append(pa.field("text_hash", pa.int64()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), SHARD_BYTES):
                n_words, n_hit, found, spans = _shard(block, phrases.value)
                rows = batch.slice(block.first, len(n_words))
                columns = [rows.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, out.field("items").type), pa.array(spans, out.field("spans").type)]
                yield pa.RecordBatch.from_arrays(columns + ([rows.column("text_hash")] if keyed else []), schema=out)

    return docs.mapInArrow(search, SCHEMA + ", text_hash long" * keyed)
