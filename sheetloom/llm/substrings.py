"""Exact-substring dedup over whole texts: column-wise construction over all texts that share a minimizer.

A window of 200 bytes has a minimizer: the smallest hash among its 16-byte grams, at its first place. Equal windows
have equal minimizers at equal distances, so texts are cut into segments (runs of windows that share one minimizer
place) and only segments of equal minimizers are brought together, aligned at the minimizer. There the construction
runs column by column from the right: each round inserts one symbol of every segment, which turns the order of the
suffixes of one column and their common prefixes into those of the next. The symbols read in that order are the
column's part of the collection's Burrows-Wheeler transform; orders and prefixes are two sequential runs that each round
reads once and writes anew. A window is repeated if it shares 200 bytes with a neighbour of its column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, spread_join
from .tokens import Block, blocks, mix

LENGTH = 200
GRAM = 16
#: Bits of a minimizer's sort key that hold its place, so that the first place wins a tie; longer texts go in pieces.
PLACE_BITS = 23
PIECE_BYTES = 1 << 20
#: Bytes of segments that are built up together.
COLLECTION_BYTES = 2 << 20
#: Distinct segments that one minimizer may bring together (some 10 MB). Those of a larger group are cut in two: windows
#: that begin far before the minimizer, and others. Pieces are dealt by the bytes that all windows of a half can hold,
#: which are more than half a window, and one of equal ones is kept. Where more different pieces than this hold the same
#: bytes, their windows are counted one by one, so that no group grows with the input.
GROUP = 32_768

_PLACE = np.uint64((1 << PLACE_BITS) - 1)
_KEY = np.random.default_rng(16).integers(1, 1 << 63, 1, dtype=np.uint64)


def segments(block: Block, length: int) -> tuple[np.ndarray, ...]:
    """Of each run of windows: text, start in it, number of windows, minimizer (the whole 64-bit hash of the gram that the first
    41 bits and the place chose, as minima crowd near zero), BLAKE2b hash of the bytes (which with the
    minimizer tells whether segments are equal), and distance of the minimizer from the start."""
    found = []
    total = len(block.data)
    for a in range(0, max(1, total - length + 1), PIECE_BYTES):
        found.append(_segments(block, a, min(total, a + PIECE_BYTES + length - 1), length))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _segments(block: Block, low: int, high: int, length: int) -> tuple[np.ndarray, ...]:
    data = block.data[low:high]
    n, span = len(data), length - GRAM + 1
    n_windows = n - length + 1
    if n_windows < 1:
        return tuple(np.zeros(0, d) for d in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    eight = np.ndarray(n - 7, "<u8", data, strides=(1,))  # the bytes of half a gram from each place on
    hashes = mix(mix(eight[:-8] ^ _KEY) ^ eight[8:])
    keys = (hashes & ~_PLACE) | np.arange(n - GRAM + 1, dtype=np.uint64)
    # sliding minimum: of the rest of one stretch of `span` grams and of the start of the next
    padded = np.full(-(-len(keys) // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    rest = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(rest[:n_windows], ahead[span - 1 : span - 1 + n_windows])
    # a window must not cross the end of its text
    whole = np.ones(n_windows, bool)
    for edge in block.bounds[1:-1]:
        a = int(edge) - low
        if -length < a - 1 and a - length + 1 < n_windows:
            whole[max(0, a - length + 1) : max(0, a)] = False
    change = least[1:] != least[:-1]
    start = np.flatnonzero(whole & np.append(True, change | ~whole[:-1]))
    last = np.flatnonzero(whole & np.append(change | ~whole[1:], True))
    end = last + length
    text = np.searchsorted(block.bounds, start + low, "right") - 1
    place = (least[start] & _PLACE).astype(np.int64)
    raw = memoryview(data)
    digests = [hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return text, start + low - block.bounds[text], last - start + 1, hashes[place], np.frombuffer(b"".join(digests), np.uint64), place - start


def insert_columns(group: np.ndarray, first: np.ndarray, sizes: np.ndarray, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The column-wise construction over a collection of texts that begin at column `first` each: from the last column to the
    first, a round inserts the symbol that stands at the column in every text. Yields the column; the texts in order
    of their suffixes from it on (within their groups; a suffix that ends stands before longer ones); the common prefix
    of each with the one before it; and in the same order the symbols at the column before, which are this column's part of
    the Burrows-Wheeler transform of the collection (0 where a text begins here). Each round reads these three runs once
    from front to back and writes them anew."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    offset = np.cumsum(sizes) - sizes - first  # of the byte of column 0
    end = first + sizes
    joins = np.argsort(-end, kind="stable")
    joins_end = -end[joins]
    order, common, symbols = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint8)
    for column in range(int(end.max(initial=0)) - 1, int(first.min(initial=0)) - 1, -1):
        new = joins[np.searchsorted(joins_end, -(column + 1), "left") : np.searchsorted(joins_end, -(column + 1), "right")]
        keep = np.flatnonzero(first[order] <= column)
        if len(keep) < len(order):  # texts that are done go, and their neighbours share the least of what they shared
            common = np.minimum.reduceat(common[: keep[-1] + 1], np.append(0, keep[:-1] + 1)) if len(keep) else common[:0]
            order, symbols = order[keep], symbols[keep]
        if len(new):  # a text's last symbol stands before all longer suffixes
            order = np.concatenate([new, order])
            common = np.concatenate([np.zeros(len(new), np.int32), common])
            symbols = np.concatenate([flat[offset[new] + column], symbols])
        if not len(order):
            continue
        key = group[order] << 8 | symbols
        by = np.argsort(key, kind="stable")
        key = key[by]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        now = np.zeros(len(order), np.int32)
        if len(same):
            pairs = np.stack([by[same - 1] + 1, by[same] + 1], 1).ravel()
            now[same] = 1 + np.minimum.reduceat(np.append(common, 0), pairs)[::2]
        order, common = order[by], now
        symbols = np.where(first[order] < column, flat[np.maximum(offset[order] + column - 1, 0)], 0).astype(np.uint8)
        yield column, order, common, symbols


def repeated_windows(group: np.ndarray, first: np.ndarray, count: np.ndarray, texts: list[bytes], length: int) -> np.ndarray:
    """For every window of every segment, one segment after the other, whether its bytes begin at the same column of
    another segment of its group. group: ascending numbers; first: the column at which a segment begins."""
    mark_at = np.cumsum(count) - count - first
    marked = np.zeros(int(count.sum()), bool)
    for column, order, common, _ in insert_columns(group, first, count + length - 1, texts):
        long = np.flatnonzero(common >= length)
        if len(long):
            both = order[np.concatenate([long, long - 1])]
            marked[mark_at[both] + column] = True
    return marked


def remove_repeats(documents: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Removes each byte that lies in a `length`-byte string which begins anywhere else in the table too.

    Texts are whole UTF-8 texts; a null text is empty; matches stay within a document, overlaps count, and strings are
    judged on the input. Returns one row for each row of `documents`: doc_id, n_bytes, n_removed, spans (maximal removed
    runs, as array of first and end byte), kept (remaining bytes). Rows that repeat another, its id included, count as
    further documents; a null id stays null. All copies of a string go, so there are no ties. Texts are searched in pieces
    of PIECE_BYTES. An empty table gives no rows. Ids are taken as long. Other columns are ignored.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "substrings")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    runs = scratch.write(docs.mapInArrow(_runs(length), "doc_id long, row long, start long, n int, minimizer long, bytes long, distance int"), "runs")
    shared = runs.groupBy("minimizer").agg(F.count("*").alias("n"), (F.min("bytes") < F.max("bytes")).alias("mixed")).filter("n > 1")
    shared = scratch.write(shared, "shared")
    hits = scratch.write(spread_join(runs, shared.select("minimizer", "mixed"), ["minimizer"], counts=shared.select("minimizer", "n"), hint="merge"), "hits")
    scratch.drop("runs")
    scratch.drop("shared")
    whole = hits.filter("not mixed")
    mixed = hits.filter("mixed")
    place = F.struct("doc_id", "row", "start", "n", "distance")
    distinct = scratch.write(mixed.groupBy("minimizer", "bytes").agg(F.count("*").alias("copies"), F.min(place).alias("at")).select("minimizer", "bytes", "copies", "at.*"), "distinct")
    large = distinct.groupBy("minimizer").agg(F.count("*").alias("n")).filter(F.col("n") > group).select("minimizer", F.lit(True).alias("large"))
    large = scratch.write(large, "large")
    # the bytes of one segment for each distinct one
    pick = F.struct("start", "n", "minimizer", "distance", F.coalesce("large", F.lit(False)).alias("large"), (F.col("copies") == 1).alias("lone"))
    known = distinct.join(large, "minimizer", "left")

    def cut(chosen: DataFrame) -> DataFrame:
        picks = chosen.groupBy(F.col("doc_id").alias("p_id"), F.col("row").alias("p_row")).agg(F.collect_list(pick).alias("picks"))
        once = docs.join(picks, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("row") == F.col("p_row"))).select("doc_id", "row", "text", "picks")
        return once.mapInArrow(_cut(length), "doc_id long, row long, start long, n int, first int, lone boolean, key long, bytes binary")

    dealt = cut(known.filter("large is null"))
    settled = None
    if not large.isEmpty():
        few, settled = _settle(scratch.write(cut(known.filter("large")), "pieces", "lz4"), length, group, scratch)
        dealt = dealt.unionByName(few)
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    parts = dealt.mapInArrow(_build(length), "doc_id long, row long, first_byte long, end_byte long")
    if settled is not None:
        parts = parts.unionByName(settled)
    copies = distinct.filter("copies > 1").select("minimizer", "bytes", F.col("copies").alias("n"))
    copied = spread_join(mixed, copies.drop("n"), ["minimizer", "bytes"], "left_semi", copies, "merge")
    full = whole.select("doc_id", "row", "start", "n").union(copied.select("doc_id", "row", "start", "n"))
    spans = full.select("doc_id", "row", F.col("start").alias("first_byte"), (F.col("start") + F.col("n") + (length - 1)).alias("end_byte")).union(parts)
    spans = spans.groupBy("doc_id", "row").agg(F.collect_list(F.struct("first_byte", "end_byte")).alias("spans"))
    spans = scratch.write(spans, "spans")
    for name in ("hits", "distinct", "large", "pieces", "one", "wide"):
        scratch.drop(name)
    ready = docs.join(spans.withColumnsRenamed({"doc_id": "p_id", "row": "p_row"}), F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("row") == F.col("p_row")), "left")
    return ready.select("doc_id", "text", "spans").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, spans array<struct<first_byte:long,end_byte:long>>, kept binary")


def _settle(pieces: DataFrame, length: int, group: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of the pieces of large groups: one of each equal ones, of keys that hold `group` of these at most, to be built up;
    and the spans that are settled by counts alone, which are those of equal pieces and of windows of all other keys."""
    same = ["key", "first", "bytes"]
    one = pieces.groupBy(*same).agg(F.count("*").alias("held"), F.min(F.struct("doc_id", "row", "start", "n", "lone")).alias("at"))
    one = scratch.write(one.select(*same, "held", "at.doc_id", "at.row", "at.start", "at.n", (F.col("at.lone") & (F.col("held") == 1)).alias("lone")), "one", "lz4")
    wide = scratch.write(one.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > group).select("key"), "wide")
    few = one.join(wide, "key", "left_anti").select(*pieces.columns)
    windows = one.join(wide, "key", "left_semi").mapInArrow(_windows(length), "doc_id long, row long, start long, lone boolean, window binary")
    repeated = windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window")
    alone = windows.filter("lone").join(repeated, "window", "left_semi").select("doc_id", "row", "start", F.lit(1).alias("n"))
    equal = pieces.filter("lone").join(one.filter("held > 1").select(*same), same, "left_semi").select("doc_id", "row", "start", "n")
    return few, equal.union(alone).select("doc_id", "row", F.col("start").alias("first_byte"), (F.col("start") + F.col("n") + (length - 1)).alias("end_byte"))


def _windows(length: int):
    """Each window of each piece by a hash of its bytes."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy().astype(np.int64)
            rows = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            hashes = [hashlib.blake2b(x[k : k + length], digest_size=16).digest() for x, m in zip(batch.column("bytes").to_pylist(), n.tolist(), strict=True) for k in range(m)]
            pick = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pick), batch.column("row").take(pick), pa.array(batch.column("start").to_numpy()[rows] + at), batch.column("lone").take(pick), pa.array(hashes, pa.binary())],
                ["doc_id", "row", "start", "lone", "window"],
            )

    return windows


def _runs(length: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), PIECE_BYTES):
                text, start, n, minimizer, bytes_, distance = segments(block, length)
                rows = pa.array(text + block.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("row").take(rows), pa.array(start), pa.array(n.astype(np.int32)), pa.array(minimizer.view(np.int64)), pa.array(bytes_.view(np.int64)), pa.array(distance.astype(np.int32))],
                    ["doc_id", "row", "start", "n", "minimizer", "bytes", "distance"],
                )

    return runs


def _cut(length: int):
    names = ["doc_id", "row", "start", "n", "first", "lone", "key", "bytes"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()], strict=True)))

    width = (length - GRAM) // 2 + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            size, done = 0, set()
            for doc, row, text, picks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text", "picks")), strict=True):
                if (doc, row) in done:  # rows alike in id and text: one of them gives the bytes
                    continue
                done.add((doc, row))
                raw = text.encode()
                for p in picks:
                    a, n, first, key = p["start"], p["n"], -p["distance"], p["minimizer"]
                    pieces = [(a, n, first, key)]
                    if p["large"]:
                        pieces = []
                        while n:
                            half = (first - 1) // width  # columns half * width + 1 to (half + 1) * width
                            k = min(n, (half + 1) * width - first + 1)
                            core = raw[a - first + (half + 1) * width : a - first + half * width + 1 + length]
                            own = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=key.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)
                            pieces.append((a, k, first, own ^ half))
                            a, n, first = a + k, n - k, first + k
                    for a, n, first, key in pieces:
                        x = raw[a : a + n + length - 1]
                        size += len(x)
                        for column, value in zip(out, (doc, row, a, n, first, p["lone"], key, x), strict=True):
                            column.append(value)
                if size > COLLECTION_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                    out, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return cut


def _build(length: int):
    def finish(t: pa.Table) -> pa.RecordBatch:
        key = t.column("key").to_numpy()
        group = np.cumsum(np.append(0, key[1:] != key[:-1]))
        count = t.column("n").to_numpy().astype(np.int64)
        marked = repeated_windows(group, t.column("first").to_numpy().astype(np.int64), count, t.column("bytes").to_pylist(), length)
        # maximal runs of marked windows of each segment whose bytes occur once as a whole
        owner = np.repeat(np.arange(len(count)), count)
        edge = np.append(True, owner[1:] != owner[:-1])
        opens = np.flatnonzero(marked & (edge | ~np.append(False, marked[:-1])))
        shuts = np.flatnonzero(marked & (np.append(edge[1:], True) | ~np.append(marked[1:], False)))
        rows = owner[opens]
        base = t.column("start").to_numpy() - (np.cumsum(count) - count)
        lone = t.column("lone").to_numpy(zero_copy_only=False)[rows]
        rows, opens, shuts = rows[lone], opens[lone], shuts[lone]
        take = lambda c: t.column(c).combine_chunks().take(pa.array(rows))
        return pa.RecordBatch.from_arrays([_flat(take("doc_id")), _flat(take("row")), pa.array(base[rows] + opens), pa.array(base[rows] + shuts + length)], ["doc_id", "row", "first_byte", "end_byte"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            sizes = np.cumsum(batch.column("n").to_numpy().astype(np.int64) + length - 1)
            heads = np.flatnonzero(key[1:] != key[:-1]) + 1
            if held and held[-1].column("key")[-1].as_py() != key[0]:
                heads = np.append(0, heads)
            done = 0
            for h in heads.tolist():  # a collection ends with a group
                if size + (sizes[h - 1] if h else 0) - (sizes[done - 1] if done else 0) >= COLLECTION_BYTES:
                    yield finish(pa.Table.from_batches([*held, batch.slice(done, h - done)]))
                    held, size, done = [], 0, h
            held.append(batch.slice(done))
            size += int(sizes[-1] - (sizes[done - 1] if done else 0))
        if held:
            yield finish(pa.Table.from_batches(held))

    return build


def _flat(x):
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first_byte", pa.int64()), ("end_byte", pa.int64())])), pa.binary()]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
            raw, merged, kept, done = text.encode(), [], [], 0
            for s in sorted(spans or [], key=lambda s: s["first_byte"]):
                if merged and s["first_byte"] <= merged[-1]["end_byte"]:
                    merged[-1]["end_byte"] = max(merged[-1]["end_byte"], s["end_byte"])
                else:
                    merged.append(s)
            for s in merged:
                kept.append(raw[done : s["first_byte"]])
                done = s["end_byte"]
            kept = b"".join([*kept, raw[done:]])
            for column, value in zip(out, (doc, len(raw), len(raw) - len(kept), merged, kept), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
