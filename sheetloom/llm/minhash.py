"""MinHash near-dedup by an inverted join over signature coordinates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import Scratch, groups, spread_join
from .tokens import NON_SPACE, Block, blocks, mix, words

SHINGLE = 5
COORDINATES = 48
#: Probability at most that a pair at the threshold shares too few coordinates, or too few of the sketch, to be confirmed.
MISS = 1e-9
#: Documents around one hub that are compared with as many others in one step, and bytes of their differences from it.
HUB_BLOCK, HUB_BYTES = 512, 8 << 20
#: Coordinates of the sketch by which documents around a hub are compared where their differences from it are not held.
SKETCH = 256
#: Similarity (hundredths) to a hub from which a document's difference from it is held.
HELD_PERCENT = 45

_random = np.random.default_rng(48)
_MULTIPLY = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_SKETCH_MULTIPLY = _random.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH_FLIP = _random.integers(0, 1 << 63, SKETCH, dtype=np.uint64)
_STEP = _random.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_shared(n: int, percent: int) -> int:
    """How many of n coordinates a pair must share, so that one of similarity `percent` hundredths falls short with a
    probability of MISS at most."""
    p, fewer = percent / 100, 0.0
    for k in range(n):
        fewer += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if fewer > MISS:
            return max(1, k)
    return n


def shingle_sets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, one text after the other; where each text's begin."""
    _, _, first, word = words(block, NON_SPACE)
    n = len(word)
    full = max(n - SHINGLE + 1, 0)
    shingle = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        shingle[:full] += word[j : j + full] * _STEP[j]
    shingle = mix(shingle)
    sets, bounds = [], np.zeros(len(first), np.int64)
    for k in range(len(first) - 1):
        a, b = int(first[k]), int(first[k + 1])
        if b - a >= SHINGLE:
            own = np.sort(shingle[a : b - SHINGLE + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif b > a:
            own = mix(np.array([np.sum(word[a:b] * _STEP[: b - a], dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            own = shingle[:0]
        sets.append(own)
        bounds[k + 1] = bounds[k] + len(own)
    return np.concatenate(sets) if sets else shingle[:0], bounds


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "set_a", "set_b", "coordinates"]
    for batch in batches:
        for block in blocks(batch.column("text")):
            flat, bounds = shingle_sets(block)
            sizes = np.diff(bounds)
            some = np.flatnonzero(sizes)
            at = bounds[some]
            both = np.zeros((2, len(sizes)), np.uint64)
            signature = np.zeros((len(some), COORDINATES), np.int64)
            if len(some):
                both[0, some] = np.add.reduceat(mix(flat ^ _FLIP[0]), at)
                both[1, some] = np.add.reduceat(mix(flat ^ _FLIP[1]), at)
                for k in range(COORDINATES):
                    least = np.minimum.reduceat((flat ^ _FLIP[k]) * _MULTIPLY[k], at)
                    signature[:, k] = (least >> np.uint64(32)).astype(np.int64) | (k << 32)
            each = np.zeros(len(sizes) + 1, np.int32)
            each[1:] = np.cumsum(sizes > 0) * COORDINATES
            lists = pa.ListArray.from_arrays(pa.array(each, pa.int32()), pa.array(signature.ravel(), pa.int64()))
            ids = batch.column("doc_id").slice(block.first, len(sizes))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(both[0].view(np.int64)), pa.array(both[1].view(np.int64)), lists], names)


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text")):
            flat, bounds = shingle_sets(block)
            prints = [_sketch(flat[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, len(prints)), sets, pa.array(prints, pa.binary())], ["doc_id", "shingles", "sketch"])


def _sketch(own: np.ndarray) -> bytes:
    """The top byte of the mixed minimum of each of SKETCH coordinates."""
    out = np.zeros(SKETCH, np.uint8)
    step = max(1, min(32, (1 << 16) // max(1, len(own))))  # coordinates at once, so that long sets need no more memory
    for k in range(0, SKETCH if len(own) else 0, step):
        least = ((own ^ _SKETCH_FLIP[k : k + step, None]) * _SKETCH_MULTIPLY[k : k + step, None]).min(1)
        out[k : k + step] = mix(least) >> np.uint64(56)
    return out.tobytes()


def _linked(x, y, apart, percent: int):
    """Whether sets of sizes x and y that differ in `apart` shingles are similar enough; numbers, arrays or columns."""
    return 100 * (x + y - apart) >= percent * (x + y + apart)


def _against(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v): whether their full sets are linked, the size of the first, and where they are not too far from each
    other (HELD_PERCENT) in what they differ."""
    x, y = (sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(s)) for k, s in (("u", "x"), ("v", "y")))
    both = spread_join(pairs, y, ["v"]).join(x, "u")
    n, m = F.size("x").cast("long"), F.size("y").cast("long")
    apart = n + m - 2 * F.size(F.array_intersect("x", "y"))
    delta = F.when(_linked(n, m, apart, HELD_PERCENT), F.concat(F.array_except("x", "y"), F.array_except("y", "x")))
    return both.select("u", "v", _linked(n, m, apart, percent).alias("linked"), n.alias("size"), delta.alias("delta"))


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shingles that each difference of the left shares with each of the right."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, element, times = np.unique(flat, return_inverse=True, return_counts=True)
    many = times[element] > 1
    element, owner = np.unique(element[many], return_inverse=True)[1], owner[many]
    row = {k: np.full(len(sets), -1) for k in ("left", "right")}
    row["left"][left], row["right"][right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(element.max(initial=-1)) + 1, 4096):
        some = (element >= low) & (element < low + 4096)
        sides = []
        for name, n in (("left", len(left)), ("right", len(right))):
            matrix = np.zeros((n, 4096), np.float32)
            mine = some & (row[name][owner] >= 0)
            matrix[row[name][owner[mine]], element[mine] - low] = 1
            sides.append(matrix)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _compare(percent: int):
    """Rows sorted by (hub, i, j): the pairs of different components in each group. Where both differences from the hub
    are held, links follow exactly, and of these only what each document reaches is passed on (sure); other pairs are
    passed on if their sketches agree enough."""
    sketch_shared = least_shared(SKETCH, percent)

    def one(t: pa.Table) -> pa.RecordBatch | None:
        part, i, j, side = (t.column(c).to_numpy() for c in ("component", "i", "j", "side"))
        if (part == part[0]).all():
            return None
        doc, size = t.column("doc_id").to_numpy(), t.column("size").to_numpy(zero_copy_only=False)
        lists = t.column("delta").combine_chunks()
        held = lists.is_valid().to_numpy(zero_copy_only=False)
        edges, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        delta = [flat[p:q] for p, q in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        left = right = np.arange(len(doc))
        if i[0] != j[0]:
            left, right = left[side == i[0]], right[side == j[0]]
        u, v, sure = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        a, b = left[held[left]], right[held[right]]
        if len(a) and len(b):
            kept = np.flatnonzero(held)
            at = np.full(len(doc), -1)
            at[kept] = np.arange(len(kept))
            n = np.array([len(delta[k]) for k in kept])
            apart = n[at[a]][:, None] + n[at[b]] - 2 * _overlaps([delta[k] for k in kept], at[a], at[b])
            link = _linked(size[a][:, None], size[b], apart, percent) & (part[a][:, None] != part[b])
            x, y = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
            if len(x):
                link, mine, theirs = link[np.ix_(x, y)], doc[a[x]], doc[b[y]]
                most, one_side, other = np.iinfo(np.int64).max, mine, theirs
                while True:
                    now = np.minimum(one_side, np.where(link, other, most).min(1))
                    then = np.minimum(other, np.where(link, now[:, None], most).min(0))
                    if (now == one_side).all() and (then == other).all():
                        break
                    one_side, other = now, then
                u.append(np.concatenate([mine, theirs]))
                v.append(np.concatenate([one_side, other]))
                sure.append(np.ones(len(u[-1]), bool))
        prints = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(doc), SKETCH)
        for k in left.tolist():
            there = right[right > k] if i[0] == j[0] else right
            there = there[(part[there] != part[k]) & ~(held[there] & held[k])]
            there = there[np.count_nonzero(prints[there] == prints[k], axis=1) >= sketch_shared]
            u.append(np.full(len(there), doc[k]))
            v.append(doc[there])
            sure.append(np.zeros(len(there), bool))
        u, v, sure = np.concatenate(u), np.concatenate(v), np.concatenate(sure)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v)), pa.array(sure)], ["u", "v", "sure"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["hub", "i", "j"]):
            found = one(t)
            if found is not None and found.num_rows:
                yield found

    return compare


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """Groups of documents linked by near-equal word-shingle sets.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a set holds the distinct 5-word shingles of
    the whole text, or its whole word sequence where it has 1 to 4 words. Documents are linked if their sets have a
    similarity of `percent` hundredths at least (sets are held as 64-bit shingle hashes).

    1. Equal sets are one class, joined by set hash; the smallest id stands for a class.
    2. Each representative is posted under its 48 coordinate-value pairs. Pairs under which it stands alone are
       skipped, and of the others it stays posted under the rarest only: two signatures that share t (least_shared)
       of n coordinates share one among the n - t + 1 rarest (prefix), and long posting lists are skipped.
    3. Every posted document is compared with one hub of each of its lists, the one that shares most lists; pairs that
       share t coordinates are confirmed on their full sets. Groups of many copies thus give a row for each
       document rather than one for each pair.
    4. Two documents of a list share its hub. Around each hub that still has several components, documents of
       different components are compared, HUB_BLOCK by HUB_BLOCK: if the differences of both from the hub are held,
       their own difference follows exactly from these; else their sketches must agree before their full sets are
       compared. Only connections are passed on, not pairs.

    Returns one row for each row of `documents`: doc_id, n_shingles, component_id (smallest id reached), kept (doc_id
    = component_id). Null or wordless texts have 0 shingles and stand alone. Rows with a null id link with nothing
    and are kept, with a null component_id. Rows that share an id are one document with the links of all of them. Of
    equally heavy hubs the larger id is taken, which changes no result. An empty table gives no rows. Ids are taken as long.
    A text is held whole by its task, at about ten bytes for each of its own. Other columns are ignored.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "minhash")
    shared_least = least_shared(COORDINATES, percent)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.write(docs.mapInArrow(_signed, "doc_id long, n_shingles long, set_a long, set_b long, coordinates array<long>"), "signed")
    own = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = own.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.min_by("coordinates", "doc_id").alias("coordinates"))
    classes = scratch.write(classes, "classes")
    posted = classes.select("rep", F.explode("coordinates").alias("token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    # the rarest of its lists: those in which it is alone come first, and need no posting
    prefix = (
        posted.join(shared, "token")
        .groupBy("rep")
        .agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("lists"))
        .filter(F.size("lists") >= shared_least)
        .select("rep", F.slice("lists", 1, F.size("lists") - (shared_least - 1)).alias("lists"))
        .select("rep", F.aggregate("lists", F.lit(0).cast("long"), lambda s, x: s + x.n).alias("weight"), F.explode("lists.token").alias("token"))
    )
    prefix = scratch.write(prefix, "prefix")
    hubs = prefix.groupBy("token").agg(F.max(F.struct("weight", "rep")).alias("hub")).select("token", F.col("hub.rep").alias("hub"))
    around = scratch.write(prefix.join(hubs, "token").select(F.col("rep").alias("u"), F.col("hub").alias("v")).distinct(), "around")
    scratch.drop("prefix")
    coordinates = classes.select("rep", "coordinates")
    first = (
        spread_join(around.filter("u <> v"), coordinates.select(F.col("rep").alias("v"), F.col("coordinates").alias("y")), ["v"])
        .join(coordinates.select(F.col("rep").alias("u"), F.col("coordinates").alias("x")), "u")
        .filter(F.size(F.array_intersect("x", "y")) >= shared_least)
        .select("u", "v")
    )
    first = scratch.write(first, "first")
    # only texts of documents with a hub are read again; their ids are written, so that Spark knows their size
    several = around.groupBy("v").agg(F.count("*").alias("n")).filter("n > 2").select("v")
    wanted = first.select(F.col("u").alias("doc_id")).union(first.select("v")).union(around.join(several, "v", "left_semi").select("u")).distinct()
    wanted = scratch.write(wanted, "wanted")
    sets = scratch.write(docs.join(wanted, "doc_id", "left_semi").mapInArrow(_shingles, "doc_id long, shingles array<long>, sketch binary"), "sets", "lz4")
    near = scratch.write(_against(first, sets, percent).dropDuplicates(["u", "v", "linked", "delta"]), "near", "lz4")
    parts = scratch.write(connected_components(near.filter("linked").select("u", "v"), scratch, "part"), "parts")

    placed = around.join(parts.select(F.col("node").alias("u"), "component"), "u", "left").select("u", "v", F.coalesce("component", "u").alias("component"))
    placed = scratch.write(placed, "placed")
    mixed = placed.groupBy("v").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most and n > 2")
    weight = near.groupBy("v").agg(F.sum(8 * F.size("delta").cast("long")).alias("bytes"))
    mixed = mixed.join(weight, "v", "left").select("v", F.ceil(F.greatest(F.col("n") / HUB_BLOCK, F.coalesce("bytes", F.lit(0)) / HUB_BYTES)).cast("int").alias("n_blocks"))
    dealt = (
        spread_join(placed, mixed, ["v"])
        .join(near.select("u", "v", "size", "delta"), ["u", "v"], "left")
        .join(sets.select(F.col("doc_id").alias("u"), "sketch", F.size("shingles").cast("long").alias("own_size")), "u")
        .withColumn("side", F.pmod(F.xxhash64("u"), F.col("n_blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select(
            F.col("v").alias("hub"), F.col("u").alias("doc_id"), "component", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "sketch",
            F.coalesce("size", "own_size").alias("size"), F.when(F.col("u") == F.col("v"), F.coalesce("delta", F.array().cast("array<long>"))).otherwise(F.col("delta")).alias("delta"),
        )
    )
    dealt = dealt.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    second = scratch.write(dealt.mapInArrow(_compare(percent), "u long, v long, sure boolean").distinct(), "second")
    guessed = second.filter("not sure").select("u", "v").join(first, ["u", "v"], "left_anti")
    found = _against(scratch.write(guessed, "guessed"), sets, percent).filter("linked").select("u", "v")
    found = found.union(second.filter("sure").select("u", "v"))
    found = found.join(parts.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left").join(parts.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
    twice = own.select("doc_id", "set_a", "set_b").join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"]).groupBy("doc_id").agg(F.collect_set("rep").alias("reps"), F.min("rep").alias("u")).filter(F.size("reps") > 1).select("u", F.explode("reps").alias("v"))
    links = scratch.write(found.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).union(parts.select("node", "component")).union(twice), "links")
    for name in ("sets", "near", "around", "placed", "first", "wanted", "parts", "second", "guessed"):
        scratch.drop(name)
    final = connected_components(links, scratch, "final")
    reps = classes.select("set_a", "set_b", "rep").join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(reps, ["set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

