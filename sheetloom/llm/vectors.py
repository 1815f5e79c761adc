"""Embedding near-dedup: an exact metric range join over cells around pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import Scratch, groups, spread_join

#: Vectors for each pivot, on average; with more than PIVOTS pivots at this rate, fewer are taken.
CELL = 2000
PIVOTS = 4096
#: Distances to pivots that a task holds at a time.
DISTANCES = 1 << 20
#: Vectors of a cell that are compared with as many others in one step.
BLOCK = 2048


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def near_vectors(embeddings: DataFrame, least_cosine: float = 0.98, cell: int = CELL, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """Vectors of equal labels whose cosine, in double precision, is `least_cosine` at least.

    Unit vectors of that cosine lie within r = sqrt(2 - 2 * least_cosine) of each other. Pivots are the vectors whose
    hash is 0 modulo a number, so that about one in `cell` of each label is one, and `pivots` in all at most, on average;
    they are broadcast. Each vector belongs to the cell of its nearest pivot, and is copied to each other cell that could
    hold a vector within r: by the triangle inequality its distance to that pivot exceeds the nearest by 2r at most, and
    the plane half way between the two pivots is within r. Cells join independently, `block` vectors by `block` at a
    time. Links are counted where the first vector belongs; of each block only the connections are passed on. Equal
    vectors of a label are one class, which enters once with its number of members, so that copies make no pairs.

    Returns one row for each row: vec_id, n_links, component_id (smallest vec_id reached), kept (vec_id =
    component_id). Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label
    or id, link with nothing. Vectors of different lengths are not compared. Rows alike in id, label and vector are one
    vector, which comes out as often; rows that share an id but differ are vectors of their own, in one component. A
    null id is kept, with a null component. Of equally near pivots the first counts. Ids are taken as long. An empty
    table gives no rows. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "vectors")
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = vectors.groupBy("vec_id", "label", "embedding").agg(F.count("*").alias("copies"))
    big = F.lit(float("inf"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (x < big) & (x > -big)) & F.exists("embedding", lambda x: x != 0)
    compared = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    vectors = scratch.write(vectors.withColumn("row", F.when(compared, F.xxhash64("label", "embedding"))), "vectors")
    valid = vectors.filter("row is not null").groupBy("row", "label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("members"))
    valid = scratch.write(valid, "valid")
    every = max(cell, math.ceil(valid.count() / pivots))
    chosen: dict[tuple, list] = {}
    for r in valid.filter(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select("label", "embedding").collect():  # about `pivots` rows at most
        chosen.setdefault((r["label"], len(r["embedding"])), []).append(r["embedding"])
    shared = spark.sparkContext.broadcast({k: _unit(np.array(v)) for k, v in chosen.items()})
    radius = math.sqrt(max(0.0, 2 - 2 * least_cosine)) + 1e-7

    def cells(x: np.ndarray, points: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, pivot and whether it is the nearest one, of each copy of unit vectors."""
        every = np.arange(len(x))
        if points is None:
            return every, np.zeros(len(x), np.int32), np.ones(len(x), bool)
        distance = np.sqrt(np.maximum(0, 2 - 2 * x @ points.T))
        nearest = distance.argmin(1)
        least = distance[every, nearest][:, None]
        apart = np.sqrt(np.maximum(0, 2 - 2 * points[nearest] @ points.T))
        near = (distance - least <= 2 * radius) & (distance**2 - least**2 <= 2 * radius * apart + 1e-9)
        near[every, nearest] = True
        there, where = np.nonzero(near)
        return there, where, where == nearest[there]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, labels = batch.column("embedding"), np.array(batch.column("label").to_pylist(), object)
            dims = np.array([len(x) for x in lists])
            for key in {*zip(labels.tolist(), dims.tolist(), strict=True)}:
                points, every = shared.value.get(key), np.flatnonzero((labels == key[0]) & (dims == key[1]))
                step = max(1, DISTANCES // (1 if points is None else len(points)))
                for rows in (every[k : k + step] for k in range(0, len(every), step)):
                    raw = np.array(lists.take(pa.array(rows)).to_pylist(), np.float64)
                    there, where, own = cells(_unit(raw), points)
                    pick = pa.array(rows[there])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("label").take(pick), pa.array(np.full(len(there), key[1], np.int32)), pa.array(where.astype(np.int32)), pa.array(own), batch.column("vec_id").take(pick), batch.column("row").take(pick), batch.column("members").take(pick), pa.array([v.tobytes() for v in raw[there]], pa.binary())],
                        ["label", "dims", "pivot", "own", "vec_id", "row", "members", "vector"],
                    )

    at = ["label", "dims", "pivot"]
    assigned = scratch.write(valid.select("label", "vec_id", "row", "members", "embedding").mapInArrow(assign, "label string, dims int, pivot int, own boolean, vec_id long, row long, members long, vector binary"), "assigned", "lz4")
    sizes = assigned.groupBy(*at).agg(F.ceil(F.count_if("own") / block).cast("int").alias("n_own"), F.ceil(F.count("*") / block).cast("int").alias("n_all")).filter("n_own > 0")
    placed = assigned.join(sizes, at)
    slot = lambda n: F.pmod(F.xxhash64("row", "own"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    first = placed.filter("own").withColumn("i", slot("n_own")).select(*at, "i", upto("n_all").alias("j"), F.lit(True).alias("side"), "vec_id", "row", "members", "vector")
    second = placed.withColumn("j", slot("n_all")).select(*at, upto("n_own").alias("i"), "j", F.lit(False).alias("side"), "vec_id", "row", "members", "vector")
    dealt = first.unionByName(second).repartition(*at, "i", "j").sortWithinPartitions(*at, "i", "j")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, [*at, "i", "j"]):
            side = t.column("side").to_numpy()
            a, b = np.flatnonzero(side), np.flatnonzero(~side)
            if not len(a) or not len(b):
                continue
            raw, ids, rows = _scaled(_matrix(t.column("vector"))), t.column("vec_id").to_numpy(), t.column("row").to_numpy()
            x, y = _unit(raw[a]), _unit(raw[b])
            cosine = x @ y.T
            linked = cosine >= least_cosine
            for p, q in zip(*np.nonzero(np.abs(cosine - least_cosine) < 1e-9), strict=True):
                u, v = raw[a[p]], raw[b[q]]
                linked[p, q] = u @ v / (math.sqrt(u @ u) * math.sqrt(v @ v)) >= least_cosine
            linked &= rows[a][:, None] != rows[b]
            some, other = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
            if not len(some):
                continue
            links, mine, theirs = linked[np.ix_(some, other)], ids[a[some]], ids[b[other]]
            most, left, right = np.iinfo(np.int64).max, mine, theirs
            while True:  # the smallest id that each reaches within the block
                left_now = np.minimum(left, np.where(links, right, most).min(1))
                right_now = np.minimum(right, np.where(links, left_now[:, None], most).min(0))
                if (left_now == left).all() and (right_now == right).all():
                    break
                left, right = left_now, right_now
            node, least = np.concatenate([mine, theirs]), np.concatenate([left, right])
            members = t.column("members").to_numpy()[b[other]]
            count = np.concatenate([(links * members).sum(1), np.zeros(len(theirs), np.int64)])
            row = np.concatenate([rows[a[some]], rows[b[other]]])
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(node), pa.array(least), pa.array(count.astype(np.int64))], ["row", "node", "least", "n"])

    found = scratch.write(dealt.mapInArrow(join, "row long, node long, least long, n long"), "found")
    scratch.drop("assigned")
    # classes stand for their members; an id of several rows joins its classes
    several = vectors.filter("vec_id is not null").groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id")
    several = scratch.write(vectors.select("vec_id", "row").join(several, "vec_id", "left_semi"), "several")
    ids = several.join(valid.select("row", F.col("vec_id").alias("v")), "row").select(F.col("vec_id").alias("u"), "v")
    parts = connected_components(found.select(F.col("node").alias("u"), F.col("least").alias("v")).union(ids), scratch)
    parts = parts.select(F.col("node").alias("vec_id"), "component")
    others = valid.filter("members > 1").select("row", F.col("vec_id").alias("node"), (F.col("members") - 1).alias("n"))
    linked = found.select("row", "node", "n").union(others).groupBy("row").agg(F.min("node").alias("vec_id"), F.sum("n").alias("n_links"))
    linked = linked.join(parts, "vec_id", "left").select("row", "n_links", F.coalesce("component", "vec_id").alias("component"))
    shared_ids = several.select("vec_id").distinct().join(parts.withColumnRenamed("component", "by_id"), "vec_id")
    out = spread_join(vectors.select("vec_id", "row", "copies"), linked, ["row"], "left").join(shared_ids, "vec_id", "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("by_id", "component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which changes no digit; else squares of very large or small numbers are lost."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
