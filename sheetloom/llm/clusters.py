"""Centroid clustering of integer vectors in which segment norms screen centroids before exact distances."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch

#: Segments of a vector whose norms are kept beside it.
SEGMENTS = 16


def finite(embedding):
    """Whether no component is null, infinite or not a number."""
    big = F.lit(float("inf"))
    return F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (x < big) & (x > -big)), F.lit(False))


def segment_norms(x: np.ndarray, segments: int) -> np.ndarray:
    """Norms of the segments of integer vectors, rounded up."""
    squares = np.stack([(part * part).sum(1) for part in np.array_split(x, segments, axis=1)], 1)
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    return root + (root * root < squares)


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector and its squared distance, ties to the smaller number; and how many distances
    were computed. By Cauchy-Schwarz in each segment |x - c|^2 is |x|^2 + |c|^2 - 2 (sum of products of segment norms) at
    least. Centroids are taken by ascending bounds, and those whose bound exceeds the best distance are left out."""
    own = segment_norms(centroids, norms.shape[1])
    bound = (x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * norms @ own.T
    order = np.argsort(bound, axis=1, kind="stable")
    rows, exact = np.arange(len(x)), 0
    best, which = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(centroids))
    for place in range(len(centroids)):
        c = order[rows, place]
        open_ = bound[rows, c] <= best[rows]
        rows, c = rows[open_], c[open_]
        if not len(rows):
            break
        apart = x[rows] - centroids[c]
        d = np.einsum("ij,ij->i", apart, apart)
        better = (d < best[rows]) | ((d == best[rows]) & (c < which[rows]))
        best[rows[better]], which[rows[better]] = d[better], c[better]
        exact += len(rows)
    return which, best, exact


def _unpack(batch: pa.RecordBatch, dims: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.int32).reshape(n, dims).astype(np.int64)
    return x, np.frombuffer(b"".join(batch.column("norms").to_pylist()), np.int64).reshape(n, segments)


def cluster_vectors(embeddings: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3", segments: int = SEGMENTS) -> DataFrame:
    """Vectors of `dims` finite components, taken as integers floor(scale * x), in k clusters after `rounds` rounds.

    Centroids start as the k vectors of the smallest sha256 of `<seed>:<vec_id>` (ties: by components). A round gives each
    vector to the nearest centroid (squared distance, ties: smaller number) and replaces each centroid that has vectors by
    the componentwise floor of their mean; then vectors are assigned once more. All distances and sums are exact.

    Vectors are written once as 32-bit integers with the norms of their segments. In a round each task adds up its vectors
    by cluster, Spark adds those sums, and only k sums of `dims` components come to the driver. `nearest` says how
    centroids are screened.

    Returns one row for each kept row: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 (of the final
    centroid's components in decimal, joined by commas). Rows that are null, of another length or with null or non-finite
    components are left out. Rows that repeat count as often, each with a row of its own; a null id is hashed as an empty
    text and kept. With fewer than k vectors there are as many centroids as vectors. Components too large for exact 64-bit
    distances raise an error. An empty table gives no rows. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "clusters")
    most = math.isqrt((1 << 60) // dims)
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter((F.size("embedding") == dims) & finite("embedding"))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("vector"))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
            if len(x) and max(x.max(), -x.min()) > min(most, (1 << 31) - 1):
                raise ValueError(f"components beyond {most} have no exact 64-bit distances")
            norms = segment_norms(x, segments)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([v.tobytes() for v in x.astype(np.int32)], pa.binary()), pa.array([v.tobytes() for v in norms], pa.binary())], ["vec_id", "vector", "norms"]
            )

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    packed = scratch.write(rows.mapInArrow(compress, f"vec_id {kind}, vector binary, norms binary"), "packed")
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(start.alias("hash"), "vector").orderBy("hash", "vector").limit(k).collect()
    centroids = np.array([r["vector"] for r in first], np.int64).reshape(len(first), dims)

    def sums(now: np.ndarray):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, norms = _unpack(batch, dims, segments)
                which, _, _ = nearest(x, norms, now)
                for c in np.unique(which):
                    own = x[which == c]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(dims, c, np.int32)), pa.array(np.arange(dims, dtype=np.int32)), pa.array(own.sum(0)), pa.array(np.full(dims, len(own), np.int64))], ["cluster", "place", "total", "n"])

        return each

    for _ in range(rounds if len(first) else 0):
        added = packed.mapInArrow(sums(centroids), "cluster int, place int, total long, n long").groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        centroids = centroids.copy()
        for r in added.collect():  # k times dims rows
            centroids[r["cluster"], r["place"]] = int(r["total"]) // r["n"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, distance, _ = nearest(*_unpack(batch, dims, segments), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(which.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = scratch.write(packed.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "assigned")
    spread = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    scratch.drop("packed")
    of_cluster = lambda values, kind: F.element_at(F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>"), F.col("cluster") + 1)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster([spread.get(c, 0) for c in range(len(names))], "long").alias("cluster_inertia"),
        F.lit(sum(spread.values())).cast("long").alias("inertia"),
        of_cluster(names, "string").alias("centroid_sha256"),
    )
