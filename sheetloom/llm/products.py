"""Exact top-k inner products: vectors by descending length, partial sums in an SVD's axes, bounds by Cauchy-Schwarz."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clusters import finite
from .tables import Scratch, groups

#: Candidates and queries of a block; with more than MOST_BLOCKS blocks of candidates they grow instead.
CANDIDATES, QUERIES, MOST_BLOCKS = 4096, 4096, 1 << 18
#: The longest vectors, from which each query has a first threshold; and those of the sample that the axes are fitted on.
HEAD, FIT_ROWS = 1024, 8192
#: Axes and first thresholds are made for the LENGTHS most frequent numbers of components of up to LONGEST.
LENGTHS, LONGEST = 8, 512
#: Queries and candidates that are compared in one step.
SLICE, CHUNK = 256, 1024
_NONE = np.iinfo(np.int64).min


def axes(x: np.ndarray) -> np.ndarray:
    """Right singular vectors by descending singular values, as columns."""
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


def best_products(q: np.ndarray, q_ids: np.ndarray, least: np.ndarray, x: np.ndarray, ids: np.ndarray, turn: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For integer queries q the k best candidates x of another id with scores of `least` or more: number of the query, id
    and score; and how many scores were computed. Candidates go by descending length, in chunks. A chunk ends the search
    of a slice of queries if |q||x| is below all their thresholds. In it, sums over the first quarter and three quarters
    of the axes, and the product of what is left of both lengths, bound the score; the others get exact scores, and the
    k-th best of a query raises its threshold."""
    order = np.argsort(-np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64)), kind="stable")
    x, ids = x[order], ids[order]
    dims, computed = x.shape[1], 0
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    long_q, long_x = np.sqrt((qf * qf).sum(1)), np.sqrt((xf * xf).sum(1))
    in_floats = long_q.max() * long_x.max() < 1 << 52  # then all sums are exact in floats
    turned_q, turned_x = (qf, xf) if turn is None else (qf @ turn, xf @ turn)
    cuts = sorted({dims // 4, dims * 3 // 4} - {0, dims})
    rest = {c: (np.sqrt((turned_q[:, c:] ** 2).sum(1)), np.sqrt((turned_x[:, c:] ** 2).sum(1))) for c in cuts}
    steps = [b for b in (0, 64, 128, 256, 512) if b < len(x)] + list(range(CHUNK, len(x), CHUNK))  # short ones first, for thresholds
    out = []
    for a in range(0, len(q), SLICE):
        s = slice(a, a + SLICE)
        limit = least[s].copy()
        held_q, held_id, held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b, e in zip(steps, [*steps[1:], len(x)], strict=True):
            c = slice(b, e)
            slack = 1e-9 * np.outer(long_q[s], long_x[c]) + 1e-6
            if not (long_q[s] * long_x[b] * (1 + 1e-9) + 1e-6 >= limit).any():
                break
            live, part, done = np.outer(long_q[s], long_x[c]) + slack >= limit[:, None], 0, 0
            for cut in cuts:
                part = part + turned_q[s, done:cut] @ turned_x[c, done:cut].T
                live &= part + np.outer(rest[cut][0][s], rest[cut][1][c]) + slack >= limit[:, None]
                done = cut
                if live.mean() < 0.02:
                    break
            i, j = np.nonzero(live & (q_ids[s][:, None] != ids[c]))
            if in_floats and len(i) > live.size // 16:
                score = (qf[s] @ xf[c].T)[i, j].astype(np.int64)
            else:
                score = np.einsum("ij,ij->i", q[s][i], x[c][j])
            computed += len(i)
            good = score >= limit[i]
            if not good.any():
                continue
            held_q, held_id, held = np.append(held_q, i[good]), np.append(held_id, ids[c][j[good]]), np.append(held, score[good])
            by = np.lexsort((held_id, -held, held_q))
            place = np.arange(len(by)) - np.searchsorted(held_q[by], held_q[by])
            by, place = by[place < k], place[place < k]
            held_q, held_id, held = held_q[by], held_id[by], held[by]
            full = place == k - 1
            limit[held_q[full]] = np.maximum(limit[held_q[full]], held[full])
        out.append((held_q + a, held_id, held))
    return *(np.concatenate(v) for v in zip(*out, strict=True)), computed


def _ints(column) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.int32).reshape(len(raw), -1).astype(np.int64)


def _numbered(df: DataFrame, order: list[Column], size: int, name: str, scratch: Scratch) -> DataFrame:
    """Rows in the given order, which begins with dims, in blocks of `size` rows of one dims. Spark orders ranges, each task
    numbers its own rows, and the ranges' sizes, one row for each range and dims, say where each begins."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = {}, TaskContext.get().partitionId()
        for batch in batches:
            dims, place = batch.column("dims").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                place[own] = seen.get(d, 0) + np.arange(len(own))
                seen[d] = seen.get(d, 0) + len(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(place)], [*batch.schema.names, "part", "place"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    placed = scratch.write(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{kinds}, part int, place long"), name)
    before = Window.partitionBy("dims").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = placed.groupBy("dims", "part").agg(F.count("*").alias("n")).withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return placed.join(begins, ["dims", "part"]).withColumn(name, F.expr(f"(begin + place) div {size}")).drop("part", "place", "begin")


def top_products(embeddings: DataFrame, is_query: Column, k: int = 20, scale: int = 64, candidates: int = CANDIDATES, queries: int = QUERIES, head: int = HEAD) -> DataFrame:
    """The k highest integer inner products of each query with all other vectors: query_id, rank (from 1), vec_id, score.

    Components count as floor(scale * x). Queries are the rows where `is_query`, a condition on vec_id, holds; candidates
    are all rows of another id and the same number of components. Equal scores go by the smaller vec_id.

    Each query first meets the `head` longest vectors, so that its k-th best there is a threshold for all blocks. Candidates
    are dealt in blocks by descending length, queries in blocks by the least length that can matter to them; a pair of
    blocks meets only if |q||x| can reach a threshold. `best_products` searches a pair; its axes come from a bounded sample
    (any axes give the same rows). Each pair hands on k rows a query at most, and a window keeps the k best of all.

    Vectors that are null or empty or hold null or non-finite components, and rows without an id, take no part. Rows alike
    in id and vector are one vector; rows that share an id but differ are vectors of their own, which do not meet each
    other, and each such query has ranks of its own. Where there are fewer than k candidates, all are listed. Vectors too
    long for exact 64-bit scores raise an error. An empty table gives no rows. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "products")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite("embedding"))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("vector"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.array(v, np.int64) for v in batch.column("vector").to_pylist()]
            squares = [float((v.astype(np.float64) ** 2).sum()) for v in lists]
            if any(s >= 1 << 62 for s in squares) or any(np.abs(v).max() >= 1 << 31 for v in lists):
                raise ValueError("vectors of a length of 2^31 have no exact 64-bit products")
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([len(v) for v in lists], pa.int32()), pa.array(squares, pa.float64()), pa.array([v.astype(np.int32).tobytes() for v in lists], pa.binary())], ["vec_id", "dims", "square", "vector"]
            )

    packed = rows.mapInArrow(pack, "vec_id long, dims int, square double, vector binary").dropDuplicates(["vec_id", "vector"])
    packed = scratch.write(packed.withColumn("asks", F.coalesce(is_query, F.lit(False))), "packed")
    lengths = packed.filter(F.col("dims") <= LONGEST).groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(LENGTHS).collect()
    turns, heads = {}, {}
    for dims, n in lengths:
        own = packed.filter(F.col("dims") == dims)
        share = int(1_000_003 * min(1.0, FIT_ROWS / n))
        sample = own.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < share).select("vector").limit(2 * FIT_ROWS)
        fitted = np.array([np.frombuffer(r["vector"], np.int32) for r in sample.collect()], np.float64).reshape(-1, dims)
        turns[dims] = axes(fitted) if len(fitted) else None
        first = own.orderBy(F.desc("square"), "vec_id").limit(head).select("vec_id", "vector").collect()  # `head` rows
        heads[dims] = (np.array([np.frombuffer(r["vector"], np.int32) for r in first], np.int64), np.array([r["vec_id"] for r in first], np.int64))
    shared = spark.sparkContext.broadcast((turns, heads))  # bounded by LENGTHS, LONGEST and `head`

    def threshold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, ids, least = batch.column("dims").to_numpy(), batch.column("vec_id").to_numpy(), np.full(batch.num_rows, _NONE)
            for d in np.unique(dims).tolist():
                if d in shared.value[1]:
                    own = np.flatnonzero(dims == d)
                    x, x_ids = shared.value[1][d]
                    at, _, score, _ = best_products(_ints(batch.column("vector").take(pa.array(own))), ids[own], least[own], x, x_ids, shared.value[0][d], k)
                    full = np.bincount(at, minlength=len(own)) == k
                    lowest = np.full(len(own), np.iinfo(np.int64).max)
                    np.minimum.at(lowest, at, score)
                    least[own[full]] = lowest[full]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "dims", "square", "vector")), pa.array(least)], ["vec_id", "dims", "square", "vector", "least"])

    asked = packed.filter("asks").select("vec_id", "dims", "square", "vector").mapInArrow(threshold, "vec_id long, dims int, square double, vector binary, least long")
    # the square of the least length of a candidate that can reach the threshold
    reach = F.when((F.col("least") > 0) & (F.col("square") > 0), F.col("least").cast("double") * F.col("least") / F.col("square")).when(F.col("least") > 0, float("inf")).otherwise(0.0)
    asked = _numbered(asked.withColumn("reach", reach), [F.col("dims"), F.col("reach"), F.col("vec_id")], queries, "i", scratch)
    size = max(candidates, math.ceil(packed.count() / MOST_BLOCKS))
    held = _numbered(packed.select("vec_id", "dims", "square", "vector"), [F.col("dims"), F.desc("square"), F.col("vec_id")], size, "j", scratch)
    # one row for each block: MOST_BLOCKS at most, and one more for each number of components
    longest = held.groupBy("dims", "j").agg(F.max("square").alias("longest"))
    asks = asked.groupBy("dims", "i").agg(F.min("reach").alias("reach"))
    pairs = scratch.write(asks.join(F.broadcast(longest), "dims").filter(F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("reach")).select("dims", "i", "j"), "pairs")
    left = asked.join(pairs, ["dims", "i"]).select("dims", "i", "j", F.lit(True).alias("asks"), "vec_id", "least", "vector")
    right = held.join(pairs, ["dims", "j"]).select("dims", "i", "j", F.lit(False).alias("asks"), "vec_id", F.lit(0).cast("long").alias("least"), "vector")
    dealt = left.unionByName(right).repartition("dims", "i", "j").sortWithinPartitions("dims", "i", "j")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["dims", "i", "j"]):
            asks = t.column("asks").to_numpy()
            a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
            if not len(a) or not len(b):
                continue
            vectors, ids = _ints(t.column("vector")), t.column("vec_id").to_numpy()
            at, found, score, _ = best_products(vectors[a], ids[a], t.column("least").to_numpy()[a], vectors[b], ids[b], shared.value[0].get(vectors.shape[1]), k)
            yield pa.RecordBatch.from_arrays([t.column("vec_id").combine_chunks().take(pa.array(a[at])), t.column("vector").combine_chunks().take(pa.array(a[at])), pa.array(found), pa.array(score)], ["query_id", "asked", "vec_id", "score"])

    found = dealt.mapInArrow(search, "query_id long, asked binary, vec_id long, score long").withColumn("asked", F.xxhash64("asked"))
    best = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
