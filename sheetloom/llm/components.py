"""Connected components by alternating large-star and small-star steps, each cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import LEAST_HEAVY, Scratch, spread_join


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """edges: (u long, v long), in any direction, loops and repeats allowed. Returns node and component (the smallest
    node that it reaches) for every node of an edge that is no loop. Groups are reduced by map-side minima, no step
    holds a component in one task, and the links of a node that has many are dealt over tasks."""
    links = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = scratch.write(links, f"{name}-0")
    (most, state), k = _state(links), 0
    while True:
        many = most > LEAST_HEAVY  # no node has more links in the second join than in the first
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        least = scratch.write(least, f"{name}-least-{k}") if many else least
        large = _join(both, least, many).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large, f"{name}-large-{k}") if many else large
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = scratch.write(small, f"{name}-small-{k}") if many else small
        moved = _join(large, small, many).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.write(small.select("u", F.col("m").alias("v")).union(moved).distinct(), f"{name}-{k + 1}")
        for step in ("", "least-", "large-", "small-"):
            scratch.drop(f"{name}-{step}{k}")
        before, (most, state) = state, _state(now)
        links, k = now, k + 1
        if state == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())


def _join(rows: DataFrame, table: DataFrame, many: bool) -> DataFrame:
    """By u; table: u, m and n, the rows of u."""
    if many:
        return spread_join(rows, table.drop("n"), ["u"], counts=table.select("u", "n"))
    return rows.join(table.drop("n"), "u")


def _state(links: DataFrame) -> tuple[int, tuple]:
    """The most links of a node, and a state that equal links share."""
    mark = F.xxhash64("u", "v").cast("decimal(38,0)")
    both = links.select("u", mark.alias("mark")).union(links.select("v", F.lit(0).cast("decimal(38,0)")))
    nodes = both.groupBy("u").agg(F.count("*").alias("n"), F.sum("mark").alias("mark"))
    most, *state = nodes.agg(F.max("n"), F.sum("n"), F.sum(F.col("mark").cast("decimal(38,0)"))).first()
    return most or 0, tuple(state)
