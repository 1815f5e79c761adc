"""URL filters: host and path rules, and for all other pages a path-template tree of each host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, ascii_lower, spread_join

#: A segment stays literal if it has this many pages and this share of its node's; else it is variable.
LEAST_PAGES, LEAST_SHARE = 4, 0.02
#: Branches are alike if the shapes below them differ by this much (total variation) and one standard error, and, where both
#: hold labelled pages, their purities by PURITY_APART at most.
APART, PURITY_APART = 0.1, 0.2
#: Pseudo-pages at the host's share, which has as many at the overall share.
PRIOR = 4.0
#: A template is rejected at this purity, if this share of its pages is labelled.
REJECT, SUPPORT = 0.8, 0.2


def split_url(url):
    """Host (after the first ://, A-Z lower-cased) and path; both empty for null or without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def longest_rule(host, path, rules: list[tuple[str, str, str]]):
    """rules: (verdict, host, path). Of those that fit, the longest as a struct (rule, verdict); null if none fits. A rule
    fits its host and its subdomains where the path starts with its path."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r[1]))
    if not ordered:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    every = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(verdict).alias("verdict")) for verdict, h, p in ordered))
    fits = lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])
    first = F.get(F.filter(every, fits), F.lit(0))
    return F.when(first.isNotNull(), F.struct(F.concat(first["host"], first["path"]).alias("rule"), first["verdict"].alias("verdict")))


def wildcard(segment):
    """The shape of a variable segment: digits {n}, letters {w} or else {x}, with its file ending."""
    ending = F.regexp_extract(segment, r"\.[A-Za-z][A-Za-z0-9]{0,4}$", 0)
    stem = F.regexp_replace(segment, r"\.[A-Za-z][A-Za-z0-9]{0,4}$", "")
    shape = F.when(segment == "", "").when(stem.rlike("^[0-9]+$"), "{n}").when(stem.rlike("^[A-Za-z]+$"), "{w}").otherwise("{x}")
    return F.concat(shape, ending)


def _merged(shapes: DataFrame, totals: DataFrame) -> DataFrame:
    """host, template, branch and root: the branch that each branch of a node is merged into, if not itself. shapes: counts
    of the shapes below each branch; totals: pages of each node. Branches of LEAST_SHARE of the node take part, which
    are 50 at most; in order of their pages each joins the first root that it is like, else it is a root."""
    node, wide = ["host", "template"], "decimal(38,0)"
    branches = shapes.groupBy(*node, "branch").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    branches = branches.join(totals, node).filter((F.col("n") >= LEAST_PAGES) & (F.col("n") >= F.col("total") * LEAST_SHARE)).drop("total")
    larger = branches.withColumnsRenamed({c: f"{c}2" for c in ("branch", "n", "labelled", "blocked")})
    purity = F.abs(F.col("blocked") / F.col("labelled") - F.col("blocked2") / F.col("labelled2")) <= PURITY_APART
    pairs = branches.join(larger, node).filter((F.col("n2") > F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("branch2") < F.col("branch"))))
    pairs = pairs.filter(F.when((F.col("labelled") > 0) & (F.col("labelled2") > 0), purity).otherwise(True)).select(*node, "branch", "n", "branch2", "n2")
    own = shapes.select(*node, "branch", "rest", F.col("n").cast(wide).alias("own"))
    other = own.withColumnsRenamed({"branch": "branch2", "own": "other"})
    common = F.sum(F.least(F.col("own") * F.col("n2"), F.col("other") * F.col("n"))).cast("double") / (F.col("n").cast("double") * F.col("n2").cast("double"))
    alike = (
        pairs.join(own, [*node, "branch"]).join(other, [*node, "branch2", "rest"])
        .groupBy(*node, "branch", "n", "branch2", "n2").agg(common.alias("common"))
        .filter(1 - F.col("common") <= APART + 1 / F.sqrt(F.col("n").cast("double")))
        .groupBy(*node, "branch").agg(F.collect_list(F.struct((-F.col("n2")).alias("less"), F.col("branch2").alias("branch"))).alias("alike"))
    )
    none = F.array().cast("array<struct<less:bigint,branch:string>>")
    listed = branches.select(*node, "branch", (-F.col("n")).alias("less")).join(alike, [*node, "branch"], "left").withColumn("alike", F.coalesce("alike", none))
    nodes = listed.groupBy(*node).agg(F.array_sort(F.collect_list(F.struct("less", "branch", "alike"))).alias("all"))
    roots = F.aggregate("all", none, lambda r, b: F.when(F.arrays_overlap(r, b["alike"]), r).otherwise(F.concat(r, F.array(F.struct(b["less"].alias("less"), b["branch"].alias("branch"))))))
    each = nodes.withColumn("roots", roots).select(*node, "roots", F.inline("all"))
    first = F.array_min(F.array_intersect("alike", "roots"))
    return each.select(*node, "branch", first["branch"].alias("root")).filter("root is not null")


def template_tree(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """host, path, n, labelled, blocked (summed for each path): adds the template of each path; see judge_urls."""
    node, keep = ["host", "template"], ["host", "path", "n", "labelled", "blocked", "segments"]
    segments = F.split(F.regexp_replace("path", "^/", ""), "/", -1)
    tree = scratch.write(pages.withColumns({"segments": segments, "template": F.lit("")}), "tree-0")
    finished, depth = [], 0
    while not tree.isEmpty():
        depth += 1
        level = tree.withColumn("segment", F.get("segments", F.lit(depth - 1)))
        values = level.groupBy(*node, "segment").agg(F.sum("n").alias("n"), F.count("*").alias("paths"))
        totals = values.groupBy(*node).agg(F.sum("n").alias("total"))
        literal = values.filter(F.col("n") >= LEAST_PAGES).join(totals, node).filter(F.col("n") >= F.col("total") * LEAST_SHARE).select(*node, "segment", F.lit(True).alias("literal"))
        below = F.slice("segments", depth + 1, F.greatest(F.size("segments") - depth, F.lit(0)))
        named = spread_join(level, literal, [*node, "segment"], "left", counts=values.select(*node, "segment", F.col("paths").alias("n")))
        branch = F.concat(F.lit("/"), F.when(F.col("literal"), F.col("segment")).otherwise(wildcard(F.col("segment"))))
        named = named.select(*keep, "template", branch.alias("branch"), F.array_join(F.transform(below, lambda x: F.concat(F.lit("/"), wildcard(x))), "").alias("rest"), F.array_join(F.transform(below, lambda x: F.concat(F.lit("/"), x)), "").alias("end"))
        named = scratch.write(named, f"named-{depth}")
        shapes = named.groupBy(*node, "branch", "rest").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.count("*").alias("paths"))
        shapes = scratch.write(shapes, f"shapes-{depth}")
        roots = _merged(shapes, shapes.groupBy(*node).agg(F.sum("n").alias("total")))
        sizes = shapes.groupBy(*node, "branch").agg(F.sum("n").alias("n"), F.sum("paths").alias("paths"))
        sizes = scratch.write(sizes.join(roots, [*node, "branch"], "left").withColumn("root", F.coalesce("root", "branch")), f"sizes-{depth}")
        nodes = sizes.groupBy(*node, "root").agg(F.sum("n").alias("node_n"), F.sum("paths").alias("node_paths"))
        grown = spread_join(named, sizes.select(*node, "branch", "root").join(nodes, [*node, "root"]), [*node, "branch"], counts=sizes.select(*node, "branch", F.col("paths").alias("n")))
        # a node of few pages or of one path can part no further, which settles all that is below
        tail = F.when(F.size("segments") <= depth, "").when(F.col("node_n") < LEAST_PAGES, F.col("rest")).when(F.col("node_paths") == 1, F.col("end"))
        grown = grown.withColumn("tail", tail).withColumn("template", F.concat("template", "root"))
        grown = scratch.write(grown.select(*keep, "template", "tail"), f"grown-{depth}")
        finished.append(grown.filter("tail is not null").select(*keep[:-1], F.concat("template", "tail").alias("template")))
        tree = grown.filter("tail is null").select(*keep, "template")
        for name in ("named", "shapes", "sizes"):
            scratch.drop(f"{name}-{depth}")
    out = pages.select("host", "path", "n", "labelled", "blocked", F.lit("").alias("template")).limit(0)
    for part in finished:
        out = out.unionByName(part)
    return scratch.write(out, "templates")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Returns page_id, host, path, rule (its host and path, null if none fits) and verdict for each row of `pages`.

    A page with a rule gets the rule's verdict, and is a labelled example of it. For the others a tree of each host's
    paths decides, level by level for as long as a node can part:

    1. A segment value with LEAST_PAGES pages and LEAST_SHARE of its node's stays; others are variable and become
       wildcards of their shape.
    2. The branches of a node, in order of their pages, are merged into the first one that they are like: the shapes
       below are distributed alike, and where both hold labelled pages these are of similar purity. A branch without
       labelled pages can thus join one with labels. Merged branches are one node at the next level.
    3. Of the labelled pages of a template, the share that is blocked, smoothed towards that of its host, and this
       towards the overall one, is its purity; a template of a purity of REJECT at least, of whose pages SUPPORT are
       labelled at least, is rejected.

    Of rules that fit equally long ones go by host length, then block before allow, then host. Of values and branches with
    equally many pages the first in order of text comes first. Null urls and those without :// have an empty host and
    path. Repeated rows and null ids are judged each; ids are taken as long; an empty table gives no rows; other columns
    are ignored. Counts are summed before any join, and keys that hold many pages are dealt over tasks.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = split_url(F.col("url"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    found = split.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    judged = scratch.write(found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("own")), "judged")
    paths = judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("own").alias("labelled"), F.count_if(F.col("own") == "block").alias("blocked"))
    tree = template_tree(paths, scratch)
    templates = tree.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    hosts = tree.groupBy("host").agg(F.sum("labelled").cast("double").alias("hl"), F.sum("blocked").cast("double").alias("hb"))
    overall = tree.agg(F.sum("blocked").cast("double"), F.sum("labelled").cast("double")).first()
    rate = (overall[0] / overall[1]) if overall[1] else 0.0
    share = (F.col("hb") + PRIOR * rate) / (F.col("hl") + PRIOR)
    bad = templates.filter((F.col("l") > 0) & (F.col("l") >= SUPPORT * F.col("n"))).join(hosts, "host")
    bad = bad.filter((F.col("b") + PRIOR * share) / (F.col("l") + PRIOR) >= REJECT).select("host", "template")
    bad_paths = scratch.write(spread_join(tree, bad, ["host", "template"], "left_semi").select("host", "path", F.lit("block").alias("method")), "bad")
    scratch.keep_only("judged", "bad")
    out = spread_join(judged, bad_paths, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "method", F.lit("allow")).alias("verdict"))
