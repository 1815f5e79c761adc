"""Matching recognised names to a roster: learned corrections, exact names, then the closest name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import written

#: Edits allowed, as a share of the name's length.
FUZZY = 0.35
# fixed values: what a name and an alias weigh; the score that stands for none
WEIGHTS, SMALLEST = {0: 0.7, 1: 0.3}, 2.0**-52


def learned(corrections: DataFrame, members: DataFrame) -> DataFrame:
    """Correction text in lower case and its member; the last row of a text counts, and absent members drop out."""
    last = corrections.groupBy(F.lower("incorrect_text").alias("t")).agg(F.max_by("corrected_member_id", "ord").alias("member_id"))
    return last.join(members.select(F.col("id").alias("member_id")), "member_id", "left_semi").select("t", "member_id")


def exact(texts: DataFrame, members: DataFrame, ids_contain: bool = True) -> DataFrame:
    """For each different text t the first member whose name or alias it equals, or whose id contains it. Names and aliases
    are joined by equality; only texts as short as an id can be part of one, and an id's substrings are joined by equality
    too."""
    texts = texts.select("t").distinct()
    keys = F.concat(F.array(F.lower("full_name")), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.lower))
    if ids_contain:
        members = members.withColumn("lengths", texts.agg(F.collect_set(F.length("t"))).scalar())  # one array, within the plan
        low = F.lower("id")
        parts = F.transform(F.filter("lengths", lambda n: n <= F.length("id")), lambda n: F.transform(F.sequence(F.lit(1), F.length("id") - n + 1), lambda i: F.substr(low, i, n)))
        keys = F.concat(keys, F.coalesce(F.flatten(parts), F.array().cast("array<string>")))
    held = members.select(F.explode(F.array_distinct(keys)).alias("t"), "member_ord", F.col("id").alias("member_id"))
    return held.join(texts, "t", "left_semi").groupBy("t").agg(F.min_by("member_id", F.struct("member_ord", "member_id")).alias("member_id"))


def edits_within(pattern: Column, text: Column) -> Column:
    """Least edits that turn the pattern into some part of the text: one row of the edit table for each character of the
    text, of which the first column stays 0."""
    n = F.length(pattern)
    start = F.sequence(F.lit(0), n)

    def step(state, c):
        old = state["row"]
        row = F.aggregate(
            F.sequence(F.lit(1), n),
            F.array(F.lit(0)),
            lambda new, i: F.concat(
                new,
                F.array(
                    F.least(
                        F.get(old, i - 1) + F.when(F.substr(pattern, i, F.lit(1)) == c, 0).otherwise(1),
                        F.get(old, i) + 1,
                        F.get(new, i - 1) + 1,
                    )
                ),
            ),
        )
        return F.struct(row.alias("row"), F.least(state["best"], F.element_at(row, -1)).alias("best"))

    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(letters, F.struct(start.alias("row"), n.alias("best")), step, lambda s: s["best"])


def letters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def masks(pattern: Column) -> Column:
    """For each letter of a pattern of up to WORD letters the places where it stands, as bits."""
    each = letters(pattern)
    at = lambda x: F.aggregate(F.transform(each, lambda y, i: F.when(x == y, _bit(i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))
    return F.map_from_entries(F.transform(F.array_distinct(each), lambda x: F.struct(x, at(x))))


#: Letters of a pattern whose edit table fits into one 64-bit integer, with room for a carry.
WORD = 62


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def edits_by_bits(masks: Column, length: Column, text: Column) -> Column:
    """As edits_within, for patterns of up to WORD letters: a column of the edit table is held as the signs of its steps, in
    two integers, and each letter of the text turns it into the next by a few operations on all places at once."""
    zero = F.lit(0).cast("long")
    top = _bit(length - 1)
    every = top.bitwiseOR(top - 1)

    def step(s, c):
        eq = F.coalesce(F.element_at(masks, c), zero)
        vertical = eq.bitwiseOR(s["down"])
        across = ((eq.bitwiseAND(s["up"]) + s["up"]).bitwiseXOR(s["up"])).bitwiseOR(eq)
        rise = s["down"].bitwiseOR(F.bitwise_not(across.bitwiseOR(s["up"]))).bitwiseAND(every)
        fall = s["up"].bitwiseAND(across)
        return F.struct(vertical.alias("v"), rise.alias("rise"), fall.alias("fall"), s["edits"].alias("edits"), s["best"].alias("best"))

    def settle(s):
        edits = s["edits"] + F.when(s["rise"].bitwiseAND(top) != 0, 1).when(s["fall"].bitwiseAND(top) != 0, -1).otherwise(0)
        rise, fall = (F.shiftleft(s[k].bitwiseAND(F.bitwise_not(top)), 1) for k in ("rise", "fall"))
        up = fall.bitwiseOR(F.bitwise_not(s["v"].bitwiseOR(rise))).bitwiseAND(every)
        return F.struct(up.alias("up"), rise.bitwiseAND(s["v"]).alias("down"), edits.alias("edits"), F.least(s["best"], edits).alias("best"))

    start = F.struct(every.alias("up"), zero.alias("down"), length.alias("edits"), length.alias("best"))
    # a list of one binds what a step gives, so that it is worked out once
    return F.aggregate(letters(text), start, lambda s, c: F.get(F.transform(F.array(step(s, c)), settle), 0), lambda s: s["best"])


def _grams(c: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, i, F.lit(2))))


def _short_keys(c: Column) -> Column:
    """Letters, pairs of letters, and pairs with one letter between them, marked by a blank character that stands first."""
    one = letters(c)
    at = lambda i: F.get(one, i)
    pairs = F.transform(F.sequence(F.lit(0), F.size(one) - 2), lambda i: F.concat(at(i), at(i + 1)))
    skips = F.transform(F.sequence(F.lit(0), F.size(one) - 3), lambda i: F.concat(F.lit("\0"), at(i), at(i + 2)))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(one, F.when(F.size(one) > 1, pairs).otherwise(none), F.when(F.size(one) > 2, skips).otherwise(none)))


def _short(texts: DataFrame, names: DataFrame, most: float) -> DataFrame:
    """t, name and edits of texts of one to three letters. One or two allow no edit, so they stand in a name as a whole. Three
    allow one, so a name holds the first two, the last two, or the outer two with or without a letter between them."""
    c = letters(F.col("t"))
    three = F.array(F.concat(F.get(c, 0), F.get(c, 1)), F.concat(F.get(c, 1), F.get(c, 2)), F.concat(F.get(c, 0), F.get(c, 2)), F.concat(F.lit("\0"), F.get(c, 0), F.get(c, 2)))
    asked = texts.filter(F.length("t") < 4).select("t", F.explode(F.array_distinct(F.when(F.length("t") == 3, three).otherwise(F.array("t")))).alias("g"))
    held = names.select("name", F.explode(_short_keys(F.col("name"))).alias("g")).join(asked.select("g").distinct(), "g", "left_semi")
    return asked.join(held, "g").select("t", "name", F.when(F.contains("name", "t"), 0).otherwise(1).alias("edits")).distinct().filter(F.col("edits") <= most * F.length("t"))


def _long(texts: DataFrame, names: DataFrame, most: float) -> DataFrame:
    """t, name and edits of texts of four letters or more and names that hold enough of their pairs of letters."""
    lost = 2 * F.floor(F.length("t") * most).cast("int")
    long = texts.filter(F.length("t") >= 4).withColumn("grams_t", _grams(F.col("t"))).withColumn("lost", lost)
    held = names.filter(F.length("name") >= 2).withColumn("grams", _grams(F.col("name")))
    one = held.select("name", F.explode("grams").alias("g"))
    rare = one.groupBy("g").agg(F.count("*").alias("n"))
    # pairs that no name holds come first, and need no looking up
    chosen = long.select("t", "lost", F.explode("grams_t").alias("g")).join(rare, "g", "left").groupBy("t", "lost").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g"))).alias("by"))
    prefix = chosen.select("t", "lost", F.explode(F.slice("by", F.lit(1), F.col("lost") + 1)).alias("x")).filter("x.n > 0").select("t", "lost", F.col("x.g").alias("g"))
    pairs = prefix.join(one, "g").filter(F.length("name") >= F.length("t") - F.col("lost") / 2).select("t", "name").distinct()
    pairs = pairs.repartition(texts.sparkSession.sparkContext.defaultParallelism, "t", "name")  # few bytes, but much work for each
    near = pairs.join(held, "name").join(long.withColumn("masks", F.when(F.length("t") <= WORD, masks(F.col("t")))), "t")
    near = near.filter(F.size(F.array_intersect("grams_t", "grams")) >= F.greatest(F.lit(1), F.size("grams_t") - F.col("lost")))
    edits = F.when(F.length("t") <= WORD, edits_by_bits(F.col("masks"), F.length("t"), F.col("name"))).otherwise(edits_within(F.col("t"), F.col("name")))
    within = F.filter(F.array(edits), lambda e: e <= most * F.length("t"))  # as a list, so that edits are counted once
    return near.select("t", "name", F.explode(within).alias("edits"))


def fuzzy(texts: DataFrame, members: DataFrame, most: float = FUZZY) -> DataFrame:
    """For each different text t the member whose name and aliases are nearest to it, each within `most` edits a character.

    A key, the name or the nearest alias, that has a part within reach scores the edits to that part over the text's length;
    a member scores the product of its keys' scores to the power of their WEIGHTS (0 counts as SMALLEST), so that two keys
    within reach are nearer than one. Ties go by the whole edit distance of the name, then by roster order.

    A text of m >= 4 characters with k = floor(most * m) edits keeps all but 2k of its g different two-character parts, so
    a name within reach holds g - 2k of them at least, and one at least of the text's 2k + 1 that the fewest names
    hold; only names that do so, and are not too short, are compared. Shorter texts are looked up by what must be left of them."""
    texts = written(texts.select("t").distinct().filter("t <> ''"), "texts")  # what earlier stages leave is found once, and read often
    aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lower(a).alias("name"), F.lit(1).alias("kind")))
    keys = members.select(F.inline(F.concat(F.array(F.struct(F.lower("full_name").alias("name"), F.lit(0).alias("kind"))), aliases)), "member_ord", F.col("id").alias("member_id"))
    names = written(keys.select("name").distinct().filter("name is not null"), "names")
    near = _short(texts, names, most).unionByName(_long(texts, names, most))
    by_member = near.join(keys, "name").groupBy("t", "member_ord", "member_id").agg(*(F.min(F.when(F.col("kind") == k, F.col("edits"))).alias(f"e{k}") for k in WEIGHTS))
    share = lambda k: F.when(F.col(f"e{k}").isNull(), 1.0).otherwise(F.pow(F.greatest(F.col(f"e{k}") / F.length("t"), F.lit(SMALLEST)), F.lit(WEIGHTS[k])))
    whole = members.select(F.col("id").alias("member_id"), "member_ord", F.lower("full_name").alias("full"))
    scored = by_member.withColumn("score", share(0) * share(1)).join(whole, ["member_id", "member_ord"])
    best = scored.groupBy("t").agg(F.min(F.struct("score", F.levenshtein("t", F.coalesce("full", F.lit(""))).alias("whole"), "member_ord", "member_id")).alias("best"))
    return best.select("t", "best.member_id", "best.score")


def cascade(names: DataFrame, members: DataFrame, corrections: DataFrame, with_fuzzy: bool = True) -> DataFrame:
    """Adds member_id, confidence (0 to 1) and status to every row: correction, else exact, else fuzzy, else none. Each
    stage sees only the different texts that none before it matched; every row of names comes out once."""
    names = names.withColumn("t", F.lower("ocr_name"))
    texts = names.select("t").filter("t is not null").distinct()
    by_correction = texts.join(learned(corrections, members), "t").select("t", "member_id", F.lit(1.0).alias("confidence"), F.lit("correction").alias("status"))
    rest = texts.join(by_correction, "t", "left_anti")
    by_name = exact(rest, members).select("t", "member_id", F.lit(1.0).alias("confidence"), F.lit("exact").alias("status"))
    found = by_correction.unionByName(by_name)
    if with_fuzzy:
        found = written(found, "found")  # read twice
        rest = texts.join(found, "t", "left_anti")
        found = found.unionByName(fuzzy(rest, members).select("t", "member_id", (1 - F.col("score")).alias("confidence"), F.lit("fuzzy").alias("status")))
    return names.join(found, "t", "left").withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "status": F.coalesce("status", F.lit("none"))}).drop("t")


def assign(rows: DataFrame, choices: DataFrame, members: DataFrame) -> DataFrame:
    """A choice of member by hand (row_id, member_id): an id not in the roster gives none; status by whether an id was given."""
    known = choices.join(members.select(F.col("id").alias("member_id"), F.lit(True).alias("known")), "member_id", "left")
    chosen = known.select("row_id", F.when(F.col("known"), F.col("member_id")).alias("member_id"), F.when(F.coalesce("member_id", F.lit("")) != "", "correction").otherwise("none").alias("status"))
    return rows.drop("member_id", "status").join(chosen, "row_id")
