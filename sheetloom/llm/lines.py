"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Scratch, spread_join

#: Characters that a repeated run of lines must hold to count.
LEAST = 40
BLANK = " \t\r"
_NO_ID = -(1 << 63)
_DOC = ["doc", "row"]
#: What tells lines apart: a 64-bit hash, and 60 bits of a digest.
_LINE = ["line", "digest"]


def line_hashes(text) -> tuple:
    """124 bits in all; equal hashes of different lines in both parts are not to be met by chance, nor to be made on purpose."""
    return F.xxhash64(text), F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def line_table(documents: DataFrame, least: int) -> DataFrame:
    """The lines of doc_id, text and row that are not blank: doc, row, pos (number among these), line and digest (of the trimmed
    line) and k, the fewest lines from it on that hold `least` characters; k is null where the rest holds fewer."""
    split = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "")
    every = documents.filter("text is not null").select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), "row", F.posexplode(split).alias("pos", "text"))
    every = every.select(*_DOC, "pos", *(h.alias(n) for n, h in zip(_LINE, line_hashes(F.col("text")), strict=True)), F.length("text").cast("long").alias("size"))
    every = every.repartition(*_DOC).dropDuplicates([*_DOC, "pos"])
    before = F.sum("size").over(Window.partitionBy(*_DOC).orderBy("pos")) - F.col("size")
    every = every.withColumn("before", before).withColumn("every", F.sum("size").over(Window.partitionBy(*_DOC)))
    # the lines that begin less than `least` characters below this one's beginning
    k = F.count("*").over(Window.partitionBy(*_DOC).orderBy("before").rangeBetween(0, least - 1))
    return every.select(*_DOC, "pos", *_LINE, F.when(F.col("every") - F.col("before") >= least, k).alias("k"))


def _ranked(rows: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The rows whose keys others have too, with their rank, which is in the order of the keys. Keys are dealt by range, so no
    task holds more than its range, and the suffixes of one key are one row there."""
    classes = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    ordered = classes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranks = scratch.write(ordered.withColumn("rank", F.monotonically_increasing_id()), f"class-{name}")  # ascends over the ranges
    done = scratch.write(spread_join(rows, ranks.drop("n"), keys, counts=ranks.select(*keys, "n"), hint="merge").drop(*keys), f"rank-{name}")
    scratch.drop(f"class-{name}")
    return done


def line_ranks(lines: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The rounds of prefix doubling (all joins are merge joins, so no table passes through the driver at any size): table j ranks the suffixes (doc, row, pos) by their first 2**j lines, of those whose
    2**j lines begin another suffix too. It ends when no suffix is tied with another, so the ranks reach the full depth
    of the suffix array."""
    rounds = [_ranked(lines.select(*_DOC, "pos", *_LINE), _LINE, scratch, "0")]
    while not rounds[-1].isEmpty():
        last, step = rounds[-1], 1 << len(rounds) - 1
        below = last.select(*_DOC, (F.col("pos") - step).alias("pos"), F.col("rank").alias("r2"))
        pairs = scratch.write(last.withColumnRenamed("rank", "r1").join(below.hint("merge"), [*_DOC, "pos"]), f"pairs-{len(rounds)}")
        rounds.append(_ranked(pairs, ["r1", "r2"], scratch, str(len(rounds))))
        scratch.drop(f"pairs-{len(rounds) - 1}")
    return rounds[:-1]


def common_lines(pairs: DataFrame, rounds: list[DataFrame], scratch: Scratch) -> DataFrame:
    """Adds common to pairs (doc, row, pos, and doc2, row2, pos2): the length of the common prefix of the two suffixes, read
    off the rounds from the deepest on."""
    out = pairs.withColumn("common", F.lit(0))
    for j in range(len(rounds) - 1, -1, -1):
        one = rounds[j].select(*_DOC, F.col("pos").alias("at"), "rank")
        two = rounds[j].select(F.col("doc").alias("doc2"), F.col("row").alias("row2"), F.col("pos").alias("at2"), F.col("rank").alias("rank2"))
        out = out.withColumns({"at": F.col("pos") + F.col("common"), "at2": F.col("pos2") + F.col("common")})
        out = out.join(one.hint("merge"), [*_DOC, "at"], "left").join(two.hint("merge"), ["doc2", "row2", "at2"], "left")
        out = out.withColumn("common", F.col("common") + F.when(F.col("rank") == F.col("rank2"), 1 << j).otherwise(0)).drop("at", "at2", "rank", "rank2")
        if j % 4 == 0:
            out = scratch.write(out, f"common-{j}")
    return out


def repeated_runs(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, row, pos and common of each maximal run of lines that is a later copy; see remove_repeated_lines."""
    rounds = line_ranks(lines, scratch)
    if not rounds:
        return lines.select(*_DOC, "pos", F.lit(0).alias("common")).limit(0)
    starts = lines.filter("k is not null").select(*_DOC, "pos", "k").join(rounds[0].hint("merge"), [*_DOC, "pos"])
    # the suffixes that share k lines at least are an interval of the suffix array, named by the ranks of its first and last
    # 2**j lines
    intervals = starts.filter("k = 1").select(*_DOC, "pos", "k", F.col("rank").alias("a"), F.col("rank").alias("b"))
    for j in range(1, len(rounds)):
        some = starts.filter(F.col("k").between(1 << j, (2 << j) - 1)).drop("rank").withColumn("at", F.col("pos") + F.col("k") - (1 << j))
        ends = rounds[j].select(*_DOC, F.col("pos").alias("at"), F.col("rank").alias("b"))
        some = some.join(rounds[j].withColumnRenamed("rank", "a").hint("merge"), [*_DOC, "pos"]).join(ends.hint("merge"), [*_DOC, "at"])
        intervals = intervals.unionByName(some.select(*_DOC, "pos", "k", "a", "b"))
    intervals, keys, place = scratch.write(intervals, "intervals"), ["k", "a", "b"], F.struct(*_DOC, "pos")
    firsts = scratch.write(intervals.groupBy(*keys).agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1"), "firsts")
    later = spread_join(intervals, firsts.select(*keys, "first"), keys, counts=firsts.select(*keys, "n"), hint="merge").filter(place != F.col("first"))
    later = later.select(*_DOC, "pos", F.col("first.doc").alias("doc2"), F.col("first.row").alias("row2"), F.col("first.pos").alias("pos2"))
    # where the lines above match as well, the run above holds this one
    order = Window.partitionBy(*_DOC).orderBy("pos")
    above = F.lag(F.struct("doc2", "row2", (F.col("pos2") + 1).alias("pos2"), (F.col("pos") + 1).alias("pos"))).over(order)
    heads = later.withColumn("above", above).filter(~F.struct("doc2", "row2", "pos2", "pos").eqNullSafe(F.col("above"))).drop("above")
    return common_lines(scratch.write(heads, "heads"), rounds, scratch).select(*_DOC, "pos", "common")


def remove_repeated_lines(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """Deletes the later copies of repeated runs of lines that hold `least` characters at least.

    Lines are parted by line feeds and compared without spaces, tabs and carriage returns at their ends; lines that are
    blank then are no part of a run and stay. Suffixes of the line sequences are sorted by prefix doubling to full depth: each round
    joins a suffix's rank with that of the suffix as many lines below, and counts and ranks the pairs. The shortest run
    from a line on with `least` characters is looked up in its interval of the suffix array, which are the suffixes
    whose common prefixes hold it. Of an interval all but the first occurrence (lowest document, then highest up) are
    later copies, and from each the maximal run is deleted that it shares with the first one; its length comes from
    the rounds. A single line of `least` characters counts, shorter ones only in a run. Intervals are reduced by counts
    and minima, and none is held in one task.

    Returns one row for each row of `documents`: doc_id, n_lines, n_removed, n_runs (maximal runs of deleted lines, blank
    ones between them aside) and kept (the text that is left). A null text has no lines and stays null; an empty one is one
    blank line. An empty table gives no rows. Ids are taken as long. Ids that repeat are ordered by a hash of the text, and
    so are ties; rows alike in id and text are one document and come out alike; a null id is the lowest. Other columns are
    ignored.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "lines")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("text"))
    runs = repeated_runs(scratch.write(line_table(docs, least), "lines"), scratch)
    runs = runs.groupBy(*_DOC).agg(F.collect_list(F.struct("pos", "common")).alias("runs"))
    # either side may be large; a merge join treats them alike at every size
    runs = scratch.write(runs, "runs").withColumnRenamed("row", "run_row").hint("merge")
    scratch.keep_only("runs")
    joined = docs.join(runs, (F.coalesce("doc_id", F.lit(_NO_ID)) == F.col("doc")) & (F.col("row") == F.col("run_row")), "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "n_lines", "n_removed", "n_runs", "kept"], [pa.int64()] * 4 + [pa.string()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs")), strict=True):
                every = [] if text is None else text.split("\n")
                spans = sorted((r["pos"], r["pos"] + r["common"]) for r in found or [])
                kept, pos, n_runs, dropped, end, at = [], -1, 0, False, 0, 0
                for line in every:
                    if line.strip(BLANK):
                        pos += 1
                        while at < len(spans) and spans[at][0] <= pos:
                            end, at = max(end, spans[at][1]), at + 1
                        if pos < end:
                            n_runs += not dropped
                            dropped = True
                            continue
                        dropped = False
                    kept.append(line)
                for column, value in zip(out, (doc, len(every), len(every) - len(kept), n_runs, None if text is None else "\n".join(kept)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return joined.select("doc_id", "text", "runs").mapInArrow(remove, "doc_id long, n_lines long, n_removed long, n_runs long, kept string")
