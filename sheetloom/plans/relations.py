"""Rosters, sessions, recognised rows, pixels, words and edits as views of the given tables, in Spark and in SQL.

Every builder has a fragment of the same name in SQL, so that a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("member_ord"),
        key.cast("string").alias("id"),
        F.col("c_name").alias("full_name"),
        F.array(F.concat(F.lit("Cust "), key.cast("string"))).alias("aliases"),
        F.when(key % 9 != 0, F.col("c_mktsegment")).alias("department"),
        F.when(key % 5 != 0, F.concat(F.lower("c_name"), F.lit("@x.org"))).alias("email"),
    )


MEMBERS = """members AS (
  SELECT c_custkey AS member_ord, CAST(c_custkey AS VARCHAR) AS id, c_name AS full_name, ['Cust ' || c_custkey] AS aliases,
    CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS department, CASE WHEN c_custkey % 5 <> 0 THEN lower(c_name) || '@x.org' END AS email FROM customer)"""


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as a roster; the alias has the words in reverse order."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("full_name")).agg(F.min("p_partkey").alias("member_ord"))
    return p.select("member_ord", F.concat(F.lit("n"), F.col("member_ord").cast("string")).alias("id"), "full_name", F.array(F.array_join(F.reverse(F.split("full_name", " ")), " ")).alias("aliases"))


ROSTER = """roster AS (
  SELECT min(p_partkey) AS member_ord, 'n' || min(p_partkey) AS id, p_name AS full_name, [array_to_string(list_reverse(string_split(p_name, ' ')), ' ')] AS aliases
  FROM part GROUP BY p_name)"""


def read_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as a recogniser may read them."""
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    read = (
        F.when(k == 0, name).when(k == 1, F.upper(name)).when(k == 2, F.replace(name, F.lit("e"), F.lit("c"))).when(k == 3, F.expr("left(p_name, length(p_name) - 2)"))
        .otherwise(F.concat(F.lit("zz"), F.col("p_partkey").cast("string")))
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_idx"), read.alias("ocr_name"))


READ_NAMES = """read_names AS (
  SELECT p_partkey AS row_idx, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, 'e', 'c')
    WHEN 3 THEN left(p_name, len(p_name) - 2) ELSE 'zz' || p_partkey END AS ocr_name FROM part)"""


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").filter("p_partkey % 50 = 2")
    text = F.replace("p_name", F.lit("e"), F.lit("c"))
    keys = roster(spark, sf_dir).select(F.col("full_name").alias("p_name"), "id")
    return p.join(keys, "p_name").select(
        F.col("p_partkey").alias("ord"),
        F.when(F.col("p_partkey") % 100 == 2, F.upper(text)).otherwise(text).alias("incorrect_text"),
        F.when(F.col("p_partkey") % 150 == 2, "absent").otherwise(F.col("id")).alias("corrected_member_id"),
    )


CORRECTIONS = """corrections AS (
  SELECT p_partkey AS ord, CASE WHEN p_partkey % 100 = 2 THEN upper(replace(p_name, 'e', 'c')) ELSE replace(p_name, 'e', 'c') END AS incorrect_text,
    CASE WHEN p_partkey % 150 = 2 THEN 'absent' ELSE r.id END AS corrected_member_id
  FROM part JOIN roster r ON r.full_name = p_name WHERE p_partkey % 50 = 2)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        key.cast("string").alias("id"),
        F.col("o_custkey").alias("owner_id"),
        F.concat(F.lit("Event "), F.col("o_orderpriority")).alias("event_name"),
        F.col("o_orderdate").cast("date").alias("session_date"),
        F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "refining").otherwise("pending").alias("status"),
        F.when(key % 1009 != 0, F.col("o_orderdate").cast("date")).alias("created_at"),
    )


SESSIONS = """sessions AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey AS owner_id, 'Event ' || o_orderpriority AS event_name, CAST(o_orderdate AS DATE) AS session_date,
    CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'refining' ELSE 'pending' END AS status,
    CASE WHEN o_orderkey % 1009 <> 0 THEN CAST(o_orderdate AS DATE) END AS created_at FROM orders)"""


def match_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    number = F.col("l_linenumber")
    return line.select(
        F.col("l_orderkey").cast("string").alias("session_id"),
        (number.cast("long") * 100000000 + F.col("l_partkey")).alias("row_idx"),
        F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey").cast("string")).alias("member_id"),
        (number == 1).alias("is_header"),
        F.when(F.col("l_returnflag") == "A", "approved").when(F.col("l_returnflag") == "R", "flagged").otherwise("correction").alias("status"),
        F.when(F.col("l_linestatus") == "O", "x").otherwise("").alias("raw_override"),
        F.when(number != 7, F.col("l_quantity") * 2).alias("ocr_confidence"),
        F.split(F.array_join(F.array_repeat(F.lit("c"), number), " "), " ").alias("columns"),
        (F.col("l_partkey") % 3 != 0).alias("present"),
    )


MATCH_ROWS = """match_rows AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS session_id, CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey AS row_idx,
    CASE WHEN l_suppkey % 7 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS member_id, l_linenumber = 1 AS is_header,
    CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'flagged' ELSE 'correction' END AS status, CASE WHEN l_linestatus = 'O' THEN 'x' ELSE '' END AS raw_override,
    CASE WHEN l_linenumber <> 7 THEN l_quantity * 2 END AS ocr_confidence, l_linenumber AS n_columns, l_partkey % 3 <> 0 AS present FROM lineitem)"""


def ocr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as rows, their parts between commas as cells."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_idx", "text"))
    return d.select(
        "doc_id",
        "row_idx",
        "text",
        F.split("text", ", ").alias("columns"),
        ((F.col("doc_id") % 3 == 0) & (F.col("row_idx") < 2)).alias("is_header"),
        (50 + (F.col("doc_id") * 7 + F.col("row_idx") * 13) % 50).cast("double").alias("confidence"),
        F.struct((F.col("row_idx") * 30.0).alias("y0"), (F.col("row_idx") * 30.0 + 10 + (F.col("doc_id") % 4) * 5).alias("y1")).alias("bbox"),
    )


OCR_ROWS = """ocr_rows AS (
  SELECT doc_id, row_idx, text, string_split(text, ', ') AS columns, doc_id % 3 = 0 AND row_idx < 2 AS is_header,
    CAST(50 + (doc_id * 7 + row_idx * 13) % 50 AS DOUBLE) AS confidence, row_idx * 30.0::DOUBLE AS y0, row_idx * 30.0::DOUBLE + 10 + (doc_id % 4) * 5 AS y1
  FROM (SELECT doc_id, unnest(range(len(l))) AS row_idx, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as lines of 64 pixels, 25 to an image; red, green and blue differ."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    cut = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("int")
    g, y = cut(F.floor((F.col("e").cast("double") + 0.6) * 250)), (F.col("vec_id") % 25).cast("int")
    return e.select((F.floor(F.col("vec_id") / 25)).cast("long").alias("img_id"), y.alias("y"), "x", cut(g + F.col("x") % 7 * 9 - 20).alias("r"), g.alias("g"), cut(g - y % 5 * 12 + 20).alias("b"))


PIXELS = """pixels AS (
  SELECT img_id, y, x, CAST(greatest(0, least(255, g + x % 7 * 9 - 20)) AS INT) AS r, g, CAST(greatest(0, least(255, g - y % 5 * 12 + 20)) AS INT) AS b FROM (
    SELECT vec_id // 25 AS img_id, vec_id % 25 AS y, x, CAST(greatest(0, least(255, floor((CAST(e AS DOUBLE) + 0.6::DOUBLE) * 250))) AS INT) AS g
    FROM (SELECT vec_id, unnest(range(len(embedding))) AS x, unnest(embedding) AS e FROM embeddings))),
ink AS (SELECT img_id, y, x, CASE WHEN 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b < 160 THEN 1 ELSE 0 END AS v FROM pixels)"""


def spread_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of which most are white: bands of ink, five lines of 25 and 16 columns of 64 without any between."""
    p = pixels(spark, sf_dir)
    ink = (F.col("y") % 12 < 7) & (F.col("x") % 32 < 16) & (F.col("g") < 190)
    return p.select("img_id", "y", "x", *(F.when(ink, F.col(c)).otherwise(255).alias(c) for c in "rgb"))


SPREAD_PIXELS = PIXELS + """,
spread AS (SELECT img_id, y, x, CASE WHEN ink THEN r ELSE 255 END AS r, CASE WHEN ink THEN g ELSE 255 END AS g, CASE WHEN ink THEN b ELSE 255 END AS b FROM (SELECT *, y % 12 < 7 AND x % 32 < 16 AND g < 190 AS ink FROM pixels))"""


def sparse_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few pixels of ink, so that there are gaps and parts."""
    return pixels(spark, sf_dir).select("img_id", "y", "x", ((F.col("g") > 178) & (F.col("y") % 5 != 4)).cast("int").alias("v"))


SPARSE_INK = PIXELS + """,
sparse AS (SELECT img_id, y, x, CASE WHEN g > 178 AND y % 5 <> 4 THEN 1 ELSE 0 END AS v FROM pixels),
size AS (SELECT img_id, max(x) + 1 AS w, max(y) + 1 AS h FROM sparse GROUP BY img_id)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations, set eight to a line with some jitter and wide gaps."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.posexplode(F.split("text", "[ \n]+")).alias("word_ord", "text")).filter("text <> ''")
    x0 = (F.col("word_ord") % 8) * 60.0 + F.when(F.col("word_ord") % 8 >= 4, 40.0).otherwise(0.0)
    y0 = F.floor(F.col("word_ord") / 8) * 24.0 + (F.col("word_ord") * 7) % 4
    return c.withColumns({"x0": x0, "y0": y0}).select("doc_id", "word_ord", "text", (60 + F.col("word_ord") % 40).cast("double").alias("confidence"), "x0", "y0", (F.col("x0") + 50.0).alias("x1"), (F.col("y0") + 12.0).alias("y1"))


WORDS = """words AS (
  SELECT doc_id, word_ord, text, CAST(60 + word_ord % 40 AS DOUBLE) AS confidence, (word_ord % 8) * 60.0::DOUBLE + CASE WHEN word_ord % 8 >= 4 THEN 40 ELSE 0 END AS x0,
    (word_ord // 8) * 24.0::DOUBLE + (word_ord * 7) % 4 AS y0
  FROM (SELECT conv_id * 1000 + turn AS doc_id, unnest(range(len(l))) AS word_ord, unnest(l) AS text FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[ \\n]+') AS l FROM conversations))
  WHERE text <> '')"""


def edit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("user_id")).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(16))))
    return u.select(
        "session_id",
        F.concat(F.lit("r"), F.col("k").cast("string")).alias("row_id"),
        F.col("k").alias("row_idx"),
        F.concat(F.lit("name "), F.col("k").cast("string")).alias("ocr_name"),
        F.when(F.col("k") != 3, F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), ((F.col("user_id") + F.col("k")) % 3 + 1).cast("int"))).alias("columns"),
        (F.col("k") == 0).alias("is_header"),
        F.lit(None).cast("string").alias("member_id"),
        F.lit("none").alias("status"),
    )


EDIT_ROWS = """edit_rows AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, 'r' || k AS row_id, k AS row_idx, 'name ' || k AS ocr_name,
    CASE WHEN k <> 3 THEN ['a', 'b', 'c'][1:(user_id + k) % 3 + 1] END AS columns, k = 0 AS is_header, CAST(NULL AS VARCHAR) AS member_id, 'none' AS status
  FROM (SELECT user_id, unnest(range(17)) AS k FROM (SELECT DISTINCT user_id FROM events)))"""


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 7
    op = F.when(F.col("event_id") % 101 == 0, "delete").when(k <= 2, "edit_cell").when(k == 3, "assign_member").when(k == 4, "approve").when(k == 5, "flag").otherwise("toggle_header")
    value = F.when(op == "edit_cell", F.col("event_type")).when(op == "assign_member", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("m"), (F.col("event_id") % 9).cast("string"))))
    return e.select(
        F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("r"), (F.col("event_id") % 17).cast("string")).alias("row_id"), F.col("event_id").alias("seq"),
        op.alias("op"), F.when(op == "edit_cell", (F.col("event_id") % 4).cast("int")).alias("col_idx"), value.alias("value"),
    )


EDIT_LOG = """edit_log AS (
  SELECT *, CASE WHEN op = 'edit_cell' THEN event_id % 4 END AS col_idx,
    CASE WHEN op = 'edit_cell' THEN event_type WHEN op = 'assign_member' THEN CASE WHEN event_id % 3 = 0 THEN '' ELSE 'm' || event_id % 9 END END AS value
  FROM (SELECT CAST(user_id AS VARCHAR) AS session_id, 'r' || event_id % 17 AS row_id, event_id AS seq, event_id, event_type,
    CASE WHEN event_id % 101 = 0 THEN 'delete' WHEN event_id % 7 <= 2 THEN 'edit_cell' WHEN event_id % 7 = 3 THEN 'assign_member' WHEN event_id % 7 = 4 THEN 'approve'
      WHEN event_id % 7 = 5 THEN 'flag' ELSE 'toggle_header' END AS op FROM events))"""
