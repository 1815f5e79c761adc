"""The queries of this subpackage by name, and their SQL. Each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clusters import cluster_vectors
from .decontaminate import decontaminate
from .lexical import rank_documents
from .lines import remove_repeated_lines
from .minhash import near_duplicates
from .mixing import label_domains, mix
from .products import top_products
from .quality import score_quality
from .substrings import remove_repeats
from .tables import Scratch, held_out
from .token_files import read_tokens, write_tokens
from .toxicity import score_toxicity
from .urls import judge_urls
from .vectors import near_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: verdict, host, path
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    scored = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


MIX_TARGETS = {"good": 0.93, "low": 0.05, "toxic": 0.02}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), MIX_TARGETS).drop("text_hash")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    scored = score_quality(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-files").root
    write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeated_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), win AS (
  SELECT DISTINCT item, len(p) AS n, array_to_string(p, ' ') AS p FROM (
    SELECT item, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) ELSE [w] END) AS p
    FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), size AS (SELECT DISTINCT n FROM win),
cand AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (
    SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size WHERE len(w) >= n)
), occ AS (SELECT c.doc_id, c.i, c.n, x.item FROM cand c JOIN win x ON c.n = x.n AND c.p = x.p),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM occ GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit h USING (doc_id) LEFT JOIN its t USING (doc_id)
"""

OP2_SQL = """
WITH RECURSIVE vec AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM vec WHERE label IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(least(vec_id, m), vec_id) AS component_id, coalesce(least(vec_id, m), vec_id) = vec_id AS kept
FROM vec LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) c ON c.u = vec_id LEFT JOIN (SELECT u, min(v) AS m FROM reach GROUP BY u) r ON r.u = vec_id
"""

def _op3_sql(depth: int = 4) -> str:
    """The template tree written out level by level, as deep as the paths of the given tables."""
    shape = "CASE WHEN {0} = '' THEN '' WHEN regexp_full_match(regexp_replace({0}, '[.][A-Za-z][A-Za-z0-9]{{0,4}}$', ''), '[0-9]+') THEN '{{n}}' WHEN regexp_full_match(regexp_replace({0}, '[.][A-Za-z][A-Za-z0-9]{{0,4}}$', ''), '[A-Za-z]+') THEN '{{w}}' ELSE '{{x}}' END || regexp_extract({0}, '[.][A-Za-z][A-Za-z0-9]{{0,4}}$')"
    level = """
, val{d} AS (SELECT host, template, segments[{d}] AS segment, sum(n) AS n FROM tree{p} GROUP BY ALL),
tot{d} AS (SELECT host, template, sum(n) AS total FROM val{d} GROUP BY ALL),
lit{d} AS (SELECT host, template, segment, true AS literal FROM val{d} JOIN tot{d} USING (host, template) WHERE n >= 4 AND CAST(n AS DOUBLE) >= CAST(total AS DOUBLE) * 0.02),
named{d} AS (
  SELECT t.host, t.path, t.n, t.labelled, t.blocked, t.segments, t.template, '/' || CASE WHEN literal THEN t.segments[{d}] ELSE {segment} END AS branch,
    array_to_string(list_transform(t.segments[{d} + 1:], lambda x: '/' || {x}), '') AS rest, array_to_string(list_transform(t.segments[{d} + 1:], lambda x: '/' || x), '') AS tail
  FROM tree{p} t LEFT JOIN lit{d} l ON l.host = t.host AND l.template = t.template AND l.segment = t.segments[{d}]
), sh{d} AS (SELECT host, template, branch, rest, CAST(sum(n) AS HUGEINT) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked, count(*) AS paths FROM named{d} GROUP BY ALL),
br{d} AS (
  SELECT *, row_number() OVER (PARTITION BY host, template ORDER BY n DESC, branch) AS k FROM (SELECT host, template, branch, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked FROM sh{d} GROUP BY ALL) JOIN tot{d} USING (host, template)
  WHERE n >= 4 AND CAST(n AS DOUBLE) >= CAST(total AS DOUBLE) * 0.02
), alike{d} AS (
  SELECT host, template, k, list(k2) AS alike FROM (
    SELECT a.host, a.template, a.k, b.k AS k2, a.n AS na, b.n AS nb, sum(least(x.n * b.n, y.n * a.n)) AS common FROM br{d} a JOIN br{d} b ON a.host = b.host AND a.template = b.template AND b.k < a.k
    JOIN sh{d} x ON x.host = a.host AND x.template = a.template AND x.branch = a.branch JOIN sh{d} y ON y.host = b.host AND y.template = b.template AND y.branch = b.branch AND y.rest = x.rest
    WHERE a.labelled = 0 OR b.labelled = 0 OR abs(a.blocked / a.labelled - b.blocked / b.labelled) <= 0.2 GROUP BY ALL)
  WHERE 1 - CAST(common AS DOUBLE) / (CAST(na AS DOUBLE) * CAST(nb AS DOUBLE)) <= 0.1 + 1 / sqrt(CAST(na AS DOUBLE)) GROUP BY ALL
), root{d}(host, template, k, roots) AS (
  SELECT DISTINCT host, template, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM br{d}
  UNION ALL SELECT r.host, r.template, b.k, CASE WHEN list_has_any(coalesce(a.alike, []), r.roots) THEN r.roots ELSE list_append(r.roots, b.k) END
  FROM root{d} r JOIN br{d} b ON b.host = r.host AND b.template = r.template AND b.k = r.k + 1 LEFT JOIN alike{d} a ON a.host = b.host AND a.template = b.template AND a.k = b.k
), map{d} AS (
  SELECT b.host, b.template, b.branch, c.branch AS root FROM br{d} b JOIN alike{d} a ON a.host = b.host AND a.template = b.template AND a.k = b.k
  JOIN (SELECT host, template, arg_max(roots, k) AS roots FROM root{d} GROUP BY ALL) r ON r.host = b.host AND r.template = b.template
  JOIN br{d} c ON c.host = b.host AND c.template = b.template AND c.k = list_min(list_intersect(a.alike, r.roots))
), sized{d} AS (
  SELECT host, template, branch, root, sum(n) OVER w AS node_n, sum(paths) OVER w AS node_paths FROM (
    SELECT s.host, s.template, s.branch, coalesce(m.root, s.branch) AS root, sum(n) AS n, sum(paths) AS paths FROM sh{d} s LEFT JOIN map{d} m ON m.host = s.host AND m.template = s.template AND m.branch = s.branch GROUP BY ALL)
  WINDOW w AS (PARTITION BY host, template, root)
), grown{d} AS (
  SELECT n.host, n.path, n.n, n.labelled, n.blocked, n.segments, n.template || z.root AS template,
    CASE WHEN len(segments) <= {d} THEN '' WHEN node_n < 4 THEN rest WHEN node_paths = 1 THEN tail END AS below
  FROM named{d} n JOIN sized{d} z ON z.host = n.host AND z.template = n.template AND z.branch = n.branch
), tree{d} AS (SELECT host, path, n, labelled, blocked, segments, template FROM grown{d} WHERE below IS NULL)"""
    levels = "".join(level.format(d=d, p=d - 1, segment=shape.format(f"t.segments[{d}]"), x=shape.format("x")) for d in range(1, depth + 1))
    ends = " UNION ALL ".join(f"SELECT host, path, n, labelled, blocked, template || below AS template FROM grown{d} WHERE below IS NOT NULL" for d in range(1, depth + 1))
    return """
WITH RECURSIVE url AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
judged AS (
  SELECT u.*, (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
    (SELECT max_by(verdict, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS own FROM url u
), tree0 AS (
  SELECT host, path, count(*) AS n, count(own) AS labelled, count(*) FILTER (own = 'block') AS blocked, '' AS template,
    string_split(regexp_replace(path, '^/', ''), '/') AS segments FROM judged GROUP BY host, path
)""" + levels + f"""
, leaf AS ({ends} UNION ALL SELECT host, path, n, labelled, blocked, template || '**' FROM tree{depth}),
hosts AS (SELECT host, CAST(sum(labelled) AS DOUBLE) AS hl, CAST(sum(blocked) AS DOUBLE) AS hb FROM leaf GROUP BY host),
overall AS (SELECT coalesce(CAST(sum(blocked) AS DOUBLE) / nullif(CAST(sum(labelled) AS DOUBLE), 0), 0) AS rate FROM leaf),
bad AS (
  SELECT t.host, t.template FROM (SELECT host, template, sum(n) AS n, sum(labelled) AS l, sum(blocked) AS b FROM leaf GROUP BY ALL) t JOIN hosts h ON h.host = t.host, overall
  WHERE l > 0 AND CAST(l AS DOUBLE) >= CAST(0.2 AS DOUBLE) * CAST(n AS DOUBLE)
    AND (CAST(b AS DOUBLE) + CAST(4 AS DOUBLE) * ((hb + CAST(4 AS DOUBLE) * rate) / (hl + CAST(4 AS DOUBLE)))) / (CAST(l AS DOUBLE) + CAST(4 AS DOUBLE)) >= CAST(0.8 AS DOUBLE)
), bad_paths AS (SELECT l.host, l.path FROM leaf l SEMI JOIN bad b ON l.host = b.host AND l.template = b.template)
SELECT page_id, j.host, j.path, rule, coalesce(own, CASE WHEN b.path IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN bad_paths b ON j.host = b.host AND j.path = b.path
"""


OP4_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM doc
), one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(least(doc_id, m), doc_id) AS component_id, coalesce(least(doc_id, m), doc_id) = doc_id AS kept
FROM sets LEFT JOIN (SELECT u, min(v) AS m FROM reach GROUP BY u) r ON r.u = doc_id
"""

OP6_SQL = """
WITH doc AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (
  SELECT doc_id, i, md5_number(b[i:i + 199]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM doc WHERE octet_length(b) >= 200)
), rep AS (
  SELECT doc_id, i FROM win SEMI JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) r ON win.h = r.h
), flagged AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM rep
), spans AS (
  SELECT doc_id, k, min(i) AS s, max(i) + 200 AS e FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM flagged) GROUP BY doc_id, k
), gaps AS (
  SELECT doc_id, lag(e, 1, 1) OVER w AS s, s AS e FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY s)
  UNION ALL SELECT doc_id, max(e), NULL FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, unhex(string_agg(hex(CASE WHEN e IS NULL THEN b[s:] ELSE b[s:e - 1] END), '' ORDER BY s)) AS b FROM gaps JOIN doc USING (doc_id) GROUP BY doc_id
), size AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(d.b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(k.b, d.b)) AS kept_sha256
FROM doc d LEFT JOIN size USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

OP10_SQL = """
WITH every AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM documents
), lines AS (
  SELECT doc_id, idx, trim(line, ' ' || chr(9) || chr(13)) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS pos
  FROM every WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), sized AS (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM lines),
runs AS (
  SELECT a.doc_id, a.pos, (SELECT string_agg(b.line, chr(10) ORDER BY b.pos) FROM sized b WHERE b.doc_id = a.doc_id AND b.pos >= a.pos AND b.upto - length(b.line) < a.upto - length(a.line) + 40) AS r
  FROM sized a JOIN (SELECT doc_id, max(upto) AS total FROM sized GROUP BY doc_id) t ON t.doc_id = a.doc_id WHERE total - a.upto + length(a.line) >= 40
), later AS (
  SELECT doc_id, pos, first_value(doc_id) OVER w AS doc2, first_value(pos) OVER w AS pos2 FROM runs WINDOW w AS (PARTITION BY r ORDER BY doc_id, pos) QUALIFY row_number() OVER w > 1
), lists AS (SELECT doc_id, list(line ORDER BY pos) AS l FROM lines GROUP BY doc_id),
same AS (
  SELECT a.doc_id, a.pos, list_transform(range(least(len(x.l) - a.pos, len(y.l) - a.pos2) + 1), lambda i: x.l[a.pos + i] = y.l[a.pos2 + i]) AS s
  FROM later a JOIN lists x ON x.doc_id = a.doc_id JOIN lists y ON y.doc_id = a.doc2
), spans AS (SELECT doc_id, pos, coalesce(list_position(s, false) - 1, len(s)) AS n FROM same),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS pos FROM spans),
marked AS (SELECT l.doc_id, l.idx, l.pos, g.pos IS NOT NULL AS gone FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos),
count_runs AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_runs
  FROM (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS before FROM marked) GROUP BY doc_id
), kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.idx) AS kept FROM every e LEFT JOIN marked m ON e.doc_id = m.doc_id AND e.idx = m.idx
  WHERE NOT coalesce(m.gone, false) GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN count_runs c ON d.doc_id = c.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

def _op11_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds written out one after the other."""
    assign = """
, a{r} AS MATERIALIZED (
  SELECT n, vec_id, e, CAST(arg_min(c, (d, c)) AS INTEGER) AS cluster, CAST(min(d) AS BIGINT) AS d FROM (
    SELECT v.n, v.vec_id, v.e, c.c, list_sum(list_transform(range(1, 65), lambda i: CAST(v.e[i] - c.e[i] AS HUGEINT) * (v.e[i] - c.e[i]))) AS d FROM v, c{r} c)
  GROUP BY n, vec_id, e
)"""
    update = """
, c{s} AS MATERIALIZED (
  SELECT o.c, coalesce(m.e, o.e) AS e FROM c{r} o LEFT JOIN (
    SELECT cluster, list(CAST(CASE WHEN t < 0 THEN -((n - 1 - t) // n) ELSE t // n END AS BIGINT) ORDER BY j) AS e
    FROM (SELECT cluster, j, sum(x) AS t, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM a{r}) GROUP BY cluster, j) GROUP BY cluster) m ON m.cluster = o.c
)"""
    steps = "".join(assign.format(r=r) + (update.format(r=r, s=r + 1) if r < rounds else "") for r in range(rounds + 1))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, e) - 1 AS BIGINT) AS c, e FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, e FROM v ORDER BY h, e LIMIT {k}))""" + steps + f"""
SELECT vec_id, cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.c
"""


OP12_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, q.e AS asked, v.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
    FROM v q JOIN v ON len(q.e) = len(v.e) AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0))
WHERE rank <= 20
"""

OP13_SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
asked AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_WORDS.format("coalesce(text, '')")}) AS t FROM benchmark WHERE item_id IS NOT NULL) GROUP BY item_id, t),
total AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM doc WHERE len(w) > 0),
post AS (SELECT uid, t, count(*) AS tf FROM (SELECT uid, unnest(w) AS t FROM doc) GROUP BY uid, t),
weight AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM post GROUP BY t), total),
scored AS (
  SELECT p.uid, p.t, w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 75 + (75 * len(d.w) * n) // l))) AS score FROM post p JOIN weight w ON p.t = w.t JOIN doc d ON p.uid = d.uid, total
), sums AS (
  SELECT item_id, uid, CAST(sum(score * times) AS BIGINT) AS score FROM scored JOIN asked ON scored.t = asked.t GROUP BY item_id, uid HAVING sum(score * times) > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, uid) AS rank FROM sums JOIN doc USING (uid)) WHERE rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_vectors": op2_vectors,
    "op3_urls": op3_urls,
    "op4_minhash": op4_minhash,
    "op5_toxicity": op5_toxicity,
    "op6_substrings": op6_substrings,
    "op7_mixing": op7_mixing,
    "op8_token_files": op8_token_files,
    "op9_quality": op9_quality,
    "op10_lines": op10_lines,
    "op11_clusters": op11_clusters,
    "op12_products": op12_products,
    "op13_lexical": op13_lexical,
}

SQL: dict[str, str] = {
    "op1_decontaminate": OP1_SQL,
    "op2_vectors": OP2_SQL,
    "op3_urls": _op3_sql(),
    "op4_minhash": OP4_SQL,
    "op6_substrings": OP6_SQL,
    "op10_lines": OP10_SQL,
    "op11_clusters": _op11_sql(),
    "op12_products": OP12_SQL,
    "op13_lexical": OP13_SQL,
}
