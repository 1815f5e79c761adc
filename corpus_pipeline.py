"""Documents to token blocks in stages, each of which calls one operator on all that its predecessor kept.

Every stage takes an empty table (and gives one), null ids and texts, texts of any length, and further columns of any name,
which all stages but the last hand on as they are. What each makes of nulls, ties and repeated rows stands at its head."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm import decontaminate
from sheetloom.llm.minhash import near_duplicates
from sheetloom.llm.mixing import label_domains, mix, sample
from sheetloom.llm.queries import table, tokenizer_path
from sheetloom.llm.tables import Scratch, held_out
from sheetloom.llm.token_files import read_tokens, write_tokens
from sheetloom.llm.toxicity import score_toxicity

#: A document goes if its probability of the toxic label is this or more.
TOXIC = 0.5
#: Hundredths of shingles in common from which documents are near copies.
SIMILAR = 80
#: Target shares of tokens; low is what the labels call quality 0.
TARGETS = {"good": 0.98, "low": 0.02}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a probability below TOXIC, learned from the labels outside the held-out fold. A row is judged by its
    text alone: repeated rows stay or go together, a null text counts as an empty one, and one of exactly TOXIC goes."""
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    return score_toxicity(docs, labels).filter(F.col("toxicity") < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of documents of a similarity of SIMILAR hundredths. Of rows alike in
    id and text one stays; texts that share an id are one document and stay or go together. Rows with a null id stay, as
    do those without words."""
    gone = near_duplicates(docs, percent=SIMILAR).filter("not kept").select("doc_id").distinct()
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id")
    # either list may be large; a merge join treats them alike at every size
    once = docs.join(gone.union(twice).distinct().hint("merge"), "doc_id", "left_anti")
    again = docs.join(twice, "doc_id", "left_semi").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs. Each row is judged by itself; null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, so that domains have their target shares of tokens. Rows alike in id and
    text have one rate and one hash, so they stay, go or double together; a null or empty text has no tokens and the rate of
    the prior shares."""
    labels = label_domains(table(spark, sf_dir, "labels").filter("coalesce(toxic, 0) = 0"), with_toxic=False)
    return sample(docs, mix(docs, labels, TARGETS))


def to_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, read back from the files written: ascending ids, null ones first,
    rows of one id in any order. A null or empty text is the end id alone."""
    path = Scratch(spark, "token-files").root
    write_tokens(docs, tokenizer_path(), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_domains),
    ("token_files", to_token_files),
]

#: SQL expresses neither the learned stages nor the token files; tests hold the run against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
