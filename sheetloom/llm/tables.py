"""Tables in the shared folder that cut lineage, and small helpers that the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import shared_folder

#: A key is heavy if it holds more than one in HEAVY of all rows, so there are fewer than HEAVY such keys, and is dealt
#: over SALTS tasks. Keys of LEAST_HEAVY rows or fewer need no dealing.
HEAVY, SALTS, LEAST_HEAVY = 256, 32, 500


class Scratch:
    """Written tables of one job. A table is safe against the loss of executors, as its files lie in the shared
    folder; drop() removes one that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
        """The table as written. by: a column whose values become folders; it then stands last."""
        path, out = f"{self.root}/{name}", df.write.option("compression", codec)
        (out.partitionBy(by) if by else out).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self._path(f"{self.root}/{name}")
        self._system(path).delete(path, True)

    def keep_only(self, *names: str) -> None:
        """Removes all tables but those that the result still reads."""
        root = self._path(self.root)
        for status in self._system(root).listStatus(root):
            if status.getPath().getName() not in names:
                self.drop(status.getPath().getName())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _system(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None, hint: str | None = None) -> DataFrame:
    """rows.join(table, keys, how) for a table of few rows a key, where one key may hold most of the rows: the rows of a
    heavy key are dealt over SALTS tasks, and the table's rows of it go to each of these. counts: keys and n, of the keys
    that more than one row holds; else `rows`, which should be a written table, is counted first. hint: of the join; with
    "merge" it is the same join at every size."""
    hinted = lambda df: df.hint(hint) if hint else df
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    most, total = counts.agg(F.max("n"), F.sum("n")).first()
    if most is None or most <= max(LEAST_HEAVY, total // HEAVY):
        return rows.join(hinted(table), keys, how)
    heavy = counts.filter(F.col("n") > total // HEAVY).select(*keys).collect()  # fewer than HEAVY by their definition
    kinds = {f.name: f.dataType for f in rows.schema}
    listed = F.array(*(F.struct(*(F.lit(v).cast(kinds[k]).alias(k) for k, v in zip(keys, row, strict=True))) for row in heavy))
    is_heavy = F.array_contains(listed, F.struct(*keys))
    left = rows.withColumn("salt__", F.when(is_heavy, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(0).cast("int"))
    right = table.withColumn("salt__", F.explode(F.when(is_heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(hinted(right), [*keys, "salt__"], how).drop("salt__")


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id):
    """True for the rows whose crc32 of the id as text is 0 modulo 5; labels of these are never learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of sorted rows, one after the other; each is to be of a bounded size."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        edges = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text and the other columns of labels (one row for each id) of about `most` labelled documents at most,
    by hash of the id. The sample of ids has a bounded size, so it is broadcast and no text is shuffled."""
    n = labels.count()
    part = int(1_000_003 * min(1.0, most / max(1, n)))
    chosen = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < part)
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
