"""Token-ID files: documents as Huffman-coded ids in independent blocks, in ascending order of their ids."""

from __future__ import annotations

import hashlib
import os
import random
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .huffman import LONGEST, Table, canonical, code_lengths, pack
from .tables import Scratch
from .tokens import LOWER, NON_SPACE, blocks, equal_runs, run_hashes, word_bounds

BLOCK_IDS = 1 << 16
#: Words whose ids a worker keeps; then it starts anew.
CACHE_WORDS = 1 << 19
BLOCKS_AT_ONCE = 32
_encoders: dict = {}
_codes = np.arange(256)
_LETTER = (_codes >= 0x61) & (_codes <= 0x7A)
_MARK = np.isin(_codes, np.frombuffer(b'.,;:!?%*&#$)"', np.uint8))


class WordIds:
    """Ids of texts by way of their words. A tokenizer that drops white space, lower-cases, and never joins letters to other
    marks gives the ids of a text as those of its words in turn, also where words are cut between an ASCII letter and one
    of the marks .,;:!?%*&#$)" and A-Z are lower-cased first. Whether the given one does is tried on random texts; if it does
    not, whole texts are encoded. Texts with <| may hold special tokens and are cut at white space only. Words are told
    apart by their bytes."""

    def __init__(self, tokenizer: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.divider, self.divider_id = next(((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized), ("", -1))
        self.end_id = end_id
        self.clear()
        self.by_words = True
        self.by_words = self._tried()

    def _tried(self) -> bool:
        r = random.Random(8)
        texts = ["".join(r.choice("abAB09 \u00e9\u00df\u2003\u0301\t\n.,;:!?%*&#$)\"'-_/<|") for _ in range(r.randrange(1, 40))) for _ in range(300)]
        for block in blocks(pa.array(texts)):
            ids, size = self.encode(block)
            cut = np.split(ids, np.cumsum(size)[:-1])
        fits = all([*e.ids, self.end_id] == c.tolist() for e, c in zip(self._encode(texts), cut, strict=True))
        self.clear()
        return fits

    def _encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.array([self.end_id], np.uint32)
        self.start, self.length = np.zeros(1, np.int64), np.ones(1, np.int64)  # entry 0 is the end id

    def learn(self, new: list[bytes], together: bool) -> None:
        """together: many words at once, parted by a special token that none of them holds."""
        texts = [x.decode() for x in new]
        if together:
            ids = self._encode([self.divider.join(texts[k : k + 256]) + self.divider for k in range(0, len(texts), 256)])
            flat = np.concatenate([np.array(e.ids, np.uint32) for e in ids])
            ends = np.flatnonzero(flat == self.divider_id)
            size = np.diff(ends, prepend=-1) - 1
            flat = flat[flat != self.divider_id]
        else:
            ids = [e.ids for e in self._encode(texts)]
            size = np.array([len(i) for i in ids], np.int64)
            flat = np.array([i for x in ids for i in x], np.uint32)
        self.known.update(zip(new, range(len(self.start), len(self.start) + len(new)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.length = np.concatenate([self.length, size])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text, one text after the other, and how many each has, both with the end id."""
        if not self.by_words:
            raw = block.data.tobytes()
            ids = [[*e.ids, self.end_id] for e in self._encode([raw[a:b].decode() for a, b in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True)])]
            return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)
        plain = b"<|" not in block.data.tobytes()
        data = LOWER[block.data] if plain else block.data
        starts, ends = word_bounds(block, data, NON_SPACE, (_LETTER, _MARK) if plain else None)
        first = np.searchsorted(starts, block.bounds)
        _, at, back = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
        other = np.flatnonzero(~equal_runs(data, starts, ends, at[back]))  # words of one hash that are not the same
        if len(other):
            back[other] = len(at) + np.arange(len(other))
            at = np.append(at, other)
        if len(self.known) > CACHE_WORDS:
            self.clear()
        raw = data.tobytes()
        each = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        new = list(dict.fromkeys(x for x in each if x not in self.known))
        if new:
            self.learn(new, plain and bool(self.divider))
        entry = np.array([self.known[x] for x in each], np.int64)[back] if each else np.zeros(0, np.int64)
        entry = np.insert(entry, first[1:], 0)
        size = self.length[entry]
        begin = np.cumsum(size) - size
        ids = self.flat[np.arange(int(size.sum())) - np.repeat(begin - self.start[entry], size)]
        total = np.append(0, np.cumsum(size))
        edge = first + np.arange(len(first))
        return ids, total[edge[1:]] - total[edge[:-1]]


def _encoder(tokenizer: str, end_id: int) -> WordIds:
    key = hashlib.sha256(tokenizer.encode()).digest(), end_id
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordIds(tokenizer, end_id)
    return _encoders[key]


def write_tokens(documents: DataFrame, tokenizer_path: str, out_path: str, end_id: int = 2, block_ids: int = BLOCK_IDS, longest: int = LONGEST) -> None:
    """Writes the ids of every whole text, each closed by `end_id`, to `out_path`:

    * codes: id, bits of its canonical Huffman code (from the counts of the whole table, `longest` bits at most);
    * blocks: part and number in it, ids before it in its part, doc_ids, n_tokens of each, payload (the codes, first
      bit first) and offsets (64-bit little-endian bit offsets of every 1024th id). A block holds whole documents of
      about `block_ids` ids and is decoded by itself.

    Parts, blocks and the documents in them ascend by doc_id; null ids come first, rows of one id in any order, each row is
    a document. A null or empty text gives the end id alone. Of equally frequent ids the smaller has the earlier code. An
    empty table gives files without rows. Ids are taken as long. A document is never cut, so a long text makes a block of
    its own size. The vocabulary file is read by the driver and sent to the tasks. Other columns are ignored.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "tokens")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokenizer = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))  # one vocabulary file, which executors need not hold

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer.value, end_id)
        for batch in batches:
            for block in blocks(batch.column("text")):
                ids, size = encoder.encode(block)
                kind = np.uint16 if ids.max(initial=0) < 1 << 16 else np.uint32
                edge = np.append(0, np.cumsum(size)).tolist()
                raw = ids.astype(kind)
                rows = [raw[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                width = np.full(len(size), np.dtype(kind).itemsize, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, len(size)), pa.array(width), pa.array(rows, pa.binary())], ["doc_id", "width", "ids"])

    encoded = scratch.write(docs.mapInArrow(encode, "doc_id long, width int, ids binary"), "ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for ids in _by_width(batch):
                more = np.bincount(ids)
                if len(more) > len(total):
                    more, total = total, more
                total[: len(more)] += more
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    counts = encoded.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    table = np.zeros(max([r[0] for r in counts], default=0) + 1, np.int64)
    for r in counts:
        table[r[0]] = r[1]
    lengths = code_lengths(table, longest)
    spark.createDataFrame([(i, int(b)) for i, b in enumerate(lengths) if b], "id long, bits int").coalesce(1).write.parquet(f"{out_path}/codes")
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths)))
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("payload", pa.binary()), ("offsets", pa.binary())])

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes = shared.value
        part, before, number = TaskContext.get().partitionId(), 0, 0
        docs, texts, held = [], [], 0

        def block() -> pa.RecordBatch:
            payload, offsets = pack(np.concatenate(texts), lengths, codes)
            row = [part, number, before, docs, [len(t) for t in texts], payload, offsets.astype("<u8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc, width, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "width", "ids")), strict=True):
                docs.append(doc)
                texts.append(np.frombuffer(raw, f"<u{width}").astype(np.int64))
                held += len(texts[-1])
                if held >= block_ids:
                    yield block()
                    before, number, docs, texts, held = before + held, number + 1, [], [], 0
        if docs:
            yield block()

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.repartitionByRange(n_parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(to_blocks, "part int, block long, before long, doc_ids array<long>, n_tokens array<long>, payload binary, offsets binary").write.option("compression", "uncompressed").parquet(f"{out_path}/blocks")
    scratch.drop("ids")


def _by_width(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    widths = batch.column("width").to_numpy()
    for w in np.unique(widths).tolist():
        rows = batch.column("ids").filter(pa.array(widths == w))
        yield np.frombuffer(b"".join(rows.to_pylist()), f"<u{w}").astype(np.int64)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files at `path`: doc_id, start (ids of all documents before it), n_tokens, ids (32-bit
    little-endian) and ids_crc32."""
    codes = spark.read.parquet(f"{path}/codes").collect()  # at most the vocabulary
    lengths = np.zeros(max([r["id"] for r in codes], default=0) + 1, np.int64)
    for r in codes:
        lengths[r["id"]] = r["bits"]
    stored = spark.read.parquet(f"{path}/blocks")
    totals = stored.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, n: s + n).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    begin, so_far = {}, 0
    for r in sorted(totals.collect()):  # one row for each part
        begin[r["part"]], so_far = so_far, so_far + r["n"]
    shared = spark.sparkContext.broadcast((lengths, begin))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, begin = shared.value
        table = Table(lengths)
        for whole in batches:
            for k in range(0, whole.num_rows, BLOCKS_AT_ONCE):
                batch = whole.slice(k, BLOCKS_AT_ONCE)
                sizes = [np.array(n, np.int64) for n in batch.column("n_tokens").to_pylist()]
                offsets = [np.frombuffer(o, "<u8").astype(np.int64) for o in batch.column("offsets").to_pylist()]
                decoded = table.unpack(batch.column("payload").to_pylist(), offsets, [int(n.sum()) for n in sizes])
                for part, before, docs, n, ids in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist(), batch.column("doc_ids").to_pylist(), sizes, decoded, strict=True):
                    edge = np.append(0, np.cumsum(n))
                    raw = ids.astype("<u4").tobytes()
                    each = [raw[4 * a : 4 * b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs, pa.int64()), pa.array(begin[part] + before + edge[:-1]), pa.array(n), pa.array(each, pa.binary()), pa.array([zlib.crc32(x) for x in each], pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids", "ids_crc32"],
                    )

    return stored.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")
