"""Token-id output as directly addressable codes, in files of their own format.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of
every id, level 1 the next chunk of those ids that have one, and so on. Each
level has a bitmap that says which of its entries continue, and a rank
directory with the number of continuations before every block of 512 bits.
Reading id ``i`` takes a chunk, a block of the bitmap and a rank of each level,
at places that are known beforehand: no block is decoded, and nothing is
compressed.

A *segment* is one image: magic, its length, ids of its write task before it,
numbers of documents, ids and levels, each level's size and places, then
document ids, document ends, and the levels. A file is some segments, each with
a line feed behind it. Files go through Spark's committer, so a lost executor
or a second attempt never leaves half a file, and any store works. A store is
three folders: ``segments`` (the files), ``documents`` and ``directory``
(Parquet, made by reading the files back).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import Workspace, ship
from .bounded import to_rows
from .tokens import END_ID, by_size, default_tokenizer, encoder, read_definition

MAGIC = b"DAC8\x02\0\0\0"
BLOCK_BITS = 512
#: Ids after which a segment is closed, and segments of a file: some twenty megabytes.
SEGMENT_IDS, FILE_SEGMENTS = 1 << 20, 8
#: Fields behind the magic: length, ids before, documents, ids, levels. Of each level: entries, places of chunks, bitmap and ranks.
_HEAD, _LEVEL = struct.Struct("<5Q"), struct.Struct("<4Q")

DOCUMENTS = "doc_id long, shard int, part int, at long, length long, start long, n_tokens long, ids_crc32 long"


def pack(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray, before: int = 0) -> bytes:
    """The image of a segment. ends: of each document, the ids up to its end."""
    rest, levels = np.asarray(ids, "<u4"), []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        levels.append((len(rest), (rest & 0xFF).astype("u1").tobytes(), bits.tobytes(), _ranks(bits).tobytes()))
        if not more.any():
            break
        rest = rest[more] >> 8
    docs = [np.array([d is None for d in doc_ids], "u1").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.asarray(ends, "<u8").tobytes()]
    at = len(MAGIC) + _HEAD.size + _LEVEL.size * len(levels) + sum(map(len, docs))
    table = []
    for n, *parts in levels:
        places = []
        for p in parts:
            places.append(at)
            at += len(p)
        table.append(_LEVEL.pack(n, *places))
    head = _HEAD.pack(at, before, len(doc_ids), len(ids), len(levels))
    return b"".join([MAGIC, head, *table, *docs, *(p for _, *parts in levels for p in parts)])


def _ranks(bits: np.ndarray) -> np.ndarray:
    step = BLOCK_BITS // 8
    padded = np.zeros(-(-max(len(bits), 1) // step) * step, "u1")
    padded[: len(bits)] = bits
    sums = np.bitwise_count(padded).reshape(-1, step).sum(axis=1, dtype="<u4")
    return np.concatenate([[0], np.cumsum(sums)[:-1]]).astype("<u4")


class Segment:
    """Access to one image through ``read(at, n)``, which gives bytes from its beginning on; only what is asked for is read."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        head = bytes(read(0, len(MAGIC) + _HEAD.size))
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.length, self.before, self.n_docs, self.n_ids, n_levels = _HEAD.unpack_from(head, len(MAGIC))
        self.levels = list(_LEVEL.iter_unpack(bytes(read(len(head), _LEVEL.size * n_levels))))
        self._docs_at = len(head) + _LEVEL.size * n_levels

    @classmethod
    def of(cls, image) -> "Segment":
        view = memoryview(image)
        return cls(lambda at, n: view[at : at + n])

    def _array(self, kind: str, n: int, at: int) -> np.ndarray:
        return np.frombuffer(self.read(at, n * np.dtype(kind).itemsize), kind)

    @property
    def doc_ids(self) -> list[int | None]:
        absent, known = self._array("u1", self.n_docs, self._docs_at), self._array("<i8", self.n_docs, self._docs_at + self.n_docs)
        return [None if a else d for a, d in zip(absent.tolist(), known.tolist())]

    @property
    def ends(self) -> np.ndarray:
        return self._array("<u8", self.n_docs, self._docs_at + 9 * self.n_docs).astype("i8")

    def __getitem__(self, i: int) -> int:
        """The i-th id: of each level a chunk, and a block of 64 bytes and a rank if there may be a next one."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value, step = 0, BLOCK_BITS // 8
        for level, (n, chunks, bitmap, ranks) in enumerate(self.levels):
            value |= self.read(chunks + i, 1)[0] << (8 * level)
            if level + 1 == len(self.levels):
                break
            block = i // BLOCK_BITS
            bits = bytes(self.read(bitmap + block * step, min(step, -(-n // 8) - block * step)))
            inside = int.from_bytes(bits, "little")
            if not inside >> (i % BLOCK_BITS) & 1:
                break
            (rank,) = struct.unpack("<I", bytes(self.read(ranks + 4 * block, 4)))
            i = rank + (inside & ((1 << i % BLOCK_BITS) - 1)).bit_count()
        return value

    def ids(self) -> np.ndarray:
        """All ids, level by level from the highest."""
        value = np.zeros(0, "<u4")
        for n, chunks, bitmap, _ in reversed(self.levels):
            mine = self._array("u1", n, chunks).astype("<u4")
            more = np.unpackbits(self._array("u1", -(-n // 8), bitmap), count=n, bitorder="little").astype(bool)
            mine[more] |= value << 8
            value = mine
        return value


def _segments(definition: str, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(definition), np.array([END_ID], "<u4")
        base = held = 0
        docs, parts, ends = [], [], []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack(np.concatenate(parts), docs, np.array(ends), base)], pa.binary())], names=["image"])

        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in by_size(texts):
                for d, ids in zip(ids_of[part], enc.encode(texts[part])):
                    docs.append(d)
                    parts += [ids, end]
                    held += len(ids) + 1
                    ends.append(held)
                    if held >= segment_ids:
                        yield close()
                        base, held = base + held, 0
                        docs, parts, ends = [], [], []
        if docs:
            yield close()

    return run


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of DOCUMENTS from files (shard, part, content); start counts from the write task's first id."""
    for batch in batches:
        for shard, part, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            view, at = memoryview(content.as_buffer()), 0
            while at < len(view):
                s = Segment.of(view[at:])
                ids, ends, n = s.ids(), s.ends, s.n_docs
                starts = np.concatenate([[0], ends[:-1]]).astype("i8")
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                columns = (s.doc_ids, [shard] * n, [part] * n, [at] * n, [s.length] * n, starts + s.before, ends - starts, crcs)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in DOCUMENTS.split(", ")])
                at += s.length + 1


class TokenStore:
    """Files of token ids under one folder, and where each document and segment lies in them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def write(cls, docs: DataFrame, path: str, tokenizer: str, partitions: int | None = None, segment_ids: int = SEGMENT_IDS) -> "TokenStore":
        """Encode every text (null: empty) with the end id after it; write files in ascending doc_id order, and read them back.

        Rows are dealt out by ranges of doc_id (one shuffle, of doc_id and text
        alone); rows with one doc_id stay together, ordered by text, nulls
        first, so a range is one write task. A file's number is its task's and
        then its own: the order of the names is that of the ids.
        """
        store = cls(docs.sparkSession, path)
        ship(docs.sparkSession)
        narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        dealt = narrow.repartitionByRange("doc_id") if partitions is None else narrow.repartitionByRange(partitions, "doc_id")
        images = dealt.sortWithinPartitions("doc_id", "text").mapInArrow(_segments(read_definition(tokenizer), segment_ids), "image binary")
        # The text writer puts a string's bytes out as they are, and a cast leaves them so.
        images.select(F.col("image").cast("string").alias("value")).write.mode("overwrite").option("compression", "none").option("lineSep", "\n").option("maxRecordsPerFile", FILE_SEGMENTS).text(store._at("segments"))
        store._index()
        return store

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _files(self) -> DataFrame:
        """(path, shard, part, content): write task and number of each file by its name; content is read only where it is used."""
        number = lambda pattern: F.regexp_extract("path", pattern, 1).cast("int")
        files = self.spark.read.format("binaryFile").load(self._at("segments"))
        return files.select("path", number(r"/part-(\d+)[^/]*$").alias("shard"), number(r"-c(\d+)[^/]*$").alias("part"), "content")

    def _index(self) -> None:
        found = self._files().select("shard", "part", "content").mapInArrow(_read_back, DOCUMENTS)
        found.write.mode("overwrite").parquet(self._at("read-back"))
        rows = self.spark.read.schema(DOCUMENTS).parquet(self._at("read-back"))
        # One row for each write task, to place the tasks one after the other; a task's segments know their own place.
        before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
        tasks = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(before, F.lit(0)).alias("before"))
        tasks.write.mode("overwrite").parquet(self._at("tasks"))
        placed = rows.join(to_rows(self.spark.read.parquet(self._at("tasks"))), "shard").withColumn("start", F.col("start") + F.col("before"))
        segments = placed.groupBy("shard", "part", "at", "length").agg(F.min("start").alias("first"), F.sum("n_tokens").alias("n_ids"), F.count(F.lit(1)).alias("n_docs"))
        segments.join(self._files().select("path", "shard", "part"), ["shard", "part"]).write.mode("overwrite").parquet(self._at("directory"))

    def documents(self) -> DataFrame:
        """doc_id, start (ids before it), n_tokens, ids_crc32, as read back from the files."""
        rows = self.spark.read.schema(DOCUMENTS).parquet(self._at("read-back"))
        placed = rows.join(to_rows(self.spark.read.parquet(self._at("tasks"))), "shard")
        return placed.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")

    def directory(self) -> DataFrame:
        """A row for each segment: path, at, length, first (ids before it), n_ids, n_docs."""
        return self.spark.read.parquet(self._at("directory")).select("path", "at", "length", "first", "n_ids", "n_docs")

    def ids_at(self, positions: list[int]) -> list[int]:
        """Ids at some positions of the whole output. Of each one's file only the bytes on its path are read.

        A position without an id is an IndexError.
        """
        asked = self.spark.createDataFrame([(p,) for p in sorted(set(positions))], "position long")
        here = self.directory().join(F.broadcast(asked), (F.col("position") >= F.col("first")) & (F.col("position") < F.col("first") + F.col("n_ids")))
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        found = {}
        for r in here.select("path", "at", "first", "position").collect():
            where = jvm.org.apache.hadoop.fs.Path(r.path)
            stream = where.getFileSystem(conf).open(where)

            def read(at: int, n: int, stream=stream, base=r["at"]) -> bytes:
                stream.seek(base + at)
                return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))

            try:
                found[r.position] = Segment(read)[r.position - r["first"]]
            finally:
                stream.close()
        for p in positions:
            if p not in found:
                raise IndexError(p)
        return [found[p] for p in positions]


def op8_token_codes(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Every document of the table, written as files and read back.

    Null text: the end id alone. Null doc_id: kept, before all others. Empty
    table: no rows. Rows repeated with one doc_id: one result row each. Other
    columns take no part.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return TokenStore.write(docs, Workspace(spark, "token-codes").path("store"), tokenizer or default_tokenizer()).documents()
