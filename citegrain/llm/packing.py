"""Order-preserving packing by dynamic programming over cut positions.

Documents in ``doc_id`` order form a stream of ids. A window is a run of at
most 2048 ids, and one sequence of the output. Windows are cut at ends of
documents, ends of sentences and, where neither comes for long, anywhere. The
plan minimises padding plus penalties of the cuts: with ``v[j]`` the best cost
up to position ``p[j]`` plus ``p[j]``, ``v[j] = capacity + penalty[j] + min v[i]``
over ``p[j] - capacity <= p[i] < p[j]``, a sliding-window minimum that a
monotone queue gives in constant time for each position.

Each range of ``doc_id`` is planned by one task, in chunks of about a million
ids; a chunk's last window goes over to the next chunk. What is left at a
task's end is split into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .tokens import END_ID, by_size, default_tokenizer, encoder, read_definition

CAPACITY = 2048
#: Penalties, in tokens of padding.
SENTENCE_CUT, HARD_CUT = 4, 24
#: Where no document or sentence ends for so many ids, cuts are allowed at this spacing.
HARD_SPACING = 64
CHUNK_IDS = 1 << 20
#: A task's last window is split into powers of two if its padding would be more.
TAIL_PADDING = 64

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sentence_ends(definition: str) -> np.ndarray:
    """By id: whether the token ends a sentence (its text ends with . ! or ?)."""
    vocab = json.loads(definition)["model"]["vocab"]
    ends = np.zeros(max(vocab.values()) + 1024, bool)
    for token, i in vocab.items():
        ends[i] = token.removesuffix("</w>").endswith((".", "!", "?"))
    return ends


def cut_positions(ids: np.ndarray, doc_ends: list[int], ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Positions where a window may end, ascending from 0 to len(ids), and their penalties."""
    n = len(ids)
    allowed = np.full(n + 1, -1, np.int32)
    allowed[1:][ends[ids]] = SENTENCE_CUT
    allowed[doc_ends] = 0
    allowed[0] = allowed[n] = 0
    pos = np.flatnonzero(allowed >= 0)
    far = np.flatnonzero(np.diff(pos) > HARD_SPACING)
    if len(far):
        extra = np.concatenate([np.arange(pos[k] + HARD_SPACING, pos[k + 1], HARD_SPACING) for k in far])
        allowed[extra] = HARD_CUT
        pos = np.flatnonzero(allowed >= 0)
    return pos.tolist(), allowed[pos].tolist()


def plan_windows(pos: list[int], penalty: list[int], capacity: int = CAPACITY, open_end: bool = False) -> list[int]:
    """The cheapest window ends, from the first position (not listed) to the last.

    With an open end, what follows the last window end fits one window and is
    left over at no cost.
    """
    if len(pos) < 2:
        return []
    v, prev = [pos[0]] + [0] * (len(pos) - 1), [0] * len(pos)
    queue = deque([0])
    for j in range(1, len(pos)):
        low = pos[j] - capacity
        while pos[queue[0]] < low:
            queue.popleft()
        i = prev[j] = queue[0]
        x = v[j] = v[i] + capacity + penalty[j]
        while queue and v[queue[-1]] > x:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(pos) - 1
    if open_end:
        fits = range(bisect_left(pos, pos[-1] - capacity), len(pos))
        j = min(fits, key=lambda i: v[i] - pos[i])
    while j:
        cuts.append(pos[j])
        j = prev[j]
    return cuts[::-1]


def tail_lengths(length: int, capacity: int = CAPACITY) -> list[int]:
    """The last window of a task, split into powers of two if padding it would waste much."""
    if not length or capacity - length <= TAIL_PADDING:
        return [length] if length else []
    parts = []
    while length:
        parts.append(1 << (length.bit_length() - 1))
        length -= parts[-1]
    return parts


class _Chunk:
    """Documents, or rests of them, not yet cut."""

    def __init__(self):
        self.docs: list[list] = []  # doc_id, ids in front of this part, ids of the document, ids of this part
        self.n = 0

    def add(self, doc_id, start: int, total: int, ids: np.ndarray) -> None:
        self.docs.append([doc_id, start, total, ids])
        self.n += len(ids)

    def cut(self, windows: list[int], first_sequence: int) -> tuple[dict[str, list], "_Chunk"]:
        """Pieces of the windows that end at the given positions, and what comes after the last."""
        out: dict[str, list] = {k.split()[0]: [] for k in PIECES.split(", ")}
        rest, at, k, begun = _Chunk(), 0, 0, 0
        for doc_id, start, total, ids in self.docs:
            done = 0
            while done < len(ids) and k < len(windows):
                take = min(len(ids) - done, windows[k] - at)
                row = (doc_id, start + done, take, zlib.crc32(ids[done : done + take].tobytes()), total, first_sequence + k, at - begun)
                for column, value in zip(out.values(), row):
                    column.append(value)
                done, at = done + take, at + take
                if at == windows[k]:
                    k, begun = k + 1, at
            if done < len(ids):
                rest.add(doc_id, start + done, total, ids[done:])
        return out, rest


def _pack(definition: str, chunk_ids: int):
    types = pa.schema([(k.split()[0], pa.int64()) for k in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 36
        enc, ends, end = encoder(definition), sentence_ends(definition), np.uint32(END_ID)
        chunk = _Chunk()

        def planned(last: bool):
            ids = np.concatenate([d[3] for d in chunk.docs])
            doc_ends = np.cumsum([len(d[3]) for d in chunk.docs]).tolist()
            windows = plan_windows(*cut_positions(ids, doc_ends, ends), open_end=True)
            if last:
                at = windows[-1] if windows else 0
                for length in tail_lengths(len(ids) - at):
                    at += length
                    windows.append(at)
            return windows

        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in by_size(texts):
                for doc_id, ids in zip(ids_of[part], enc.encode(texts[part])):
                    ids = np.append(ids, end)
                    chunk.add(doc_id, 0, len(ids), ids)
                    if chunk.n >= chunk_ids:
                        windows = planned(False)
                        out, chunk = chunk.cut(windows, sequence)
                        sequence += len(windows)
                        yield pa.RecordBatch.from_pydict(out, schema=types)
        if chunk.n:
            yield pa.RecordBatch.from_pydict(chunk.cut(planned(True), sequence)[0], schema=types)

    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, partitions: int | None = None, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids.

    Null text: empty, so the end id alone. Null doc_id: kept, packed first.
    Rows repeated with one doc_id are packed each. Empty table: no rows.
    Other columns take no part. sequence_id is unique and ascends with doc_id;
    it is dense within each task only.
    """
    ship(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = narrow.repartitionByRange("doc_id") if partitions is None else narrow.repartitionByRange(partitions, "doc_id")
    return dealt.sortWithinPartitions("doc_id", "text").mapInArrow(_pack(read_definition(tokenizer or default_tokenizer()), chunk_ids), PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of the table, packed."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows packed, as often as they are there: pieces take the place of documents.

    Null text: the end id alone. Null doc_id: packed first. Repeated rows are
    packed each. Empty table: no rows. Other columns take no part.
    """
    return pack_documents(docs)
