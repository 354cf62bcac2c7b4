"""Vectors of texts by an injected encoder, in Arrow batches; a deterministic one for tests and dry runs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

#: What a question is prefixed with before it is encoded.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
Encoder = Callable[[list[str]], np.ndarray]


def hash_encoder(dimension: int = 64) -> Encoder:
    """Unit vectors seeded by each text's digest."""

    def encode(texts: list[str]) -> np.ndarray:
        rows = [np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8])).normal(size=dimension) for t in texts]
        return np.array(rows, np.float32).reshape(len(texts), dimension)

    encode.name = f"hash-{dimension}"
    return encode


def name_of(encoder: Encoder) -> str:
    """The model that vectors are from: the encoder's own name, else that of its function or class."""
    return str(getattr(encoder, "name", None) or getattr(encoder, "__qualname__", None) or type(encoder).__qualname__)


def encode_texts(df: DataFrame, text: str, encoder: Encoder, dimension: int, prefix: str = "", batch: int = 256) -> DataFrame:
    """Adds vector, at length one (a zero vector stays zero). A null text has a null vector; an encoder's wrong shape is an error."""
    ship(df.sparkSession)
    at = df.columns.index(text)
    schema = df.drop("vector").withColumn("vector", F.array().cast("array<float>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, batch):
                part = b.slice(start, batch)
                texts = part.column(at).to_pylist()
                known = [i for i, t in enumerate(texts) if t is not None]
                found: list = [None] * len(texts)
                if known:
                    v = np.asarray(encoder([prefix + texts[i] for i in known]), np.float32)
                    if v.shape != (len(known), dimension):
                        raise ValueError(f"the encoder gave {v.shape}, not {(len(known), dimension)}")
                    norm = np.linalg.norm(v, axis=1, keepdims=True)
                    v = np.divide(v, norm, out=v.copy(), where=norm > 0)
                    for i, row in zip(known, v):
                        found[i] = row.tolist()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.float32()))], names=[*part.schema.names, "vector"])

    return df.drop("vector").mapInArrow(run, schema)


def encode_missing(passages: DataFrame, previous: DataFrame | None, encoder: Encoder, dimension: int) -> DataFrame:
    """Vectors of passages, those of an earlier run where it had the passage; the rest go to the encoder, with their headers."""
    full = passages.withColumn("_indexed", F.concat_ws("\n", "header", "text"))
    if previous is None:
        return encode_texts(full, "_indexed", encoder, dimension).drop("_indexed")
    kept = previous.select("passage_id", F.col("vector").alias("_kept")).dropDuplicates(["passage_id"])
    joined = full.join(kept, "passage_id", "left")
    fresh = encode_texts(joined.where("_kept IS NULL").drop("_kept"), "_indexed", encoder, dimension).drop("_indexed")
    return fresh.unionByName(joined.where("_kept IS NOT NULL").withColumn("vector", F.col("_kept")).drop("_kept", "_indexed"))


def token_counts(df: DataFrame, text: str, count: Callable[[str], int]) -> DataFrame:
    """Adds tokens, by an injected counter."""
    ship(df.sparkSession)
    at = df.columns.index(text)
    schema = df.drop("tokens").withColumn("tokens", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([count(t or "") for t in b.column(at).to_pylist()], pa.int32())], names=[*b.schema.names, "tokens"])

    return df.drop("tokens").mapInArrow(run, schema)
