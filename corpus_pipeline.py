"""From raw documents to packed sequences, in stages that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citegrain.llm import exact_dedup, language_id, mixing, near_dedup, packing
from citegrain.runtime import Workspace, scratch


STAGES = [
    ("language_id", language_id.stage_language),
    ("exact_dedup", exact_dedup.stage_exact_dedup),
    ("near_dedup", near_dedup.stage_near_dedup),
    ("mixing", mixing.stage_mixing),
    ("packing", packing.stage_packing),
]

#: Compression sizes, hash bands and token ids are beyond SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's rows are written to the shared folder and read again.

    What a stage works with is deleted once its rows are written, and its rows
    once the next stage's are.
    """
    ws = Workspace(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch() as used:
            docs = ws.put(name, stage(spark, docs, sf_dir))
        for other in used:
            if other.at != ws.at:
                other.clear()
        if before:
            ws.drop(before)
        before = name
    return docs
