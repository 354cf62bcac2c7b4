"""Stores of files: manuals by name, authored entries by Markdown, inventories and ledgers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from . import index_store as S
from . import simple_yaml

MANUALS, ENTRIES = "manuals", "triage"
LEDGER = "pointer string, resolved_at string, passage_ids array<string>, entry_keys array<string>"


class Malformed(ValueError):
    pass


def _listed(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, name, content) below a folder; content is read only where it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    relative = F.substring_index(F.col("path"), f"{base}/", -1)
    return reader.load(root).select(relative.alias("path"), F.substring_index("path", "/", -1).alias("name"), F.col("path").alias("file"), "content")


def scan_manuals(spark: SparkSession, root: str, suffix: str = "") -> tuple[bool, DataFrame | None]:
    """(available, files) of the manual store: name, source_id, reason, file, fingerprint of those that stand.

    suffix: what is added to a manual's name where the store holds something
    made of it. A folder that isn't there is not an empty one. Rejected files
    aren't read.
    """
    if not S.exists(spark, root):
        return False, None
    files = _listed(spark, root, f"*{suffix}").where(~F.col("path").contains("/"))
    if suffix:
        files = files.withColumn("name", F.expr(f"left(name, length(name) - {len(suffix)})"))
    named = C.classify_files(files.select(F.lit(MANUALS).alias("store"), "name"))
    prints = files.join(named.where("reason IS NULL").select("name"), "name", "left_semi").select("name", "file", C.fingerprint(F.col("content")).alias("fingerprint"))
    return True, named.join(prints, "name", "left")


def scan_entries(spark: SparkSession, root: str) -> tuple[bool, DataFrame | None, DataFrame | None]:
    """(available, entry files, files passed over): Markdown below the store with no hidden part of the path."""
    if not S.exists(spark, root):
        return False, None, None
    files = _listed(spark, root, "*").where(~F.col("path").rlike(r"(^|/)\."))
    entry = F.col("path").endswith(".md")
    return True, files.where(entry).select(F.col("path").alias("source_file"), "content"), files.where(~entry).select("path")


def entries_fingerprint(files: DataFrame) -> DataFrame:
    return C.store_fingerprint(files.select(F.lit(ENTRIES).alias("store"), F.col("source_file").alias("path"), F.sha2("content", 256).alias("sha")))


def load_inventory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """devices(device_id, display_name, revision, position) and declared(source_id, device, revision, status).

    No file: nothing is owned. A file that says what it must not is an error.
    """
    text = S.read_text(spark, path)
    data = (simple_yaml.load(text) if text else None) or {}
    if not isinstance(data, dict):
        raise Malformed("an inventory is a mapping")
    devices, seen = [], set()
    for i, d in enumerate(data.get("devices") or []):
        ident = d.get("id") if isinstance(d, dict) else None
        if not isinstance(ident, str) or ident.count("/") != 1 or not all(ident.split("/")) or ident.strip() != ident:
            raise Malformed(f"not a device id: {ident!r}")
        if ident in seen or not str(d.get("display_name") or "").strip():
            raise Malformed(f"{ident} is declared twice or has no display name")
        seen.add(ident)
        devices.append((ident, d["display_name"], None if d.get("revision") is None else str(d["revision"]), i))
    declared = []
    for source_id, d in (data.get("source_applicability") or {}).items():
        if source_id == "authored/triage" or not isinstance(d, dict) or d.get("device") is None:
            raise Malformed(f"no declaration of one device for {source_id}")
        declared.append((source_id, str(d["device"]), None if d.get("revision") is None else str(d["revision"]), d.get("status", "assumed")))
    return (
        spark.createDataFrame(devices, "device_id string, display_name string, revision string, position int"),
        spark.createDataFrame(declared, "source_id string, device string, revision string, status string"),
    )


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """(rows, missing). A line that isn't a ledger row is an error naming file and line."""
    text = S.read_text(spark, path)
    rows = []
    for n, line in enumerate((text or "").splitlines(), 1):
        if not line.strip():
            continue
        try:
            d = json.loads(line)
            rows.append((str(d["pointer"]), str(d["resolved_at"]), [str(x) for x in d["passage_ids"]], [str(x) for x in d["entry_keys"]]))
        except (ValueError, KeyError, TypeError) as error:
            raise Malformed(f"{path} line {n}: {error}") from error
    return spark.createDataFrame(rows, LEDGER), text is None


def write_ledger(ledger: DataFrame, path: str) -> None:
    """One JSON line a pointer, sorted, so that equal ledgers are equal files. A ledger is as small as the entries an owner wrote."""
    lines = [json.dumps({"pointer": r.pointer, "resolved_at": r.resolved_at, "passage_ids": r.passage_ids, "entry_keys": r.entry_keys}, ensure_ascii=False) for r in ledger.orderBy("pointer").collect()]
    S.write_text(ledger.sparkSession, path, "".join(x + "\n" for x in lines))


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a line-wise JSON file; blank lines are passed over, others must parse."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_ndjson(rows: DataFrame, path: str, order: str) -> None:
    rows.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").json(path)
