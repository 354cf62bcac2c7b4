"""Session plumbing: shared work tables, shipping the package to workers, Arrow batch bounds."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Applications whose workers already have the package.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    The archive goes through Spark's own file server, so no folder has to be
    shared. Arrow batches are bounded in rows and bytes here too, since one
    batch of very long texts would otherwise have no bound.
    """
    for key, value in (("maxRecordsPerBatch", "2000"), ("maxBytesPerBatch", str(16 << 20))):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", value)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # already running from a shipped archive
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    at = os.path.join(tempfile.mkdtemp(prefix="citegrain-"), "citegrain_pkg.zip")
    Path(at).write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(at)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where all is one machine, one of our own if unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        at = os.path.join(tempfile.gettempdir(), "checkpoints", "citegrain")
        os.makedirs(at, exist_ok=True)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Lists that new workspaces are entered in.
_WATCHED: list[list["Workspace"]] = []


@contextmanager
def scratch() -> Iterator[list["Workspace"]]:
    """The workspaces that are made inside, for who wants to delete them."""
    made: list[Workspace] = []
    _WATCHED.append(made)
    try:
        yield made
    finally:
        _WATCHED.remove(made)


class Workspace:
    """Tables of one operator run, under one folder of the shared root.

    ``put`` writes a frame and reads it back: it cuts lineage, survives lost
    executors, and later reads prune columns. ``drop`` removes one table, and
    ``clear`` the folder, once nothing lazy reads from them any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.at = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        for made in _WATCHED:
            made.append(self)

    def path(self, name: str) -> str:
        return f"{self.at}/{name}"

    def put(self, name: str, df: DataFrame, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).mode("overwrite").parquet(self.path(name))
        return self.get(name, df.schema)

    def get(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(name))

    def drop(self, name: str) -> None:
        self._delete(self.path(name))

    def clear(self) -> None:
        self._delete(self.at)

    def _delete(self, at: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
