"""Following an index's live version: a version is used when it is whole, and kept until a better one is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import index_store as S


class ViewWatcher:
    """Holds the current view; ``check`` looks once. A manifest that can't be read, or is of another version, is a fault and changes nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.manifest: dict | None = None
        self.view: dict[str, DataFrame] = {}
        self.fault: str | None = None

    def check(self) -> bool:
        """Whether the view was swapped."""
        try:
            found = S.read_manifest(self.spark, self.root)
            if found is None or (self.manifest and found["corpus_revision"] == self.manifest["corpus_revision"] and found["view_dir"] == self.manifest["view_dir"]):
                self.fault = None
                return False
            view = S.load_view(self.spark, self.root, found)
        except Exception as error:  # whatever is wrong with a new version, the old one stands
            self.fault = str(error)
            return False
        self.manifest, self.view, self.fault = found, view, None
        return True
