"""Snapshots of printed documents as span models: one JSON document a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The snapshot format that is read and written.
SNAPSHOT_VERSION = 1
SPAN = "struct<text:string,bbox:array<double>,font:string,size:double,flags:int,unmappable:boolean>"
LINE = f"struct<bbox:array<double>,furniture:boolean,spans:array<{SPAN}>>"
BLOCK = f"struct<bbox:array<double>,lang:string,english:boolean,lines:array<{LINE}>>"
PAGE = f"struct<number:int,width:double,height:double,images:array<array<double>>,blocks:array<{BLOCK}>>"
DOCUMENT = f"schema string, page_count int, toc array<array<string>>, pages array<{PAGE}>"


def read_snapshots(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """doc (file name), page_count, toc (level, title, page), pages. Another format or version is an error where it is read."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.json)?$", 1)
    good = F.col("schema").endswith(f".pdf.extraction/{SNAPSHOT_VERSION}")
    checked = F.when(good, F.col("page_count")).otherwise(F.raise_error(F.concat(F.lit("not a snapshot of this version: "), F.coalesce("schema", F.lit("none")))).cast("int"))
    entry = lambda t: F.struct(F.get(t, F.lit(0)).cast("int").alias("level"), F.get(t, F.lit(1)).alias("title"), F.get(t, F.lit(2)).cast("int").alias("page"))
    return raw.select(name.alias("doc"), checked.alias("page_count"), F.transform("toc", entry).alias("toc"), "pages")


def write_snapshots(documents: DataFrame, path: str, schema: str = f"citegrain.pdf.extraction/{SNAPSHOT_VERSION}") -> None:
    """One JSON line a document; fields that aren't set are left out."""
    toc = F.transform("toc", lambda t: F.array(t["level"].cast("string"), t["title"], t["page"].cast("string")))
    documents.select(F.lit(schema).alias("schema"), "page_count", toc.alias("toc"), "pages").write.option("ignoreNullFields", True).mode("overwrite").json(path)


def select_pages(documents: DataFrame, pages: list[int]) -> DataFrame:
    """Some pages of a document; page_count stays that of the whole."""
    return documents.withColumn("pages", F.filter("pages", lambda p: p["number"].isin(*pages)))
