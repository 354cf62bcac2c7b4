"""The closed record types as Spark schemas, and their rules as columns: null where a row is good, else what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------
AUTHORED_SOURCE = "authored/triage"
KINDS = ("vendor-manual", "authored-triage")
STATUSES = ("confirmed", "assumed")
MANUAL_ONLY = ("vendor", "product", "doctype", "lang", "doc_version", "page_count", "low_text")
REJECTIONS = ("filename-invalid", "source-id-collision", "no-text-layer", "no-english-content", "unreadable-text", "authored-invalid")
# ---------------------------------------------------------------------------

SOURCE = (
    "kind string NOT NULL, source_id string NOT NULL, vendor string, product string, doctype string, lang string, doc_version string, display_name string NOT NULL, "
    "hardware_applicability struct<status:string,device:string,revision:string> NOT NULL, page_count int, ingested_at string NOT NULL, chunk_count int NOT NULL, low_text boolean"
)
PASSAGE = (
    "passage_id string NOT NULL, source_id string NOT NULL, section_number string, section_title string NOT NULL, page_start int, page_end int, text string NOT NULL, "
    "degraded boolean NOT NULL, has_figures boolean NOT NULL, unbacked boolean NOT NULL, entry_location string"
)
STATE_VALUE = "key string NOT NULL, value string, observed_at timestamp NOT NULL, origin string, origin_kind string"


def _first(*rules: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(message)) for bad, message in rules])


def source_fault() -> Column:
    authored = F.col("kind") == "authored-triage"
    status = F.col("hardware_applicability.status")
    return _first(
        (~F.col("kind").isin(*KINDS) | F.col("kind").isNull(), "unknown kind"),
        (~status.isin(*STATUSES) | status.isNull(), "unknown applicability status"),
        *[(authored & F.col(c).isNotNull(), f"{c} doesn't apply to an authored source") for c in MANUAL_ONLY],
        (authored & (F.col("source_id") != AUTHORED_SOURCE), "an authored source has one id"),
        (authored & (status != "assumed"), "an authored source is never confirmed"),
        *[(~authored & F.col(c).isNull(), f"{c} is missing") for c in MANUAL_ONLY],
    )


def passage_fault() -> Column:
    authored = F.col("source_id") == AUTHORED_SOURCE
    return _first(
        *[(authored & F.col(c).isNotNull(), f"{c} on a passage without pages") for c in ("section_number", "page_start", "page_end")],
        (authored & F.col("entry_location").isNull(), "entry_location is missing"),
        *[(~authored & F.col(c).isNull(), f"{c} is missing") for c in ("page_start", "page_end")],
        (~authored & (F.col("page_end") < F.col("page_start")), "page_end before page_start"),
        (~authored & F.col("entry_location").isNotNull(), "entry_location on a passage with pages"),
    )


def rejection_fault() -> Column:
    return F.when(~F.coalesce(F.col("reason").isin(*REJECTIONS), F.lit(False)), "not a rejection but a failure")


def faults(rows: DataFrame, fault: Column) -> DataFrame:
    return rows.withColumn("fault", fault).where("fault IS NOT NULL")


def checked(rows: DataFrame, fault: Column) -> DataFrame:
    """The rows; a bad one is an error where it is read."""
    ok = F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(fault).cast("boolean"))
    return rows.where(ok)
