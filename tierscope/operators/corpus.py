"""Current versions and their files, attachment status and corpus accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_versions(versions: DataFrame, collections: DataFrame, path: str | None = None) -> DataFrame:
    """The latest version of each document that isn't deleted, of one collection path if given."""
    rows = versions.where(~F.coalesce("deleted", F.lit(False))).join(collections, "collection_id")
    if path is not None:
        rows = rows.where(F.col("path") == path)
    latest = Window.partitionBy("document_id").orderBy(F.desc("version_id"))
    return rows.withColumn("r", F.row_number().over(latest)).where("r = 1").drop("r")


def current_files(current: DataFrame, files: DataFrame, field: str = "publicationFile") -> DataFrame:
    """Files of a field of the current versions."""
    return current.join(files.where(F.col("field_name") == field), "version_id")


def clean_hash(value: Column) -> Column:
    """A stored SHA-256 in lower case, null if it isn't one."""
    return F.when(F.lower(value).rlike("^[a-f0-9]{64}$"), F.lower(value))


def attachment_status(attachments: DataFrame) -> DataFrame:
    """status and reason of rows of media_type, error_code: only PDFs are read, so filter on media_type first."""
    pdf = F.lower(F.coalesce("media_type", F.lit(""))) == "application/pdf"
    return attachments.withColumns({
        "status": F.when(~pdf, "excluded").when(F.col("error_code").isNull(), "included").otherwise("unreadable"),
        "exclusion_reason": F.when(~pdf, "NON_PDF_MEDIA_TYPE").otherwise(F.col("error_code")),
    })


def corpus_summary(records: DataFrame, expected: int | None = None) -> DataFrame:
    """Attachments by status, pages, and the difference from an expected count."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = records.agg(F.count("*").alias("attachments"), n("included").alias("included"), n("excluded").alias("excluded"), n("unreadable").alias("unreadable"), F.coalesce(F.sum(F.when(F.col("status") == "included", F.col("page_count"))), F.lit(0)).alias("pages"))
    return out if expected is None else out.withColumn("difference", F.col("included") - expected)


def coverage_regimes(signals: DataFrame) -> DataFrame:
    """Documents with nearly all pages in the text layer, nearly none, and the rest."""
    c = F.col("text_layer_coverage")
    out = signals.agg(F.count("*").alias("documents"), F.count_if(c >= 0.95).alias("high"), F.count_if(c < 0.1).alias("low"))
    return out.withColumn("middle", F.col("documents") - F.col("high") - F.col("low"))


def warnings_seen(pages: DataFrame) -> DataFrame:
    """Distinct warnings of all pages, sorted."""
    return pages.select(F.explode("warnings").alias("warning")).distinct().orderBy("warning")


def uniqueness(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, distinct keys, and whether all keys are unique."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"))
    return out.withColumn("is_unique", F.col("n_rows") == F.col("n_keys"))
