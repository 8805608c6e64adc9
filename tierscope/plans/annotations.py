"""The annotation pack of a page declaration: a pending record for each evaluation page, with the image it is judged by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.work import written


class PackRefused(ValueError):
    """Pages of a declaration lack their image, or there are records of pages that it doesn't have."""


def prepare_pack(declared: DataFrame, images: DataFrame, existing: DataFrame | None = None, expected_pages: int | None = None) -> DataFrame:
    """(case_id, page, stratum, image_file, image_sha256, annotation_file, annotation_status, created), one row a page.

    declared: partition, case_id, stratum, pages; its evaluation pages make the pack. images: case_id, page, content.
    existing: case_id, page and annotation_status of records that are there already; they stay as they are, the others are
    created as pending. Images are hashed where they lie; none comes to the driver.
    """
    pages = written(declared.where("partition = 'evaluation'").select("case_id", "stratum", F.explode("pages").alias("page")), "pack-pages")
    if expected_pages is not None and (found := pages.count()) != expected_pages:
        raise PackRefused(f"the declaration has {found} evaluation pages, not {expected_pages}")
    if images.groupBy("case_id", "page").count().where("count > 1").limit(1).count():
        raise PackRefused("a page has two images")
    # Of the images only those of the pack are hashed and go on.
    hashed = written(images.join(pages.select("case_id", "page"), ["case_id", "page"], "left_semi").select("case_id", "page", F.sha2("content", 256).alias("image_sha256")), "pack-images")
    if pages.join(hashed.select("case_id", "page").hint("merge"), ["case_id", "page"], "left_anti").limit(1).count():
        raise PackRefused("a page has no image")
    there = existing.select("case_id", "page", "annotation_status") if existing is not None else pages.select("case_id", "page", F.lit("").alias("annotation_status")).limit(0)
    if there.join(pages.hint("merge"), ["case_id", "page"], "left_anti").limit(1).count():
        raise PackRefused("there is a record of a page that isn't declared")
    stem = F.format_string("P%04d", F.col("page").cast("int"))
    rows = pages.join(hashed.hint("merge"), ["case_id", "page"]).join(there.hint("merge"), ["case_id", "page"], "left")
    case = F.col("case_id").cast("string")
    return rows.select("case_id", "page", "stratum", F.concat(F.lit("t3-page-images/"), case, F.lit("-"), stem, F.lit(".png")).alias("image_file"), "image_sha256", F.concat(case, F.lit("/"), stem, F.lit(".private.json")).alias("annotation_file"), F.coalesce("annotation_status", F.lit("pending")).alias("annotation_status"), F.col("annotation_status").isNull().alias("created"))
