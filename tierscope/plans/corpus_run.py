"""The outputs of a corpus run: records, inspections and the source map as ordered lines with their roots, and a summary."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.corpus import corpus_summary, uniqueness
from ..sources.files import write_new
from ..sources.lines import Written, write_lines

#: What the source map tells of a case; these columns stay out of records and inspections.
SOURCE_MAP = ("case_id", "source_key", "document_id", "version_id", "field_path", "storage_path", "storage_url", "filename", "original_filename")


def corpus_outputs(records: DataFrame, inspections: DataFrame, sources: DataFrame, folder: str, run_id: str, observed_at: str, documents: int, expected: int | None = None) -> tuple[dict, dict[str, Written]]:
    """Write corpus, inspection, source map and summary below a folder where they aren't yet; the summary and the outputs.

    records: case_id, status, page_count and more, one row an attachment. inspections: case_id, page_count and more, of the
    included ones. sources: SOURCE_MAP. Raises where a case has two records, an inspection no included record, or a
    record no source. expected: how many readable and unreadable PDFs an earlier count had; the difference is told, not
    corrected.
    """
    for name, df in (("records", records), ("inspections", inspections), ("sources", sources)):
        if not uniqueness(df, ["case_id"]).first()["is_unique"]:
            raise ValueError(f"a case has more than one row in {name}")
    if inspections.join(records.where("status = 'included'").select("case_id").hint("merge"), "case_id", "left_anti").limit(1).count():
        raise ValueError("an inspection has no included record")
    if records.join(sources.select("case_id").hint("merge"), "case_id", "left_anti").limit(1).count():
        raise ValueError("a record has no source")
    folder = folder.rstrip("/")
    outputs = {
        "corpus": write_lines(records, f"{folder}/corpus.jsonl", ["case_id"]),
        "inspection": write_lines(inspections, f"{folder}/inspection.jsonl", ["case_id"]),
        "source_map": write_lines(sources.select(*SOURCE_MAP), f"{folder}/source-map.jsonl", ["case_id"]),
    }
    counts = corpus_summary(records).first()
    pages = inspections.agg(F.coalesce(F.sum("page_count"), F.lit(0)).alias("n")).first()["n"]
    found = counts["included"] + counts["unreadable"]
    summary = {
        "schema_version": 1, "run_id": run_id, "observed_at": observed_at,
        "counts": {"documents": documents, "attachments": counts["attachments"], "included": counts["included"], "excluded": counts["excluded"], "unreadable": counts["unreadable"], "inspected": outputs["inspection"].rows, "inspected_pages": int(pages)},
        "expected": None if expected is None else {"pdfs": expected, "difference": found - expected},
        "output_roots": {name: o.root for name, o in outputs.items()},
    }
    write_new(records.sparkSession.createDataFrame([(json.dumps(summary, indent=2),)], "value string").coalesce(1), f"{folder}/summary.json", "text")
    return summary, outputs
