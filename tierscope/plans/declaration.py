"""The frozen declaration of evaluation pages: what it derives from, by hashes, and when it is refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.structure import canonical_json, sha256_text
from ..operators.sampling import declare_pages, declared_counts, select_pages
from ..sources.files import write_pair
from ..sources.run_cells import parsed_name


class DeclarationRefused(ValueError):
    """The evaluation is open already, or inputs aren't those that were frozen."""


def check_chain(sample: dict, policy: dict, config_hash: str, inspection_hash: str, sample_hash: str, seed: str, pages_each: int) -> None:
    """Raises unless each frozen step names the inputs of the next.

    sample: config_hash, inspection_hash, seed. policy: status, evaluation_cells (their number at its freeze), opened_cases,
    sample_hash, config_hash.
    """
    wrong = {
        "the policy isn't frozen": policy["status"] != "frozen",
        "the policy was frozen after evaluation cells": policy["evaluation_cells"] != 0 or bool(policy["opened_cases"]),
        "the policy is of another sample": policy["sample_hash"] != sample_hash,
        "configuration, sample and policy differ in the configuration": not config_hash == sample["config_hash"] == policy["config_hash"],
        "the sample is of other inspections": sample["inspection_hash"] != inspection_hash,
        "the sample has another seed": sample["seed"] != seed,
        "two pages of each document are declared": pages_each != 2,
    }
    if found := [name for name, bad in wrong.items() if bad]:
        raise DeclarationRefused("; ".join(found))


def declare_evaluation(cases: DataFrame, pages: DataFrame, cell_names: DataFrame, sample: dict, policy: dict, config_hash: str, inspection_hash: str, sample_hash: str, policy_hash: str, seed: str, declared_at: str, pages_each: int = 2) -> dict:
    """The declaration: pages by case, counts by stratum and partition, and the hashes of all it derives from.

    cases: partition, case_id, stratum, page_count, chars_per_page and, of evaluation cases, the frozen pages, which the rule
    must give again. pages: as select_pages takes them. cell_names (name): files of run cells; one of an evaluation
    case refuses the declaration, as does a link of the chain that doesn't hold. A sample has a handful of cases by
    stratum, so its pages come to the driver.
    """
    opened = sorted(r["name"] for r in cell_names.where(F.col("name").startswith("evaluation-") & F.col("name").endswith(".json")).limit(100).collect())
    if opened:
        raise DeclarationRefused(f"the evaluation is open already: {', '.join(opened)}")
    check_chain(sample, policy, config_hash, inspection_hash, sample_hash, seed, pages_each)
    chosen = select_pages(cases, pages, seed, pages_each)
    if cases.join(chosen.select("case_id").hint("merge"), "case_id", "left_anti").limit(1).count():
        raise DeclarationRefused("a case has no inspected page")
    declared, pages_hash = declare_pages(cases, chosen)
    counts = {f"{r['partition']}/{r['stratum']}": {"documents": r["documents"], "pages": r["pages"]} for r in declared_counts(declared).collect()}
    rows = declared.join(cases.select("case_id", "page_count").hint("merge"), "case_id").orderBy("partition", "case_id").collect()
    listed = [{"partition": r["partition"], "caseId": r["case_id"], "stratum": r["stratum"], "documentPageCount": r["page_count"], "pages": list(r["pages"])} for r in rows]
    return {
        "schemaVersion": 1, "status": "frozen", "declaredAt": declared_at, "selection": {"countPerDocument": pages_each, "seed": seed},
        "provenance": {"configHash": config_hash, "inspectionHash": inspection_hash, "sampleHash": sample_hash, "policyHash": policy_hash, "pagesHash": pages_hash},
        "evaluationCells": 0, "denominators": counts, "cases": listed,
    }


def expected_cells(declaration: dict, tier: str = "T3") -> list[str]:
    """The names of the page cells that a declaration asks for; raises if it isn't frozen or its counts aren't those of its pages."""
    if declaration["status"] != "frozen":
        raise DeclarationRefused("the declaration isn't frozen")
    names = sorted(f"{c['partition']}-{c['caseId']}-P{page:04d}-{tier}.json" for c in declaration["cases"] for page in c["pages"])
    if len(names) != declaration["denominators"]["all/all"]["pages"] or any(parsed_name(n)["tier"] != tier for n in names):
        raise DeclarationRefused("the declaration's counts aren't those of its pages")
    return names


def freeze(declaration: dict, spark, path: str) -> str:
    """Write a declaration with the manifest of its hash, where neither is yet; returns the hash."""
    text = canonical_json(declaration)
    digest = write_pair(spark, text, path)
    assert digest == sha256_text(text)
    return digest
