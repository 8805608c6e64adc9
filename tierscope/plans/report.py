"""The values of a whole report as one table: each figure with its accounting, unit and source, checked as a whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import TIERS, ratio_value
from ..operators.export import unaccounted, value_name
from ..operators.gate import COMPONENTS
from ..operators.work import written

COLUMNS = ("key", "name", "label", "value_num", "value_str", "numerator", "denominator", "excluded_count", "unit", "source")


class ReportRefused(ValueError):
    """Parts of a report don't belong together, or a value lacks its accounting."""


def _text(c: Column | str) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def figures(rows: DataFrame, label: str, source: str, entries: list[tuple]) -> DataFrame:
    """The entries (key, unit, numerator, denominator, and, where they aren't 0 and the rate, excluded count and value) of each row."""
    made = []
    for key, unit, numerator, denominator, *rest in entries:
        excluded = rest[0] if rest else F.lit(0)
        value = rest[1] if len(rest) > 1 else ratio_value(numerator, denominator, excluded)
        made.append(F.struct(_text(key).alias("key"), F.lit(label).alias("label"), value.cast("double").alias("value_num"), F.lit(None).cast("string").alias("value_str"), numerator.cast("double").alias("numerator"), denominator.cast("double").alias("denominator"), excluded.cast("double").alias("excluded_count"), F.lit(unit).alias("unit"), F.lit(source).alias("source")))
    return rows.select(F.inline(F.array(*made)))


def counts(rows: DataFrame, label: str, source: str, entries: list[tuple]) -> DataFrame:
    """Figures (key, unit, value, denominator) that are counts or amounts of their own, not rates."""
    return figures(rows, label, source, [(key, unit, value, denominator, F.lit(0), value) for key, unit, value, denominator in entries])


def texts(rows: DataFrame, label: str, source: str, key: Column, value: Column) -> DataFrame:
    none = F.lit(None).cast("double")
    return rows.select(key.alias("key"), F.lit(label).alias("label"), none.alias("value_num"), value.alias("value_str"), none.alias("numerator"), none.alias("denominator"), none.alias("excluded_count"), F.lit(None).cast("string").alias("unit"), F.lit(source).alias("source"))


def value_report(corpus: DataFrame, coverage: DataFrame, sample: DataFrame, gate: DataFrame, policies: DataFrame, baseline: DataFrame, timing: DataFrame, page_timing: DataFrame, degradation: DataFrame, density: DataFrame, probes: DataFrame, unavailable: DataFrame) -> DataFrame:
    """All values (COLUMNS) of a report.

    corpus: corpus_summary. coverage: coverage_regimes. sample: sample_summary. gate: the chosen row of gate_candidates with
    denominator. policies: simulate. baseline: page_baseline. timing: timing_cube. page_timing: page_groups by partition.
    degradation: degradation_counts. density: numerator and denominator of short runs. probes: tier, provider_id,
    version, status. unavailable: key, reason. Raises where the coverage bands aren't all inspected documents, a tier has no
    available provider, the policies cover different pages, or a value has no accounting or a key that another has.
    """
    c = F.col
    # Several parts and checks read each of these; written, what they come from is made once. All are small.
    density = density.agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))
    inputs = {"corpus": corpus, "coverage": coverage, "sample": sample, "gate": gate, "policies": policies, "baseline": baseline, "timing": timing, "page-timing": page_timing, "degradation": degradation, "density": density, "probes": probes}
    corpus, coverage, sample, gate, policies, baseline, timing, page_timing, degradation, density, probes = (written(rows, f"report-{name}") for name, rows in inputs.items())
    parts = [
        counts(corpus, "observed", "corpus summary", [(f"corpus.{n}", u, c(n), c(n)) for n, u in (("attachments", "attachments"), ("included", "PDFs"), ("excluded", "attachments"), ("unreadable", "PDFs"), ("pages", "pages"))]),
        counts(coverage, "observed", "inspections", [(f"corpus.text_layer_coverage_{n}", "PDFs", c(n), c("documents")) for n in ("high", "low", "middle")]),
        counts(sample.agg(F.sum("calibration").alias("calibration"), F.sum("evaluation").alias("evaluation")), "sampled", "sample", [(f"sample.{n}_documents", "documents", c(n), c("calibration") + c("evaluation")) for n in ("calibration", "evaluation")]),
        counts(gate, "observed", "gate calibration", [(f"gate.threshold.{n}", "score threshold", c(n), c("denominator")) for n in COMPONENTS]),
        counts(gate, "sampled", "gate calibration", [(f"gate.calibration.{a}.{e}", "document-tier examples", c(f"{a}_{e}"), c("denominator")) for a in ("reading", "structural") for e in ("false_accepts", "false_rejects")]),
        figures(policies, "sampled", "policy analysis", [(F.concat(F.lit("policy."), c("policy"), F.lit(f".tier.{t}.documents")), "documents", c(f"selected_{t.lower()}"), c("selected_documents"), c("documents") - c("selected_documents")) for t in TIERS]),
        figures(policies, "sampled", "policy analysis", [(F.concat(F.lit("policy."), c("policy"), F.lit(f".{a}.{e}")), "fraction of pages", c(f"{a}_{e}"), c("covered_pages"), c("pages") - c("covered_pages")) for a in ("reading", "structural") for e in ("false_accepts", "false_escalations")]),
        figures(policies, "sampled", "policy analysis", [(F.concat(F.lit("policy."), c("policy"), F.lit(".observed_timing_coverage")), "fraction of documents", c("observed_documents"), c("documents"))]),
        figures(baseline, "sampled", "page baseline", [(f"policy.all_T3_pages.{a}.{e}", "fraction of pages", c(f"{a}_{e}"), c("pages")) for a in ("reading", "structural") for e in ("false_accepts", "false_escalations")]),
        figures(timing.where("group = 'overall' AND tier <> 'T3'"), "sampled", "timing", [
            (F.concat(F.lit("timing."), c("tier"), F.lit(".mean_wall_ms_per_document")), "ms/document", c("wall_ms"), c("succeeded"), c("documents") - c("succeeded")),
            (F.concat(F.lit("cost_proxy."), c("tier"), F.lit(".total")), "USD", c("cost_proxy_usd"), c("documents"), c("documents") - c("succeeded"), c("cost_proxy_usd")),
        ]),
        figures(page_timing.where("partition = 'evaluation'").crossJoin(F.broadcast(corpus.select(c("pages").alias("corpus_pages")))), "sampled", "page timing", [("timing.T3.evaluation_mean_wall_ms_per_page", "ms/page", c("total_ms"), c("numerator"), c("excluded_count"))]),
        figures(page_timing.where("partition = 'evaluation'").crossJoin(F.broadcast(corpus.select(c("pages").alias("corpus_pages")))), "projected", "page timing and corpus", [("timing.T3.projected_corpus_hours", "hours", c("total_ms") / F.when(c("numerator") > 0, c("numerator")) * c("corpus_pages") / 3_600_000, c("corpus_pages"), c("excluded_count"), c("total_ms") / F.when(c("numerator") > 0, c("numerator")) * c("corpus_pages") / 3_600_000)]),
        figures(degradation, "sampled", "judgements", [(F.concat(F.lit("oracle."), c("partition"), F.lit(".higher_tier_degradation")), "fraction of pages", c("degraded_pages"), c("pages"))]),
        figures(degradation.agg(F.sum("degraded_pages").alias("degraded_pages"), F.sum("pages").alias("pages")), "sampled", "judgements", [("oracle.all.higher_tier_degradation", "fraction of pages", c("degraded_pages"), c("pages"))]),
        figures(density, "sampled", "Thai runs", [("T2.thai_short_run_density", "short runs by Thai code point", c("numerator"), c("denominator"))]),
        texts(probes, "observed", "probes", F.concat(F.lit("provider."), c("tier"), F.lit(".identity")), F.concat_ws(" ", "provider_id", "version")),
        texts(unavailable, "unavailable", "scope", c("key"), c("reason")),
    ]
    if coverage.where("high + low + middle <> documents").limit(1).count():
        raise ReportRefused("the bands of coverage aren't all inspected documents")
    if probes.where(F.col("status") == "available").select("tier").distinct().where(F.col("tier").isin(*TIERS)).count() != len(TIERS):
        raise ReportRefused("a tier has no available provider")
    if policies.select("documents", "pages").distinct().count() > 1:
        raise ReportRefused("policies are of different documents or pages")
    out = written(reduce(DataFrame.unionByName, parts).withColumn("name", value_name(F.col("key"))).select(*COLUMNS), "report")
    # A rate of nothing is no value; its accounting still tells why.
    if (bad := unaccounted(out).limit(5).collect()):
        raise ReportRefused("; ".join(f"{r['key']}: {r['problem']}" for r in bad))
    return out
