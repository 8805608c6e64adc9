"""Extraction providers: the plug-in interface, execution rule, probes, and cells run through it."""

from __future__ import annotations

import ipaddress
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import TIERS
from ..functions.structure import canonical_json, sanitise

EXECUTIONS = ("local", "private", "hosted")


class ProviderError(RuntimeError):
    """A failed extraction with a code."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Extraction:
    """What a provider returns; provider_ms is None where the service reports no time."""

    text: str
    markdown: str | None = None
    structure: object = None
    pages: list[dict] | None = None
    provider_ms: float | None = None
    warnings: list[str] = field(default_factory=list)


class TierProvider(ABC):
    """One tier's service. Instances travel to executors, so they must pickle."""

    tier: str
    provider_id: str

    @abstractmethod
    def probe_version(self) -> str:
        """The service's version; raises if it can't be reached."""

    @abstractmethod
    def extract(self, content: bytes, language: str) -> Extraction:
        """Extract a document or a page image."""

    def parameters(self) -> dict:
        return {}

    def transport_baseline(self) -> float | None:
        """Milliseconds of a call that does nothing, where the provider has one."""
        return None


def execution_location(url: str, declared: str | None = None) -> str:
    """Loopback hosts are local, and nothing else may be; other hosts must be declared private or hosted."""
    host = (urlparse(url).hostname or "").lower()
    try:
        loopback = ipaddress.ip_address(host).is_loopback
    except ValueError:
        loopback = host == "localhost" or host.endswith(".localhost")
    if declared is not None and declared not in EXECUTIONS:
        raise ValueError("unknown execution location")
    if loopback:
        if declared not in (None, "local"):
            raise ValueError("a loopback host is local")
        return "local"
    if declared in (None, "local"):
        raise ValueError("a remote host must be declared private or hosted")
    return declared


def language_hint(stratum: str) -> str:
    return "eng+tha" if stratum.endswith("thai-mixed") else "eng"


def language_hints(stratum: Column) -> Column:
    """language_hint of a column; a missing stratum has the plain one."""
    return F.when(F.coalesce(stratum.endswith("thai-mixed"), F.lit(False)), "eng+tha").otherwise("eng")


def execution_locations(endpoints: DataFrame, url: str = "url", declared: str = "declared") -> DataFrame:
    """endpoints with execution and problem: execution_location of each row, or why there is none."""
    host = F.regexp_replace(F.lower(F.coalesce(F.parse_url(F.col(url), F.lit("HOST")), F.lit(""))), r"^\[|\]$", "")
    loopback = (host == "localhost") | host.endswith(".localhost") | host.rlike(r"^127(\.\d{1,3}){3}$") | (host == "::1")
    said = F.col(declared)
    problem = F.when(said.isNotNull() & ~said.isin(*EXECUTIONS), "unknown execution location").when(loopback & (said != "local"), "a loopback host is local").when(~loopback & (said.isNull() | (said == "local")), "a remote host must be declared private or hosted")
    return endpoints.withColumn("problem", problem).withColumn("execution", F.when(F.col("problem").isNull(), F.when(loopback, "local").otherwise(said)))


def probe(provider: TierProvider) -> dict:
    """An available or unavailable record; never raises."""
    try:
        return {"tier": provider.tier, "provider_id": provider.provider_id, "status": "available", "version": provider.probe_version(), "reason": None}
    except Exception as e:  # noqa: BLE001  (any failure means unavailable)
        return {"tier": provider.tier, "provider_id": provider.provider_id, "status": "unavailable", "version": None, "reason": str(e)[:500]}


def baseline_samples(provider: TierProvider, n: int = 5) -> list[float]:
    return [b for b in (provider.transport_baseline() for _ in range(n)) if b is not None]


def parse_seconds(value: object) -> float:
    """Milliseconds of a reported time in seconds; a missing or odd one fails closed."""
    if not isinstance(value, (int, float)) or isinstance(value, bool) or value < 0:
        raise ProviderError("PROVIDER_RESPONSE_INVALID", "no usable processing time")
    return value * 1000.0


def normalise_blocks(pages: list[dict]) -> Extraction:
    """Pages of (text, blocks) as one extraction: texts with an empty line between them, structure by page."""
    texts = [p.get("text") or "" for p in pages]
    numbered = [{"page": i + 1, "text": t, "blocks": sanitise(p.get("blocks", []))} for i, (t, p) in enumerate(zip(texts, pages, strict=True))]
    whole = "\n\n".join(texts)
    return Extraction(text=whole, markdown=whole, structure=[b for p in numbered for b in p["blocks"]], pages=numbered)


CELLS = "case_id string, tier string, provider_id string, status string, wall_ms double, provider_ms double, provider_timing_status string, text string, markdown string, structure string, pages string, error_code string, error_message string"


def run_cells(todo: DataFrame, provider: TierProvider, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """Extract each row of (case_id, stratum, content); errors become failed cells. Lazy: write the result."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                base = {"case_id": r.case_id, "tier": provider.tier, "provider_id": provider.provider_id}
                began = clock()
                try:
                    e = asdict(provider.extract(bytes(r.content), language_hint(r.stratum or "")))
                    rows.append(base | {"status": "succeeded", "wall_ms": (clock() - began) * 1000, "provider_ms": e["provider_ms"], "provider_timing_status": "unavailable" if e["provider_ms"] is None else "observed", "text": e["text"], "markdown": e["markdown"], "structure": canonical_json(sanitise(e["structure"])), "pages": None if e["pages"] is None else canonical_json(e["pages"]), "error_code": None, "error_message": None})
                except Exception as x:  # noqa: BLE001  (a cell records its failure)
                    code = getattr(x.__cause__, "code", None) or getattr(x, "code", None) or type(x).__name__.upper()
                    rows.append(base | {"status": "failed", "wall_ms": None, "provider_ms": None, "provider_timing_status": "unavailable", "text": None, "markdown": None, "structure": None, "pages": None, "error_code": code, "error_message": str(x)[:500]})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CELLS.split(", ")])

    return todo.select("case_id", "stratum", "content").mapInPandas(run, CELLS)


def unavailable_cells(todo: DataFrame, probed: dict) -> DataFrame:
    """Cells of a provider that a probe couldn't reach."""
    return todo.select("case_id", F.lit(probed["tier"]).alias("tier"), F.lit(probed["provider_id"]).alias("provider_id"), F.lit("unavailable").alias("status"), F.lit("PROVIDER_UNAVAILABLE").alias("error_code"), F.lit(probed["reason"]).alias("error_message"))


def attempts_by_tier(cases: DataFrame, providers: DataFrame) -> DataFrame:
    """(case_id, tier, provider_id, status): each case's tiers (case_id, tiers) with the provider that a probe found for the tier
    (tier, provider_id, status); `unprobed` where none did. Raises if a tier has two providers. As many rows as tiers."""
    if providers.groupBy("tier").count().where("count > 1").limit(1).count():
        raise ValueError("a tier has two providers")
    asked = cases.select("case_id", F.explode(F.array_distinct("tiers")).alias("tier"))
    return asked.join(F.broadcast(providers.where(F.col("tier").isin(*TIERS)).select("tier", "provider_id", "status")), "tier", "left").select("case_id", "tier", "provider_id", F.coalesce("status", F.lit("unprobed")).alias("status"))


def combine_pages(page_artifacts: DataFrame) -> DataFrame:
    """One artifact by case from its sampled pages (case_id, page, cache_key, text, wall_ms): texts in page order
    with an empty line between, summed time, and a key over the pages' keys."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "cache_key", "text")))
    rows = page_artifacts.groupBy("case_id").agg(ordered.alias("p"), F.sum("wall_ms").alias("wall_ms"), F.count("*").alias("page_count"))
    return rows.select("case_id", F.sha2(F.array_join("p.cache_key", ":"), 256).alias("artifact_key"), F.array_join("p.text", "\n\n").alias("text"), F.col("p.text").alias("pages"), "wall_ms", "page_count")
