"""Domain views over the driver's tables, deterministic and alike in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.core import TIERS
from .operators.signals import document_signals, inspect_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts, over as many partitions as there are cores: a small one is a single row group."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each line of a document, with a made-up image ratio, missing in every 13th document."""
    rows = texts(spark, sf_dir).select(F.col("doc_id").alias("case_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "text"))
    rows = rows.withColumn("page", (F.col("pos") + 1).cast("long"))
    return rows.select("case_id", "page", "text", F.when(F.col("case_id") % 13 != 0, ((F.col("case_id") * 7 + F.col("page") * 3) % 11) / 10.0).alias("image_area_ratio"))


PAGE_EVIDENCE = """page_evidence AS (SELECT doc_id AS case_id, i AS page, lines[i] AS text,
  CASE WHEN doc_id % 13 <> 0 THEN ((doc_id * 7 + i * 3) % 11) / 10.0::DOUBLE END AS image_area_ratio
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)))"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_signals(inspect_pages(page_evidence(spark, sf_dir)))


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '{pattern}'))"


_SPACE = r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_ODD = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{E000}-\x{F8FF}\x{FFFD}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"
PAGES = PAGE_EVIDENCE + f""", pages AS (SELECT case_id, page, length(t) - {_n(_SPACE)} AS text_chars, {_n(_ODD)} AS anomalous_chars,
  {_n(r'\p{L}')} AS letter_chars, {_n(r'[\x{0E01}-\x{0E30}\x{0E32}\x{0E33}\x{0E40}-\x{0E46}]')} AS thai_chars, {_n(r'\p{Latin}')} AS latin_chars, image_area_ratio
  FROM (SELECT *, nfc_normalize(text) AS t FROM page_evidence))"""
SIGNALS = PAGES + """, sums AS (SELECT case_id, count(*) AS page_count, sum(text_chars) AS total_text_chars, avg(text_chars) AS chars_per_page,
  count(*) FILTER (text_chars >= 32) / count(*) AS text_layer_coverage, stddev_pop(text_chars) AS sd,
  CASE WHEN bool_and(image_area_ratio IS NOT NULL) THEN sum(image_area_ratio) / count(*) END AS mean_image_area_ratio,
  CASE WHEN bool_and(image_area_ratio IS NOT NULL) THEN count(*) FILTER (image_area_ratio >= 0.8) / count(*) END AS full_page_image_ratio,
  sum(anomalous_chars) AS odd, sum(letter_chars) AS letters, sum(thai_chars) AS thai, sum(latin_chars) AS latin FROM pages GROUP BY 1),
signals AS (SELECT case_id, page_count, total_text_chars, chars_per_page, text_layer_coverage, CASE WHEN chars_per_page = 0 THEN 0 ELSE sd / chars_per_page END AS chars_per_page_cv,
  mean_image_area_ratio, full_page_image_ratio, odd / greatest(1, total_text_chars) AS encoding_anomaly_ratio,
  CASE WHEN letters = 0 THEN 0 ELSE thai / letters END AS thai_char_ratio, CASE WHEN letters = 0 THEN 0 ELSE latin / letters END AS latin_char_ratio,
  CASE WHEN letters = 0 THEN false ELSE thai / letters >= 0.1 AND latin / letters >= 0.1 END AS mixed_script FROM sums)"""
STRATA_SQL = SIGNALS + """, strata AS (SELECT *, CASE WHEN degraded AND (thai_char_ratio >= 0.1 OR mixed_script) THEN 'scanned-degraded-thai-mixed' WHEN degraded THEN 'scanned-degraded-en'
  WHEN coalesce(mean_image_area_ratio, 0) >= 0.2 OR chars_per_page_cv >= 0.75 THEN 'layout-heavy-born-digital' ELSE 'born-digital-en' END AS stratum
  FROM (SELECT *, text_layer_coverage < 0.5 OR coalesce(full_page_image_ratio, 0) >= 0.5 OR encoding_anomaly_ratio >= 0.02 AS degraded FROM signals))"""


def tier_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four made-up extractions of each document: unpaged, plain, with stray characters and long runs, cut off."""
    docs = texts(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    rows = docs.select("doc_id", "t", F.explode(F.array(*map(F.lit, TIERS))).alias("tier"))
    odd = F.concat("t", F.repeat(F.lit("�"), (F.col("doc_id") % 5).cast("int")), F.repeat(F.lit("."), (F.col("doc_id") % 20).cast("int")), F.lit("กิ"), F.repeat(F.lit("é"), (F.col("doc_id") % 15).cast("int")))
    cut = F.substr("t", F.lit(1), F.floor(F.length("t") / (1 + F.col("doc_id") % 3)).cast("int"))
    text = F.when(F.col("tier") == "T0", F.translate("t", "\n", " ")).when(F.col("tier") == "T1", F.col("t")).when(F.col("tier") == "T2", odd).otherwise(cut)
    out = rows.select("doc_id", "tier", text.alias("text"))
    return out.withColumns({
        "case_id": F.col("doc_id"),
        "artifact_key": F.concat_ws(":", F.col("doc_id").cast("string"), "tier"),
        "pages": F.when(F.col("tier") != "T0", F.split("text", "\n", -1)),
        "has_structure": F.col("tier") != "T0",
    })


TIER_ARTIFACTS = """artifacts AS (SELECT doc_id AS case_id, tier, doc_id || ':' || tier AS artifact_key, tier <> 'T0' AS has_structure, CASE tier WHEN 'T0' THEN replace(t, chr(10), ' ') WHEN 'T1' THEN t
  WHEN 'T2' THEN t || repeat('�', (doc_id % 5)::INT) || repeat('.', (doc_id % 20)::INT) || 'กิ' || repeat('é', (doc_id % 15)::INT)
  ELSE substr(t, 1, floor(length(t) / (1 + doc_id % 3))::INT) END AS text FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), (VALUES ('T0'), ('T1'), ('T2'), ('T3')) AS v(tier))"""


def oracle_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged tiers by labelled document (one page each) from its labels and id."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    pick = lambda label, f: F.array_compact(F.array(*(F.when((F.col(label) == (1 if label == "quality" else 0)) & f(i), t) for i, t in enumerate(TIERS))))
    return rows.select(F.col("doc_id").alias("case_id"), F.lit(1).alias("page"), pick("quality", lambda i: (F.col("doc_id") + i) % 3 != 0).alias("usable_tiers"), pick("toxic", lambda i: (F.col("doc_id") + 2 * i) % 4 != 0).alias("structurally_adequate_tiers"))


ORACLE_PAGES = """oracle_pages AS (SELECT doc_id AS case_id, 1 AS page,
  list_transform(list_filter([0, 1, 2, 3], lambda i: quality = 1 AND (doc_id + i) % 3 <> 0), lambda i: 'T' || i) AS usable_tiers,
  list_transform(list_filter([0, 1, 2, 3], lambda i: toxic = 0 AND (doc_id + 2 * i) % 4 <> 0), lambda i: 'T' || i) AS structurally_adequate_tiers FROM labels)"""


def run_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run cell for each event."""
    return cells_of(table(spark, sf_dir, "events"))


def cells_of(e: DataFrame) -> DataFrame:
    """Run cells of events, of a table or a stream."""
    i = F.col("event_id")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "unavailable").when((F.col("event_type") == "view") & (i % 7 == 0), "censored").otherwise("succeeded")
    return e.select(
        F.col("user_id").alias("case_id"), i.alias("page"), F.concat(F.lit("T"), (i % 4).cast("string")).alias("tier"), F.when(F.col("user_id") % 3 == 0, "calibration").otherwise("evaluation").alias("partition"),
        F.element_at(F.array(*map(F.lit, ("born-digital-en", "layout-heavy-born-digital", "scanned-degraded-en", "scanned-degraded-thai-mixed"))), (F.col("user_id") % 4 + 1).cast("int")).alias("stratum"),
        (F.col("user_id") % 9 + 1).alias("page_count"), status.alias("status"), (i % 11 != 0).alias("has_artifact"), F.col("value").alias("wall_ms"), F.concat(F.lit("p"), (i % 2).cast("string")).alias("provider_id"),
        F.when(i % 3 == 0, F.col("value") / 2).alias("provider_ms"), F.when(i % 3 == 0, "observed").otherwise("unavailable").alias("provider_timing_status"), (i % 5 == 0).alias("cache_hit"), F.when(status == "censored", F.col("value")).alias("observed_minimum_wall_ms"), F.col("ts").cast("timestamp").alias("started_at"))


RUN_CELLS = """cells AS (SELECT user_id AS case_id, event_id AS page, 'T' || (event_id % 4) AS tier, CASE WHEN user_id % 3 = 0 THEN 'calibration' ELSE 'evaluation' END AS partition,
  ['born-digital-en', 'layout-heavy-born-digital', 'scanned-degraded-en', 'scanned-degraded-thai-mixed'][user_id % 4 + 1] AS stratum, user_id % 9 + 1 AS page_count,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'unavailable' WHEN event_type = 'view' AND event_id % 7 = 0 THEN 'censored' ELSE 'succeeded' END AS status,
  event_id % 11 <> 0 AS has_artifact, value AS wall_ms, 'p' || (event_id % 2) AS provider_id, CASE WHEN event_id % 3 = 0 THEN value / 2 END AS provider_ms,
  CASE WHEN event_id % 3 = 0 THEN 'observed' ELSE 'unavailable' END AS provider_timing_status, event_id % 5 = 0 AS cache_hit,
  CASE WHEN event_type = 'view' AND event_id % 7 = 0 THEN value END AS observed_minimum_wall_ms FROM events)"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as elements; tokens are words between single spaces."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("turn").alias("reading_order"), F.lit(0).alias("pos"), "role", F.coalesce("text", F.lit("")).alias("text"), F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " ", -1), lambda x: x != "")).cast("long").alias("tokens"))


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An opportunity between turns that follow one another: a break where the role changes, else a join."""
    a = elements(spark, sf_dir).select("doc_id", F.col("id").alias("before_element_id"), (F.col("reading_order") + 1).alias("n"), F.col("role").alias("r"))
    b = elements(spark, sf_dir).select("doc_id", F.col("id").alias("after_element_id"), F.col("reading_order").alias("n"), "role")
    return a.join(b, ["doc_id", "n"]).select("doc_id", F.when(F.col("r") != F.col("role"), "break").otherwise("join").alias("expected_action"), "before_element_id", "after_element_id")


ELEMENTS = """elements AS (SELECT conv_id AS doc_id, conv_id || ':' || turn AS id, turn AS reading_order, role, coalesce(text, '') AS text, len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')) AS tokens FROM conversations),
boundaries AS (SELECT a.doc_id, CASE WHEN a.role <> b.role THEN 'break' ELSE 'join' END AS expected_action, a.id AS before_id, b.id AS after_id FROM elements a JOIN elements b ON a.doc_id = b.doc_id AND b.reading_order = a.reading_order + 1)"""


def replay_gates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(initial, artifacts): made-up gate results by document and tier; every 17th document fails T0, T1 and T2
    so that it uses its escalations up."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id")).distinct()
    forced = F.col("case_id") % 17 == 5
    initial = docs.withColumn("initial_tier", F.when(forced, "T0").otherwise(F.concat(F.lit("T"), (F.col("case_id") % 3).cast("string"))))
    rows = docs.withColumn("i", F.explode(F.array(*map(F.lit, range(4))))).where("NOT (i = 3 AND case_id % 11 = 0)")
    passed = ~forced & ((F.col("case_id") * 31 + F.col("i") * 17) % 5 < 2)
    why = F.when(passed, F.array().cast("array<string>")).when(F.when(forced, F.col("i") > 0).otherwise((F.col("case_id") + F.col("i")) % 2 == 0), F.array(F.lit("TEXT_RETENTION_FAILED"))).otherwise(F.array(F.lit("STRUCTURAL_YIELD_FAILED")))
    tier = F.concat(F.lit("T"), F.col("i").cast("string"))
    return initial, rows.select("case_id", tier.alias("tier"), F.concat_ws(":", F.col("case_id").cast("string"), tier).alias("artifact_key"), passed.alias("passed"), why.alias("reasons"))


REPLAY_GATES = """ids AS (SELECT DISTINCT doc_id AS case_id, CASE WHEN doc_id % 17 = 5 THEN 0 ELSE doc_id % 3 END AS initial FROM documents),
gates AS (SELECT case_id, i, case_id % 17 <> 5 AND (case_id * 31 + i * 17) % 5 < 2 AS passed, CASE WHEN case_id % 17 = 5 THEN i > 0 ELSE (case_id + i) % 2 = 0 END AS text_failure
  FROM ids, (VALUES (0), (1), (2), (3)) AS v(i) WHERE NOT (i = 3 AND case_id % 11 = 0))"""
