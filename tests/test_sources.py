"""Readers, writers, the artifact store, providers, plans and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from tierscope import manifest
from tierscope.operators import gate, signals
from tierscope.plans import analysis
from tierscope.sources import artifacts, files, images, providers
from tierscope.streaming import runlog


def test_cells_by_name(spark, tmp_path):
    cell = {"caseId": "F129", "tier": "T3", "status": "censored", "startedAt": "2026-08-05T10:00:00+07:00", "finishedAt": "2026-08-05T03:30:00Z", "observedMinimumWallMs": 1461000, "cache": {"hit": False}}
    (tmp_path / "calibration-F129-T3.json").write_text(json.dumps(cell))
    (tmp_path / "evaluation-F002-P0020-T3.json").write_text(json.dumps(cell | {"status": "succeeded", "wallMs": 5}))
    got = {r["partition"]: r for r in files.read_cells(spark, str(tmp_path)).collect()}
    assert (got["calibration"]["case_id"], got["calibration"]["page"], got["calibration"]["started_at"].hour) == ("F129", None, 3)
    assert (got["evaluation"]["page"], got["evaluation"]["wall_ms"]) == (20, 5.0)
    (tmp_path / "stray.json").write_text(json.dumps(cell))
    with pytest.raises(Exception, match="not a run cell"):
        files.read_cells(spark, str(tmp_path)).collect()


def test_json_and_blobs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    assert files.read_json_lines(spark, str(tmp_path / "a.jsonl"), "x int").count() == 2
    (tmp_path / "b.jsonl").write_text("{bad\n")
    with pytest.raises(Exception):
        files.read_json_lines(spark, str(tmp_path / "b.jsonl"), "x int").collect()
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    assert files.read_blobs(spark, str(tmp_path)).first()["length"] == 4


def test_guards():
    assert files.statement_kind(" SELECT 1") == "select"
    for bad in ("DELETE FROM x", "", "42"):
        with pytest.raises(ValueError):
            files.statement_kind(bad)
    assert files.safe_path("/a/", "b/c") == "/a/b/c"
    for bad in ("/etc", "../x", "a/../../b"):
        with pytest.raises(ValueError):
            files.safe_path("/a", bad)
    assert files.checked_option("run", "v1.0-a_b") == "v1.0-a_b"
    with pytest.raises(ValueError):
        files.checked_option("run", "../x")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\nc'), (2, None)], "k int, v string")
    path = str(tmp_path / "t")
    assert files.write_once(df, path) and not files.write_once(df.orderBy(F.desc("k")), path)
    with pytest.raises(ValueError):
        files.write_once(df.limit(1), path)
    with pytest.raises(Exception):
        files.write_new(df, path)
    files.write_pending(df.limit(1), path)
    assert spark.read.parquet(path).count() == 2
    files.write_csv(df, str(tmp_path / "c"))
    assert '"a,""b""' in "".join(p.read_text() for p in (tmp_path / "c").glob("part-*"))


def test_artifact_store(spark, tmp_path):
    store = artifacts.ArtifactStore(spark, str(tmp_path / "cas"))
    rows = spark.createDataFrame([("ab12", "one", '{"x":1}'), ("cd34", "two", '{"x":2}')], "cache_key string, case_id string, payload string")
    assert store.get(rows).where("hit").count() == 0
    assert store.put(rows) == 2 and store.put(rows) == 0
    alias = store.get(spark.createDataFrame([("ab12", "other"), ("ee", "none")], "cache_key string, case_id string")).orderBy("cache_key").collect()
    assert (alias[0]["case_id"], alias[0]["payload"], alias[0]["hit"], alias[1]["hit"]) == ("other", '{"x":1}', True, False)
    with pytest.raises(artifacts.ConflictingArtifact):
        store.put(rows.withColumn("payload", F.lit("{}")))
    assert store.verify().count() == 0
    spark.createDataFrame([("ab99", "x", "{}", "0" * 64, "ab")], "cache_key string, case_id string, payload string, payload_hash string, bucket string").write.mode("append").partitionBy("bucket").parquet(store.path)
    assert store.verify().count() == 1
    with pytest.raises(Exception, match="corrupt"):
        store.get(spark.createDataFrame([("ab99", "x")], "cache_key string, case_id string")).collect()


class Echo(providers.TierProvider):
    tier, provider_id = "T1", "echo"

    def probe_version(self):
        raise ConnectionError("refused")

    def extract(self, content, language):
        if content == b"bad":
            raise providers.ProviderError("PROVIDER_HTTP_500", "broken")
        return providers.Extraction(text=f"{content.decode()} {language}", structure={"url": "u", "text": "t"}, provider_ms=providers.parse_seconds(0.5))


def test_locations_of_columns(spark):
    rows = [(u, d) for u in ("http://127.0.0.1:9/x", "http://LOCALHOST", "https://x.example", "http://[::1]:80/", "https://a.localhost/y", "https://128.0.0.1", "odd") for d in (None, "local", "private", "hosted", "other")]
    got = {(r["url"], r["declared"]): (r["execution"], r["problem"]) for r in providers.execution_locations(spark.createDataFrame(rows, "url string, declared string")).collect()}
    for url, declared in rows:
        try:
            assert got[url, declared] == (providers.execution_location(url, declared), None)
        except ValueError as e:
            assert got[url, declared] == (None, str(e))
    hints = spark.createDataFrame([("scanned-degraded-thai-mixed",), ("born-digital-en",), (None,)], "s string").select(providers.language_hints(F.col("s")).alias("h"))
    assert [r["h"] for r in hints.collect()] == ["eng+tha", "eng", "eng"]


def test_providers(spark):
    assert providers.execution_location("http://127.0.0.1:9/x") == providers.execution_location("http://localhost") == "local"
    assert providers.execution_location("https://x.example", "private") == "private"
    for url, how in (("https://x.example", None), ("https://x.example", "local"), ("http://127.0.0.1", "hosted"), ("https://x.example", "odd")):
        with pytest.raises(ValueError):
            providers.execution_location(url, how)
    for bad in (None, "1", -1, True):
        with pytest.raises(providers.ProviderError):
            providers.parse_seconds(bad)
    todo = spark.createDataFrame([("a", "scanned-degraded-thai-mixed", bytearray(b"hi")), ("b", "born-digital-en", bytearray(b"bad"))], "case_id string, stratum string, content binary")
    got = {r["case_id"]: r for r in providers.run_cells(todo, Echo()).collect()}
    assert (got["a"]["text"], got["a"]["provider_ms"], got["a"]["structure"]) == ("hi eng+tha", 500.0, '{"text":"t"}')
    assert (got["b"]["status"], got["b"]["error_code"]) == ("failed", "PROVIDER_HTTP_500")
    probed = providers.probe(Echo())
    assert probed["status"] == "unavailable" and providers.unavailable_cells(todo, probed).first()["error_message"] == "refused"
    assert providers.baseline_samples(Echo()) == []
    e = providers.normalise_blocks([{"text": "a", "blocks": [{"path": "p", "k": 1}]}, {"text": None}])
    assert (e.text, e.structure, e.pages[1]["page"]) == ("a\n\n", [{"k": 1}], 2)
    pages = spark.createDataFrame([("c", 2, "k2", "two", 5.0), ("c", 1, "k1", "one", 7.0)], "case_id string, page int, cache_key string, text string, wall_ms double")
    r = providers.combine_pages(pages).first()
    assert (r["text"], r["wall_ms"], r["pages"]) == ("one\n\ntwo", 12.0, ["one", "two"])


def test_image_area(spark):
    view = (0.0, 0.0, 100.0, 100.0)
    half = [["save"], ["transform", 100, 0, 0, 50, 0, 0], ["image"], ["restore"]]
    assert images.image_area_ratio(half, view) == 0.5
    assert images.image_area_ratio(half * 3, view) == 1.0, "overlaps are summed, the sum is capped"
    assert images.image_area_ratio([["transform", 100, 0, 0, 100, 90, 90], ["image"]], view) == pytest.approx(0.01)
    assert images.image_area_ratio([["transform", 0, 10, -10, 0, 50, 50], ["image"]], view) == pytest.approx(0.01)
    assert images.image_area_ratio([["image"]], (0, 0, 0, 0)) == 0.0
    form = [["form", [100, 0, 0, 50, 0, 0]], ["image"], ["form_end"], ["transform", 10, 0, 0, 10, 0, 0], ["image"], ["form", None], ["image"], ["form_end"]]
    assert images.image_areas(form, view) == (pytest.approx(0.52), [])
    assert images.image_areas([["image_repeat", 10, 10, [0, 0, 50, 50, 7]], ["mask_repeat", 10, 0, 0, 20, [5, 5]], ["image_group", [[10, 0, 0, 10, 0, 0], None, [20, 0, 0, 10, 0, 0]]]], view) == (pytest.approx(0.07), ["INVALID_IMAGE_GROUP"])
    assert images.image_areas([["image_repeat", "x", 1, [0, 0]], ["mask_repeat", 1, 1], ["transform", 1]], view) == (0.0, ["INVALID_IMAGE_REPEAT", "INVALID_IMAGE_MASK_REPEAT", "INVALID_IMAGE_TRANSFORM"])
    df = spark.createDataFrame([(json.dumps(half), 100.0, 100.0), (None, 1.0, 1.0)], "o string, w double, h double")
    assert [r["r"] for r in df.select(images.image_ratio("o", "w", "h").alias("r")).collect()][0] == 0.5


def test_policy_plan(spark):
    evidence = spark.createDataFrame([("a", 1, "word " * 40, 0.0), ("b", 1, "x", 0.9)], "case_id string, page int, text string, image_area_ratio double")
    found = signals.document_signals(signals.inspect_pages(evidence))
    rows = [(c, t, f"{c}{t}", "word " * 40 if t != "T0" or c == "a" else "x", ["word " * 40], t != "T0") for c in "ab" for t in ("T0", "T1", "T2", "T3")]
    arts = spark.createDataFrame(rows, "case_id string, tier string, artifact_key string, text string, pages array<string>, has_structure boolean")
    cells = arts.select("case_id", "tier", F.lit("succeeded").alias("status"), F.lit(10.0).alias("wall_ms"))
    judged = spark.createDataFrame([("a", 1, ["T0"], ["T0"]), ("b", 1, ["T2"], ["T2"])], "case_id string, page int, usable_tiers array<string>, structurally_adequate_tiers array<string>")
    got = {r["policy"]: r for r in analysis.analyse_policies(found, arts, cells, judged).collect()}
    assert got["gated"]["selected_t0"] == 1 and got["gated"]["selected_t2"] == 1 and got["gated"]["reading_false_accepts"] == 0
    assert got["allT0"]["reading_false_accepts"] == 1
    inspections = found.select("case_id", "total_text_chars", "page_count", "thai_char_ratio", "latin_char_ratio", F.lit(True).alias("expects_structure"))
    examples = analysis.gate_examples(arts, inspections, judged)
    assert examples.count() == 8 and set(gate.COMPONENTS) < set(examples.columns)


def test_sample_plan(spark):
    texts = {"born-digital-en": "plain text words " * 5, "layout-heavy-born-digital": None, "scanned-degraded-en": "x", "scanned-degraded-thai-mixed": "กขค"}
    pages = []
    for s, t in texts.items():
        for i in range(6):
            first, second = (t, t) if t else ("tiny words here that are at least 32 chars", "long " * 200)
            pages += [(f"{s}-{i}", 1, first, 0.0), (f"{s}-{i}", 2, second, 0.0)]
    evidence = spark.createDataFrame(pages, "case_id string, page int, text string, image_area_ratio double")
    got = analysis.draw_sample(evidence, "seed").collect()
    assert len(got) == 24 and all((r["pages"] == [1, 2]) == (r["partition"] == "evaluation") and r["case_id"].startswith(r["stratum"]) for r in got)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = {"case_id": "a", "tier": "T0", "page": 1, "status": "succeeded", "started_at": "2026-08-05T10:00:00Z"}
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, [line, line, line | {"page": 2, "status": "failed"}])))
    cells = runlog.cell_stream(spark, str(tmp_path / "in"), "case_id string, tier string, page int, status string, started_at timestamp")
    query = runlog.status_stream(cells).writeStream.outputMode("complete").format("memory").queryName("runlog_counts").trigger(availableNow=True).start()
    query.awaitTermination(60)
    r = spark.table("runlog_counts").first()
    assert (r["succeeded"], r["failed"]) == (1, 1)


def test_manifest():
    m = manifest.capture(run=lambda c: None)
    assert m["commit"] is None and m["dirty"] is None and m["spark"] and m["processors"]


def test_stored_files_are_fetched_checked_and_cached(spark, tmp_path):
    import hashlib

    (tmp_path / "up/sub").mkdir(parents=True)
    (tmp_path / "up/sub/a.pdf").write_bytes(b"first")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = [("a", None, "sub/a.pdf", None), ("b", None, "sub/a.pdf", sha(b"other")), ("c", None, "../x", None), ("d", None, "gone", None), ("e", "http://x/ok", "", sha(b"web").upper()), ("f", "https://x/missing", "", None)]
    stored = spark.createDataFrame(rows, "case_id string, storage_url string, storage_path string, file_hash string")

    def get(url):
        if url.endswith("ok"):
            return b"web"
        raise files.StorageError("STORAGE_HTTP_404")

    got = {r["case_id"]: r for r in files.read_stored(stored, str(tmp_path / "up"), get).collect()}
    assert {k: r["error_code"] for k, r in got.items()} == {"a": None, "b": "STORAGE_HASH_MISMATCH", "c": "STORAGE_PATH_OUTSIDE_FOLDER", "d": "STORAGE_NOT_FOUND", "e": None, "f": "STORAGE_HTTP_404"}
    assert bytes(got["a"]["content"]) == b"first" and got["e"]["content_hash"] == sha(b"web") and got["b"]["content"] is None
    some = stored.where("case_id IN ('a', 'e')")
    cache = str(tmp_path / "cache")
    assert files.read_or_cache(some, str(tmp_path / "up"), cache, get).where("error_code IS NULL").count() == 2
    (tmp_path / "up/sub/a.pdf").write_bytes(b"second")
    kept = {r["case_id"]: bytes(r["content"]) for r in files.read_or_cache(some, str(tmp_path / "up"), cache, get).collect()}
    assert kept == {"a": b"first", "e": b"web"}, "without a hash the cached copy stays"
    # Why a file can't be had is told; what is read is read once; of two copies without a hash the same one is always used.
    asked = []
    counted = lambda url: (asked.append(url), get(url))[1]
    told = {r["case_id"]: r["error_code"] for r in files.read_or_cache(stored, str(tmp_path / "up"), cache, counted).collect()}
    assert told == {"a": None, "b": "STORAGE_HASH_MISMATCH", "c": "STORAGE_PATH_OUTSIDE_FOLDER", "d": "STORAGE_NOT_FOUND", "e": None, "f": "STORAGE_HTTP_404"}
    spark.createDataFrame([("a", bytearray(b"other"), sha(b"other"))], "case_id string, content binary, content_hash string").write.mode("append").parquet(cache)
    least = min((b"first", b"other"), key=sha)
    assert bytes(files.read_or_cache(stored.where("case_id = 'a'"), str(tmp_path / "up"), cache, get).first()["content"]) == least
    fresh = spark.createDataFrame([("a", None, "sub/a.pdf", sha(b"second"))], stored.schema)
    assert bytes(files.read_or_cache(fresh, str(tmp_path / "up"), cache, get).first()["content"]) == b"second"


def test_declarations_come_with_their_hash(spark, tmp_path):
    path = str(tmp_path / "declared")
    digest = files.write_pair(spark, '{"status": "frozen", "pages": 2}', path)
    assert len(digest) == 64 and files.read_pair(spark, path)["pages"] == 2
    with pytest.raises(Exception, match="exist"):
        files.write_pair(spark, "{}", path)
    spark.createDataFrame([('{"status": "frozen"}',)], "value string").write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError, match="manifest"):
        files.read_pair(spark, path)
    checks = spark.createDataFrame([("a", "x", digest), ("b", "x", None)], "name string, content string, sha256 string")
    assert [r["passed"] for r in files.verify_hashes(checks).orderBy("name").collect()] == [False, False]


def test_frozen_rules():
    from tierscope.operators import oracle

    rule = {"fields": ["a", "b"], "rule": "r", "basis": "x"}
    assert oracle.holds_frozen({"a": 1.0, "b": 2}, {"a": 1, "b": 2}) and not oracle.holds_frozen({"b": 2, "a": 1}, {"a": 1, "b": 2})
    assert oracle.declares_derivation(rule | {"appliedAt": "2026-08-05"}, rule)
    for bad in (None, rule, rule | {"appliedAt": "2026-8-5"}, rule | {"appliedAt": "2026-08-05\n"}, rule | {"appliedAt": "2026-08-05", "basis": "y"}, rule | {"appliedAt": "2026-08-05", "fields": ["b", "a"]}):
        assert not oracle.declares_derivation(bad, rule)
