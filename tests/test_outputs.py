"""Ordered outputs with one root, corpus runs, page declarations, and writers that meet."""

import hashlib
import json
import threading

import pytest
from pyspark.sql import functions as F

from tierscope.plans import corpus_run, declaration
from tierscope.sources import artifacts, claims, files, lines, providers


def root_of(texts, block):
    level = texts
    while True:
        level = [hashlib.sha256("\n".join(level[i : i + block]).encode()).hexdigest() for i in range(0, len(level), block)] or [hashlib.sha256(b"").hexdigest()]
        if len(level) == 1:
            return level[0]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 500])
def test_root_is_of_the_rows_alone(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(lines, "BLOCK", 7)
    rows = [(i * 37 % 101, f"é {i}", None if i % 3 else i) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, v string, w int")
    want = [json.dumps(dict(zip("kvw", r)), ensure_ascii=False, separators=(",", ":")) for r in rows]
    want = [t for _, t in sorted((json.loads(t)["k"], t) for t in want)]
    roots = {lines.tree_root(lines.placed_lines(df.repartition(p), ["k"])) for p in (1, 3, 8)}
    assert roots == {(n, root_of(want, 7))}
    out = lines.write_lines(df.repartition(5), str(tmp_path / "out"), ["k"])
    assert (out.rows, out.root) == (n, root_of(want, 7))
    files = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    assert [x for p in files for x in p.read_text().splitlines()] == want, "files and lines in order"
    assert lines.verify_lines(df, str(tmp_path / "out"), ["k"]) and not lines.verify_lines(df.union(df.limit(1) if n else spark.createDataFrame([(1, "", 1)], df.schema)), str(tmp_path / "out"), ["k"])
    with pytest.raises(Exception, match="exist"):
        lines.write_lines(df, str(tmp_path / "out"), ["k"])


def run_tables(spark):
    records = spark.createDataFrame([("F1", "included", 3), ("F2", "excluded", None), ("F3", "unreadable", None), ("F4", "included", 4)], "case_id string, status string, page_count int")
    inspections = spark.createDataFrame([("F1", 3), ("F4", 4)], "case_id string, page_count int")
    sources = spark.createDataFrame([(f"F{i}", f"k{i}", i, i, "f", "p", None, "n", "o") for i in (1, 2, 3, 4)], "case_id string, source_key string, document_id int, version_id int, field_path string, storage_path string, storage_url string, filename string, original_filename string")
    return records, inspections, sources


def test_corpus_run(spark, tmp_path):
    records, inspections, sources = run_tables(spark)
    summary, outputs = corpus_run.corpus_outputs(records, inspections, sources, str(tmp_path / "run"), "r1", "2026-08-05T00:00:00Z", documents=2, expected=4)
    assert summary["counts"] == {"documents": 2, "attachments": 4, "included": 2, "excluded": 1, "unreadable": 1, "inspected": 2, "inspected_pages": 7}
    assert summary["expected"] == {"pdfs": 4, "difference": -1} and summary["output_roots"] == {k: o.root for k, o in outputs.items()}
    assert sorted(p.name for p in (tmp_path / "run").iterdir() if not p.name.endswith(".manifest")) == ["corpus.jsonl", "inspection.jsonl", "source-map.jsonl", "summary.json"]
    assert lines.verify_lines(records.repartition(3), str(tmp_path / "run/corpus.jsonl"), ["case_id"])
    assert json.loads("\n".join(r["value"] for r in spark.read.text(str(tmp_path / "run/summary.json")).collect())) == summary
    for bad in ((records.union(records.limit(1)), inspections, sources), (records, inspections.withColumn("case_id", F.concat("case_id", F.lit("x"))), sources), (records, inspections, sources.where("case_id <> 'F2'"))):
        with pytest.raises(ValueError):
            corpus_run.corpus_outputs(*bad, str(tmp_path / "other"), "r", "t", 1)


def declared(spark, names=(), **changes):
    cases = spark.createDataFrame([("calibration", "F1", "scanned-degraded-en", 4, 100.0, None), ("evaluation", "F2", "scanned-degraded-en", 4, 100.0, [2, 3])], "partition string, case_id string, stratum string, page_count int, chars_per_page double, pages array<int>")
    pages = spark.createDataFrame([(c, i, t, a, 0) for c in ("F1", "F2") for i, (t, a) in enumerate(((100, 0.0), (5, 0.9), (100, 0.1), (400, 0.0)), 1)], "case_id string, page int, text_chars long, image_area_ratio double, warnings int")
    given = {"sample": {"config_hash": "c", "inspection_hash": "i", "seed": "s"}, "policy": {"status": "frozen", "evaluation_cells": 0, "opened_cases": [], "sample_hash": "m", "config_hash": "c"}, "config_hash": "c", "inspection_hash": "i", "sample_hash": "m", "policy_hash": "p", "seed": "s", "declared_at": "2026-08-05"}
    cells = spark.createDataFrame([(n,) for n in names], "name string")
    return declaration.declare_evaluation(changes.pop("cases", cases), pages, cells, **(given | changes))


def test_page_declaration(spark, tmp_path):
    d = declared(spark, ["calibration-F1-T3.json", "evaluation.md"])
    assert d["cases"][1] == {"partition": "evaluation", "caseId": "F2", "stratum": "scanned-degraded-en", "documentPageCount": 4, "pages": [2, 3]}
    assert d["denominators"]["all/all"] == {"documents": 2, "pages": 4} and d["denominators"]["evaluation/scanned-degraded-en"] == {"documents": 1, "pages": 2}
    assert set(d["provenance"]) == {"configHash", "inspectionHash", "sampleHash", "policyHash", "pagesHash"}
    assert declaration.expected_cells(d) == [f"{p}-P000{n}-T3.json" for p in ("calibration-F1", "evaluation-F2") for n in (2, 3)]
    with pytest.raises(declaration.DeclarationRefused, match="counts"):
        declaration.expected_cells(d | {"cases": d["cases"][:1]})
    assert len(declaration.freeze(d, spark, str(tmp_path / "d"))) == 64


def test_refused_declarations(spark):
    with pytest.raises(declaration.DeclarationRefused, match="open already: evaluation-F2-T0.json"):
        declared(spark, ["evaluation-F2-T0.json"])
    policy = {"status": "frozen", "evaluation_cells": 0, "opened_cases": [], "sample_hash": "m", "config_hash": "c"}
    sample = {"config_hash": "c", "inspection_hash": "i", "seed": "s"}
    for bad in ({"policy": policy | {"status": "draft"}}, {"policy": policy | {"evaluation_cells": 1}}, {"policy": policy | {"opened_cases": ["F2"]}}, {"policy": policy | {"sample_hash": "x"}}, {"policy": policy | {"config_hash": "x"}}, {"sample": sample | {"inspection_hash": "x"}}, {"sample": sample | {"seed": "x"}}, {"pages_each": 3}):
        with pytest.raises(declaration.DeclarationRefused):
            declared(spark, **bad)
    other = spark.createDataFrame([("evaluation", "F2", "scanned-degraded-en", 4, 100.0, [1, 3])], "partition string, case_id string, stratum string, page_count int, chars_per_page double, pages array<int>")
    with pytest.raises(ValueError, match="frozen"):
        declared(spark, cases=other)


def test_writers_of_one_key_meet(spark, tmp_path):
    """Two writers put the same new keys at once: one row a key, and of two payloads one is refused."""
    schema = "cache_key string, case_id string, payload string"
    for payloads, conflicts in ((("{}", "{}"), 0), (('{"x":1}', '{"x":2}'), 1)):
        path = str(tmp_path / f"cas{conflicts}")
        found, together = [], threading.Barrier(2)

        def put(payload):
            rows = spark.createDataFrame([(f"ab{i}", "c", payload) for i in range(5)], schema)
            together.wait()
            try:
                found.append(artifacts.ArtifactStore(spark, path).put(rows))
            except artifacts.ConflictingArtifact as e:
                found.append(e)

        threads = [threading.Thread(target=put, args=(p,)) for p in payloads]
        [t.start() for t in threads]
        [t.join(300) for t in threads]
        assert len(found) == 2 and sum(isinstance(f, Exception) for f in found) == conflicts
        assert sum(f for f in found if isinstance(f, int)) == 5
        table = spark.read.parquet(path)
        assert table.count() == table.select("cache_key").distinct().count() == 5


def test_claims_of_a_lost_writer(spark, tmp_path):
    store = artifacts.ArtifactStore(spark, str(tmp_path / "cas"), wait_s=0.5)
    rows = spark.createDataFrame([("ab1", "c", "{}"), ("cd1", "c", "{}")], "cache_key string, case_id string, payload string")
    assert store.claims.take("cd")
    with pytest.raises(claims.Claimed):
        store.put(rows)
    assert store.put(rows.where("cache_key = 'ab1'")) == 1, "other ranges go on"
    assert store.claims.release("cd") and store.put(rows) == 1 and store.put(rows) == 0


@pytest.mark.parametrize("other", [False, True])
def test_two_writers_of_one_path(spark, tmp_path, other):
    """Both write at once: one does, and the other one finds its rows there, or others."""
    found, together = [], threading.Barrier(2)

    def write(n):
        df = spark.range(n).repartition(2)
        together.wait()
        try:
            found.append(files.write_once(df, str(tmp_path / "t")))
        except ValueError as e:
            found.append(str(e))

    threads = [threading.Thread(target=write, args=(n,)) for n in (10, 11 if other else 10)]
    [t.start() for t in threads]
    [t.join(300) for t in threads]
    assert len(found) == 2 and True in found and (any("other rows" in str(f) for f in found) if other else False in found)
    assert spark.read.parquet(str(tmp_path / "t")).count() in (10, 11)


def test_attempts_by_tier(spark):
    cases = spark.createDataFrame([("a", ["T0", "T2", "T2"]), ("b", ["T3"]), ("c", [])], "case_id string, tiers array<string>")
    probes = spark.createDataFrame([("T0", "p0", "available"), ("T2", "p2", "unavailable"), ("TX", "p9", "available")], "tier string, provider_id string, status string")
    got = sorted(tuple(r) for r in providers.attempts_by_tier(cases, probes).collect())
    assert got == [("a", "T0", "p0", "available"), ("a", "T2", "p2", "unavailable"), ("b", "T3", None, "unprobed")]
    with pytest.raises(ValueError):
        providers.attempts_by_tier(cases, probes.union(probes.limit(1)))
