"""The pipeline's stages over small tables against plain Python."""

import hashlib

import public_tokenizers
import pytest

import corpus_pipeline
from tierscope.llm import byte_bpe, secret_scan

from .test_documents import ODD, brute_groups, sentence


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(21)
    items = [(i, sentence(rng, 30, 4000)) for i in range(5)]
    base = sentence(rng, 120, 4000)
    texts = [base, base, base.replace(base.split()[5], "other", 1), sentence(rng, 50, 4000) + " " + items[2][1], "token = abcdefgh1234 " + sentence(rng, 30, 4000), *ODD, "1 2 3"]
    texts += [sentence(rng, 40, 4000) for _ in range(30)]
    rows = [(i, t, "en" if i % 7 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    sf = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    kept = {i: t for i, t, *_ in rows if t is not None and any(map(str.isalpha, t))}
    model_kept = set(seen["language_id"])
    assert model_kept <= set(kept) and {0, 1, 2, 3, 4} <= model_kept
    groups = brute_groups([(i, kept[i]) for i in model_kept])
    first = {i for i, (_, c) in groups.items() if i == c}
    assert set(seen["ngram_jaccard_join"]) == first and 1 not in first and 2 not in first
    assert set(seen["benchmark_decontamination"]) == first - {3}
    assert all(r["text"] == secret_scan.redact(kept[i]) for i, r in seen["secret_scan"].items()) and "[REDACTED]" in seen["secret_scan"][4]["text"]
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    codec = byte_bpe.ByteBPE(ranks, public_tokenizers.PATTERN)
    for i, r in seen["byte_level_bpe"].items():
        ids = codec.ids(seen["secret_scan"][i]["text"])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == set(seen["byte_level_bpe"])


def test_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op1_quality_qda", "op5_lm_score", "op7_lang_id"])
def test_queries_cover_every_document(spark, name):
    import os

    from tierscope.llm import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    ids = sorted(r["doc_id"] for r in queries.QUERIES[name](spark, sf).select("doc_id").collect())
    assert ids == sorted(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())


def test_near_duplicates_by_five_words_and_80_percent(spark, monkeypatch):
    import random

    from tierscope.llm import ngram_jaccard

    from .test_documents import docs_of, edited, words

    monkeypatch.setattr(ngram_jaccard, "TILE", 8)
    rng = random.Random(22)
    base = sentence(rng, 100, 10**6)
    texts = [base, base + " " + sentence(rng, 20, 10**6), base + " " + sentence(rng, 30, 10**6), *ODD]
    for _ in range(40):
        own = sentence(rng, rng.randrange(30, 200), 5000)
        texts += [own] + [edited(rng, own, rng.randrange(0, 6)) for _ in range(3)]
    sets = []
    for t in texts:
        w = words("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = {i for i in range(len(texts)) if find(i) == i}
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs_of(spark, texts), "").collect()}
    assert got == want and {0, 2} <= want and 1 not in want
