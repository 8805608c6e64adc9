"""Null ids, rows that share an id, and empty tables, for every operator on documents."""

import hashlib
import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tierscope.llm import bm25_decontam, byte_bpe, embedding_dedup, lang_id, license_digest, lm_score, quality_qda, secret_scan, substring_dedup
from tierscope.llm.ngram_jaccard import group_documents

from .test_documents import PATH, brute_base, brute_substrings, docs_of, sentence, words


def operators(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten.")], "item_id long, text string")
    return {
        "quality": lambda d: quality_qda.score_quality(d, labels),
        "secrets": secret_scan.scan_secrets,
        "redaction": secret_scan.redact_secrets,
        "substrings": substring_dedup.remove_repeats,
        "licences": license_digest.scan_licenses,
        "lm": lambda d: lm_score.score_by_models(d, labels.select("doc_id")),
        "language": lambda d: lang_id.predict(d, lang_id.train(d, PATH)),
        "bpe": lambda d: byte_bpe.encode_digests(d, PATH, public_tokenizers.PATTERN),
        "leaks": lambda d: bm25_decontam.find_leaks(d, items),
        "jaccard": group_documents,
    }


@pytest.mark.parametrize("name", ["quality", "secrets", "redaction", "substrings", "licences", "lm", "language", "bpe", "leaks", "jaccard"])
def test_edges(spark, name):
    run = operators(spark)[name]
    text = " ".join(f"w{i}" for i in range(40))
    nameless = docs_of(spark, [text, None]).withColumn("doc_id", F.lit(None).cast("long"))
    docs = docs_of(spark, [text, text, None, "", "x"]).union(docs_of(spark, ["other words " + text, "y"])).union(nameless)
    got = run(docs).collect()
    if name == "leaks":
        assert got == []
    elif name == "licences":
        assert len(got) == len({(r["doc_id"], r["canonical_sha256"]) for r in got}) == 9
    else:
        assert len(got) == docs.count()
        assert sum(r["doc_id"] is None for r in got) == 2
    assert run(docs.limit(0)).count() == 0
    if name != "language":  # whose labels are a column of the documents
        assert len(run(docs.select("text", "doc_id")).collect()) == len(got)


def test_texts_longer_than_a_block(spark):
    """A text of over a megabyte beside short ones, for every operator: it counts whole, and its end as much as its begin."""
    rng = random.Random(51)
    passage, item = sentence(rng, 40), "which colour has the sky at noon on a clear day in summer. It is a light blue."
    long_ = sentence(rng, 230_000, 50_000) + f" {passage} password=hunter22hunter {item}\nReleased under the MIT License."
    texts = [long_, "short words " + passage, "one more text", long_ + " end"]
    assert len(long_) > 1_200_000
    docs, run = docs_of(spark, texts), operators(spark)
    rows = {name: {r["doc_id"]: r for r in run[name](docs).collect()} for name in ("quality", "secrets", "redaction", "substrings", "licences", "lm", "language", "bpe", "jaccard")}
    assert all(set(r) == {0, 1, 2, 3} for r in rows.values())
    want = brute_substrings(list(enumerate(texts)))
    assert {i: (r["n_words"], r["n_removed"], r["kept_text"]) for i, r in rows["substrings"].items()} == want and want[3][1] > 230_000
    assert rows["secrets"][0]["base_sha256"] == hashlib.sha256(brute_base(long_).encode()).hexdigest() and rows["secrets"][0]["n_assign"] == 1
    assert "hunter22" not in rows["redaction"][0]["text"] and rows["redaction"][0]["text"].startswith(long_[:1000])
    assert (rows["licences"][0]["n_notices"], rows["licences"][0]["notice_ids"]) == (1, "MIT")
    assert rows["lm"][0]["n_tokens"] == len(words(long_)) and rows["lm"][2]["n_tokens"] == 3
    assert rows["bpe"][0]["decoded_sha256"] == hashlib.sha256(long_.encode()).hexdigest()
    sizes = [len({tuple(w[i : i + 4]) for i in range(len(w) - 3)} or [w]) for w in (words(t.lower()) for t in texts)]
    assert [rows["jaccard"][i]["n_shingles"] for i in range(4)] == sizes
    assert [rows["jaccard"][i]["component_id"] for i in range(4)] == [0, 1, 2, 0]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r["doc_id"] for r in bm25_decontam.find_leaks(docs, items).collect()} == {0, 3}


BIG = [(1 << 60) + 1, None, (1 << 60) + 3]


@pytest.mark.parametrize("name", ["quality", "secrets", "substrings", "licences", "lm", "language", "bpe", "jaccard"])
def test_ids_of_64_bits_beside_null(spark, name):
    """Doubles hold 53 bits: ids stay as they are where one of a batch is null."""
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, text + f" end{n}", "en") for n, i in enumerate(BIG)], "doc_id long, text string, lang string").coalesce(1)
    rows = operators(spark)[name](docs).collect()
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(map(str, BIG))
    if name == "quality":
        assert {r["doc_id"]: r["held_out"] for r in rows} == {i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in BIG}
    if name == "jaccard":
        assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"]} == {BIG[0]: BIG[0], BIG[2]: BIG[0]}
    if name == "substrings":
        assert {r["doc_id"]: r["n_removed"] for r in rows if r["doc_id"]} == {BIG[0]: 0, BIG[2]: 40}


def test_leaks_and_links_of_64_bit_ids(spark):
    item = "which colour has the sky at noon on a clear day in summer. It is a light blue."
    docs = spark.createDataFrame([(i, f"{n} {item}") for n, i in enumerate(BIG)], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in bm25_decontam.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()} == set(BIG)
    vectors = spark.createDataFrame([(BIG[0], [1.0, 0.01, 0.3]), (None, [1.0, 0.0, 0.3]), (BIG[2], [1.0, 0.0, 0.3])], "vec_id long, embedding array<double>").coalesce(1)
    rows = {r["vec_id"]: r for r in embedding_dedup.link_vectors(vectors).collect()}
    assert set(rows) == set(BIG) and all(rows[i]["n_links"] == 1 and rows[i]["component_id"] == BIG[0] for i in (BIG[0], BIG[2]))
