"""Column functions and tree helpers against hand-checked values."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tierscope.functions import core, distance, structure, text, windows


def one(spark, **columns):
    """The value of a column expression."""
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def lit(x):
    return F.lit(x)


def test_ratio(spark):
    r = one(spark, a=core.ratio_value(lit(1), lit(4)), b=core.ratio_value(lit(0), lit(0)), c=core.ratio_value(lit(0), lit(0), 2), d=core.ratio_value(lit(1), lit(0)))
    assert (r["a"], r["b"], r["c"], r["d"]) == (0.25, 0.0, None, None)
    m = one(spark, m=core.metric(lit(2), lit(4), 1))["m"]
    assert (m["numerator"], m["denominator"], m["excluded_count"], m["value"]) == (2, 4, 1, 0.5)
    assert one(spark, p=core.percentage(lit(1), lit(8)))["p"] == "12.5% (1/8)"


def test_tiers(spark):
    r = one(spark, rank=core.tier_rank(lit("T2")), none=core.tier_rank(lit("T9")), ordered=core.ordered_tiers(F.array(lit("T3"), lit("T1"), lit("T1"), lit("x"))))
    assert (r["rank"], r["none"], r["ordered"]) == (2, None, ["T1", "T3"])


def test_character_counts(spark):
    s = "กabcdefghi�\x00"
    c = one(spark, c=text.character_counts(lit(s)))["c"]
    assert (c["text_chars"], c["anomalous_chars"], c["letter_chars"], c["thai_chars"], c["latin_chars"]) == (13, 3, 10, 1, 9)
    # The two kinds of white space differ on U+0085 and U+FEFF.
    assert one(spark, c=text.character_counts(lit("a\x85﻿ b")))["c"]["text_chars"] == 3
    assert one(spark, n=text.nfc(lit("é")))["n"] == "é"


def test_sanity(spark):
    def value(s):
        counts = text.gate_counts(lit(s))
        return one(spark, v=text.character_sanity(counts["solid_"], counts["bad_"]))["v"]


    assert value("") == 0.0 and value(" \n") == 0.0 and value("plain text") == 1.0
    assert value("abcdefghi�") == pytest.approx(0.9)
    assert value("." * 10 + "a" * 7) == pytest.approx(1 - 3 / 17), "runs under 8 are fine"
    assert value("x" + " " * 9) == 0.0, "runs of spaces count though spaces don't"
    assert value("ab" + "😀" * 8) == pytest.approx(1 - 9 / 10), "run lengths are in UTF-16 units"
    assert value("\n" * 20 + "ab" + "\u2028" * 9) == 1.0


def test_script_consistency(spark):
    def value(s, thai, latin):
        counts = text.gate_counts(lit(s))
        return one(spark, v=text.script_consistency(counts["thai_"], counts["latin_"], lit(thai), lit(latin)))["v"]


    assert value("abc", 0.0, 0.05) is None
    assert value("123", 0.0, 1.0) == 0.0
    assert value("abกข", 0.5, 0.5) == 1.0
    assert value("abcก", 0.5, 0.5) == pytest.approx(0.5)


def test_markup(spark):
    value = lambda s: one(spark, v=text.strip_markup(lit(s)))["v"]
    assert value("cost $5 and $$x$$") == "cost $5 and x"
    assert value("growth < decline") == "growth < decline"
    assert value('<div data-note="x > y">Caption</div>') == " Caption "
    assert value("a <b unclosed") == "a <b unclosed" and value("$x$ $y$") == "x y"
    assert one(spark, v=text.for_cer(lit("<b>a</b> é 　b")))["v"] == "aéb"
    assert one(spark, v=text.for_wer(lit(" a  b\n"), lit("english")))["v"] == "a b"
    assert one(spark, v=text.for_wer(lit("ก ข"), lit("thai")))["v"] == "กข"


def test_errors(spark):
    e = lambda a, b: one(spark, v=text.character_error_rate(lit(a), lit(b)))["v"].asDict()
    assert e("abc", "axc")["value"] == pytest.approx(1 / 3)
    assert e("", "") == {"numerator": 0, "denominator": 0, "excluded_count": 0, "value": 0.0}
    assert e("", "x") == {"numerator": 0, "denominator": 0, "excluded_count": 1, "value": None}
    assert distance.edit_distance(list("kitten"), list("sitting")) == 3
    tokens = text.word_tokens()
    w = one(spark, v=text.word_error_rate(tokens(lit("It's 3.5 km, no?"), lit("english")), tokens(lit("It's 3.5 miles"), lit("english"))))["v"]
    assert (w["numerator"], w["denominator"]) == (2, 4)
    assert one(spark, v=text.text_similarity(lit(""), lit("")))["v"] == 1.0


def test_small_normalisers(spark):
    r = one(spark, a=text.metadata_text(lit("  a \n b ")), b=text.metadata_text(lit(" ")), c=text.control_text(lit("A b\nC")), d=text.fold_typography(lit("“x” –  it’s ")))
    assert (r["a"], r["b"], r["c"], r["d"]) == ("a b", None, "abc", '"x" - it\'s')
    m = one(spark, m=text.short_thai_runs(lit("กข ค abc งจฉ")))["m"]
    assert (m["numerator"], m["denominator"]) == (3, 6)


def test_trees(spark):
    assert structure.canonical_json({"b": 1, "a": [True, None, "é"]}) == '{"a":[true,null,"é"],"b":1}'
    assert structure.canonical_json({"b": 1, "B": 2, "a": 3, "_": 4, "1": 5}) == '{"_":4,"1":5,"a":3,"b":1,"B":2}'
    numbers = [1.0, -0.0, 1e-7, 1.5e-7, 1e-6, 123456.789, 1e21, 1.5e300, 1e20, 1.2345678901234567e20, 0.1 + 0.2, -2.5, 10**20]
    assert structure.stringify(numbers) == "[1,0,1e-7,1.5e-7,0.000001,123456.789,1e+21,1.5e+300,100000000000000000000,123456789012345670000,0.30000000000000004,-2.5,100000000000000000000]"
    assert structure.sanitise({"body": [], "Origin": {"x": 1}, "nested": {"sourceUrl": "u", "semantic": 1}}) == {"body": [], "nested": {"semantic": 1}}
    key = structure.artifact_key("c" * 64, "p", "1", None, {"ocr": False})
    assert key != structure.artifact_key("c" * 64, "p", "1", None, {"ocr": True})
    for provider, version in (("p", "1"), ('a"b', "v\\1"), ("é\n", 'v"1')):
        got = one(spark, k=structure.artifact_key_column(lit("c" * 64), lit(provider), lit(version), lit(None).cast("string"), lit('{"ocr":false}')))["k"]
        assert got == structure.artifact_key("c" * 64, provider, version, None, {"ocr": False})


def test_canonical_columns(spark):
    """Keys by Unicode collation, numbers as doubles, on the column path and on the driver."""
    import json

    tree = {"z": 1152921504606846977, "é": {"b c": 1, "b_c": 2, "b-c": 3, "É": [1.50, 1e3, -0.0, 2**53, 2**53 + 2]}, "f": "é\n\"", "e": None, "E": True, "10": 1, "9": 2, "": 0}
    want = '{"":0,"10":1,"9":2,"e":null,"E":true,"é":{"b c":1,"b_c":2,"b-c":3,"É":[1.5,1000,0,9007199254740992,9007199254740994]},"f":"é\\n\\"","z":1152921504606847000}'
    rows = spark.createDataFrame([(json.dumps(tree),), (json.dumps(tree, ensure_ascii=False),), ("3",), ("[]",), (None,), ('{"ж":1,"я":2,"ё":3,"ß":4,"ss":5,"日":6}',)], "t string")
    got = [r["c"] for r in rows.select(structure.canonical("t").alias("c")).collect()]
    assert got[:5] == [want, want, "3", "[]", None] and structure.canonical_json(tree) == want
    assert got[5] == '{"ss":5,"ß":4,"ё":3,"ж":1,"я":2,"日":6}', "orders that no table of marks has"


def largest_batch(spark, build):
    """Most bytes of text that one batch takes to Python after build() has made its columns."""
    @F.pandas_udf("long")
    def size(t: pd.Series) -> pd.Series:
        return pd.Series([int(t.str.len().sum())] * len(t))

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        build()
        return spark.range(3000, numPartitions=1).select(size(F.repeat(F.lit("0123456789"), 1000)).alias("n")).agg(F.max("n")).first()[0]
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def test_canonical_goes_to_python_in_bounded_batches(spark):
    assert largest_batch(spark, lambda: structure.canonical("t")) < 4 << 20


def test_windows_go_to_python_in_bounded_batches(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert largest_batch(spark, lambda: windows.page_windows(docs, docs.withColumn("page", F.lit(0)))) < 4 << 20


def test_counts_of_one_pass_against_plain_python(spark):
    """Runs that end with their text, wide characters, several texts of a batch, and a null."""
    import unicodedata

    texts = ["aaaaaaa", "aaaaaaaa", "a" * 9, "", "\n" * 20 + "x" * 7 + "😀" * 9, "กกกกกกกก é\ufffd\x00 Ж\u0301", "e\u0301" * 9, "\x0b\x85\ufeff\u2028 ª×", "x" * 8 + "y" * 9]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").coalesce(1)
    got = {r["i"]: r for r in rows.select("i", *(c.alias(k) for k, c in text.gate_counts(F.col("t")).items()), text.character_counts(F.col("t"), normalise=True).alias("c")).collect()}
    runs = [0, 1, 2, 0, 11, 1, 0, 0, 3]
    for i, t in enumerate(texts):
        spaces = sum(c in "\t\n\x0b\x0c\r \x85\xa0\u2028\u2029\u3000" for c in t)
        odd = sum(c in "\x00\ufffd" for c in t)
        assert (got[i]["solid_"], got[i]["bad_"], got[i]["thai_"]) == (len(t) - spaces, odd + runs[i], t.count("ก")), t
        n = unicodedata.normalize("NFC", t)
        assert got[i]["c"]["letter_chars"] == sum(unicodedata.category(c)[0] == "L" for c in n), t
    assert got[len(texts)]["solid_"] is None and got[len(texts)]["c"]["text_chars"] is None


def test_gate_counts_go_with_rows_in_place_of_texts(spark):
    from tierscope.operators import gate

    df = spark.createDataFrame([(1, "word " * 9, ["word " * 9], True), (2, "", None, False)], "case_id long, text string, pages array<string>, has_structure boolean")
    seen = spark.createDataFrame([(1, 36, 1, 0.0, 1.0, True), (2, 5, 2, 0.2, 0.0, True)], "case_id long, total_text_chars long, page_count long, thai_char_ratio double, latin_char_ratio double, expects_structure boolean")
    few = gate.counted(df)
    assert not {"text", "pages"} & set(few.columns)
    want = gate.with_components(df.join(seen, "case_id")).select("case_id", *gate.COMPONENTS)
    assert sorted(gate.with_components(few.join(seen, "case_id")).select("case_id", *gate.COMPONENTS).collect()) == sorted(want.collect())
