"""Every registered query of the engine's own operators against DuckDB, and the entry module."""

import glob
import os

import pandas as pd
import pytest

import __spark_entry__ as entry_module
from tierscope import queries

SF = os.environ.get("TIERSCOPE_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (bool, int, str)) else str(v)


def listed(frame, columns):
    return sorted(repr([plain(v) for v in row]) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def tables():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, tables, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLE_SQL:
        want = tables.sql(queries.ORACLE_SQL[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert listed(got, columns) == listed(want, columns)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_whole_texts_are_compared(spark, tmp_path):
    own = [f"w{i}" for i in range(100)]
    other = own[:90] + [f"z{i}" for i in range(14)]
    spark.createDataFrame([(1, " ".join(own))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, " ".join(other))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    # Of the turns that are divisible by 3 the other side has no "e": the third keeps 80 of 180 characters.
    turns = [(7, 1, "user", "y" * 300), (7, 2, "user", "z" * 300), (7, 3, "user", "x" * 80 + "e" * 100)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    errors = queries.QUERIES["word_errors"](spark, str(tmp_path)).first()
    assert (errors["edits"], errors["reference_words"], errors["wer"]) == (14, 100, 0.14)
    matched = queries.QUERIES["structure_matching"](spark, str(tmp_path)).first()
    assert (matched["true_positives"], matched["false_positives"], matched["false_negatives"]) == (2, 1, 1)
