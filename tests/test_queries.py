"""Every named query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from twinreel.plans import oracles, queries

DATA = "/root/testdata/sf0.001"


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("" if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) else str(v).removesuffix(".0") for v in row) for row in frame.itertuples(index=False))


def same_as_sql(spark, name, folder):
    db = duckdb.connect()
    for file in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}{'/*.parquet' if os.path.isdir(file) else ''}'")
    expected = db.execute(oracles.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, str(folder)).toPandas()
    assert len(expected) and plain(got) == plain(expected)


def documents(spark, folder, rows):
    """Tables of documents (doc_id, text, source, n_chars), none of them labelled."""
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id bigint, text string, source string, n_chars bigint, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_sets_whose_hashes_are_equal(spark, tmp_path):
    """Murmur3 makes 1999393441 of both (src13, 6167) and (src14, 4144)."""
    documents(spark, tmp_path, [(i, f"text {i}", *(("src13", 6167) if i % 2 else ("src14", 4144))) for i in range(6)])
    same_as_sql(spark, "merge_verdicts", tmp_path)


def test_instructions_for_large_groups(spark, tmp_path):
    """Of groups 3 and 7 only the first has a hundredth entry."""
    documents(spark, tmp_path, [(3 + 4 * i, "many" if i != 1 and i != 5 else "few", "src1", 4) for i in range(103)])
    same_as_sql(spark, "resolution_plan", tmp_path)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query(spark, name):
    db = duckdb.connect()
    for file in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    expected = db.execute(oracles.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert [[x.replace(".000000", "") for x in r] for r in plain(got)] == [[x.replace(".000000", "") for x in r] for r in plain(expected)]
