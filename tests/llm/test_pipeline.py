"""The pipeline over the smallest tables, each stage against a plain version."""

import os

import pytest

import __spark_entry__
import corpus_pipeline

from test_operators import ODD, PASSAGE, labels, odd

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = [{r["doc_id"] for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        seen.append({r["doc_id"] for r in docs.collect()})
        assert seen[-1] <= seen[-2], name
    texts = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        texts[r["doc_id"]] = r["text"]
    last = {}
    for i in sorted(seen[1]):
        last[texts[i]] = i
    assert seen[2] == set(last.values())
    out = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(seen[4])


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_rows(spark, tmp_path, rows):
    """Nulls, empty and long texts, repeated rows, clashing columns; no rows."""
    labels(spark, [(4, 0, 1), (7, 0, 1), (None, 1, 0)]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    first = docs = odd(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == first.columns
    kept = {r["doc_id"] for r in docs.collect()}
    if not rows:
        assert not kept
    else:  # of 1, 2, 3 and the null text one stays, of 4, 5 and 6 one, and 7 and 8 hold the passage
        assert {9, 10, 11, 12, 13, 14} <= kept and len({1, 2, 3} & kept) <= 1 and len({4, 5, 6} & kept) == 1 and not {7, 8} & kept


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
