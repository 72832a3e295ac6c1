"""Registered queries against their SQL and the pipeline against its parts."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stayflow.llm import decontaminate, simhash
from stayflow.llm.queries import ORACLE, QUERIES

from .test_near_copies import kept_by_hand

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want, got = db.sql(ORACLE[name]).df(), QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    columns = sorted(got.columns)
    got, want = (x[columns].sort_values("doc_id").reset_index(drop=True) for x in (got, want))
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_returns_every_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = QUERIES[name](spark, SF).select("doc_id")
    assert ids.count() == docs.count() and ids.exceptAll(docs.select("doc_id")).isEmpty()


def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        path = corpus_pipeline.shared_path(spark, "stage")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == columns
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if k == 0:
            assert all(labels[i] == 1 for i in ids if i in labels)
            assert all(i in ids for i, good in labels.items() if good)
        elif k == 1:
            rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
            assert ids == kept_by_hand(rows)[0]
        elif k == 2:
            assert decontaminate.contamination(docs, bench).where(F.size("hits") > 0).isEmpty()
            clean = decontaminate.contamination(before, bench).where(F.size("hits") == 0)
            assert ids == {r["id"] for r in clean.select("id").collect()}
        elif k == 4:
            assert docs.count() == before.count() and set(columns) < set(docs.columns)
            assert docs.where(~F.col("shard").between(0, 15)).isEmpty()


def test_hot_keys_change_no_class(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(simhash.simhash_classes(docs, hot=2)) == key(simhash.simhash_classes(docs))
