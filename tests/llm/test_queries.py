"""Registered queries against their SQL, and the pipeline against its operators."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from sheafmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    result = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    want = sorted(repr([plain(row[names.index(c)]) for c in columns]) for row in result.fetchall())
    assert sorted(repr([plain(v) for v in row]) for row in frame.select(columns).collect()) == want


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_take_effect(spark, tmp_path):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    extra = documents.limit(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars")
    docs, kept = documents.union(extra), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == documents.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    judged = queries.QUERIES["op10_quality_rules"](spark, SF)
    assert kept[0] == {r.doc_id for r in judged.where("kept").collect()}
    assert kept[0] > kept[1] >= kept[2] == kept[3] == kept[4]
    leaks = {r.doc_id for r in queries.QUERIES["op9_decontamination"](spark, SF).collect()}
    assert not leaks & kept[2] and kept[1] - kept[2] <= leaks
    assert docs.where("n_tokens != size(ids)").count() == 0


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() == 0
