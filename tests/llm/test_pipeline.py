"""The stages in turn, and the registered queries' columns."""

import corpus_pipeline as pipeline
from tests.check_oracle import compare, connect
from tests.llm.conftest import make_docs
from tripsearch.llm import oracle, queries, raking

import pytest
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_against_sql(spark, name):
    problem = compare(connect(SF_DIR), queries.QUERIES[name](spark, SF_DIR), oracle.ORACLE_SQL[name])
    assert problem is None or problem == "empty on both sides"


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.ORACLE_SQL)))
def test_other_queries_have_a_row_per_document(spark, name):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert queries.QUERIES[name](spark, SF_DIR).select("doc_id").distinct().count() == docs.count()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    left = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, left, SF_DIR)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= left.count()
        left = out
    last = pipeline.run(spark, SF_DIR)
    sampled = {r.doc_id for r in raking.mix(left).filter("sampled").collect()}
    assert {r.doc_id for r in last.collect()} == sampled and 0 < len(sampled) < left.count()
    assert all(r.sample_weight >= 1 for r in last.collect())


def test_columns_that_clash_with_helpers_pass_through(spark, odd_rows):
    names = ("short_text", "Short_of_Tag", "short_of_id")
    docs = make_docs(spark, odd_rows)
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit("kept "), F.col("doc_id").cast("string")))
    out = pipeline.repeated_passages(spark, docs, SF_DIR)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    assert all(r[name] == (None if r.doc_id is None else f"kept {r.doc_id}") for r in rows for name in names)


def test_stages_take_odd_rows_and_none(spark, odd_rows, no_docs):
    for name, stage in pipeline.STAGES:
        assert stage(spark, no_docs, SF_DIR).count() == 0, name
    left = make_docs(spark, odd_rows)
    for name, stage in pipeline.STAGES:
        left = stage(spark, left, SF_DIR)
        left.count()
    assert left.filter("doc_id is null").count() <= 1  # the last stage samples


def test_repeated_passages_against_plain(spark):
    """Stage 3 on whole texts: every byte under a passage that a smaller id holds too goes, whatever it overlaps."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in pipeline.repeated_passages(spark, docs, SF_DIR).collect()}
    size, least, want = pipeline.PASSAGE, {}, {}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
    for doc, text in rows:
        raw = text.encode()
        for a in range(len(raw) - size + 1):
            least.setdefault(raw[a : a + size], doc)
    for doc, text in rows:
        raw, gone = text.encode(), set()
        for a in range(len(raw) - size + 1):
            if least[raw[a : a + size]] < doc:
                gone.update(range(a, a + size))
        want[doc] = bytes(b for i, b in enumerate(raw) if i not in gone).decode("utf-8", "ignore")
    assert {d: t or "" for d, t in got.items()} == want
    assert any(want[d] != t for d, t in rows)


def test_native_plans(spark):
    for name in ("op1_mixing", "op9_decontamination"):
        plan = queries.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
