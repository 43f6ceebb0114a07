"""Registered queries and the pipeline on the smallest tables."""
import os

import duckdb
import pytest

import corpus_pipeline
from sitelode.llm.common import table
from sitelode.llm.oracles import ORACLES
from sitelode.llm.queries import QUERIES
from sitelode.session import durable

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_queries_return_every_row(spark):
    for name, of in (("op1_suffix_dedup", "documents"), ("op4_quality", "documents"), ("op5_toxicity", "documents"), ("op6_simhash", "documents"), ("op11_quality_rules", "documents"), ("op12_centroids", "embeddings"), ("op13_merkle", "documents"),
                     ("op9_main_text", "pages")):
        assert QUERIES[name](spark, SF).count() == table(spark, SF, of).count()


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, SF))
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] < counts[0] and counts[-1] > 0.6 * counts[0]
    # The rows of run() are those of the stages one after the other.
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    key = lambda rows: sorted((r["doc_id"], r["taken"], r["text"]) for r in rows)
    assert key(corpus_pipeline.run(spark, SF).collect()) == key(last.collect())
    con = duckdb.connect()
    benchmark = con.execute(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()
    texts = [r["text"] for r in docs.collect()]
    assert not any(b[0] in t for b in benchmark for t in texts)


def test_stages_take_empty_and_null_rows(spark, frame):
    schema = table(spark, SF, "documents").schema
    rows = [(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", None, 0), (3, "word " * 30, "en", "s", 150), (3, "word " * 30, "en", "s", 150)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SF)
        assert kept.count() <= len(rows), name
        assert stage(spark, docs.limit(0), SF).isEmpty(), name
