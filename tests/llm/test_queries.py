"""The registered queries with SQL twins, and the pipeline against its stages' rules."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lotwise.llm import registry
from tests.conftest import SF
from tests.test_oracles import TABLES, rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(registry.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_all_are_there():
    got = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in got) for n in range(1, 14)) and "pipeline" in got


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        nxt = stage(spark, docs, SF)
        assert nxt.columns == docs.columns, name
        before, docs = docs, spark.createDataFrame(nxt.collect(), nxt.schema)
        assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id: r.n_tokens for r in last}


def test_pipeline_of_odd_rows(spark, tmp_path):
    bench = spark.createDataFrame([(1, "The old train of the north leaves at ten in the morning and comes back at noon with all of its guests.")], "item_id long, text string")
    kind = "doc_id long, text string, lang string, source string, n_chars long, found string, token long, class_id long"
    words = "the train goes to the old town and some people wait there for it in the rain with their dogs"
    rows = [
        (1, None, None, None, None, "f", 1, 1), (2, "", "en", "s", 0, "f", 1, 1), (3, "12 34", "en", "s", 5, "f", 1, 1), (4, words, "en", "s", 80, "f", 1, 1), (5, words, None, None, None, "f", 1, 1),
        (5, words, None, None, None, "f", 1, 1), (None, words + " too", "en", "s", 80, "f", 1, 1), (7, "mail me at a@b.co about the town and its very old people", "en", "s", 50, "f", 1, 1),
        (8, "Look: " + bench.first().text, "en", "s", 90, "f", 1, 1)]
    for name, some in (("odd", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(some, kind).write.parquet(f"{folder}/documents.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == kind.replace(" long", "").replace(" string", "").split(", "), stage_name
        got = corpus_pipeline.run(spark, folder).collect()
        assert sorted(r.doc_id or 0 for r in got) == ([0, 4, 7] if some else [])
