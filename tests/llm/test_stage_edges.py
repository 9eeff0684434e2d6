"""The pipeline's stages on empty tables, nulls, repeated rows and clashing column names."""

import pytest

import corpus_pipeline
from formweave.llm import exact_dedup, jaccard, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(1, "The quick brown fox jumps over the lazy dog today.", "en", "s", 1), (1, "The quick brown fox jumps over the lazy dog today.", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "No id here, but words enough to keep.", "en", "s", 1), (None, None, "en", "s", 0),
        (4, "Other words stand in this text and nothing else does.", "en", "s", 1), (5, "word " * 30_000, "en", "s", 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("edges")
    spark.createDataFrame([(i, i % 2, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_any_table(spark, folder, name, stage):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out, none = stage(spark, docs, folder), stage(spark, docs.limit(0), folder)
    assert none.count() == 0
    if name == "best-fit packing":
        assert {r.doc_id for r in out.collect()} == {r[0] for r in ROWS} and sum(r.length for r in out.collect()) > 30_000
        return
    assert out.schema == docs.schema and none.schema == docs.schema
    rows = list(map(tuple, out.collect()))
    assert all(r in ROWS for r in rows)
    if name == "exact dedup":
        assert len(rows) == len(set(rows)) == 5
    if name == "n-gram Jaccard join":
        assert {r[0] for r in rows} == {1, 2, 3, 4, 5, None}


@pytest.mark.parametrize("keep", [exact_dedup.kept_documents, jaccard.distinct_documents, lambda d: quality.good_documents(d, d.limit(0).selectExpr("doc_id", "n AS quality")), lambda d: toxicity.clean_documents(d, d.limit(0).selectExpr("doc_id", "n AS toxic"))])
def test_columns_with_the_names_of_the_operators(spark, keep):
    schema = "doc_id long, text string, sid long, n int, run int, digest string, score double, rep long, component long, goes boolean, key string"
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3, "d", 0.5, 4, 5, True, "k"), (2, "g h i j k l", 9, 8, 7, "e", 0.1, 6, 5, False, "m")], schema)
    out = keep(docs)
    assert out.columns == docs.columns and set(map(tuple, out.collect())) <= set(map(tuple, docs.collect()))
