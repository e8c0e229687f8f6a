"""Every registered query of the subpackage on empty tables."""

import pytest

from tessera.llm.queries import QUERIES

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long", "pages": "page_id long, url string, html string", "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int", "embeddings": "vec_id int, embedding array<float>, label int",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    made = f"file://{tmp_path_factory.mktemp('empty')}"
    for name, kinds in TABLES.items():
        spark.createDataFrame([], kinds).write.parquet(f"{made}/{name}.parquet")
    return made


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_rows_give_no_rows(spark, folder, name):
    found = QUERIES[name](spark, folder)
    assert found.collect() == [] and len(found.columns) > 2


def test_pipeline_on_no_documents(spark, folder):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, folder).collect() == []
