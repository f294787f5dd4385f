"""The first of each group of near duplicates, whatever the type of ids and where ids repeat."""

import pytest

from itemforge.llm import ngram_join

COPY, OTHER = "one two three four five six seven eight", "quite another text of some more words than five"


@pytest.mark.parametrize("kind", ["int", "string", "long"])
def test_ids_of_any_type(spark, kind):
    docs = spark.createDataFrame([(i, COPY if i % 2 else OTHER + f" {i}" * 9) for i in range(1, 9)], "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    out = ngram_join.first_of_each(docs)
    assert out.columns == docs.columns and sorted(int(r["doc_id"]) for r in out.collect()) == [1, 2, 4, 6, 8]


def test_shared_ids_of_different_texts(spark):
    docs = spark.createDataFrame([(3, COPY), (3, OTHER), (3, COPY), (1, COPY), (None, COPY), (4, OTHER)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in ngram_join.first_of_each(docs).collect()) == [(0, COPY), (1, COPY), (3, OTHER)]
