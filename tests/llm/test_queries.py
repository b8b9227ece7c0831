"""Registered queries equal their SQL forms; the others return a row per document."""

import pytest

from oracle import compare, connect
from tidemill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, folder, name):
    assert compare(QUERIES[name](spark, folder).toPandas(), connect(folder).execute(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", ["op6_near_dedup", "op7_language", "op8_toxicity", "op9_sharding", "op10_fingerprints"])
def test_a_row_per_document(spark, folder, name):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    assert QUERIES[name](spark, folder).select("doc_id").distinct().count() == documents.count()
