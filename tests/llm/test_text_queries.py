"""Registered text queries beside their SQL, and the others' shape."""

import pytest
from check import compare, connect

from isopleth.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), SQL[name]) == []


@pytest.mark.parametrize("name", ["op1_sentencepiece", "op3_language", "op8_jaccard_join", "op9_quality", "op10_toxicity"])
def test_a_row_for_each_document(spark, name):
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == len(ids) and {r.doc_id for r in rows} == ids


def test_audit_finds_every_fault(spark):
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    kind = F.element_at(F.create_map(F.lit(3), F.lit("changed"), F.lit(4), F.lit("changed"), F.lit(5), F.lit("missing")), (F.crc32(F.col("page_id").cast("string")) % 97).cast("int"))
    want = {(r.page_id, r.kind) for r in pages.select("page_id", kind.alias("kind")).filter("kind IS NOT NULL").collect()}
    assert {(r.page_id, r.kind) for r in QUERIES["op4_merkle_audit"](spark, SF).collect()} == want
