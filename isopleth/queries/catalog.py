"""Catalog search over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as c
from .base import query, table

CATALOG_SQL = """catalog AS (
  SELECT d.doc_id, source AS name, source AS provider, lang AS domain, text AS notes,
         CAST(n_chars AS VARCHAR) AS variables, quality = 1 AS globe, toxic = 1 AS amoc
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""
HAYSTACK_SQL = """lower(coalesce(name, '') || ' ' || coalesce(provider, '') || ' ' || coalesce(variables, '') || ' ' || coalesce(notes, '') || ' ' || '')"""


def documents_catalog(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select(
        "doc_id", F.col("source").alias("name"), F.col("source").alias("provider"), F.col("lang").alias("domain"),
        F.lit(None).cast("string").alias("subdomain"), F.col("n_chars").cast("string").alias("variables"),
        F.col("text").alias("notes"), (F.col("quality") == 1).alias("globe"), (F.col("toxic") == 1).alias("amoc"),
    )


@query(f"""
WITH {CATALOG_SQL}
SELECT doc_id, name, domain, globe, amoc FROM catalog
WHERE domain = 'en' AND coalesce(globe, false) AND contains({HAYSTACK_SQL}, 'ther')
""")
def catalog_hits(spark, sf_dir):
    hits = c.search(documents_catalog(spark, sf_dir), text="THER", domain="en", globe=True)
    return hits.select("doc_id", "name", "domain", "globe", "amoc")


@query(f"""
WITH {CATALOG_SQL}
SELECT row_number() OVER (ORDER BY doc_id) AS rank, doc_id, name, domain, length(notes) AS note_length FROM catalog
WHERE contains({HAYSTACK_SQL}, 'er')
""")
def catalog_search(spark, sf_dir):
    hits = c.search(documents_catalog(spark, sf_dir), text="er")
    return c.ranked(hits, "doc_id").select("rank", "doc_id", "name", "domain", F.length("notes").cast("long").alias("note_length"))


@query(f"""
WITH {CATALOG_SQL}
SELECT count(CASE WHEN coalesce(amoc, false) AND contains({HAYSTACK_SQL}, 'the') THEN 1 END) AS hits, count(*) AS records FROM catalog
""")
def catalog_count(spark, sf_dir):
    return c.hit_count(documents_catalog(spark, sf_dir), text="the", amoc=True)


@query("SELECT DISTINCT lang AS domain FROM documents ORDER BY lang")
def catalog_domains(spark, sf_dir):
    return c.domains(documents_catalog(spark, sf_dir))
