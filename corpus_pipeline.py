"""A corpus from raw documents to token digests, stage by stage.

Every stage works on all documents its predecessor kept. Stages but the last return the
columns of ``documents``; an empty table goes through as an empty one, and missing ids and
texts are treated as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.llm import decontaminate, jaccard, line_dedup, toxicity
from isopleth.llm.base import BLANKS, held, learnable, own
from isopleth.llm.queries import encoded, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; those without text stay."""
    labels = table(spark, sf_dir, "labels").filter(learnable("doc_id"))
    model = toxicity.fit(docs, "doc_id", "text", labels, "doc_id", "toxic")
    name = own(docs, "toxicity")
    return toxicity.score(docs, "text", model, name).filter(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go, and each text has its new length.

    A document that this leaves without anything but white space had no line of its own: it is
    a copy of earlier documents, whole or in parts, and goes too, as the stages behind it could
    only see an empty text. Documents without text to begin with stay.
    """
    kept, changed = own(docs, "kept"), F.col("n_dropped") > 0
    out = line_dedup.drop_repeated_lines(docs, "doc_id", "text", kept)
    out = out.filter(~(changed & (F.translate(kept, BLANKS, "") == "")))
    length = F.length(kept).cast(docs.schema["n_chars"].dataType)
    out = out.withColumns({"text": F.when(changed, F.col(kept)).otherwise(F.col("text")), "n_chars": F.when(changed, length).otherwise(F.col("n_chars"))})
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked on five-word shingles at a similarity of 0.8 the first stays, those without id last."""
    return jaccard.keep_one(docs, "doc_id", "text", jaccard.Rule(words=5, percent=80), nameless=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of a benchmark item go, each by its own text, with or without id."""
    items, number = table(spark, sf_dir, "benchmark"), own(docs, "number")
    # Written, so that both scans see the same numbers.
    marked, _ = held(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = decontaminate.contaminated(marked, number, "text", items, "item_id", "text", min_tokens=1)
    return marked.join(found.select(F.col("doc_id").alias(number)).distinct(), number, "left_anti").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    return encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: Scores of a trained model and exact vocabulary pieces can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = held(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
