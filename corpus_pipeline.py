"""A training corpus from documents: toxic ones go, near duplicates go, personal data is masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last
return the columns of documents, with any further ones the table has, whatever their names.

Null and empty texts are kept by all stages: they score as clean, link with nothing, have no personal data and become pieces of length 0. Rows without an id
count as documents of their own; of equal rows one stays. An empty table gives no rows. Very long texts are worked on whole, each in one task, and cut only
by the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.llm import jaccard, packing, pii, toxicity
from plansift.llm.common import cut, discard, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of rows that aren't held out."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.train(docs, labels, keep=~toxicity.held_out(F.col("_id")))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by shingle likeness of 0.8 or more, the one of least id stays."""
    return jaccard.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found becomes its kind in brackets; n_chars follows the text."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece: where it lies in which sequence, and its text."""
    return packing.sequences(docs, packing.pack(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again, and deleted once the next one's are."""
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            written: list[str] = []
            docs = cut(docs, written)
            discard(spark, before)  # what the stage has read isn't read again
            before = written
    return docs
