"""A training-data pipeline: five stages, each written and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import exact_dedup, ngram_join, packing, pii, toxicity
from orrery.llm.common import remove, shared_dir, table, whole_row


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows among them, doesn't call toxic.

    Null and empty texts score as the model's bias; rows that repeat an id are scored each; an empty table gives no rows.
    """
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id; null text is empty text. An empty table gives no rows."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near copies.

    Rows without an id, and null and empty texts, stay; rows that repeat an id stay or go together. An empty table gives no rows.
    """
    found = ngram_join.ngram_components(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the personal data in their texts replaced by its kind; n_chars counts a new text and else stays.

    Null text stays null, empty text empty; ids and repeated rows play no part. An empty table gives no rows.
    """
    rows = docs.select(whole_row(docs.columns), F.col("text").alias("text"))
    masked = pii.mask(pii.find_pii(rows, out_col="_pii"), spans_col="_pii")
    changed = F.size("_pii") > 0
    new = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("_row.n_chars"))}
    return masked.select(*(new.get(k, F.col("_row")[k]).alias(k) for k in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their tokens. Null and empty texts are their end token alone; an empty table gives no rows."""
    import public_tokenizers

    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("pii", mask_personal_data), ("packing", pack)]

#: The first stage fits a model, which SQL can't express; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is removed once the next one is written; the last one stays, for the caller to remove."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
