"""The corpus pipeline: toxicity, near-dedup, substring dedup, PII, packing. Part of subpackage llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldsieve.llm import lineage, near_dedup, packing, pii, queries, substring_dedup, toxicity
from fieldsieve.shipping import ship
from fieldsieve.tables import spread

TOXIC = 0.7
SHINGLE, NUM, DEN = 5, 80, 100
#: Words of a passage that counts as repeated; shorter common passages (licences, greetings) stay.
PASSAGE = 40
SEQUENCE, END_ID = 4096, 1

#: A stage of a classifier and one of a tokenizer can't be told in SQL; tests compare with brute force.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 stay as they are; the lexicon is learnt from labelled rows of `docs`. Null texts stay."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels), TOXIC)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id; a row without an id stays."""
    ship(spark)
    return near_dedup.drop_near_duplicates(docs, SHINGLE, NUM, DEN)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 40 words or more that stand earlier in the corpus are cut out of the texts; all rows stay."""
    ship(spark)
    return substring_dedup.drop_repeats(docs, PASSAGE)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities in the texts are replaced by surrogates; all rows stay."""
    ship(spark)
    return pii.replace_entities(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids of all documents, packed into sequences of 4096."""
    ship(spark)
    return packing.packed_documents(docs, queries.tokenizer_path(), SEQUENCE, END_ID)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole of documents."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        docs = lineage.cut(stage(spark, docs, sf_dir), name)
    return docs
