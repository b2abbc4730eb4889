"""A training corpus from raw documents: toxic ones go, of near duplicates one stays, benchmark
leaks go, secrets are masked, and what is left is packed into sequences.

Every stage but the last returns the columns of its documents, whatever further ones there are.
Rows that are alike are judged alike, and one of them survives the near duplicates; empty tables
stay empty all the way. No text is too long for a stage: those that need all of a text's words
at once take them one text at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import bagminhash, decontaminate, packing, secrets, store, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of toxicity; null and empty texts stay."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*_named(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest id; null and empty texts are copies of each other."""
    return bagminhash.deduplicated(docs).select(*_named(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null and empty texts stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*_named(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; n_chars, where it isn't null, follows the text. Null texts stay null."""
    out = secrets.masked(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("long"))).select(*_named(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; a null or empty text is one piece of no words, in no sequence."""
    return packing.packed(docs)


def _named(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: The stages learn, draw signatures and pack in an order of their own: no SQL, but brute-force tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's rows are written to the shared folder and read again; a stage's table goes when the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            store.drop(before)
        before = docs
    return docs
