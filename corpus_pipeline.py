"""A training corpus from documents: five stages, each over all that its predecessor kept.

Each stage is written as Parquet and read again; the last gives how much of each document the mix takes.  All but the last return the
columns of documents, whatever their names.  An empty table goes through all of them as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import decontaminate, exact_dedup, mixing, quality, simhash
from turnwise.llm.shared import quoted, table, unused

#: Documents that are likelier of quality 0 than 1 go.
LEAST_SCORE = 0.5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; it learns from docs and labels.

    Null and empty texts are judged like any other, by the classes' prior; equal texts and repeated rows are judged alike, and a score
    that ties the limit stays.  Long texts are scored whole.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = unused(docs.columns, "quality_score")
    return quality.score(docs, model, name).where(F.col(name) >= LEAST_SCORE).select(*map(quoted, docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id stays.

    Null and empty texts are equal; a null doc_id loses against any other; of rows that tie exactly one stays.
    """
    return exact_dedup.distinct(docs, written=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays.

    Texts without words, null ones too, are near copies of each other; a null doc_id loses against any other; of rows that tie
    exactly one stays, and rows that share a doc_id but not their texts are judged apart.
    """
    return simhash.one_of_each(docs, written=True)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut from the texts; every document stays.

    Null texts stay null, texts without a hit as they are; rows that repeat are cut alike; items without words cut nothing.
    """
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each document.

    Null and empty texts have size 0 and give nothing; a null source is one of its own; rows that repeat are separate documents.
    """
    return mixing.mix(docs)


STAGES = [("quality classifier", classify), ("exact dedup", exact), ("SimHash near-dedup", near), ("benchmark decontamination", decontaminated), ("mixing to target weights", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs


#: The classifier and the fingerprints can't be told in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
