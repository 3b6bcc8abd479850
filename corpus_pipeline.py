"""Five stages over documents: language, near-duplicates, benchmark leaks, PII, mixture.

Each takes (spark, docs, sf_dir); its result is written as Parquet and read as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelens.llm import decontam, langid, mixing, pii, simhash
from probelens.llm.common import written

#: a document whose likeliest language has less than this share is no text of a language
LEAST_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter (null and empty texts too), or without a language of LEAST_SHARE, go.

    Rows may repeat, lack an id, and have further columns of any name: a row is judged by its text alone.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    found = langid.identify(rows, langid.learn(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the smallest doc_id, or a row without an id where the group has no other.

    Null and wordless texts are one group. Ids may repeat: rows are grouped by their texts.
    """
    return simhash.keep_one(docs, nameless_apart=False)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null and empty texts have none. A row is judged by its text alone."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with surrogates for personal data, by the session's key, or a public one, so that reruns agree."""
    return pii.replace_pii(docs, key=spark.conf.get("spark.probelens.pii.key", None) or "public")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: documents with their target, words taken and positions.

    Ids may repeat or be null; documents without words, and those that the targets don't reach, are not in the mix.
    Columns of documents named like one of the mix's give way to it.
    """
    return mixing.mix(docs, keep=True).where("taken > 0")


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", private_data), ("mixture", mixture)]

#: SimHash and the language model can't be expressed in SQL: tests/llm compares run() with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
