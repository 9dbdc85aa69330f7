"""From raw documents to training shards: five stages, each a table that the next one reads.

All stages take any rows: nulls in every column, empty and very long texts, repeated rows
and ids, extra columns (which go no further), and empty tables, which give empty ones. What
becomes of such rows is told with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm import decontaminate, minhash_join, mixing, quality_crf, slots
from trialweave.llm.scratch import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Tokens that the mixture gives, by those of its input, and how often it may take a document.
MIX_SHARE, MIX_EPOCHS = 1.0, 2
#: Least likeness of near duplicates, in percent of the shingles of both.
NEAR_PERCENT = 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the line model scores under the threshold.

    A null text is scored as an empty one. Repeated rows have equal scores, so all go or all stay. Without usable labels the score is 0.5, under the threshold.
    """
    return quality_crf.keep_good(docs.select(*COLUMNS), _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest id.

    Null and empty texts are near nothing and stay, once for each id. Of rows that repeat id and text one stays; different texts of an id are documents of their own. A row without id always stays.
    """
    return minhash_join.deduplicate(docs.select(*COLUMNS), NEAR_PERCENT)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents in which a benchmark passage occurs.

    Null and empty texts are clean. Each row is judged alone, so repeated rows all go or all stay.
    """
    return decontaminate.decontaminate(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, some of them twice, so that domains, languages and sources come to their weights.

    A null language or source is a value of its own. Texts without words cost nothing of a budget and come with the prefix they fall in. Rows of one id are taken together. The last document of a leaf's prefix has its first words only, and ``n_chars`` follows.
    """
    mixed = mixing.mix(docs.select(*COLUMNS), share=MIX_SHARE, max_epochs=MIX_EPOCHS)
    size = F.char_length("text").cast("bigint")
    return mixed.withColumn("n_chars", F.when(size < F.col("n_chars"), size).otherwise(F.col("n_chars")))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the rows into shards of near equal bytes.

    A null text has size 1. Rows without id share one slot; repeated rows have a place each.
    """
    return slots.shard(docs.select(*COLUMNS))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("clean_of_benchmark", clean_of_benchmark), ("mixture", mixture), ("sharding", sharding)]
#: A trained chain model and signatures have no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
