"""Stages that can be broken off and taken up again: blocks of units, and a table of those that are done.

A stage works on units (subjects, voxels, files) in blocks by a hash of their key. Each
block is a Spark job that writes to a folder of its own attempt; then one row of the commit
table names that folder. What was written without a row does not count, so a block may be
tried again at any time. A later run reads the commits, leaves out the blocks that are
there and does the rest. Commits carry the stage's ``version``, which says what the work depends on (its
parameters, its inputs): blocks of another version do not count.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "_commits"
_COMMIT = "version string, block int, blocks int, folder string, n_rows bigint"


def commits(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """version, block, blocks, folder, n_rows of the blocks that are done; one row a block, whatever was tried twice."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{COMMITS}")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], _COMMIT)
    done = spark.read.schema(_COMMIT).parquet(f"{folder}/{COMMITS}").where(F.col("version") == version)
    return done.groupBy("version", "block", "blocks").agg(F.min(F.struct("folder", "n_rows")).alias("_c")).select("version", "block", "blocks", "_c.folder", "_c.n_rows")


def missing(spark: SparkSession, folder: str, version: str, blocks: int) -> DataFrame:
    """block: those without a commit."""
    return spark.range(blocks).select(F.col("id").cast("int").alias("block")).join(commits(spark, folder, version).where(F.col("blocks") == blocks).select("block"), "block", "left_anti")


def block_of(keys: list[str], blocks: int):
    return F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")


def run(units: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame], folder: str, version: str, blocks: int = 16) -> DataFrame:
    """``work`` on every block of ``units`` that is not done, and the rows of all blocks.

    Rows of equal keys are in one block; null keys are one key. An error of ``work`` ends the run and leaves what was
    committed. The number of blocks belongs to a version: with another one nothing counts as done.
    """
    spark = units.sparkSession
    dealt = units.withColumn("_block", block_of(keys, blocks))
    for r in missing(spark, folder, version, blocks).orderBy("block").collect():  # numbers of blocks
        path = f"{folder}/block-{r['block']:06d}-{uuid.uuid4().hex}"
        made = work(dealt.where(F.col("_block") == r["block"]).drop("_block"))
        made.write.parquet(path)
        row = [(version, r["block"], blocks, path, spark.read.schema(made.schema).parquet(path).count())]
        spark.createDataFrame(row, _COMMIT).coalesce(1).write.mode("append").parquet(f"{folder}/{COMMITS}")
    return read(spark, folder, version, blocks, work(dealt.limit(0).drop("_block")).schema)


def read(spark: SparkSession, folder: str, version: str, blocks: int, schema) -> DataFrame:
    """The rows of a stage that is done; an error if a block is missing."""
    done = commits(spark, folder, version).where(F.col("blocks") == blocks).select("folder").collect()
    if len(done) < blocks:
        raise RuntimeError(f"{blocks - len(done)} of {blocks} blocks are missing")
    return spark.read.schema(schema).parquet(*[r["folder"] for r in done])
