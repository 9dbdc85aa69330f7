"""Trial tables from the given parquet tables.

``trials``: subject, phase, condition, trial_idx, features. Every 48 vectors are one
subject, the first 24 its learning phase, so the number of subjects grows with the table
while a subject's trials do not.
``scores``: subject, condition, trial_no, score, from events. ``subjects``: subject, grp,
drug, clinical score, from customers. ``maps``: subject, feature_id, value, from line
items. ``features``: feature_id, roi and voxel (i, j, k), from parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH = 64
PER_SUBJECT = 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(v / PER_SUBJECT).cast("bigint").alias("subject"),
        F.when(F.floor(v / (PER_SUBJECT // 2)) % 2 == 0, "learn").otherwise("test").alias("phase"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("label") % 3 + 1).cast("int")).alias("condition"),
        v.alias("trial_idx"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("condition"), F.row_number().over(order).cast("bigint").alias("trial_no"), F.col("value").alias("score"), "event_id", "ts")


def groups(subject: str = "subject") -> tuple:
    """Group and drug of a subject id, two by two."""
    s = F.col(subject)
    return F.when(s % 2 == 0, "G1").otherwise("G2").alias("grp"), F.when(F.floor(s / 2) % 2 == 0, "D1").otherwise("D2").alias("drug")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("grp"), F.when(F.col("c_nationkey") % 2 == 0, "D1").otherwise("D2").alias("drug"), F.col("c_acctbal").alias("clinical"))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("feature_id")).agg(F.avg("l_quantity").alias("value"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("feature_id"), F.col("p_brand").alias("roi"), F.col("p_size").cast("bigint").alias("size"), (k % 20).alias("i"), (F.floor(k / 20) % 20).alias("j"), F.floor(k / 400).alias("k"), F.col("p_retailprice").alias("weight"))


#: The same tables for the checking SQL, as CTEs.
TRIALS = """trials AS (SELECT vec_id // 48 AS subject, CASE WHEN (vec_id // 24) % 2 = 0 THEN 'learn' ELSE 'test' END AS phase, ['A', 'B', 'C'][label % 3 + 1] AS condition,
  vec_id AS trial_idx, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS features FROM embeddings)"""
LONG = TRIALS + """, long AS (SELECT subject, phase, condition, trial_idx, generate_subscripts(features, 1) AS pos, unnest(features) AS x FROM trials)"""
SCORES = """scores AS (SELECT user_id AS subject, event_type AS condition, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS trial_no, value AS score, event_id, ts FROM events)"""
MAPS = """maps AS (SELECT l_suppkey AS subject, l_partkey AS feature_id, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"""
SUBJECTS = """subjects AS (SELECT c_custkey AS subject, c_mktsegment AS grp, CASE WHEN c_nationkey % 2 = 0 THEN 'D1' ELSE 'D2' END AS drug, c_acctbal AS clinical FROM customer)"""
FEATURES = """features AS (SELECT p_partkey AS feature_id, p_brand AS roi, CAST(p_size AS BIGINT) AS size, p_partkey % 20 AS i, p_partkey // 20 % 20 AS j, p_partkey // 400 AS k, p_retailprice AS weight FROM part)"""


def group_sql(s: str) -> str:
    return f"CASE WHEN {s} % 2 = 0 THEN 'G1' ELSE 'G2' END AS grp, CASE WHEN {s} // 2 % 2 = 0 THEN 'D1' ELSE 'D2' END AS drug"


def p_sql(t: str, free: str) -> str:
    """Two-sided p of a t in SQL: Simpson's rule with 2,000 steps on the density over the angle atan(t / sqrt(df))."""
    angle = f"atan(abs({t}) / sqrt({free}))"
    area = f"list_sum(list_transform(range(0, 2001), lambda k: CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(cos({angle} * k / 2000), {free} - 1)))"
    return f"greatest(0, 1 - 2 * exp(lgamma(({free} + 1) / 2.0::DOUBLE) - lgamma({free} / 2.0::DOUBLE)) / sqrt(pi()) * {angle} / 6000 * {area})"


def q_sql(source: str, keys: str, tie: str) -> str:
    """Benjamini-Hochberg q of ``p`` as CTEs ranked_q and with_q over a table, within keys (SQL text, may be empty)."""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"ranked_q AS (SELECT *, row_number() OVER ({part} ORDER BY p, {tie}) AS place, count(*) OVER ({part}) AS size_of FROM {source}), with_q AS (SELECT *, least(1.0, min(p * size_of / place) OVER ({part} ORDER BY p DESC, {tie} DESC ROWS UNBOUNDED PRECEDING)) AS q FROM ranked_q)"
