"""Queries that merge chunks, cut and rank, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.operators import merging, ordered
from trialweave.plans.ordered_queries import r6
from trialweave.sources import adapters as A
from trialweave.sources.adapters import FEATURES, MAPS, SCORES

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line number as a chunk of a supplier's map; a chunk without any discount has no mean."""
    held = F.avg(F.when(F.col("l_discount") > 0, F.col("l_quantity")))
    return A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("condition"), "l_linenumber").agg(held.alias("value"), F.count(F.lit(1)).alias("n"))


_CHUNKS = "c AS (SELECT l_suppkey AS subject, l_returnflag AS condition, l_linenumber, avg(CASE WHEN l_discount > 0 THEN l_quantity END) AS value, count(*) AS n FROM lineitem GROUP BY ALL)"


@query(f"WITH {_CHUNKS} SELECT subject, condition, CAST(sum(n) AS BIGINT) AS merged, count(n) AS n_chunks FROM c GROUP BY ALL")
def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.sum_chunks(_chunks(spark, sf_dir), ["subject", "condition"], "n")


@query(f"WITH {_CHUNKS} SELECT subject, condition, round(avg(value), 6) AS merged, count(value) AS n_chunks FROM c GROUP BY ALL")
def merge_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.mean_chunks(_chunks(spark, sf_dir), ["subject", "condition"], "value").select("subject", "condition", *r6("merged"), "n_chunks")


@query(f"""WITH {SCORES}, s AS (SELECT * FROM scores WHERE condition IN ('click', 'view')), n AS (SELECT subject, condition, max(trial_no) AS n FROM s GROUP BY ALL), l AS (SELECT subject, min(n) AS n FROM n GROUP BY subject)
SELECT subject, condition, trial_no, event_id FROM s JOIN l USING (subject) WHERE trial_no <= n""")
def synced_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two series of a subject cut to the shorter one."""
    t = A.scores(spark, sf_dir).where(F.col("condition").isin("click", "view"))
    return merging.same_length(t, ["subject"], "condition", "trial_no").select("subject", "condition", "trial_no", "event_id")


@query("""SELECT l_orderkey AS subject, CASE WHEN count(DISTINCT l_linenumber) = 3 THEN 2.0::DOUBLE * sum(l_quantity) END AS subscale FROM lineitem WHERE l_linenumber IN (1, 2, 3) GROUP BY 1""")
def subscale_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the sum of three items, where all three are there."""
    items = A.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "subject")
    return merging.subscale(items, ["subject"], "l_linenumber", "l_quantity", [1, 2, 3])


@query(f"""WITH {SCORES} SELECT subject, condition, row_number() OVER (PARTITION BY subject, condition ORDER BY trial_no) AS spike, trial_no, 1 AS value FROM scores WHERE score > 90""")
def spike_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.indicators(A.scores(spark, sf_dir), ["subject", "condition"], "trial_no", F.col("score") > 90)


@query(f"""WITH {MAPS}, {FEATURES}, m AS (SELECT roi, round(avg(value), 6) AS mean_value FROM maps JOIN features USING (feature_id) GROUP BY roi) SELECT roi, mean_value, row_number() OVER (ORDER BY mean_value DESC, roi) AS rank FROM m""")
def region_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.maps(spark, sf_dir).join(A.features(spark, sf_dir), "feature_id").groupBy("roi").agg(F.round(F.avg("value"), 6).alias("mean_value"))
    return merging.ranked(m, "mean_value", "roi")


@query(f"""WITH {FEATURES}, p AS (SELECT roi, feature_id, CAST(feature_id * feature_id % 99991 AS DOUBLE) / 99991 / 50 AS p FROM features), r AS (SELECT *, row_number() OVER (ORDER BY p, feature_id) AS k, count(*) OVER () AS m FROM p),
q AS (SELECT roi, feature_id, p, least(1.0, min(p * m / k) OVER (ORDER BY p DESC, feature_id DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)
SELECT roi, feature_id, round(p, 9) AS p, round(q, 9) AS q FROM q WHERE q <= 0.05 ORDER BY p, feature_id LIMIT 20""")
def significant_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty features of the smallest p among those with q up to 0.05, with their regions."""
    p = A.features(spark, sf_dir).select("roi", "feature_id", ((F.col("feature_id") * F.col("feature_id") % 99991).cast("double") / 99991 / 50).alias("p"))
    q = ordered.bh(p, "p").where("q <= 0.05")
    return q.orderBy("p", "feature_id").limit(20).select("roi", "feature_id", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))
