"""Queries on neighbourhoods, regions and maps of trials and subjects, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.operators import centroids, geometry, inference, selection, similarity
from trialweave.operators import permutation as perm
from trialweave.plans.ordered_queries import r6
from trialweave.sources import adapters as A
from trialweave.sources.adapters import FEATURES, LONG, MAPS, SUBJECTS, WIDTH

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
KEYS = ["subject", "phase"]
N_PERM = 5000
#: Eight regions of eight elements each.
REGIONS = {f"r{k}": list(range(8 * k, 8 * k + 8)) for k in range(WIDTH // 8)}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


@query(f"""WITH {LONG}, grid AS (SELECT range AS pos, range % 4 AS i, range // 4 % 4 AS j, range // 16 AS k FROM range({WIDTH})),
near AS (SELECT a.pos AS center, b.pos FROM grid a JOIN grid b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1),
two AS (SELECT a.subject, a.phase, a.trial_idx AS trial_a, b.trial_idx AS trial_b, a.pos, a.x, b.x AS y FROM long a JOIN long b ON a.subject = b.subject AND a.phase = b.phase AND b.trial_idx = a.trial_idx + 1 AND a.pos = b.pos)
SELECT subject, phase, trial_a, trial_b, center, round(corr(x, y), 6) AS pearson, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS cosine FROM two JOIN near n ON n.pos = two.pos - 1 GROUP BY ALL""")
def searchlight_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each trial with the next in the cube around each element, on a 4 x 4 x 4 grid."""
    t, pos = A.trials(spark, sf_dir), F.col("id")
    grid = spark.range(WIDTH).select(pos.alias("feature_id"), (pos % 4).alias("i"), (F.floor(pos / 4) % 4).alias("j"), F.floor(pos / 16).alias("k"))
    pairs = t.select(*KEYS, F.col("trial_idx").alias("trial_a"), (F.col("trial_idx") + 1).alias("trial_b"))
    s = similarity.cube_pairs(t, pairs, geometry.box(grid, 1), KEYS)
    return s.select(*KEYS, "trial_a", "trial_b", "center", *r6("pearson", "cosine"))


_SERIES = f"""{LONG}, series AS (SELECT subject, phase, trial_idx, 'r' || (pos - 1) // 8 AS region, avg(x) AS m FROM long GROUP BY ALL),
related AS (SELECT a.subject, a.phase, a.region AS region_a, b.region AS region_b, count(*) AS n_trials, corr(a.m, b.m) AS r FROM series a JOIN series b ON a.subject = b.subject AND a.phase = b.phase AND a.trial_idx = b.trial_idx AND a.region <> b.region GROUP BY ALL)"""


@query(f"WITH {_SERIES} SELECT subject, phase, region_a, region_b, n_trials, round(r, 6) AS r FROM related WHERE r IS NOT NULL AND NOT isnan(r)")
def region_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of the mean series of each two regions over a subject's trials in a phase."""
    return similarity.region_matrix(A.trials(spark, sf_dir), KEYS, REGIONS).select(*KEYS, "region_a", "region_b", "n_trials", *r6("r"))


@query(f"WITH {_SERIES} SELECT phase, region_a AS region, " + ", ".join(f"round(avg(r) FILTER (region_b = '{n}' AND NOT isnan(r)), 6) AS {n}" for n in REGIONS) + " FROM related GROUP BY ALL")
def region_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions by regions for each phase: the mean correlation over subjects, NULL on the diagonal."""
    r = similarity.region_matrix(A.trials(spark, sf_dir), KEYS, REGIONS)
    wide = r.groupBy("phase", F.col("region_a").alias("region")).pivot("region_b", list(REGIONS)).agg(F.avg("r"))
    return wide.select("phase", "region", *r6(*REGIONS))


@query(f"""WITH {LONG}, people AS (SELECT DISTINCT subject, CASE WHEN subject % 2 = 0 THEN 'G1' ELSE 'G2' END AS grp FROM trials WHERE phase = 'learn'), m AS (SELECT subject, pos, avg(x) AS x FROM long WHERE phase = 'learn' GROUP BY ALL),
drawn AS (SELECT unnest(range(0, {N_PERM + 1})) AS perm_id, subject, grp FROM people), placed AS (SELECT *, row_number() OVER (PARTITION BY perm_id ORDER BY md5(perm_id || '-' || subject), subject) AS k FROM drawn),
every AS (SELECT p.perm_id, p.subject, b.grp FROM placed p JOIN placed b ON b.perm_id = 0 AND b.k = p.k WHERE p.perm_id > 0 UNION ALL SELECT 0, subject, grp FROM people),
g AS (SELECT perm_id, pos, avg(x) FILTER (grp = 'G1') AS a, avg(x) FILTER (grp = 'G2') AS b FROM every JOIN m USING (subject) GROUP BY ALL), c AS (SELECT perm_id, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 9) AS c FROM g GROUP BY perm_id), seen AS (SELECT c AS s FROM c WHERE perm_id = 0)
SELECT round(s, 6) AS similarity, count(*) FILTER (c <= s) AS n_below, count(*) FILTER (c >= s) AS n_above, round(least(1, 2 * least(count(*) FILTER (c <= s), count(*) FILTER (c >= s)) / {N_PERM}.0::DOUBLE), 6) AS p, round(avg(c), 6) AS null_mean FROM c, seen WHERE perm_id > 0 GROUP BY s""")
def spatial_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of two groups' mean maps against shuffled groups of subjects."""
    own = centroids.mean_vectors(A.trials(spark, sf_dir).where("phase = 'learn'"), ["subject"], WIDTH, name="map").select("subject", A.groups()[0], "map")
    s = perm.map_similarity(own, "subject", "grp", "G1", "G2", "map", WIDTH, N_PERM)
    return s.select(*r6("similarity"), "n_below", "n_above", *r6("p", "null_mean"))


_TESTED = f"""WITH {MAPS}, {FEATURES}, g AS (SELECT feature_id, count(value) AS n, avg(value - 25) AS mean, stddev_samp(value) AS sd FROM maps GROUP BY feature_id), w AS (SELECT feature_id, mean, mean / (sd / sqrt(n)) AS t, n - 1 AS free FROM g WHERE n >= 3 AND sd > 0),
tested AS (SELECT *, round({A.p_sql('t', 'free')}, 9) AS p FROM w)"""


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = inference.one_sample_t(A.maps(spark, sf_dir).withColumn("value", F.col("value") - 25), ["feature_id"], "value", 3).where("t is not null")
    return t.withColumn("p", F.round("p", 9))


@query(_TESTED + """, k AS (SELECT count(*) AS k FROM tested WHERE mean > 0 AND p < 0.05) SELECT feature_id, round(mean, 6) AS score, round(p, 6) AS p FROM tested, k WHERE mean > 0 AND (k < 20 OR p < 0.05)""")
def importance_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of positive effect with p under 0.05, or all positive ones where these are few."""
    return selection.importance_mask(_tested(spark, sf_dir), "mean", "p").select("feature_id", F.round("mean", 6).alias("score"), *r6("p"))


@query(_TESTED + """ SELECT roi, count(*) AS n_tested, count(*) FILTER (p < 0.05) AS n_significant, count(*) FILTER (p < 0.05 AND mean > 0) AS n_positive, round(avg(mean), 6) AS mean_effect FROM tested JOIN features USING (feature_id) GROUP BY roi""")
def significance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many features of each region are significant, and the mean effect."""
    t = _tested(spark, sf_dir).join(A.features(spark, sf_dir).select("feature_id", "roi"), "feature_id")
    hit = F.col("p") < 0.05
    return t.groupBy("roi").agg(F.count(F.lit(1)).alias("n_tested"), F.count(F.when(hit, 1)).alias("n_significant"), F.count(F.when(hit & (F.col("mean") > 0), 1)).alias("n_positive"), F.round(F.avg("mean"), 6).alias("mean_effect"))


@query("""WITH m AS (SELECT l_suppkey AS subject, l_partkey AS feature_id, avg(CASE WHEN l_discount > 0 THEN l_quantity END) AS value FROM lineitem GROUP BY 1, 2)
SELECT feature_id, count(*) AS n, round(var_pop(value), 6) AS variance FROM m GROUP BY feature_id HAVING count(*) = count(value) AND var_pop(value) > 0""")
def valid_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with a value in all their maps, and not the same one in all."""
    held = F.avg(F.when(F.col("l_discount") > 0, F.col("l_quantity")))
    m = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("feature_id")).agg(held.alias("value"))
    return selection.valid_features(m, ["feature_id"], "value").select("feature_id", "n", *r6("variance"))


@query(f"""WITH {SUBJECTS}, d AS (SELECT o_custkey AS subject, o_orderpriority AS display, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT subject, grp, display, o_orderkey AS first_order FROM subjects LEFT JOIN (SELECT * FROM d WHERE k = 1) USING (subject)""")
def display_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with the first of their rows in a table that repeats subjects, NULL without any."""
    d = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("display"), F.col("o_orderkey").alias("first_order"))
    return A.subjects(spark, sf_dir).join(selection.first_rows(d, ["subject"], "first_order"), "subject", "left").select("subject", "grp", "display", "first_order")


@query("""SELECT c_custkey AS subject, CASE left(CAST(c_custkey AS VARCHAR), 1) WHEN '1' THEN 'patient' WHEN '2' THEN 'control' END AS grp FROM customer""")
def prefix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of a subject from the first digit of its id."""
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"))
    return c.select("subject", selection.group_of_prefix("subject", {"1": "patient", "2": "control"}).alias("grp"))
