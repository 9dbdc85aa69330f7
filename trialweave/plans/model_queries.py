"""Queries that fit models or generate designs; SQL stands beside those it can express."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.operators import centroids, clusters, decoding, design, enhancement, group_models, ordered, regions
from trialweave.sources import adapters as A
from trialweave.sources import files, readers
from trialweave.sources.adapters import SCORES

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
PAIR = ("B", "C")
#: Sign flips of the cluster masses and of the enhanced maps, as the reference has it.
CLUSTER_DRAWS = 5000


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query()
def subject_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated accuracy of two conditions for each subject and phase."""
    return decoding.decode(A.trials(spark, sf_dir), ["subject", "phase"], PAIR)


@query()
def transfer_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of the learning phase on the test phase: probability separation for each subject."""
    t = A.trials(spark, sf_dir)
    m = decoding.models(t.where("phase = 'learn'"), ["subject"], PAIR)
    return decoding.separation(decoding.transfer(t.where("phase = 'test'"), m, ["subject"], PAIR), ["subject"], PAIR)


def _group_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.trials(spark, sf_dir).select("*", *A.groups())
    m = decoding.models(t.where("phase = 'learn'"), ["grp"], PAIR).withColumnRenamed("grp", "model_grp")
    test = t.where("phase = 'test'").join(m, F.col("grp") != F.col("model_grp"))
    return test.where(F.col("condition").isin(*PAIR)).withColumn("score", decoding.score())


@query()
def cross_group_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's model (fitted on a bounded sample of its trials) on the other group's test trials: forced-choice accuracy."""
    return decoding.forced_choice(_group_scored(spark, sf_dir), "subject", PAIR)


@query()
def weight_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance of features with scores under the other group's model."""
    return decoding.haufe(_group_scored(spark, sf_dir), ["model_grp"])


@query()
def trial_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out probabilities of each subject's trials, binned against what they were."""
    p = decoding.leave_one_out(A.trials(spark, sf_dir), ["subject"], PAIR)
    return decoding.calibration(p, [], F.col("condition") == PAIR[1])


@query()
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean importance of each feature over subjects, merged as chunks are."""
    i = decoding.importance(A.trials(spark, sf_dir), ["subject"], PAIR)
    return i.groupBy("pos").agg(F.avg("importance").alias("importance"), F.avg((F.col("p") < 0.05).cast("int")).alias("share_significant"), F.count(F.lit(1)).alias("n_subjects"))


@query()
def nested_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated nested cross-validation over the whole group: weights and pattern of the final model by feature, beside the held-out accuracy."""
    n = group_models.nested(A.trials(spark, sf_dir), PAIR, "subject", decoding.STRENGTHS)
    tested = n.accuracy[np.isfinite(n.accuracy)]
    rows = [(k, float(n.coef[k]), float(n.pattern[k]), float(tested.mean()), float(tested.std()), len(tested), n.strength, n.n_subjects) for k in range(len(n.coef))]
    return spark.createDataFrame(rows, "pos bigint, weight double, pattern double, accuracy double, accuracy_sd double, n_folds bigint, strength double, n_subjects bigint")


@query()
def heldout_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fall of the forced-choice accuracy of held-out subjects when a feature is shuffled."""
    return group_models.importance(A.trials(spark, sf_dir), PAIR, "subject", "trial_idx")


@query()
def crossnobis_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.crossnobis(A.trials(spark, sf_dir), ["subject"])


def _centred_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.maps(spark, sf_dir).withColumn("value", F.col("value") - 25.5)


@query()
def cluster_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family-wise p of cluster masses of the mean map, by sign flips of suppliers."""
    return clusters.family_wise(_centred_maps(spark, sf_dir), A.features(spark, sf_dir), CLUSTER_DRAWS)


@query()
def enhanced_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family-wise p of the mean map with threshold-free enhancement."""
    return enhancement.family_wise(_centred_maps(spark, sf_dir), A.features(spark, sf_dir), CLUSTER_DRAWS)


@query(f"""WITH {SCORES}, c AS (SELECT DISTINCT condition FROM scores), n AS (SELECT condition, row_number() OVER (ORDER BY condition) - 1 AS pos, count(*) OVER () AS n FROM c)
SELECT a.condition || '>' || b.condition AS contrast, array_to_string(list_transform(range(0, a.n), lambda k: CASE WHEN k = a.pos THEN '1' WHEN k = b.pos THEN '-1' ELSE '0' END), ',') AS weights FROM n a JOIN n b ON a.pos <> b.pos
UNION ALL SELECT condition || '>baseline', array_to_string(list_transform(range(0, n), lambda k: CASE WHEN k = pos THEN '1' ELSE '0' END), ',') FROM n
UNION ALL SELECT condition || '>rest', array_to_string(list_transform(range(0, n), lambda k: CASE WHEN k = 0 THEN CAST(n - 1 AS VARCHAR) ELSE '-1' END), ',') FROM n WHERE pos = 0
UNION ALL SELECT 'linear_trend', array_to_string(list_transform(range(0, n), lambda k: CAST(k - (n - 1) // 2 AS VARCHAR)), ',') FROM n WHERE pos = 0""")
def contrast_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrasts generated from the conditions there are."""
    c = A.scores(spark, sf_dir).select("condition")
    every = design.pairwise(c).unionByName(design.against_baseline(c)).unionByName(design.first_against_rest(c)).unionByName(design.linear_trend(c))
    return every.select("contrast", F.array_join(F.transform("weights", lambda x: x.cast("int").cast("string")), ",").alias("weights"))


@query("""WITH s AS (SELECT c_custkey AS subject, c_mktsegment AS grp, CASE WHEN c_nationkey % 2 = 0 THEN 'D1' ELSE 'D2' END AS drug FROM customer),
l AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS k FROM (SELECT DISTINCT grp FROM s)), e AS (SELECT drug, row_number() OVER (ORDER BY drug) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT drug FROM s))
SELECT subject, grp, drug, CAST(l.k * e.n + e.k AS INTEGER) AS cell, CAST(list_position(list_transform(range(0, (SELECT count(*) FROM l) * e.n), lambda x: CASE WHEN x = l.k * e.n + e.k THEN 1 ELSE 0 END), 1) AS BIGINT) AS place FROM s JOIN l USING (grp) JOIN e USING (drug)""")
def factorial_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = design.cells(A.subjects(spark, sf_dir), ["grp", "drug"])
    return d.select("subject", "grp", "drug", "cell", F.array_position("design_row", 1.0).alias("place"))


@query("""WITH e AS (SELECT user_id AS subject, event_type AS condition, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)
SELECT subject, CASE WHEN condition = 'view' AND n > 1 THEN CASE WHEN k = 1 THEN 'view_first' ELSE 'view_others' END ELSE condition END AS split_condition, count(*) AS n_events FROM e GROUP BY ALL""")
def first_trial_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first view of a subject apart from the others."""
    s = readers.first_split(A.scores(spark, sf_dir), ["subject"], "condition", "view", "event_id")
    return s.groupBy("subject", "split_condition").agg(F.count(F.lit(1)).alias("n_events"))


@query("""WITH d AS (SELECT avg(value) + 1.5 * stddev_samp(value) AS lim FROM events) SELECT event_id AS frame FROM events, d WHERE value > lim OR (event_type = 'error' AND value > 95)""")
def spike_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events over the mean by 1.5 deviations, or errors of over 95."""
    e = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("frame"), F.when(F.col("event_type") == "error", F.col("value")).alias("framewise_displacement"), F.col("value").alias("dvars"))
    return readers.spikes(e, fd_limit=95.0)


@query("""SELECT s_suppkey, 'S' || regexp_replace(regexp_replace(trim(s_name), '^Supplier#', ''), '^0+', '') AS label FROM supplier""")
def supplier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels cleaned by prefix and leading zeros."""
    name = F.regexp_replace(F.regexp_replace(readers.subject_id("s_name"), "^Supplier#", ""), "^0+", "")
    return A.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("S"), name).alias("label"))


@query("""WITH m AS (SELECT l_suppkey AS subject, avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS b, avg(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS c FROM lineitem GROUP BY 1)
SELECT subject, round(b / c * 100, 6) AS percent, round((b - c) / (abs(c) + 1e-6) * 100, 6) AS percent_voxel FROM m""")
def signal_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both forms of percent change of one condition against another."""
    of = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    m = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("subject")).agg(of("A").alias("b"), of("N").alias("c"))
    return m.select("subject", F.round(readers.percent_change(F.col("b"), F.col("c")), 6).alias("percent"), F.round(readers.percent_change_voxel(F.col("b"), F.col("c")), 6).alias("percent_voxel"))


@query("""SELECT p_brand AS roi, l_returnflag AS condition, round(avg(l_quantity), 6) AS mean_value, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def region_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region by condition means: the long form of the pivoted report."""
    line = A.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("feature_id"), F.col("l_returnflag").alias("condition"), F.col("l_quantity").alias("value"))
    m = centroids.region_means(line, A.features(spark, sf_dir), ["condition"])
    return m.select("roi", "condition", F.round("mean_value", 6).alias("mean_value"), F.col("n_features").alias("n"))


@query()
def permuted_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of each subject against its own label shuffles."""
    return decoding.permuted_accuracy(A.trials(spark, sf_dir), ["subject"], PAIR)


@query()
def empirical_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each subject whose importance is positive and beyond that of models of shuffled labels (p < 0.05)."""
    f = decoding.shuffled_fits(A.trials(spark, sf_dir), ["subject"], PAIR)
    return f.select("subject", "pos", "importance", F.col("importance_p").alias("p"), ((F.col("importance_p") < 0.05) & (F.col("importance") > 0)).alias("selected"))


@query()
def weight_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of each subject's model against those of shuffled labels: z, p and q over the subject's features."""
    f = decoding.shuffled_fits(A.trials(spark, sf_dir), ["subject"], PAIR, repeats=1)
    q = ordered.bh_within(f.select("subject", "pos", "weight", F.col("weight_z").alias("z"), F.col("weight_p").alias("p")), ["subject"], "p", "pos")
    return q.withColumn("rejected", F.col("q") <= 0.05)


@query()
def bootstrap_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns over draws of subjects from the whole group."""
    pattern, z = group_models.bootstrap(A.trials(spark, sf_dir), PAIR, "subject")
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(pattern, z, strict=True))], "pos bigint, pattern double, z double")


@query()
def calibrated_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated probabilities of trials, binned against what they were."""
    p = decoding.calibrated(A.trials(spark, sf_dir), ["subject"], PAIR)
    return decoding.calibration(p, [], F.col("condition") == PAIR[1])


_CELLS = "WITH m AS (SELECT l_suppkey AS subject, l_partkey AS feature_id, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2), g AS (SELECT feature_id, CASE WHEN subject % 2 = 0 THEN 'G1' ELSE 'G2' END AS grp, CASE WHEN subject // 2 % 2 = 0 THEN 'D1' ELSE 'D2' END AS drug, value FROM m), c AS (SELECT feature_id, avg(value) FILTER (grp = 'G1' AND drug = 'D1') AS a, avg(value) FILTER (grp = 'G1' AND drug = 'D2') AS b, avg(value) FILTER (grp = 'G2' AND drug = 'D1') AS c, avg(value) FILTER (grp = 'G2' AND drug = 'D2') AS d, count(*) FILTER (grp = 'G1' AND drug = 'D1') AS na, count(*) FILTER (grp = 'G1' AND drug = 'D2') AS nb, count(*) FILTER (grp = 'G2' AND drug = 'D1') AS nc, count(*) FILTER (grp = 'G2' AND drug = 'D2') AS nd FROM g GROUP BY feature_id)"


@query(_CELLS + """ SELECT feature_id, contrast, round(effect, 6) AS effect FROM (SELECT feature_id, 'G1_D1>0' AS contrast, a AS effect FROM c WHERE na >= 2 UNION ALL SELECT feature_id, 'G2_D1>0', c FROM c WHERE nc >= 2 UNION ALL SELECT feature_id, 'G1>G2|D1', a - c FROM c WHERE least(na, nc) >= 2
UNION ALL SELECT feature_id, 'D2>D1|G1', b - a FROM c WHERE least(na, nb) >= 2 UNION ALL SELECT feature_id, 'D2>D1|G2', d - c FROM c WHERE least(nc, nd) >= 2 UNION ALL SELECT feature_id, 'interaction', (b - d) - (a - c) FROM c WHERE least(na, nb, nc, nd) >= 2)""")
def map_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and drug effects of every feature of the maps."""
    from trialweave.operators import inference

    m = A.maps(spark, sf_dir).select("feature_id", "value", *A.groups())
    return inference.contrast_battery(m, ["feature_id"], "grp", ("G1", "G2"), "drug", ("D1", "D2"), "value").select("feature_id", "contrast", F.round("effect", 6).alias("effect"))


@query()
def region_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding report of each subject and region, of eight ranges of the vector; every 13th trial is not usable."""
    atlas = spark.createDataFrame([(f"r{k}", 8 * k, 8) for k in range(A.WIDTH // 8)], "region string, start int, size int")
    return regions.report(A.trials(spark, sf_dir), atlas, "subject", ("B", "C"), "A", "learn", "test", usable=F.col("trial_idx") % 13 != 0)


@query()
def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of each table, from the metadata of the folder."""
    found = files.scan(spark, sf_dir, "*.parquet")
    table = F.regexp_extract("path", r"/([A-Za-z_]+)\.parquet(/|$)", 1)
    return found.groupBy(table.alias("table")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))
