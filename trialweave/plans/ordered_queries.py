"""Queries on scalar trials, maps and regions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.operators import centroids, inference, ordered
from trialweave.operators import permutation as perm
from trialweave.sources import adapters as A
from trialweave.sources.adapters import FEATURES, MAPS, SCORES, SUBJECTS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
KEYS = ["subject", "condition"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query(f"""WITH {SCORES}, h AS (SELECT *, CASE WHEN trial_no <= count(*) OVER (PARTITION BY subject, condition) // 2 THEN 'H1' ELSE 'H2' END AS half FROM scores),
c AS (SELECT subject, condition, avg(CASE WHEN half = 'H1' THEN score END) AS first, avg(CASE WHEN half = 'H2' THEN score END) AS second, regr_slope(score, trial_no) AS slope, count(*) AS n FROM h GROUP BY ALL)
SELECT {A.group_sql('subject')}, condition, count(*) AS n_subjects, round(avg(second - first), 6) AS mean_change, round(stddev_samp(second - first) / sqrt(count(second - first)), 6) AS sem_change, round(avg(slope), 6) AS mean_slope
FROM c WHERE n >= 4 GROUP BY ALL""")
def drift_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change from first to second half and slope over trials, by group, drug and condition."""
    h = ordered.halves(A.scores(spark, sf_dir), KEYS, ["trial_no"])
    part = lambda x: F.avg(F.when(F.col("half") == x, F.col("score")))
    c = h.groupBy(*KEYS).agg((part("H2") - part("H1")).alias("change"), F.regr_slope("score", "trial_no").alias("slope"), F.count(F.lit(1)).alias("n")).where("n >= 4")
    out = c.select("*", *A.groups()).groupBy("grp", "drug", "condition").agg(F.count(F.lit(1)).alias("n_subjects"), F.avg("change").alias("mean_change"), (F.stddev_samp("change") / F.sqrt(F.count("change"))).alias("sem_change"), F.avg("slope").alias("mean_slope"))
    return out.select("grp", "drug", "condition", "n_subjects", *r6("mean_change", "sem_change", "mean_slope"))


@query(f"""WITH {SCORES}, r AS (SELECT *, count(*) OVER (PARTITION BY subject, condition) AS n FROM scores)
SELECT subject, condition, event_id, trial_no, CASE WHEN trial_no <= n // 2 THEN 'H1' ELSE 'H2' END AS half, CASE WHEN n - trial_no < 4 THEN 'Late' WHEN trial_no <= 4 THEN 'Early' END AS stage,
 CASE WHEN n >= 8 THEN CASE WHEN n - trial_no < 4 THEN 'Late' WHEN trial_no <= 4 THEN 'Early' END END AS slice, (trial_no - 1) // 3 + 1 AS block FROM r""")
def trial_order_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter, halves, early and late (late wins), guarded slices, blocks of three."""
    t = A.scores(spark, sf_dir)
    t = ordered.halves(t, KEYS, ["trial_no"])
    t = ordered.early_late(t, KEYS, ["trial_no"])
    t = ordered.slices(t, KEYS, ["trial_no"], name="slice")
    return t.select(*KEYS, "event_id", "trial_no", "half", "stage", "slice", ordered.block(F.col("trial_no"), 3).alias("block"))


@query(f"""WITH {SCORES} SELECT subject, condition, count(*) AS n_points, CASE WHEN count(*) >= 3 THEN round(regr_slope(score, trial_no), 6) END AS slope FROM scores GROUP BY ALL""")
def trial_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.slopes(A.scores(spark, sf_dir), KEYS, "trial_no", "score", 3).select(*KEYS, "n_points", *r6("slope"))


@query(f"""WITH {SCORES}, w AS (SELECT subject, avg(CASE WHEN condition = 'click' THEN score END) AS m_click, avg(CASE WHEN condition = 'view' THEN score END) AS m_view, avg(CASE WHEN condition = 'purchase' THEN score END) AS m_purchase,
 regr_slope(CASE WHEN condition = 'click' THEN score END, trial_no) AS s_click, regr_slope(CASE WHEN condition = 'view' THEN score END, trial_no) AS s_view FROM scores GROUP BY subject)
SELECT subject, round(m_click, 6) AS mean_click, round(m_view, 6) AS mean_view, round(m_purchase, 6) AS mean_purchase, round(m_click - m_view, 6) AS click_less_view, round(m_click - m_purchase, 6) AS click_less_purchase, round(s_click, 6) AS slope_click, round(s_view, 6) AS slope_view FROM w""")
def score_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per subject: means by condition, their differences, slopes."""
    of = lambda c: F.when(F.col("condition") == c, F.col("score"))
    w = A.scores(spark, sf_dir).groupBy("subject").agg(*[F.avg(of(c)).alias(f"mean_{c}") for c in ("click", "view", "purchase")], *[F.regr_slope(of(c), F.col("trial_no")).alias(f"slope_{c}") for c in ("click", "view")])
    w = w.withColumn("click_less_view", F.col("mean_click") - F.col("mean_view")).withColumn("click_less_purchase", F.col("mean_click") - F.col("mean_purchase"))
    return w.select("subject", *r6("mean_click", "mean_view", "mean_purchase", "click_less_view", "click_less_purchase", "slope_click", "slope_view"))


@query(f"""WITH {SCORES} SELECT {A.group_sql('subject')}, condition, round(avg(score), 6) AS mean, round(stddev_samp(score) / sqrt(count(score)), 6) AS sem, count(score) AS n FROM scores GROUP BY ALL""")
def condition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.scores(spark, sf_dir).select("*", *A.groups())
    return centroids.summary(t, ["grp", "drug", "condition"], "score").select("grp", "drug", "condition", *r6("mean", "sem"), "n")


@query(f"""WITH {SCORES} SELECT condition, count(score) AS n, round(var_pop(score), 6) AS variance, round(stddev_pop(score), 6) AS deviation, round(kurtosis_pop(score), 5) AS kurtosis,
 round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q75 FROM scores GROUP BY condition""")
def score_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.moments(A.scores(spark, sf_dir), ["condition"], "score").select("condition", "n", *r6("variance", "deviation"), F.round("kurtosis", 5).alias("kurtosis"), *r6("q25", "median", "q75"))


_P = "CAST(feature_id * 7919 % 100003 AS DOUBLE) / 100003"
_BINNED = f"""WITH {SCORES}, s AS (SELECT condition, least(greatest(score / 100, 0), 1) AS p FROM scores), b AS (SELECT condition, least(CAST(floor(p / (1.0::DOUBLE / 20)) AS BIGINT), 19) AS bin, count(*) AS n FROM s GROUP BY ALL)
, d AS (SELECT condition, bin, n, n / (sum(n) OVER (PARTITION BY condition) * (1.0::DOUBLE / 20)) AS density FROM b)"""


@query(_BINNED + " SELECT condition, bin, n, round(density, 6) AS density FROM d")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.scores(spark, sf_dir).select("condition", F.least(F.greatest(F.col("score") / 100, F.lit(0.0)), F.lit(1.0)).alias("p"))
    return centroids.histogram(p, ["condition"], "p").select("condition", "bin", "n", *r6("density"))


@query(_BINNED + ", t AS (SELECT condition, sum(density) + 20 * 1e-9 AS total, sum((density + 1e-9) * ln(density + 1e-9)) + (20 - count(*)) * 1e-9 * ln(1e-9) AS part FROM d GROUP BY condition) SELECT condition, round(ln(total) - part / total, 6) AS entropy FROM t")
def score_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.scores(spark, sf_dir).select("condition", F.least(F.greatest(F.col("score") / 100, F.lit(0.0)), F.lit(1.0)).alias("p"))
    return centroids.histogram_entropy(centroids.histogram(p, ["condition"], "p"), ["condition"]).select("condition", *r6("entropy"))


@query(f"""WITH {SCORES}, p AS (SELECT subject, least(greatest(score / 100, 1e-9), 1 - 1e-9) AS p, condition FROM scores)
SELECT subject, round(avg(-(p * log2(p) + (1 - p) * log2(1 - p))), 6) AS entropy, round(avg(abs(p - 0.5)), 6) AS margin, round(avg(CASE WHEN condition = 'click' THEN p END) - avg(CASE WHEN condition = 'view' THEN p END), 6) AS separation FROM p GROUP BY subject""")
def probability_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bernoulli entropy in bits, decision margin, separation of two conditions."""
    from trialweave.functions import vectors as V

    p = A.scores(spark, sf_dir).withColumn("p", F.least(F.greatest(F.col("score") / 100, F.lit(1e-9)), F.lit(1 - 1e-9)))
    of = lambda c: F.avg(F.when(F.col("condition") == c, F.col("p")))
    return p.groupBy("subject").agg(F.avg(V.bernoulli_entropy(F.col("p"))).alias("entropy"), F.avg(V.decision_margin(F.col("p"))).alias("margin"), (of("click") - of("view")).alias("separation")).select("subject", *r6("entropy", "margin", "separation"))


@query(f"""WITH {MAPS}, {FEATURES} SELECT subject, roi, round(avg(value), 6) AS mean_value, count(value) AS n_features FROM maps JOIN features USING (feature_id) GROUP BY ALL""")
def region_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.region_means(A.maps(spark, sf_dir), A.features(spark, sf_dir), ["subject"]).select("subject", "roi", *r6("mean_value"), "n_features")


@query(f"""WITH {MAPS} SELECT feature_id, round(avg(value), 6) AS mean_value, count(value) AS n_subjects FROM maps GROUP BY feature_id""")
def group_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.group_map(A.maps(spark, sf_dir), ["feature_id"]).select("feature_id", *r6("mean_value"), "n_subjects")


@query("""WITH c AS (SELECT l_suppkey AS subject, l_returnflag AS condition, l_linenumber AS chunk, avg(l_quantity) AS value, count(*) AS weight FROM lineitem GROUP BY ALL)
SELECT subject, condition, round(sum(value * weight) / sum(weight), 6) AS merged, CAST(sum(weight) AS BIGINT) AS weight FROM c GROUP BY ALL""")
def merge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk means merged by their weights."""
    c = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("condition"), "l_linenumber").agg(F.avg("l_quantity").alias("value"), F.count(F.lit(1)).alias("weight"))
    return centroids.weighted_mean(c, ["subject", "condition"], "value", "weight").select("subject", "condition", *r6("merged"), "weight")


@query(f"""WITH {MAPS}, p AS (SELECT feature_id, {_P} AS p FROM maps GROUP BY feature_id), r AS (SELECT *, row_number() OVER (ORDER BY p, feature_id) AS k, count(*) OVER () AS m FROM p)
SELECT feature_id, round(p, 9) AS p, round(least(1.0, min(p * m / k) OVER (ORDER BY p DESC, feature_id DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM r""")
def fdr_over_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benjamini-Hochberg q of every feature."""
    p = A.maps(spark, sf_dir).select("feature_id").distinct().withColumn("p", (F.col("feature_id") * 7919 % 100003).cast("double") / 100003)
    return ordered.bh(p, "p").select("feature_id", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@query(f"""WITH {FEATURES}, p AS (SELECT roi, feature_id, {_P} AS p FROM features), r AS (SELECT *, row_number() OVER (PARTITION BY roi ORDER BY p, feature_id) AS k, count(*) OVER (PARTITION BY roi) AS m FROM p),
q AS (SELECT roi, feature_id, least(1.0, min(p * m / k) OVER (PARTITION BY roi ORDER BY p DESC, feature_id DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)
SELECT roi, feature_id, round(q, 9) AS q, q <= 0.05 AS rejected FROM q""")
def fdr_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.features(spark, sf_dir).withColumn("p", (F.col("feature_id") * 7919 % 100003).cast("double") / 100003)
    q = ordered.bh(p, "p", keys=["roi"])
    return q.select("roi", "feature_id", F.round("q", 9).alias("q"), (F.col("q") <= 0.05).alias("rejected"))


@query(f"""WITH {SUBJECTS}, a AS (SELECT avg(clinical) AS m, stddev_pop(clinical) AS s FROM subjects), k AS (SELECT subject, CASE WHEN abs((clinical - m) / s) <= 1.6 THEN clinical END AS v FROM subjects, a), b AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM k)
SELECT subject, round((v - m) / s, 6) AS z FROM k, b""")
def clinical_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-pass z-scores; the limit is low so that this table has outliers."""
    return ordered.z_without_outliers(A.subjects(spark, sf_dir), "clinical", 1.6).select("subject", *r6("z"))


@query(f"""WITH {FEATURES}, c AS (SELECT roi, count(*) AS n FROM features GROUP BY roi) SELECT roi, n, CAST(coalesce(sum(n) OVER (ORDER BY roi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins FROM c""")
def region_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.offsets(A.features(spark, sf_dir).groupBy("roi").agg(F.count(F.lit(1)).alias("n")), "roi", "n")


@query(f"""WITH {FEATURES}, z AS (SELECT roi, feature_id, weight, percent_rank() OVER (ORDER BY weight) AS pr FROM features), t AS (SELECT quantile_cont(weight, 0.95) AS cut FROM features)
SELECT roi, CAST(sum(CASE WHEN weight >= cut AND weight > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_selected, round(100 * avg(CASE WHEN weight >= cut AND weight > 0 THEN 1 ELSE 0 END), 6) AS percent FROM z, t GROUP BY roi""")
def percentile_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features at or over the 95th percentile, counted by region."""
    f = A.features(spark, sf_dir)
    cut = ordered.quantiles(f, [], "weight", {"cut": 0.95})
    sel = f.crossJoin(F.broadcast(cut)).withColumn("sel", F.when((F.col("weight") >= F.col("cut")) & (F.col("weight") > 0), 1).otherwise(0))
    return sel.groupBy("roi").agg(F.sum("sel").alias("n_selected"), (100 * F.avg("sel")).alias("percent")).select("roi", "n_selected", *r6("percent"))


@query(f"""WITH {MAPS}, g AS (SELECT feature_id, avg(value) - 25 AS effect FROM maps GROUP BY feature_id) SELECT feature_id, round(effect, 6) AS effect FROM g ORDER BY round(abs(effect), 9) DESC, feature_id LIMIT 10""")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest effects by absolute value; ties by feature."""
    g = A.maps(spark, sf_dir).groupBy("feature_id").agg((F.avg("value") - 25).alias("effect"))
    return g.orderBy(F.round(F.abs("effect"), 9).desc(), "feature_id").limit(10).select("feature_id", *r6("effect"))


@query(f"""WITH {SCORES}, o AS (SELECT o_custkey AS subject, count(*) AS n_orders, sum(o_totalprice) AS spent FROM orders GROUP BY 1), {SUBJECTS}, e AS (SELECT subject, avg(score) AS mean_score FROM scores GROUP BY subject)
SELECT subject, grp, drug, clinical, n_orders, round(spent, 2) AS spent, round(mean_score, 6) AS mean_score FROM subjects JOIN o USING (subject) LEFT JOIN e USING (subject)""")
def clinical_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with their order totals (inner) and score means (left)."""
    o = A.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("spent"))
    e = A.scores(spark, sf_dir).groupBy("subject").agg(F.avg("score").alias("mean_score"))
    return A.subjects(spark, sf_dir).join(o, "subject").join(e, "subject", "left").select("subject", "grp", "drug", "clinical", "n_orders", F.round("spent", 2).alias("spent"), *r6("mean_score"))


@query("""SELECT c_custkey AS subject FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def missing_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects without any record: an anti join."""
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"))
    return c.join(A.table(spark, sf_dir, "orders"), F.col("subject") == F.col("o_custkey"), "left_anti")


def _subject_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.scores(spark, sf_dir).groupBy(*KEYS).agg(F.avg("score").alias("m")).select("*", *A.groups())


_MEANS = f"WITH {SCORES}, s AS (SELECT subject, condition, avg(score) AS m FROM scores GROUP BY ALL), g AS (SELECT *, {A.group_sql('subject')} FROM s)"


_ARMS = "a AS (SELECT condition, avg(m) FILTER (grp = 'G1') AS ma, avg(m) FILTER (grp = 'G2') AS mb, var_samp(m) FILTER (grp = 'G1') AS va, var_samp(m) FILTER (grp = 'G2') AS vb, count(m) FILTER (grp = 'G1') AS na, count(m) FILTER (grp = 'G2') AS nb FROM g GROUP BY condition)"


@query(_MEANS + f""", {_ARMS}, w AS (SELECT condition, ma - mb AS difference, (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS free, (ma - mb) / sqrt((va + vb) / 2) AS cohen_d FROM a),
tested AS (SELECT *, {A.p_sql('t', 'free')} AS p FROM w), {A.q_sql('tested', '', 'condition')}
SELECT condition, round(difference, 6) AS difference, round(t, 6) AS t, round(free, 5) AS df, round(cohen_d, 6) AS cohen_d, round(p, 6) AS p, round(q, 6) AS q FROM with_q""")
def welch_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Welch's t of the groups in each condition, q over conditions."""
    w = inference.welch_t(_subject_means(spark, sf_dir), ["condition"], "grp", "G1", "G2", "m")
    return ordered.bh(w, "p").select("condition", *r6("difference", "t"), F.round("df", 5).alias("df"), *r6("cohen_d", "p", "q"))


@query(_MEANS + f""", {_ARMS}, v AS (SELECT *, ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) AS v FROM a), w AS (SELECT condition, ma - mb AS difference, (ma - mb) / sqrt(v * (1.0 / na + 1.0 / nb)) AS t, (ma - mb) / sqrt(v) AS cohen_d, CAST(na + nb - 2 AS BIGINT) AS df FROM v)
SELECT condition, round(difference, 6) AS difference, round(t, 6) AS t, round(cohen_d, 6) AS cohen_d, df, round({A.p_sql('t', 'df')}, 6) AS p FROM w""")
def student_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _subject_means(spark, sf_dir)
    return inference.two_sample_t(s, ["condition"], "grp", "G1", "G2", "m").select("condition", *r6("difference", "t", "cohen_d"), F.col("df").cast("bigint").alias("df"), *r6("p"))


@query(_MEANS + f""", w AS (SELECT grp, condition, count(m) AS n, avg(m - 50) AS mean, avg(m - 50) / (stddev_samp(m) / sqrt(count(m))) AS t, count(m) - 1 AS df FROM g GROUP BY ALL), tested AS (SELECT *, {A.p_sql('t', 'df')} AS p FROM w), {A.q_sql('tested', 'grp', 'condition')}
SELECT grp, condition, n, round(mean, 6) AS mean, round(t, 6) AS t, df, round(p, 6) AS p, round(q, 6) AS q FROM with_q""")
def one_sample_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means against the middle of the scale, q over each group's conditions."""
    w = inference.one_sample_t(_subject_means(spark, sf_dir).withColumn("m", F.col("m") - 50), ["grp", "condition"], "m")
    return ordered.bh(w, "p", keys=["grp"]).select("grp", "condition", "n", *r6("mean", "t"), "df", *r6("p", "q"))


@query()
def student_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided p, q over conditions, stars and signed z of the group differences; tails are not in SQL."""
    t = inference.two_sample_t(_subject_means(spark, sf_dir), ["condition"], "grp", "G1", "G2", "m")
    t = ordered.bh(t, "p")
    return t.select("condition", *r6("difference", "t", "p", "q"), inference.stars(F.col("p")).alias("stars"), F.round(inference.signed_z(F.col("difference"), F.col("p")), 6).alias("z"))


@query(f"""WITH {SCORES}, x AS (SELECT condition, score, {A.group_sql('subject')} FROM scores), v AS (SELECT DISTINCT condition, score FROM x),
c AS (SELECT condition, score, count(*) FILTER (grp = 'G1') AS a, count(*) FILTER (grp = 'G2') AS b FROM x GROUP BY ALL), f AS (SELECT condition, abs(CAST(sum(a) OVER w AS DOUBLE) / sum(a) OVER (PARTITION BY condition) - CAST(sum(b) OVER w AS DOUBLE) / sum(b) OVER (PARTITION BY condition)) AS d, a, b FROM c WINDOW w AS (PARTITION BY condition ORDER BY score))
, m AS (SELECT condition, max(d) AS ks, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b FROM f GROUP BY condition), l AS (SELECT *, ks * sqrt(CAST(n_a AS DOUBLE) * n_b / (n_a + n_b)) AS l FROM m)
SELECT condition, round(ks, 6) AS ks, n_a, n_b, round(CASE WHEN l < 0.2 THEN 1 ELSE least(1, greatest(0, list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0::DOUBLE * k * k * l * l))))) END, 6) AS p FROM l""")
def score_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of the groups' scores, and its p."""
    x = A.scores(spark, sf_dir).select("*", *A.groups())
    return inference.ks(x, ["condition"], "grp", "G1", "G2", "score").select("condition", *r6("ks"), "n_a", "n_b", *r6("p"))


_MERGED = f"""WITH {SUBJECTS}, o AS (SELECT o_custkey AS subject, count(*) AS n_orders, sum(o_totalprice) AS spent, avg(o_totalprice) AS mean_price FROM orders GROUP BY 1), m AS (SELECT * FROM subjects JOIN o USING (subject))"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(F.count(F.lit(1)).cast("double").alias("n_orders"), F.sum("o_totalprice").alias("spent"), F.avg("o_totalprice").alias("mean_price"))
    return A.subjects(spark, sf_dir).join(o, "subject")


@query(_MERGED + """, l AS (SELECT grp, clinical, unnest(['n_orders', 'spent', 'mean_price']) AS metric, unnest([CAST(n_orders AS DOUBLE), spent, mean_price]) AS value FROM m), c AS (SELECT grp, metric, count(*) AS n, CASE WHEN count(*) >= 6 THEN corr(value, clinical) END AS r FROM l GROUP BY ALL), w AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c)
SELECT grp, metric, n, round(r, 6) AS r, round(t, 5) AS t, """ + f"round({A.p_sql('t', '(n - 2)')}, 6) AS p FROM w")
def clinical_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inference.correlations(_merged(spark, sf_dir), ["grp"], ["n_orders", "spent", "mean_price"], "clinical")
    return c.select("grp", "metric", "n", *r6("r"), F.round("t", 5).alias("t"), *r6("p"))


@query(_MERGED + """, c AS (SELECT grp, count(*) AS n, corr(spent, clinical) AS xy, corr(spent, n_orders) AS xz, corr(clinical, n_orders) AS yz FROM m GROUP BY grp), w AS (SELECT grp, n, xy AS r, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS partial_r FROM c), v AS (SELECT *, partial_r * sqrt((n - 2) / (1 - partial_r * partial_r)) AS t FROM w)
SELECT grp, n, round(r, 6) AS r, round(partial_r, 6) AS partial_r, """ + f"round({A.p_sql('t', '(n - 2)')}, 6) AS p FROM v")
def clinical_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.partial_correlation(_merged(spark, sf_dir), ["grp"], "spent", "clinical", "n_orders").select("grp", "n", *r6("r", "partial_r", "p"))


@query(_MERGED + """, c AS (SELECT grp, CAST(count(*) AS DOUBLE) AS n, regr_slope(spent, clinical) AS slope, regr_intercept(spent, clinical) AS intercept, regr_sxx(spent, clinical) AS xx, regr_syy(spent, clinical) AS yy, regr_sxy(spent, clinical) AS xy FROM m GROUP BY grp), w AS (SELECT *, slope / sqrt((yy - slope * xy) / (n - 2) / xx) AS t FROM c)
SELECT grp, n, round(slope, 4) AS slope, round(intercept, 3) AS intercept, round(t, 5) AS t, round(xy * xy / (xx * yy), 6) AS r2, """ + f"round({A.p_sql('t', '(n - 2)')}, 6) AS p FROM w")
def clinical_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inference.ols(_merged(spark, sf_dir), ["grp"], "clinical", "spent")
    return c.select("grp", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("t", 5).alias("t"), *r6("r2", "p"))


@query(_MEANS + """, c AS (SELECT condition, grp, drug, count(m) AS n, avg(m) AS mean, var_pop(m) * count(m) AS ss FROM g GROUP BY ALL), t AS (SELECT condition, sum(n) AS n, sum(CASE WHEN (grp = 'G1') = (drug = 'D1') THEN mean ELSE -mean END) AS effect, sum(ss) AS ss, sum(1.0 / n) AS wide FROM c GROUP BY condition), w AS (SELECT condition, CAST(n AS DOUBLE) AS n, effect, effect / sqrt(ss / (n - 4) * wide) AS t FROM t)
SELECT condition, n, round(effect, 6) AS interaction, round(t, 6) AS t, """ + f"round({A.p_sql('t', '(n - 4)')}, 6) AS p FROM w")
def group_by_drug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interaction of group and drug in each condition."""
    s = _subject_means(spark, sf_dir)
    return inference.interaction(s, ["condition"], "grp", ("G1", "G2"), "drug", ("D1", "D2"), "m").select("condition", "n", *r6("interaction", "t", "p"))


#: Draws of each permutation test, as the reference has it.
_N = 5000
_DRAW = f"unnest(range(1, {_N + 1})) AS perm_id"


@query(_MEANS + f""", o AS (SELECT condition, avg(m - 50) AS observed, count(m) AS n FROM g GROUP BY condition), d AS (SELECT condition, subject, m - 50 AS x, {_DRAW} FROM g),
z AS (SELECT condition, perm_id, avg(CASE WHEN substr(md5(((perm_id - 1) // 32) || '-' || subject), CAST((perm_id - 1) % 32 AS INT) + 1, 1) < '8' THEN x ELSE -x END) AS v FROM d GROUP BY ALL)
SELECT condition, round(observed, 6) AS observed, CAST(sum(CASE WHEN abs(round(v, 9)) >= abs(round(observed, 9)) THEN 1 ELSE 0 END) AS BIGINT) AS n_beyond, round((sum(CASE WHEN abs(round(v, 9)) >= abs(round(observed, 9)) THEN 1 ELSE 0 END) + 1) / {_N + 1}.0, 6) AS p, round(avg(v), 6) AS null_mean, round(stddev_pop(v), 6) AS null_sd FROM z JOIN o USING (condition) GROUP BY condition, observed""")
def sign_flip_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _subject_means(spark, sf_dir).withColumn("x", F.col("m") - 50)
    return perm.sign_flip(s, ["condition"], "subject", "x", _N).select("condition", *r6("observed"), "n_beyond", *r6("p", "null_mean", "null_sd"))


_LABELS = f"""ids AS (SELECT DISTINCT subject, grp, drug FROM g), base AS (SELECT *, row_number() OVER (ARM ORDER BY md5('0-' || subject), subject) AS k FROM ids), drawn AS (SELECT subject, drug, {_DRAW} FROM ids),
ranked AS (SELECT *, row_number() OVER (PARTITION BY perm_id ARM2 ORDER BY md5(perm_id || '-' || subject), subject) AS k FROM drawn)"""


# two groups drawn anew: the first has the subjects with the smallest keys
_TWO = f"""ids AS (SELECT DISTINCT subject, grp FROM g), keyed AS (SELECT subject, {_DRAW} FROM ids),
placed AS (SELECT perm_id, subject, row_number() OVER (PARTITION BY perm_id ORDER BY substr(md5(((perm_id - 1) // 4) || '-' || subject), CAST(8 * ((perm_id - 1) % 4) + 1 AS INT), 8), subject) AS k FROM keyed),
labels AS (SELECT perm_id, subject, CASE WHEN k <= (SELECT count(*) FROM ids WHERE grp = 'G1') THEN 'G1' ELSE 'G2' END AS grp FROM placed)"""
_BEYOND = f"""SELECT condition, round(observed, 6) AS observed, CAST(sum(CASE WHEN abs(round(v, 9)) >= abs(round(observed, 9)) THEN 1 ELSE 0 END) AS BIGINT) AS n_beyond, round((sum(CASE WHEN abs(round(v, 9)) >= abs(round(observed, 9)) THEN 1 ELSE 0 END) + 1) / {_N + 1}.0, 6) AS p, round(avg(v), 6) AS null_mean, round(stddev_pop(v), 6) AS null_sd FROM z JOIN o USING (condition) GROUP BY condition, observed"""
_T = "(avg(m) FILTER ({0}.grp = 'G1') - avg(m) FILTER ({0}.grp = 'G2')) / sqrt((var_pop(m) FILTER ({0}.grp = 'G1') * count(m) FILTER ({0}.grp = 'G1') + var_pop(m) FILTER ({0}.grp = 'G2') * count(m) FILTER ({0}.grp = 'G2')) / (count(m) - 2) * (1.0 / count(m) FILTER ({0}.grp = 'G1') + 1.0 / count(m) FILTER ({0}.grp = 'G2')))"


@query(_MEANS + ", " + _TWO + f""", o AS (SELECT condition, avg(m) FILTER (grp = 'G1') - avg(m) FILTER (grp = 'G2') AS observed FROM g GROUP BY condition),
z AS (SELECT condition, perm_id, avg(m) FILTER (l.grp = 'G1') - avg(m) FILTER (l.grp = 'G2') AS v FROM g JOIN labels l USING (subject) GROUP BY ALL) {_BEYOND}""")
def group_permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two groups' means against groups drawn anew."""
    s = _subject_means(spark, sf_dir).drop("drug")
    return perm.group_difference(s, ["condition"], "subject", "grp", "G1", "G2", "m", _N).select("condition", *r6("observed"), "n_beyond", *r6("p", "null_mean", "null_sd"))


@query(_MEANS + ", " + _TWO + f""", o AS (SELECT condition, {_T.format('g')} AS observed FROM g GROUP BY condition), z AS (SELECT condition, perm_id, {_T.format('l')} AS v FROM g JOIN labels l USING (subject) GROUP BY ALL) {_BEYOND}""")
def group_permutation_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Student's t of two groups against that of groups drawn anew."""
    s = _subject_means(spark, sf_dir).drop("drug")
    return perm.group_difference(s, ["condition"], "subject", "grp", "G1", "G2", "m", _N, statistic="t").select("condition", *r6("observed"), "n_beyond", *r6("p", "null_mean", "null_sd"))


_CELL = "(avg(m) FILTER ({0}.grp = 'G1' AND g.drug = 'D1') - avg(m) FILTER ({0}.grp = 'G2' AND g.drug = 'D1')) - (avg(m) FILTER ({0}.grp = 'G1' AND g.drug = 'D2') - avg(m) FILTER ({0}.grp = 'G2' AND g.drug = 'D2'))"


@query(_MEANS + ", " + _LABELS.replace("ARM2", ", drug").replace("ARM", "PARTITION BY drug") + f""", labels AS (SELECT r.perm_id, r.subject, b.grp FROM ranked r JOIN base b USING (k, drug)),
o AS (SELECT condition, {_CELL.format('g')} AS observed FROM g GROUP BY condition), z AS (SELECT condition, perm_id, {_CELL.format('l')} AS v FROM g JOIN labels l USING (subject) GROUP BY ALL)
SELECT condition, round(observed, 6) AS observed, CAST(sum(CASE WHEN abs(round(v, 9)) >= abs(round(observed, 9)) THEN 1 ELSE 0 END) AS BIGINT) AS n_beyond, round((sum(CASE WHEN abs(round(v, 9)) >= abs(round(observed, 9)) THEN 1 ELSE 0 END) + 1) / {_N + 1}.0, 6) AS p, round(avg(v), 6) AS null_mean, round(stddev_pop(v), 6) AS null_sd FROM z JOIN o USING (condition) GROUP BY condition, observed""")
def interaction_permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _subject_means(spark, sf_dir)
    return perm.interaction(s, ["condition"], "subject", "grp", "G1", "G2", "drug", "D1", "D2", "m", _N).select("condition", *r6("observed"), "n_beyond", *r6("p", "null_mean", "null_sd"))


