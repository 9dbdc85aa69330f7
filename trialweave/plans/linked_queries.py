"""Queries that tie trial series, parcels and scores to one another, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.operators import decoding, drift, geometry, inference, ordered, similarity
from trialweave.plans.ordered_queries import r6
from trialweave.plans.vector_queries import _AXIS, _TRAJECTORY
from trialweave.sources import adapters as A
from trialweave.sources.adapters import FEATURES, LONG, MAPS, SCORES, WIDTH

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
PAIR = ("B", "C")
N_PERM = 5000
#: The map is of random numbers, of which few have a small q.
REPORT_Q = 0.99
NEAR = 20


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


_COUPLED = f"""{_TRAJECTORY}, {SCORES}, j AS (SELECT subject, phase, no, list_transform(list_zip(features, s), lambda p: p[1] - p[2]) AS x, {_AXIS} AS ax FROM trials JOIN k USING (trial_idx) JOIN s USING (subject, phase) JOIN g USING (subject, phase)),
path AS (SELECT subject, phase, no, list_dot_product(x, ax) / list_dot_product(ax, ax) AS way FROM j),
coupled AS (SELECT p.subject, phase, count(*) AS n_pairs, CASE WHEN count(*) >= 3 AND min(way) < max(way) AND min(score) < max(score) THEN corr(way, score) END AS r FROM path p JOIN scores c ON c.subject = p.subject AND c.condition = 'click' AND c.trial_no = p.no GROUP BY ALL)"""


def _path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.trajectory(A.trials(spark, sf_dir), WIDTH, ["subject", "phase"], "B", "A").withColumnRenamed("score", "way")


def _coupled(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = A.scores(spark, sf_dir).where("condition = 'click'").select("subject", "trial_no", "score")
    return drift.coupling(_path(spark, sf_dir), clicks, ["subject"], ["trial_no"], "way", "score", ["phase"])


@query(_COUPLED + " SELECT subject, phase, n_pairs, round(r, 6) AS r FROM coupled")
def series_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of a subject's way to the target with its scores, trial by trial."""
    return _coupled(spark, sf_dir).select("subject", "phase", "n_pairs", *r6("r"))


@query(_COUPLED + """, m AS (SELECT subject, phase, count(*) AS n_points, CASE WHEN count(*) >= 3 THEN regr_slope(way, no) END AS slope FROM path GROUP BY ALL)
SELECT subject, phase, n_points, round(slope, 6) AS slope, n_pairs, round(r, 6) AS r FROM m LEFT JOIN coupled USING (subject, phase)""")
def trajectory_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes of the way to the target, with the coupling where there is one."""
    slope = ordered.slopes(_path(spark, sf_dir), ["subject", "phase"], "trial_no", "way", 3)
    return slope.join(_coupled(spark, sf_dir), ["subject", "phase"], "left").select("subject", "phase", "n_points", *r6("slope"), "n_pairs", *r6("r"))


@query(f"""WITH {LONG}, grid AS (SELECT range AS pos, range % 4 AS i, range // 4 % 4 AS j, range // 16 AS k FROM range({WIDTH})),
near AS (SELECT a.pos AS center, b.pos FROM grid a, grid b QUALIFY row_number() OVER (PARTITION BY a.pos ORDER BY pow(a.i - b.i, 2) + pow(a.j - b.j, 2) + pow(a.k - b.k, 2), b.pos) <= {NEAR}),
c AS (SELECT subject, phase, condition, trial_idx, center, n.pos, x - avg(x) OVER (PARTITION BY trial_idx, center) AS c FROM long l JOIN near n ON n.pos = l.pos - 1), u AS (SELECT *, c / sqrt(sum(c * c) OVER (PARTITION BY trial_idx, center)) AS u FROM c),
s AS (SELECT subject, phase, condition, center, pos, sum(u) AS s, count(*) AS n FROM u GROUP BY ALL), t AS (SELECT *, sum(s) OVER w AS a, sum(n) OVER w AS m FROM s WINDOW w AS (PARTITION BY subject, phase, center, pos)),
p AS (SELECT subject, phase, center, condition, max(n) AS n, max(m) AS m, sum(s * s) AS ss, sum(s * (a - s)) AS sa FROM t GROUP BY ALL)
SELECT subject, phase, center, condition, round((ss - n) / nullif(n * (n - 1), 0) - sa / nullif(n * (m - n), 0), 6) AS score FROM p""")
def parcel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within less between similarity of each condition in the 20 parcels nearest to each parcel; an element of the vector is a parcel on a 4 x 4 x 4 grid."""
    pos = F.col("id")
    grid = spark.range(WIDTH).select(pos.alias("feature_id"), (pos % 4).alias("i"), (F.floor(pos / 4) % 4).alias("j"), F.floor(pos / 16).alias("k"))
    around = similarity.neighbourhoods(A.trials(spark, sf_dir), geometry.nearest(grid, NEAR, 2.0))
    units = similarity.unit(around, min_valid=0.0)
    return similarity.within_between(units, ["subject", "phase", "center"], NEAR).select("subject", "phase", "center", "condition", *r6("score"))


_SCORED = f"""WITH {LONG}, m AS (SELECT subject, pos, avg(x) FILTER (condition = 'B') AS low, avg(x) FILTER (condition = 'C') AS high FROM long WHERE phase = 'learn' GROUP BY ALL),
own AS (SELECT subject, trial_idx, condition AS label, sum((x - (low + high) / 2) * (high - low)) AS score FROM long JOIN m USING (subject, pos) WHERE phase = 'test' AND condition IN ('B', 'C') AND low IS NOT NULL AND high IS NOT NULL GROUP BY ALL),
drawn AS (SELECT unnest(range(0, {N_PERM + 1})) AS perm_id, trial_idx, label FROM own), placed AS (SELECT *, row_number() OVER (PARTITION BY perm_id ORDER BY md5(perm_id || '-' || trial_idx), trial_idx) AS k FROM drawn),
shuffled AS (SELECT p.perm_id, p.trial_idx, b.label FROM placed p JOIN placed b ON b.perm_id = 0 AND b.k = p.k WHERE p.perm_id > 0), every AS (SELECT perm_id, subject, s.label, score FROM shuffled s JOIN own USING (trial_idx) UNION ALL SELECT 0, subject, label, score FROM own)"""
_TALLY = f""", seen AS (SELECT accuracy, n FROM marks WHERE perm_id = 0)
SELECT round(s.accuracy, 6) AS accuracy, s.n, count(*) FILTER (round(m.accuracy, 9) >= round(s.accuracy, 9)) AS n_beyond, round((count(*) FILTER (round(m.accuracy, 9) >= round(s.accuracy, 9)) + 1) / {N_PERM + 1}.0::DOUBLE, 6) AS p, round(avg(m.accuracy), 6) AS null_mean FROM marks m, seen s WHERE m.perm_id > 0 GROUP BY s.accuracy, s.n"""


def _choice(spark: SparkSession, sf_dir: str, subject: str | None) -> DataFrame:
    t = A.trials(spark, sf_dir)
    scored = decoding.centroid_scores(t.where("phase = 'learn'"), t.where("phase = 'test'"), ["subject"], PAIR, WIDTH)
    return decoding.shuffled_choice(scored, PAIR, N_PERM, subject).select(*r6("accuracy"), "n", "n_beyond", *r6("p", "null_mean"))


@query(_SCORED + ", marks AS (SELECT perm_id, avg(CAST((score > 0) = (label = 'C') AS INT)) AS accuracy, count(*) AS n FROM every GROUP BY perm_id)" + _TALLY)
def transfer_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of the test phase on the learning phase's axis, against labels shuffled over trials."""
    return _choice(spark, sf_dir, None)


@query(_SCORED + """, per AS (SELECT perm_id, subject, avg(score) FILTER (label = 'B') AS low, avg(score) FILTER (label = 'C') AS high FROM every GROUP BY ALL),
marks AS (SELECT perm_id, avg(CAST(high > low AS INT)) AS accuracy, count(*) AS n FROM per WHERE low IS NOT NULL AND high IS NOT NULL GROUP BY perm_id)""" + _TALLY)
def cross_phase_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects whose mean score is higher for the second condition, against labels shuffled over trials."""
    return _choice(spark, sf_dir, "subject")


@query(f"""WITH {MAPS}, {FEATURES}, g AS (SELECT feature_id, count(value) AS n, avg(value - 25) AS mean, stddev_samp(value) AS sd FROM maps GROUP BY feature_id), w AS (SELECT feature_id, mean, mean / (sd / sqrt(n)) AS t, n - 1 AS free FROM g WHERE n >= 3 AND sd > 0),
tested AS (SELECT *, round({A.p_sql('t', 'free')}, 9) AS p FROM w), {A.q_sql('tested', '', 'feature_id')}
SELECT feature_id, roi, round(mean, 6) AS mean, round(t, 6) AS t, round(p, 6) AS p, round(q, 6) AS q, CAST(sign(mean) AS INT) AS direction FROM with_q JOIN features USING (feature_id)""")
def labelled_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean map against the middle of its scale: p, q over the map, direction and region of each feature."""
    t = inference.one_sample_t(A.maps(spark, sf_dir).withColumn("value", F.col("value") - 25), ["feature_id"], "value", 3).where("t is not null")
    q = ordered.bh(t.withColumn("p", F.round("p", 9)), "p")
    return q.join(A.features(spark, sf_dir).select("feature_id", "roi"), "feature_id").select("feature_id", "roi", *r6("mean", "t", "p", "q"), F.signum("mean").cast("int").alias("direction"))


@query(f"""WITH {MAPS}, {FEATURES}, g AS (SELECT feature_id, count(value) AS n, avg(value - 25) AS mean, stddev_samp(value) AS sd FROM maps GROUP BY feature_id), w AS (SELECT feature_id, mean, mean / (sd / sqrt(n)) AS t, n - 1 AS free FROM g WHERE n >= 3 AND sd > 0),
tested AS (SELECT *, round({A.p_sql('t', 'free')}, 9) AS p FROM w), {A.q_sql('tested', '', 'feature_id')}
SELECT feature_id, roi, round(mean, 6) AS effect, round(q, 6) AS q FROM with_q JOIN features USING (feature_id) WHERE q <= {REPORT_Q} ORDER BY abs(round(mean, 6)) DESC, feature_id LIMIT 10""")
def largest_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest effects of the mean map, either way, among features with a q up to the report's limit."""
    t = inference.one_sample_t(A.maps(spark, sf_dir).withColumn("value", F.col("value") - 25), ["feature_id"], "value", 3).where("t is not null")
    q = ordered.bh(t.withColumn("p", F.round("p", 9)), "p").where(F.col("q") <= REPORT_Q)
    named = q.join(A.features(spark, sf_dir).select("feature_id", "roi"), "feature_id").select("feature_id", "roi", F.round("mean", 6).alias("effect"), F.round("q", 6).alias("q"))
    return named.orderBy(F.desc(F.abs("effect")), "feature_id").limit(10)
