"""Queries on trial vectors and voxel neighbourhoods, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions import vectors as V
from trialweave.operators import centroids, drift, geometry, ordered, similarity
from trialweave.sources import adapters as A
from trialweave.sources.adapters import FEATURES, LONG, MAPS, TRIALS, WIDTH

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
KEYS = ["subject", "phase"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


_UNIT = LONG + """, m AS (SELECT trial_idx, avg(x) AS mu FROM long GROUP BY trial_idx), c AS (SELECT subject, phase, condition, trial_idx, pos, x - mu AS x FROM long JOIN m USING (trial_idx)),
nn AS (SELECT trial_idx, sqrt(sum(x * x)) AS len FROM c GROUP BY trial_idx), u AS (SELECT subject, phase, condition, trial_idx, pos, x / CASE WHEN len = 0 THEN 1 ELSE len END AS x FROM c JOIN nn USING (trial_idx)),
uv AS (SELECT subject, phase, condition, trial_idx, list(x ORDER BY pos) AS u FROM u GROUP BY ALL)"""
_CENTROID = LONG + """, cell AS (SELECT subject, phase, condition, pos, avg(x) AS x FROM long GROUP BY ALL), num AS (SELECT subject, phase, condition, count(*) AS n FROM trials GROUP BY ALL),
cen AS (SELECT subject, phase, condition, list(x ORDER BY pos) AS v, max(n) AS n FROM cell JOIN num USING (subject, phase, condition) GROUP BY ALL)"""


@query(f"WITH {_CENTROID} SELECT subject, phase, condition, n AS n_trials, round(sqrt(list_dot_product(v, v)), 6) AS length, round(list_sum(v) / len(v), 6) AS mean, round(v[1], 6) AS first, round(v[64], 6) AS last FROM cen")
def condition_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = centroids.mean_vectors(A.trials(spark, sf_dir), [*KEYS, "condition"], WIDTH)
    return m.select(*KEYS, "condition", "n_trials", F.round(V.norm("centroid"), 6).alias("length"), F.round(V.mean("centroid"), 6).alias("mean"), F.round(F.get("centroid", F.lit(0)), 6).alias("first"), F.round(F.get("centroid", F.lit(WIDTH - 1)), 6).alias("last"))


@query(f"WITH {TRIALS}, p AS (SELECT a.subject, a.phase, a.trial_idx AS trial_a, b.trial_idx AS trial_b, a.condition AS cond_a, b.condition AS cond_b, a.features AS x, b.features AS y FROM trials a JOIN trials b ON a.subject = b.subject AND a.phase = b.phase AND a.trial_idx < b.trial_idx), q AS (SELECT *, list_transform(x, lambda v: v - list_avg(x)) AS cx, list_transform(y, lambda v: v - list_avg(y)) AS cy FROM p) SELECT subject, phase, trial_a, trial_b, cond_a, cond_b, round(list_cosine_similarity(x, y), 6) AS cosine, round(list_cosine_similarity(cx, cy), 6) AS pearson FROM q")
def trial_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a subject's trials in a phase (24 trials at most)."""
    return similarity.pairs(A.trials(spark, sf_dir), KEYS).select(*KEYS, "trial_a", "trial_b", "cond_a", "cond_b", *r6("cosine", "pearson"))


@query(f"WITH {TRIALS}, p AS (SELECT a.subject, a.phase, least(a.condition, b.condition) AS type_a, greatest(a.condition, b.condition) AS type_b, a.features AS x, b.features AS y FROM trials a JOIN trials b ON a.subject = b.subject AND a.phase = b.phase AND a.trial_idx < b.trial_idx) SELECT subject, phase, type_a, type_b, round(avg(list_cosine_similarity(list_transform(x, lambda v: v - list_avg(x)), list_transform(y, lambda v: v - list_avg(y)))), 6) AS mean, count(*) AS n_pairs FROM p GROUP BY ALL")
def type_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean Pearson of pairs within and between conditions."""
    return similarity.type_table(similarity.pairs(A.trials(spark, sf_dir), KEYS), KEYS).select(*KEYS, "type_a", "type_b", *r6("mean"), "n_pairs")


@query(f"""WITH {_UNIT}, w AS (SELECT a.subject, a.phase, a.condition, avg(list_dot_product(a.u, b.u)) AS within FROM uv a JOIN uv b ON a.subject = b.subject AND a.phase = b.phase AND a.condition = b.condition AND a.trial_idx < b.trial_idx GROUP BY ALL),
b AS (SELECT a.subject, a.phase, a.condition, avg(list_dot_product(a.u, b.u)) AS between FROM uv a JOIN uv b ON a.subject = b.subject AND a.phase = b.phase AND a.condition <> b.condition GROUP BY ALL), k AS (SELECT DISTINCT subject, phase, condition FROM uv)
SELECT subject, phase, condition, round(within, 6) AS within, round(between, 6) AS between, round(within - between, 6) AS score FROM k LEFT JOIN w USING (subject, phase, condition) LEFT JOIN b USING (subject, phase, condition)""")
def within_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity within a condition less that to the others: sums in place of pairs."""
    u = similarity.unit(A.trials(spark, sf_dir))
    return similarity.within_between(u, KEYS, WIDTH).select(*KEYS, "condition", *r6("within", "between", "score"))


@query(f"""WITH {_UNIT}, h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY subject, phase, condition ORDER BY trial_idx) <= count(*) OVER (PARTITION BY subject, phase, condition) // 2 THEN 'H1' ELSE 'H2' END AS half FROM uv),
w AS (SELECT a.subject, a.phase, a.half, a.condition, avg(list_dot_product(a.u, b.u)) AS within FROM h a JOIN h b ON a.subject = b.subject AND a.phase = b.phase AND a.half = b.half AND a.condition = b.condition AND a.trial_idx < b.trial_idx GROUP BY ALL),
b AS (SELECT a.subject, a.phase, a.half, a.condition, avg(list_dot_product(a.u, b.u)) AS between FROM h a JOIN h b ON a.subject = b.subject AND a.phase = b.phase AND a.half = b.half AND a.condition <> b.condition GROUP BY ALL), k AS (SELECT DISTINCT subject, phase, half, condition FROM h)
SELECT subject, phase, half, condition, round(within - between, 6) AS score FROM k LEFT JOIN w USING (subject, phase, half, condition) LEFT JOIN b USING (subject, phase, half, condition)""")
def split_half_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within less between, for each half of the trials."""
    u = ordered.halves(similarity.unit(A.trials(spark, sf_dir)), [*KEYS, "condition"], ["trial_idx"])
    return similarity.within_between(u, [*KEYS, "half"], WIDTH).select(*KEYS, "half", "condition", *r6("score"))


@query(f"""WITH {_UNIT} SELECT a.subject, a.phase, a.condition AS cond_a, b.condition AS cond_b, round(avg(list_dot_product(a.u, b.u)), 6) AS similarity FROM uv a JOIN uv b ON a.subject = b.subject AND a.phase = b.phase AND a.condition < b.condition GROUP BY ALL""")
def between_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.between_pairs(similarity.unit(A.trials(spark, sf_dir)), KEYS, WIDTH).select(*KEYS, "cond_a", "cond_b", *r6("similarity"))


@query(f"""WITH {_UNIT}, s AS (SELECT a.subject, a.phase, a.condition, a.trial_idx, avg(list_dot_product(a.u, b.u)) FILTER (a.condition = b.condition) AS i, avg(list_dot_product(a.u, b.u)) FILTER (a.condition <> b.condition) AS o FROM uv a LEFT JOIN uv b ON a.subject = b.subject AND a.phase = b.phase AND a.trial_idx <> b.trial_idx GROUP BY ALL)
SELECT subject, phase, condition, trial_idx, round(i - o, 6) AS score FROM s""")
def trial_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.trial_scores(similarity.unit(A.trials(spark, sf_dir)), KEYS, WIDTH).select(*KEYS, "condition", "trial_idx", *r6("score"))


@query(f"""WITH {_CENTROID} SELECT a.subject, a.condition AS cond_first, b.condition AS cond_second, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM cen a JOIN cen b ON a.subject = b.subject AND a.phase = 'learn' AND b.phase = 'test'""")
def cross_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.cross_phase(A.trials(spark, sf_dir), WIDTH, "learn", "test").select("subject", "cond_first", "cond_second", *r6("similarity"))


@query(f"""WITH {_CENTROID} SELECT a.subject, least(a.condition, b.condition) AS cond_a, greatest(a.condition, b.condition) AS cond_b, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS similarity FROM cen a JOIN cen b ON a.subject = b.subject AND a.phase = 'learn' AND b.phase = 'test' AND a.condition <> b.condition GROUP BY ALL""")
def cross_phase_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.cross_phase_between(similarity.cross_phase(A.trials(spark, sf_dir), WIDTH, "learn", "test")).select("subject", "cond_a", "cond_b", *r6("similarity"))


@query(f"""WITH {_CENTROID} SELECT t.subject, t.condition, t.trial_idx, round(list_cosine_similarity(t.features, v), 6) AS similarity FROM trials t JOIN cen c ON t.subject = c.subject AND t.condition = c.condition AND t.phase = 'learn' AND c.phase = 'test'""")
def cross_phase_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each learning trial against its condition's test centroid."""
    t = A.trials(spark, sf_dir)
    goal = centroids.mean_vectors(t.where("phase = 'test'"), ["subject", "condition"], WIDTH)
    return similarity.to_centroid(t.where("phase = 'learn'"), goal, ["subject", "condition"]).select("subject", "condition", "trial_idx", *r6("similarity"))


@query(f"""WITH {LONG}, k AS (SELECT subject, phase, condition, trial_idx, row_number() OVER (PARTITION BY subject, phase, condition ORDER BY trial_idx) AS no, count(*) OVER (PARTITION BY subject, phase, condition) AS n FROM trials),
s AS (SELECT *, CASE WHEN n - no < 4 THEN 'Late' WHEN no <= 4 THEN 'Early' END AS stage FROM k WHERE n >= 8), cell AS (SELECT subject, phase, condition, stage, pos, avg(x) AS x FROM s JOIN long USING (subject, phase, condition, trial_idx) WHERE stage IS NOT NULL GROUP BY ALL),
p AS (SELECT subject, phase, condition, stage, list(x ORDER BY pos) AS v FROM cell GROUP BY ALL), whole AS (SELECT subject, phase, condition, list(x ORDER BY pos) AS v FROM (SELECT subject, phase, condition, pos, avg(x) AS x FROM s JOIN long USING (subject, phase, condition, trial_idx) GROUP BY ALL) GROUP BY ALL),
d AS (SELECT a.subject, a.phase, a.condition AS cond_a, b.condition AS cond_b, sum(CASE WHEN a.stage = 'Late' THEN list_cosine_similarity(a.v, b.v) ELSE -list_cosine_similarity(a.v, b.v) END) AS delta FROM p a JOIN p b ON a.subject = b.subject AND a.phase = b.phase AND a.stage = b.stage AND a.condition < b.condition GROUP BY ALL),
r AS (SELECT s.subject, s.phase, s.condition, w.condition AS other, regr_slope(list_cosine_similarity(t.features, w.v), s.no) AS slope FROM s JOIN trials t USING (trial_idx) JOIN whole w ON s.subject = w.subject AND s.phase = w.phase AND s.condition <> w.condition GROUP BY ALL),
g AS (SELECT subject, phase, least(condition, other) AS cond_a, greatest(condition, other) AS cond_b, avg(slope) AS slope FROM r GROUP BY ALL)
SELECT subject, phase, cond_a, cond_b, round(delta, 6) AS delta, round(slope, 6) AS slope FROM d JOIN g USING (subject, phase, cond_a, cond_b)""")
def dynamic_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late less early similarity of condition pairs, and slopes of trials towards the other condition."""
    return similarity.dynamic(A.trials(spark, sf_dir), WIDTH, KEYS).select(*KEYS, "cond_a", "cond_b", *r6("delta", "slope"))


@query(f"""WITH {_CENTROID} SELECT a.subject, a.phase, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(b.v, b.v)), 6) AS projection, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, round(list_distance(a.v, b.v), 6) AS distance FROM cen a JOIN cen b ON a.subject = b.subject AND a.phase = b.phase AND a.condition = 'B' AND b.condition = 'A'""")
def plasticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.plasticity(A.trials(spark, sf_dir), WIDTH, KEYS, "B", "A").select(*KEYS, *r6("projection", "cosine", "distance"))


_TRAJECTORY = f"""WITH {LONG}, k AS (SELECT trial_idx, row_number() OVER (PARTITION BY subject, phase ORDER BY trial_idx) AS no, count(*) OVER (PARTITION BY subject, phase) AS n FROM trials WHERE condition = 'B'),
s0 AS (SELECT subject, phase, pos, avg(x) AS x FROM long JOIN k USING (trial_idx) WHERE no <= n // 2 GROUP BY ALL), s AS (SELECT subject, phase, list(x ORDER BY pos) AS s FROM s0 GROUP BY ALL),
e0 AS (SELECT subject, phase, pos, avg(x) AS x, max(n) AS n FROM long JOIN k USING (trial_idx) WHERE no > n // 2 GROUP BY ALL), e AS (SELECT subject, phase, list(x ORDER BY pos) AS e, max(n) AS n FROM e0 GROUP BY ALL),
g0 AS (SELECT subject, phase, pos, avg(x) AS x, count(*) AS m FROM long WHERE condition = 'A' GROUP BY ALL), g AS (SELECT subject, phase, list(x ORDER BY pos) AS g, max(m) AS m FROM g0 GROUP BY ALL)"""
_AXIS = "list_transform(list_zip(g, s), lambda p: p[1] - p[2])"


@query(_TRAJECTORY + f""", j AS (SELECT subject, phase, no, list_transform(list_zip(features, s), lambda p: p[1] - p[2]) AS x, {_AXIS} AS ax FROM trials JOIN k USING (trial_idx) JOIN s USING (subject, phase) JOIN g USING (subject, phase))
SELECT subject, phase, no AS trial_no, round(list_dot_product(x, ax) / list_dot_product(ax, ax), 6) AS score FROM j""")
def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.trajectory(A.trials(spark, sf_dir), WIDTH, KEYS, "B", "A").select(*KEYS, "trial_no", *r6("score"))


@query(_TRAJECTORY + f""", j AS (SELECT subject, phase, no, list_transform(list_zip(features, s), lambda p: p[1] - p[2]) AS x, {_AXIS} AS ax FROM trials JOIN k USING (trial_idx) JOIN s USING (subject, phase) JOIN g USING (subject, phase)), t AS (SELECT subject, phase, no, list_dot_product(x, ax) / list_dot_product(ax, ax) AS score FROM j)
SELECT subject, phase, count(*) AS n_points, CASE WHEN count(*) >= 3 THEN round(regr_slope(score, no), 6) END AS slope FROM t GROUP BY ALL""")
def trajectory_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = drift.trajectory(A.trials(spark, sf_dir), WIDTH, KEYS, "B", "A")
    return ordered.slopes(t, KEYS, "trial_no", "score", 3).select(*KEYS, "n_points", *r6("slope"))


@query(_TRAJECTORY + f""", j AS (SELECT subject, phase, list_transform(list_zip(e, s), lambda p: p[1] - p[2]) AS d, {_AXIS} AS ax FROM s JOIN e USING (subject, phase) JOIN g USING (subject, phase) WHERE n >= 4 AND m >= 2)
SELECT subject, phase, round(list_cosine_similarity(d, ax), 6) AS drift_cosine, round(list_dot_product(d, ax) / sqrt(list_dot_product(ax, ax)), 6) AS drift_projection FROM j""")
def drift_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift(A.trials(spark, sf_dir), WIDTH, KEYS, "B", "A").select(*KEYS, *r6("drift_cosine", "drift_projection"))


_RDM = f"""WITH {_CENTROID}, q AS (SELECT subject, phase, condition, list_transform(v, lambda x: x - list_avg(v)) AS c FROM cen), rdm AS (SELECT a.subject, a.phase, a.condition AS cond_a, b.condition AS cond_b, 1 - list_cosine_similarity(a.c, b.c) AS distance FROM q a JOIN q b ON a.subject = b.subject AND a.phase = b.phase AND a.condition < b.condition)"""


@query(_RDM + " SELECT subject, phase, cond_a, cond_b, round(distance, 6) AS distance FROM rdm")
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.rdm(A.trials(spark, sf_dir), WIDTH, KEYS).select(*KEYS, "cond_a", "cond_b", *r6("distance"))


@query(_RDM + """, p AS (SELECT subject, phase, max(distance) FILTER (cond_a = 'B' AND cond_b = 'C') AS ts, max(distance) FILTER (cond_a = 'A' AND cond_b = 'B') AS sb, max(distance) FILTER (cond_a = 'A' AND cond_b = 'C') AS tb FROM rdm GROUP BY ALL)
SELECT subject, phase, round(ts, 6) AS threat_safety, round(sb, 6) AS safety_background, round(ts - sb, 6) AS inhibition_index, round(tb - sb, 6) AS background_index FROM p""")
def topology_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = drift.topology(drift.rdm(A.trials(spark, sf_dir), WIDTH, KEYS), KEYS, "C", "B", "A")
    return t.select(*KEYS, *r6("threat_safety", "safety_background", "inhibition_index", "background_index"))


@query(f"""WITH {LONG}, mu AS (SELECT subject, pos, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY ALL) SELECT subject, phase, condition, trial_idx, round(sqrt(sum((x - m) * (x - m))), 6) AS centred_length, round(sum(abs((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END)), 5) AS standard_sum FROM long JOIN mu USING (subject, pos) WHERE condition <> 'A' GROUP BY ALL""")
def centred_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred and standardised within subject over all conditions, then two conditions kept."""
    t = A.trials(spark, sf_dir)
    c = ordered.center_within(t, ["subject"], WIDTH)
    s = ordered.standardize_within(t, ["subject"], WIDTH).select("trial_idx", F.col("features").alias("_s"))
    j = c.join(s, "trial_idx").where("condition <> 'A'")
    return j.select(*KEYS, "condition", "trial_idx", F.round(V.norm("features"), 6).alias("centred_length"), F.round(V.total(F.transform("_s", F.abs)), 5).alias("standard_sum"))


_SPHERE = """near AS (SELECT a.feature_id AS center, b.feature_id AS neighbor, b.roi, b.size, b.weight, (a.i-b.i)*(a.i-b.i)+(a.j-b.j)*(a.j-b.j)+(a.k-b.k)*(a.k-b.k) AS s, greatest(abs(a.i-b.i), abs(a.j-b.j), abs(a.k-b.k)) AS side FROM features a JOIN features b ON abs(a.i-b.i) <= 3 AND abs(a.j-b.j) <= 3 AND abs(a.k-b.k) <= 3)"""


@query(f"WITH {FEATURES}, {_SPHERE} SELECT center, count(*) AS n_neighbors, CAST(sum(neighbor) AS BIGINT) AS neighbor_sum, round(sum(sqrt(s)), 6) AS distance_sum FROM near WHERE s <= 6.25 GROUP BY center")
def sphere_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels within 2.5 of each voxel, by cells of that size."""
    n = geometry.sphere(A.features(spark, sf_dir), 2.5)
    return n.groupBy("center").agg(F.count(F.lit(1)).alias("n_neighbors"), F.sum("neighbor").alias("neighbor_sum"), F.round(F.sum("distance"), 6).alias("distance_sum"))


@query(f"WITH {FEATURES}, {_SPHERE} SELECT center, count(*) AS n_neighbors, CAST(sum(neighbor) AS BIGINT) AS neighbor_sum FROM near WHERE side <= 1 GROUP BY center")
def box_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = geometry.box(A.features(spark, sf_dir), 1)
    return n.groupBy("center").agg(F.count(F.lit(1)).alias("n_neighbors"), F.sum("neighbor").alias("neighbor_sum"))


@query(f"WITH {FEATURES}, {_SPHERE}, r AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY s, neighbor) AS rank FROM near) SELECT center, neighbor, round(sqrt(s), 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8")
def nearest_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight nearest voxels, the voxel itself included."""
    return geometry.nearest(A.features(spark, sf_dir), 8, 1.5).select("center", "neighbor", *r6("distance"), "rank")


@query(f"""WITH {FEATURES}, {MAPS}, {_SPHERE}, g AS (SELECT feature_id, avg(value) FILTER (subject % 2 = 0) - avg(value) FILTER (subject % 2 = 1) AS effect FROM maps GROUP BY feature_id)
SELECT center, count(effect) AS n_used, round(avg(effect), 6) AS mean_effect FROM near JOIN g ON neighbor = feature_id WHERE s <= 6.25 GROUP BY center HAVING count(effect) >= 10""")
def searchlight_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean group difference in the sphere of each voxel with at least ten values."""
    m = A.maps(spark, sf_dir)
    of = lambda k: F.avg(F.when(F.col("subject") % 2 == k, F.col("value")))
    g = m.groupBy("feature_id").agg((of(0) - of(1)).alias("effect"))
    points = A.features(spark, sf_dir).hint("merge").join(g, "feature_id", "left")  # a value goes along with its voxel
    n = geometry.sphere(points, 2.5, keep=["effect"])
    return n.groupBy("center").agg(F.count("effect").alias("n_used"), F.avg("effect").alias("mean_effect")).where("n_used >= 10").select("center", "n_used", *r6("mean_effect"))
