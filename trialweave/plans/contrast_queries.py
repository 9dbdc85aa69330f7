"""Batteries of contrasts over cells of groups, drugs and conditions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.operators import contrasts, maps
from trialweave.plans import map_queries
from trialweave.plans.ordered_queries import r6
from trialweave.sources import adapters as A
from trialweave.sources.adapters import MAPS, SCORES

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FACTORS = {"grp": ["G1", "G2"], "drug": ["D1", "D2"]}
EVENTS = ["click", "purchase", "view"]


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


def _battery(spark: SparkSession) -> DataFrame:
    """Each cell, groups within a drug, drugs within a group, and the interaction."""
    return contrasts.products(spark, {f: contrasts.factor_terms(f, v) for f, v in FACTORS.items()})


_TERMS = "('{0}', '{0}', 1), ('{1}', '{1}', 1), ('{0}>{1}', '{0}', 1), ('{0}>{1}', '{1}', -1)"
_WEIGHTS = f"""gt(gn, grp, gw) AS (VALUES {_TERMS.format('G1', 'G2')}), dt(dn, drug, dw) AS (VALUES {_TERMS.format('D1', 'D2')}),
weights AS (SELECT gn || '|' || dn AS contrast, grp, drug, CAST(gw * dw AS DOUBLE) AS weight, count(*) OVER (PARTITION BY gn, dn) AS n_cells FROM gt, dt)"""


def _tested(keys: str, least: int = 2) -> str:
    """CTEs cells, joined and tested of a table ``source`` with grp, drug and value."""
    return f"""cells AS (SELECT {keys}grp, drug, CAST(count(value) AS DOUBLE) AS n, avg(value) AS mean, var_pop(value) * count(value) AS m2 FROM source WHERE value IS NOT NULL GROUP BY ALL),
joined AS (SELECT {keys}contrast, n, n_cells, weight * mean AS wm, weight * weight * m2 / ((n - 1) * n) AS e FROM cells JOIN weights USING (grp, drug) WHERE n >= {least}),
summed AS (SELECT {keys}contrast, CAST(sum(n) AS BIGINT) AS n, sum(wm) AS effect, sum(e) AS v, sum(e * e / (n - 1)) AS w FROM joined GROUP BY {keys}contrast HAVING count(*) = max(n_cells)),
tested AS (SELECT *, CASE WHEN v > 1e-18 THEN effect / sqrt(v) END AS t, CASE WHEN w > 0 THEN v * v / w END AS free FROM summed)"""


_ROUNDED, _WHOLE = "round((ss - n) / nullif(n * (n - 1), 0) - sa / nullif(n * (m - n), 0), 6)", "(ss - n) / nullif(n * (n - 1), 0) - sa / nullif(n * (m - n), 0)"


@query(f"""WITH score_maps AS ({map_queries.ORACLE['condition_maps'].replace(_ROUNDED, _WHOLE)}), source AS (SELECT center, part, condition, score AS value, {A.group_sql('subject')} FROM score_maps WHERE phase = 'test'), {_WEIGHTS}, {_tested('center, part, condition, ')},
with_p AS (SELECT *, round({A.p_sql('t', 'free')}, 9) AS p FROM tested WHERE t IS NOT NULL), {A.q_sql('with_p', 'part, condition, contrast', 'center')}
SELECT center, part, condition, contrast, n, round(effect, 6) AS effect, round(t, 4) AS t, round(p, 5) AS p, round(q, 5) AS q FROM with_q UNION ALL SELECT center, part, condition, contrast, n, round(effect, 6), NULL, NULL, NULL FROM tested WHERE t IS NULL""")
def searchlight_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and drug contrasts of the subjects' condition maps around every voxel, over all trials and both halves: t, p, and q over the map."""
    test = A.trials(spark, sf_dir).where("phase = 'test'")
    m = maps.condition_maps(test, map_queries.grid(spark), map_queries.RADIUS, ["subject"], side=map_queries.SIDE).select("center", "part", "condition", "score", *A.groups())
    b = contrasts.battery(m, ["center", "part", "condition"], ["part", "condition"], _battery(spark), list(FACTORS), "score")
    return b.select("center", "part", "condition", "contrast", "n", *r6("effect"), F.round("t", 4).alias("t"), F.round("p", 5).alias("p"), F.round("q", 5).alias("q"))


@query(f"""WITH {MAPS}, source AS (SELECT feature_id, value, {A.group_sql('subject')} FROM maps), {_WEIGHTS}, {_tested('feature_id, ')},
with_p AS (SELECT *, round({A.p_sql('t', 'free')}, 9) AS p FROM tested WHERE t IS NOT NULL), {A.q_sql('with_p', 'contrast', 'feature_id')}
SELECT feature_id, contrast, n, round(effect, 6) AS effect, round(t, 4) AS t, round(p, 5) AS p, round(q, 5) AS q FROM with_q UNION ALL SELECT feature_id, contrast, n, round(effect, 6), NULL, NULL, NULL FROM tested WHERE t IS NULL""")
def map_contrast_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same contrasts of every feature of the maps."""
    m = A.maps(spark, sf_dir).select("feature_id", "value", *A.groups())
    b = contrasts.battery(m, ["feature_id"], [], _battery(spark), list(FACTORS), "value")
    return b.select("feature_id", "contrast", "n", *r6("effect"), F.round("t", 4).alias("t"), F.round("p", 5).alias("p"), F.round("q", 5).alias("q"))


_LEVELS = {"grp": FACTORS["grp"], "condition": EVENTS, "drug": FACTORS["drug"]}
# a factor that takes part: differences from its first level; one that does not: the average
_FACTOR_SQL = ", ".join(
    f"{f}_t(name_{f}, {f}, w_{f}) AS (VALUES " + ", ".join([f"('', '{v}', 1.0 / {len(names)})" for v in names] + [f"('{f}:{v}-{names[0]}', '{w}', {1 if w == v else -1})" for v in names[1:] for w in (v, names[0])]) + ")" for f, names in _LEVELS.items()
)


@query(f"""WITH {SCORES}, s AS (SELECT subject, condition, avg(score) AS value FROM scores WHERE condition IN ('click', 'purchase', 'view') GROUP BY ALL), source AS (SELECT *, {A.group_sql('subject')} FROM s), {_FACTOR_SQL},
weights AS (SELECT concat_ws(' x ', nullif(name_grp, ''), nullif(name_condition, ''), nullif(name_drug, '')) AS contrast, grp, condition, drug, w_grp * w_condition * w_drug AS weight FROM grp_t, condition_t, drug_t WHERE name_grp || name_condition || name_drug <> ''),
cells AS (SELECT grp, condition, drug, CAST(count(*) AS DOUBLE) AS n, avg(value) AS mean, var_pop(value) * count(*) AS m2 FROM source GROUP BY ALL),
summed AS (SELECT contrast, CAST(sum(n) AS BIGINT) AS n, sum(weight * mean) AS effect, sum(weight * weight * m2 / ((n - 1) * n)) AS v, sum(pow(weight * weight * m2 / ((n - 1) * n), 2) / (n - 1)) AS w FROM cells JOIN weights USING (grp, condition, drug) GROUP BY contrast),
tested AS (SELECT *, effect / sqrt(v) AS t, v * v / w AS free FROM summed)
SELECT contrast, n, round(effect, 6) AS effect, round(t, 5) AS t, round(free, 4) AS df, round({A.p_sql('t', 'free')}, 6) AS p FROM tested""")
def factor_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main effects and interactions of group, condition and drug, two by three by two, on subjects' mean scores."""
    s = A.scores(spark, sf_dir).where(F.col("condition").isin(*EVENTS)).groupBy("subject", "condition").agg(F.avg("score").alias("value")).select("condition", "value", *A.groups())
    t = contrasts.tested(contrasts.moments(s, [], list(_LEVELS), "value"), contrasts.main_effects_and_interactions(spark, _LEVELS), [], list(_LEVELS))
    return t.select("contrast", "n", *r6("effect"), F.round("t", 5).alias("t"), F.round("df", 4).alias("df"), *r6("p"))
