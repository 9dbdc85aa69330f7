"""Queries of neighbourhood maps: every element of a trial's vector is a voxel of a 4 x 4 x 4 grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.operators import atlas, geometry, maps, selection
from trialweave.plans.ordered_queries import r6
from trialweave.sources import adapters as A
from trialweave.sources.adapters import FEATURES, LONG, SCORES, WIDTH

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
KEYS = ["subject", "phase"]
RADIUS = 1.5
#: Side of a block: eight blocks, each with a halo.
SIDE = 2
CHUNKS = 7


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


def grid(spark: SparkSession) -> DataFrame:
    pos = F.col("id")
    return spark.range(WIDTH).select(pos.alias("feature_id"), (pos % 4).alias("i"), (F.floor(pos / 4) % 4).alias("j"), F.floor(pos / 16).alias("k"))


_NEAR = f"""grid AS (SELECT range AS pos, range % 4 AS i, range // 4 % 4 AS j, range // 16 AS k FROM range({WIDTH})),
near AS (SELECT a.pos AS center, b.pos FROM grid a JOIN grid b ON pow(a.i - b.i, 2) + pow(a.j - b.j, 2) + pow(a.k - b.k, 2) <= {RADIUS**2})"""
# trials of ``source`` around each centre, less their mean and of norm 1
_UNITS = """c AS (SELECT {keys}, center, n.pos, x - avg(x) OVER w AS c FROM {source} l JOIN near n ON n.pos = l.pos - 1 WINDOW w AS (PARTITION BY {keys}, center)),
u AS (SELECT *, c / sqrt(sum(c * c) OVER (PARTITION BY {keys}, center)) AS u FROM c)"""
_PART_KEYS = "part, subject, phase, condition, trial_idx"


@query(f"""WITH {LONG}, {_NEAR}, ordered AS (SELECT subject, phase, condition, trial_idx, row_number() OVER w AS k, count(*) OVER (PARTITION BY subject, phase, condition) AS n FROM trials WINDOW w AS (PARTITION BY subject, phase, condition ORDER BY trial_idx)),
parts AS (SELECT 'FULL' AS part, trial_idx FROM ordered UNION ALL SELECT CASE WHEN k <= n // 2 THEN 'H1' ELSE 'H2' END, trial_idx FROM ordered), own AS (SELECT part, long.* FROM long JOIN parts USING (trial_idx)), {_UNITS.format(keys=_PART_KEYS, source='own')},
s AS (SELECT part, subject, phase, condition, center, pos, sum(u) AS s, count(*) AS n FROM u GROUP BY ALL), t AS (SELECT *, sum(s) OVER w AS a, sum(n) OVER w AS m FROM s WINDOW w AS (PARTITION BY part, subject, phase, center, pos)),
p AS (SELECT part, subject, phase, center, condition, max(n) AS n, max(m) AS m, sum(s * s) AS ss, sum(s * (a - s)) AS sa FROM t GROUP BY ALL), marks AS (SELECT part, subject, phase, center, condition, round((ss - n) / nullif(n * (n - 1), 0) - sa / nullif(n * (m - n), 0), 6) AS score FROM p),
names AS (SELECT DISTINCT subject, phase, condition FROM trials), every AS (SELECT * FROM names, (SELECT DISTINCT part FROM marks), (SELECT DISTINCT center FROM near))
SELECT subject, phase, center, part, condition, score FROM every LEFT JOIN marks USING (part, subject, phase, center, condition)""")
def condition_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within less between similarity of each condition around every voxel, over all trials and over both halves."""
    m = maps.condition_maps(A.trials(spark, sf_dir), grid(spark), RADIUS, KEYS, side=SIDE)
    return m.select(*KEYS, "center", "part", "condition", *r6("score"))


@query(f"""WITH {LONG}, {_NEAR}, {_UNITS.format(keys='subject, phase, condition, trial_idx', source='long')}, s AS (SELECT subject, phase, condition, center, pos, avg(u) AS m FROM u GROUP BY ALL)
SELECT a.subject, a.phase, a.center, a.condition AS cond_a, b.condition AS cond_b, round(sum(a.m * b.m), 6) AS similarity FROM s a JOIN s b USING (subject, phase, center, pos) WHERE a.condition < b.condition GROUP BY ALL""")
def pair_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity between the trials of two conditions around every voxel."""
    return maps.pair_maps(A.trials(spark, sf_dir), grid(spark), RADIUS, KEYS, side=SIDE).select(*KEYS, "center", "cond_a", "cond_b", *r6("similarity"))


@query(f"""WITH {LONG}, {_NEAR}, {_UNITS.format(keys='subject, phase, condition, trial_idx', source='long')}, s AS (SELECT subject, phase, condition, center, pos, sum(u) AS s, count(*) AS n FROM u GROUP BY ALL),
t AS (SELECT *, sum(s) OVER w AS a, sum(n) OVER w AS m FROM s WINDOW w AS (PARTITION BY subject, phase, center, pos))
SELECT u.subject, u.phase, u.center, u.condition, u.trial_idx, CASE WHEN max(n) >= 2 AND max(m - n) > 0 THEN round(sum(u * (s - u)) / (max(n) - 1) - sum(u * (a - s)) / max(m - n), 6) END AS score
FROM u JOIN t USING (subject, phase, condition, center, pos) GROUP BY ALL""")
def trial_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each trial around every voxel."""
    return maps.trial_maps(A.trials(spark, sf_dir), grid(spark), RADIUS, KEYS, side=SIDE).select(*KEYS, "center", "condition", "trial_idx", *r6("score"))


_MEANS = "m AS (SELECT subject, phase, condition, pos - 1 AS pos, avg(x) AS m FROM long GROUP BY ALL)"


@query(f"""WITH {LONG}, {_NEAR}, {_MEANS}, d AS (SELECT a.subject, center, a.condition AS c1, b.condition AS c2, sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)) AS s FROM m a JOIN m b USING (subject, pos) JOIN near USING (pos) WHERE a.phase = 'learn' AND b.phase = 'test' GROUP BY ALL),
ways AS (SELECT subject, center, least(c1, c2) AS cond_a, greatest(c1, c2) AS cond_b, avg(s) AS s, count(*) AS n FROM d GROUP BY ALL), names AS (SELECT DISTINCT subject, condition FROM trials), centers AS (SELECT DISTINCT center FROM near),
every AS (SELECT a.subject, center, a.condition AS cond_a, b.condition AS cond_b FROM names a JOIN names b ON a.subject = b.subject AND a.condition <= b.condition CROSS JOIN centers)
SELECT subject, center, cond_a, cond_b, CASE WHEN n = CASE WHEN cond_a = cond_b THEN 1 ELSE 2 END THEN round(s, 6) END AS similarity FROM every LEFT JOIN ways USING (subject, center, cond_a, cond_b)""")
def cross_phase_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of conditions across phases around every voxel."""
    return maps.cross_phase_maps(A.trials(spark, sf_dir), grid(spark), RADIUS, ["subject"], "learn", "test", side=SIDE).select("subject", "center", "cond_a", "cond_b", *r6("similarity"))


@query(f"""WITH {LONG}, {_NEAR}, {_MEANS} SELECT l.subject, center, l.phase, l.condition, trial_idx, CASE WHEN count(m.m) > 0 THEN round(sum(x * m.m) / sqrt(sum(x * x) * sum(m.m * m.m)), 6) END AS similarity
FROM long l JOIN near n ON n.pos = l.pos - 1 LEFT JOIN m ON m.subject = l.subject AND m.condition = l.condition AND m.pos = n.pos AND m.phase <> l.phase GROUP BY ALL""")
def cross_phase_trial_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each trial with its condition's pattern in the other phase, around every voxel."""
    m = maps.cross_phase_trial_maps(A.trials(spark, sf_dir), grid(spark), RADIUS, ["subject"], "learn", "test", side=SIDE)
    return m.select("subject", "center", "phase", "condition", "trial_idx", *r6("similarity"))


_SIMILAR = f"""alike AS (SELECT l.subject, l.phase, center, l.condition, m.condition AS other, trial_idx, sum(x * m.m) / sqrt(sum(x * x) * sum(m.m * m.m)) AS s FROM long l JOIN near n ON n.pos = l.pos - 1
JOIN m ON m.subject = l.subject AND m.phase = l.phase AND m.condition <> l.condition AND m.pos = n.pos GROUP BY ALL)"""


@query(f"""WITH {LONG}, {_NEAR}, {_MEANS}, numbered AS (SELECT subject, phase, condition, trial_idx, row_number() OVER w AS k, count(*) OVER (PARTITION BY subject, phase, condition) AS n FROM trials WINDOW w AS (PARTITION BY subject, phase, condition ORDER BY trial_idx)),
staged AS (SELECT l.subject, l.phase, l.condition, l.pos - 1 AS pos, avg(x) FILTER (k <= 4) AS early, avg(x) FILTER (k > n - 4) AS late FROM long l JOIN numbered USING (trial_idx) WHERE n >= 8 GROUP BY ALL),
delta AS (SELECT a.subject, a.phase, center, a.condition AS cond_a, b.condition AS cond_b, sum(a.late * b.late) / sqrt(sum(a.late * a.late) * sum(b.late * b.late)) - sum(a.early * b.early) / sqrt(sum(a.early * a.early) * sum(b.early * b.early)) AS delta
  FROM staged a JOIN staged b USING (subject, phase, pos) JOIN near USING (pos) WHERE a.condition < b.condition GROUP BY ALL), {_SIMILAR},
slopes AS (SELECT s.subject, s.phase, center, s.condition, other, regr_slope(s, k) AS slope FROM alike s JOIN numbered USING (trial_idx) GROUP BY ALL),
way AS (SELECT subject, phase, center, least(condition, other) AS cond_a, greatest(condition, other) AS cond_b, avg(slope) AS slope FROM slopes GROUP BY ALL)
SELECT subject, phase, center, cond_a, cond_b, round(delta, 6) AS delta, round(slope, 6) AS slope FROM delta JOIN way USING (subject, phase, center, cond_a, cond_b)""")
def dynamic_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the similarity of two conditions from early to late trials, and its slope, around every voxel."""
    return maps.dynamic_maps(A.trials(spark, sf_dir), grid(spark), RADIUS, KEYS, side=SIDE).select(*KEYS, "center", "cond_a", "cond_b", *r6("delta", "slope"))


@query(f"WITH {LONG}, {_NEAR}, {_MEANS}, {_SIMILAR} SELECT subject, phase, center, condition, other, trial_idx, round(s, 6) AS similarity FROM alike")
def dynamic_trial_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each trial with the pattern of every other condition, around every voxel."""
    return maps.dynamic_trial_maps(A.trials(spark, sf_dir), grid(spark), RADIUS, KEYS, side=SIDE).select(*KEYS, "center", "condition", "other", "trial_idx", *r6("similarity"))


@query(f"""WITH {FEATURES}, n AS (SELECT feature_id, row_number() OVER (ORDER BY feature_id) - 1 AS k, count(*) OVER () AS n FROM features)
SELECT feature_id, CAST(c AS BIGINT) AS chunk FROM n, range({CHUNKS}) AS r(c) WHERE k >= c * n // {CHUNKS} AND k < (c + 1) * n // {CHUNKS}""")
def voxel_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels in chunks of near equal size, in order."""
    return maps.chunked(A.features(spark, sf_dir), CHUNKS).select("feature_id", "chunk")


_ORDER = "o AS (SELECT roi, row_number() OVER (ORDER BY min(feature_id)) AS k, count(*) AS n FROM features GROUP BY roi), begins AS (SELECT roi, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM o), places AS (SELECT feature_id, roi, b + row_number() OVER (PARTITION BY roi ORDER BY feature_id) - 1 AS pos FROM features JOIN begins USING (roi))"


@query(f"WITH {FEATURES}, {_ORDER}, v AS (SELECT l_partkey AS pos, avg(l_quantity) AS value FROM lineitem GROUP BY 1) SELECT feature_id, roi, round(coalesce(value, 0), 6) AS value FROM places LEFT JOIN v USING (pos)")
def region_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat vector of one value a line-item part, put into the voxels of the regions, which come in the order of their first voxel."""
    grid = A.features(spark, sf_dir)
    order = grid.groupBy("roi").agg(F.min("feature_id").alias("order"))
    means = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("pos")).agg(F.avg("l_quantity").alias("value"))
    every = grid.select(F.col("feature_id").alias("pos")).join(means, "pos", "full").select("pos", F.coalesce("value", F.lit(0.0)).alias("value"))
    return geometry.scatter(every, grid, order).select("feature_id", "roi", *r6("value"))


@query(f"""WITH {FEATURES}, p AS (SELECT l_partkey AS feature_id, l_suppkey % 5 AS structure, avg(l_quantity) AS probability FROM lineitem GROUP BY ALL), g(region, structure) AS (VALUES ('low', 0), ('low', 1), ('middle', 2), ('middle', 3), ('high', 4)),
t AS (SELECT region, feature_id, sum(probability) AS s FROM p JOIN g USING (structure) GROUP BY ALL HAVING sum(probability) > 40) SELECT region, CASE WHEN i < 10 THEN 'left' ELSE 'right' END AS hemisphere, feature_id FROM t JOIN features USING (feature_id) WHERE i <> 10""")
def hemisphere_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of three regions in which the values of their structures add up to over 40, by hemisphere."""
    p = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("feature_id"), (F.col("l_suppkey") % 5).alias("structure")).agg(F.avg("l_quantity").alias("probability"))
    p = p.join(A.features(spark, sf_dir).select("feature_id", (F.col("i") - 10).alias("x")), "feature_id")
    groups = spark.createDataFrame([("low", 0), ("low", 1), ("middle", 2), ("middle", 3), ("high", 4)], "region string, structure long")
    return atlas.hemisphere_masks(p, groups, 40.0)


@query(f"WITH {SCORES} SELECT subject, condition, trial_no, round(score, 6) AS score FROM scores WHERE trial_no BETWEEN 3 AND 8")
def trials_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials from the third to the eighth of each subject and condition."""
    return selection.in_range(A.scores(spark, sf_dir), "trial_no", (3, 8)).select("subject", "condition", "trial_no", *r6("score"))
