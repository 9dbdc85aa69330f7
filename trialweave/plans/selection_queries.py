"""Queries that select, match and rearrange, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions import vectors as V
from trialweave.functions.aggregates import corr
from trialweave.operators import centroids, geometry, selection, similarity
from trialweave.operators import permutation as perm
from trialweave.sources import adapters as A
from trialweave.sources.adapters import FEATURES, LONG, MAPS, SCORES, TRIALS, WIDTH

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query("""SELECT s_suppkey, coalesce(TRY_CAST(nullif(regexp_extract(s_name, '#([0-9]+)', 1), '') AS BIGINT), TRY_CAST(nullif(regexp_extract(s_name, '([0-9]+)', 1), '') AS BIGINT)) AS trial_no FROM supplier""")
def parsed_trial_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "supplier").select("s_suppkey", selection.trial_number("s_name").alias("trial_no"))


@query("""WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1), t AS (SELECT p_size FROM c ORDER BY n DESC, p_size LIMIT 1) SELECT p_partkey, p_size FROM part WHERE p_size = (SELECT p_size FROM t)""")
def majority_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.majority(A.table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size")


@query(f"""WITH {SCORES}, n AS (SELECT subject, condition, count(*) AS n FROM scores GROUP BY ALL) SELECT condition, count(*) AS n_keys, count(CASE WHEN n >= 8 THEN 1 END) AS n_enough, CAST(sum(n) AS BIGINT) AS n_trials FROM n GROUP BY condition""")
def trial_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.coverage(A.scores(spark, sf_dir), ["subject"], "condition", 8)


@query(f"""WITH {MAPS}, e AS (SELECT feature_id, round(avg(value) - 25.5, 6) AS effect, subject % 2 AS g FROM maps GROUP BY feature_id, subject % 2), m AS (SELECT CASE WHEN g = 0 THEN 'G1' ELSE 'G2' END AS grp, feature_id, effect FROM e), h AS (SELECT count(*) AS n FROM m WHERE grp = 'G1' AND effect > 12)
SELECT grp, feature_id, effect FROM m WHERE grp = 'G1' AND effect > 12 UNION ALL SELECT grp, feature_id, effect FROM (SELECT *, row_number() OVER (ORDER BY abs(effect) DESC, feature_id DESC) AS k FROM m WHERE grp = 'G2') WHERE k <= (SELECT n FROM h)""")
def matched_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first group's hits, and as many of the second group's largest effects, which has no hits of its own here."""
    e = A.maps(spark, sf_dir).groupBy("feature_id", F.when(F.col("subject") % 2 == 0, "G1").otherwise("G2").alias("grp")).agg(F.round(F.avg("value") - 25.5, 6).alias("effect"))
    return selection.matched(e, "grp", "G1", "G2", (F.col("grp") == "G1") & (F.col("effect") > 12), "effect", "feature_id").select("grp", "feature_id", "effect")


@query(f"""WITH {SCORES} SELECT subject, condition, array_to_string(list(CAST(event_id AS VARCHAR) ORDER BY trial_no), ',') AS events FROM scores GROUP BY ALL""")
def condition_event_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = selection.event_lists(A.scores(spark, sf_dir), ["subject", "condition"], "trial_no", "trial_no", "event_id")
    return lists.select("subject", "condition", F.array_join(F.transform("event_ids", lambda x: x.cast("string")), ",").alias("events"))


@query(f"""WITH {SCORES}, j AS (SELECT a.subject, a.condition, a.trial_no AS target, avg(b.score) FILTER (a.trial_no = b.trial_no) AS own, avg(b.score) FILTER (a.trial_no <> b.trial_no) AS others FROM scores a JOIN scores b ON a.subject = b.subject AND a.condition = b.condition GROUP BY ALL) SELECT subject, condition, target, round(own, 6) AS own, round(others, 6) AS others FROM j""")
def trial_against_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trial beside the mean of the others of its subject and condition."""
    s = A.scores(spark, sf_dir).select("subject", "condition", F.col("trial_no").alias("target"), "score")
    j = selection.beside_others(s, ["subject", "condition"], "score")
    return j.select("subject", "condition", "target", F.round("own", 6).alias("own"), F.round("others", 6).alias("others"))


@query("""SELECT CAST(user_id AS BIGINT) AS subject FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 99""")
def subject_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with both conditions, without those with an outlying trial."""
    e = A.table(spark, sf_dir, "events")
    of = lambda c: e.where(c).select(F.col("user_id").alias("subject"))
    return of("event_type = 'click'").intersect(of("event_type = 'purchase'")).subtract(of("event_type = 'error' and value > 99"))


_NEAR = "near AS (SELECT a.feature_id AS center, b.feature_id AS neighbor FROM features a JOIN features b ON abs(a.i-b.i) <= 1 AND abs(a.j-b.j) <= 1 AND abs(a.k-b.k) <= 1 AND (a.i-b.i)*(a.i-b.i)+(a.j-b.j)*(a.j-b.j)+(a.k-b.k)*(a.k-b.k) <= 1)"


@query(f"""WITH {FEATURES}, {_NEAR}, line AS (SELECT l_partkey AS feature_id, l_returnflag AS condition, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), j AS (SELECT center, condition, neighbor, v FROM near JOIN line ON neighbor = feature_id),
p AS (SELECT a.center, a.condition AS cond_a, b.condition AS cond_b, corr(a.v, b.v) AS r, count(*) AS n FROM j a JOIN j b ON a.center = b.center AND a.neighbor = b.neighbor AND a.condition < b.condition GROUP BY ALL)
SELECT center, round(avg(1 - r), 5) AS dissimilarity FROM p WHERE n >= 5 AND r IS NOT NULL AND NOT isnan(r) GROUP BY center HAVING count(*) = 3""")
def sphere_dissimilarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean correlation distance of three condition patterns over the sphere of each voxel."""
    line = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("feature_id"), F.col("l_returnflag").alias("condition")).agg(F.avg("l_quantity").alias("v"))
    # the three conditions of a voxel in one row: pairs of them need no join
    wide = line.groupBy("feature_id").agg(*[F.max(F.when(F.col("condition") == c, F.col("v"))).alias(c) for c in "ANR"])
    points = A.features(spark, sf_dir).hint("merge").join(wide, "feature_id", "left")  # the values go along with their voxel
    j = geometry.sphere(points, 1.0, keep=list("ANR"))
    ok = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    pairs = [("A", "N"), ("A", "R"), ("N", "R")]
    r = j.groupBy("center").agg(*[corr(F.when(ok(a, b), F.col(a)), F.when(ok(a, b), F.col(b))).alias(f"r{k}") for k, (a, b) in enumerate(pairs)], *[F.count(F.when(ok(a, b), 1)).alias(f"n{k}") for k, (a, b) in enumerate(pairs)])
    full = r.where(" and ".join(f"n{k} >= 5 and r{k} is not null and not isnan(r{k})" for k in range(3)))
    return full.select("center", F.round(((1 - F.col("r0")) + (1 - F.col("r1")) + (1 - F.col("r2"))) / 3, 5).alias("dissimilarity"))


_PERMS = 20


@query(f"""WITH {LONG}, base AS (SELECT subject, trial_idx, condition, row_number() OVER (PARTITION BY subject ORDER BY trial_idx) AS k FROM trials WHERE phase = 'learn'), drawn AS (SELECT subject, trial_idx, unnest(range(1, {_PERMS + 1})) AS perm_id FROM base),
r AS (SELECT *, row_number() OVER (PARTITION BY perm_id, subject ORDER BY md5(perm_id || '-' || trial_idx), trial_idx) AS k FROM drawn), l AS (SELECT r.perm_id, r.subject, r.trial_idx, b.condition FROM r JOIN base b USING (subject, k) WHERE b.condition IN ('B', 'C')),
cell AS (SELECT perm_id, subject, condition, pos, avg(x) AS x FROM l JOIN long USING (subject, trial_idx) WHERE phase = 'learn' GROUP BY perm_id, subject, l.condition, pos), v AS (SELECT perm_id, subject, condition, list(x ORDER BY pos) AS v FROM cell GROUP BY ALL)
SELECT a.perm_id, a.subject, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM v a JOIN v b ON a.perm_id = b.perm_id AND a.subject = b.subject AND a.condition = 'B' AND b.condition = 'C'""".replace("l.condition, pos)", "l.condition, pos)").replace("SELECT perm_id, subject, condition, pos, avg(x) AS x FROM l JOIN long USING (subject, trial_idx)", "SELECT l.perm_id, l.subject, l.condition, pos, avg(x) AS x FROM l JOIN long ON l.subject = long.subject AND l.trial_idx = long.trial_idx").replace("GROUP BY perm_id, subject, l.condition, pos", "GROUP BY ALL"))
def label_permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of two conditions' centroids under labels shuffled within each subject."""
    t = A.trials(spark, sf_dir).where("phase = 'learn'")
    labels = perm.within_subject_labels(t, "subject", "trial_idx", "condition", _PERMS).where(F.col("condition").isin("B", "C"))
    m = centroids.mean_vectors(labels.join(t.select("trial_idx", "features"), "trial_idx"), ["perm_id", "subject", "condition"], WIDTH)
    two = m.groupBy("perm_id", "subject").agg(*[F.any_value(F.when(F.col("condition") == c, F.col("centroid")), True).alias(c) for c in "BC"])
    return two.where("B is not null and C is not null").select("perm_id", "subject", F.round(V.cosine("B", "C"), 6).alias("cosine"))


@query(f"""WITH {LONG}, num AS (SELECT subject, trial_idx, avg(x) FILTER (pos <= 16) AS m, phase, condition FROM long GROUP BY ALL) SELECT subject, phase, condition, count(*) AS n, round(corr(m, trial_idx), 6) AS r FROM num GROUP BY ALL HAVING count(*) >= 3""")
def region_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of a region's mean (its first 16 features) with trial order."""
    t = A.trials(spark, sf_dir).withColumn("m", V.mean(V.gather("features", list(range(16)))))
    g = t.groupBy("subject", "phase", "condition").agg(F.count(F.lit(1)).alias("n"), F.round(corr("m", F.col("trial_idx").cast("double")), 6).alias("r"))
    return g.where("n >= 3")


@query(f"""WITH {TRIALS}, c AS (SELECT subject, phase, trial_idx, list_transform(features, lambda x: x - list_avg(features)) AS c FROM trials),
n AS (SELECT subject, phase FROM trials GROUP BY ALL HAVING count(*) > 1)
SELECT a.subject, a.phase, a.trial_idx AS row, b.trial_idx AS col, CASE WHEN a.trial_idx <> b.trial_idx THEN round(list_cosine_similarity(a.c, b.c), 6) END AS value FROM c a JOIN c b ON a.subject = b.subject AND a.phase = b.phase JOIN n ON n.subject = a.subject AND n.phase = a.phase""")
def trial_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both triangles of each subject's trial matrix, NULL on the diagonal."""
    m = similarity.matrix(similarity.pairs(A.trials(spark, sf_dir), ["subject", "phase"]), ["subject", "phase"])
    return m.withColumn("value", F.round("value", 6))
