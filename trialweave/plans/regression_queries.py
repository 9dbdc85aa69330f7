"""Queries of regressions with several covariates and mixed models; SQL stands beside those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.operators import regression
from trialweave.plans.ordered_queries import _MERGED, _merged, r6
from trialweave.sources import adapters as A

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
COVARIATES = ["n_orders", "mean_price"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _partial(a: str, b: str, c: str) -> str:
    """Partial correlation of a and b given c, in SQL, from columns r_{two names}."""
    r = lambda x, y: "r_" + "".join(sorted((x, y)))
    return f"({r(a, b)} - {r(a, c)} * {r(b, c)}) / sqrt((1 - {r(a, c)} * {r(a, c)}) * (1 - {r(b, c)} * {r(b, c)}))"


@query(_MERGED + f""", c AS (SELECT grp, count(*) AS n, corr(spent, clinical) AS r_xy, corr(spent, n_orders) AS r_vx, corr(clinical, n_orders) AS r_vy, corr(spent, mean_price) AS r_wx, corr(clinical, mean_price) AS r_wy, corr(n_orders, mean_price) AS r_vw FROM m GROUP BY grp),
p AS (SELECT grp, n, r_xy, {_partial('x', 'y', 'v')} AS xy, {_partial('x', 'w', 'v')} AS xw, {_partial('y', 'w', 'v')} AS yw FROM c), q AS (SELECT grp, n, r_xy AS r, (xy - xw * yw) / sqrt((1 - xw * xw) * (1 - yw * yw)) AS partial_r FROM p), t AS (SELECT *, partial_r * sqrt((n - 2) / (1 - partial_r * partial_r)) AS t FROM q)
SELECT grp, n, round(r, 6) AS r, round(partial_r, 6) AS partial_r, round({A.p_sql('t', '(n - 2)')}, 6) AS p FROM t""")
def clinical_partial_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of spending and the clinical score without two covariates."""
    return regression.partial_correlation(_merged(spark, sf_dir), ["grp"], "spent", "clinical", COVARIATES).select("grp", "n", *r6("r", "partial_r", "p"))


@query(_MERGED + f""", c AS (SELECT grp, count(*) AS n, covar_pop(n_orders, n_orders) AS aa, covar_pop(n_orders, clinical) AS ab, covar_pop(clinical, clinical) AS bb, covar_pop(n_orders, spent) AS ay, covar_pop(clinical, spent) AS "by", covar_pop(spent, spent) AS yy FROM m GROUP BY grp),
d AS (SELECT *, aa * bb - ab * ab AS det, (ay * bb - "by" * ab) / (aa * bb - ab * ab) AS sa, ("by" * aa - ay * ab) / (aa * bb - ab * ab) AS sb FROM c), e AS (SELECT *, yy - sa * ay - sb * "by" AS rest FROM d),
f AS (SELECT grp, n, 'n_orders' AS term, sa AS slope, sa * sqrt(aa / yy) AS beta, sqrt(rest * n / (n - 3) * bb / det / n) AS se, 1 - rest / yy AS r2 FROM e UNION ALL SELECT grp, n, 'clinical', sb, sb * sqrt(bb / yy), sqrt(rest * n / (n - 3) * aa / det / n), 1 - rest / yy FROM e), g AS (SELECT *, slope / se AS t FROM f)
SELECT grp, term, n, round(slope, 4) AS slope, round(beta, 6) AS beta, round(se, 4) AS se, round(t, 5) AS t, round({A.p_sql('t', '(n - 3)')}, 6) AS p, round(r2, 6) AS r2 FROM g""")
def clinical_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spending on the number of orders and the clinical score, with slopes of z-scores."""
    t = regression.ols(_merged(spark, sf_dir), ["grp"], ["n_orders", "clinical"], "spent")
    return t.select("grp", "term", "n", F.round("slope", 4).alias("slope"), *r6("beta"), F.round("se", 4).alias("se"), F.round("t", 5).alias("t"), *r6("p", "r2"))


@query()
def mixed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of trials by group, drug and their interaction, with a random intercept a subject, in each condition."""
    s = A.scores(spark, sf_dir).select("subject", "condition", "score", *A.groups())
    s = s.withColumn("group2", (F.col("grp") == "G2").cast("double")).withColumn("drug2", (F.col("drug") == "D2").cast("double")).withColumn("both", F.col("group2") * F.col("drug2"))
    return regression.random_intercept(s, ["condition"], ["group2", "drug2", "both"], "score", "subject")
