"""Linear decoding within groups that a task can hold (a subject's trials, a set of subjects): fits in NumPy, scoring and counting in DataFrames."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions import vectors as V
from trialweave.operators.lineage import cut
from trialweave.operators.ordered import same

MODEL = "mean array<double>, scale array<double>, coef array<double>, intercept double"


def seed_of(*parts: object) -> int:
    return int.from_bytes(hashlib.md5("|".join(map(str, parts)).encode()).digest()[:4], "little")


def standardizer(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each feature, a deviation of 0 as 1."""
    scale = x.std(0)
    return x.mean(0), np.where(scale == 0, 1.0, scale)


def logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, penalize_intercept: bool = False, steps: int = 100) -> tuple[np.ndarray, float]:
    """L2 logistic regression with balanced weights by Newton steps, on rows scaled beforehand; y is 0 or 1.

    In the dual form where features outnumber rows: w = X' a, so that a step solves a system of rows.
    """
    n, n_pos = len(y), int(y.sum())
    weight = np.where(y == 1, n / (2 * n_pos), n / (2 * (n - n_pos)))
    basis = x if x.shape[1] <= n else np.linalg.qr(x.T)[0]  # rows only reach the span of x
    z = x if basis is x else x @ basis
    a = np.column_stack([z, np.ones(n)])
    ridge = np.full(a.shape[1], 1.0)
    ridge[-1] = 1.0 if penalize_intercept else 1e-10
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        grad = c * a.T @ (weight * (p - y)) + ridge * w
        hess = c * (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return (w[:-1] if basis is x else basis @ w[:-1]), float(w[-1])


def logistic_draws(x: np.ndarray, ys: np.ndarray, c: float = 1.0, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """:func:`logistic` for each row of labels in ``ys``, in Newton steps of all draws at once: coefficients (draws by features) and intercepts.

    ``x`` is draws by rows by features, or has one entry for all draws. Where features are as many as
    rows or more, coefficients are sums of rows, and a step solves for the rows' shares.
    """
    n, n_pos = ys.shape[1], ys.sum(1, keepdims=True)
    weight = np.where(ys == 1, n / (2 * n_pos), n / (2 * (n - n_pos)))
    if x.shape[2] >= n:
        return _logistic_shares(x, ys, c * weight, steps)
    a = np.concatenate([x, np.ones((*x.shape[:2], 1))], 2)
    ridge = np.full(a.shape[2], 1.0)
    ridge[-1] = 1e-10
    w = np.zeros((len(ys), a.shape[2]))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip((a @ w[:, :, None])[:, :, 0], -35, 35)))
        grad = c * (a.swapaxes(1, 2) @ (weight * (p - ys))[:, :, None])[:, :, 0] + ridge * w
        hess = c * a.swapaxes(1, 2) @ (a * (weight * p * (1 - p))[:, :, None]) + np.diag(ridge)
        step = np.linalg.solve(hess, grad[:, :, None])[:, :, 0]
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w[:, :-1], w[:, -1]


#: Draws whose matrices are worked on at once, so that they stay in the processor's cache.
TOGETHER = 50


def _logistic_shares(x: np.ndarray, ys: np.ndarray, weight: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The same Newton steps in the scores of the rows: coefficients are x' share, and the matrix of a step is that of products of rows, with 1 added."""
    draws, n = ys.shape
    if draws > TOGETHER:
        parts = [slice(lo, lo + TOGETHER) for lo in range(0, draws, TOGETHER)]
        done = [_logistic_shares(x if len(x) == 1 else x[k], ys[k], weight[k], steps) for k in parts]
        return np.concatenate([c for c, _ in done]), np.concatenate([b for _, b in done])
    product = x @ x.swapaxes(1, 2)
    whole = np.empty((draws, n + 1, n + 1))
    right = np.zeros((draws, n + 1, 1))
    share, shift, score = np.zeros((draws, n)), np.zeros((draws, 1)), np.zeros((draws, n))
    at = np.arange(n)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(score, -35, 35)))
        root = np.sqrt(weight * p * (1 - p))
        np.multiply(product, root[:, :, None], out=whole[:, :n, :n])
        whole[:, :n, :n] *= root[:, None, :]
        whole[:, at, at] += 1
        whole[:, :n, n] = whole[:, n, :n] = root
        whole[:, n, n] = -1e-10
        right[:, :n, 0] = root * score - weight * (p - ys) / root
        found = np.linalg.solve(whole, right)[:, :, 0]
        share, shift = root * found[:, :n], found[:, n:]
        new = (product @ share[:, :, None])[:, :, 0] + shift
        moved, score = np.abs(new - score).max(), new
        if moved < 1e-6:  # steps are squared from one to the next: what is left is under 1e-11
            break
    coef = share @ x[0] if len(x) == 1 else (share[:, None, :] @ x)[:, 0]
    return coef, shift[:, 0]


def fit(x: np.ndarray, y: np.ndarray, c: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    mean, scale = standardizer(x)
    coef, intercept = logistic((x - mean) / scale, y, c)
    return mean, scale, coef, intercept


def decision(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray, float]) -> np.ndarray:
    mean, scale, coef, intercept = model
    return (x - mean) / scale @ coef + intercept


def folds(y: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Stratified folds: each class is shuffled and dealt round; fewer folds where a class is small."""
    out, r = np.zeros(len(y), int), np.random.default_rng(seed)
    for value in np.unique(y):
        at = r.permutation(np.flatnonzero(y == value))
        out[at] = np.arange(len(at)) % k
    return out


def group_folds(y: np.ndarray, groups: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Whole groups to folds, largest first, each to the fold with the fewest rows so far."""
    names, counts = np.unique(groups, return_counts=True)
    k, load, fold = min(k, len(names)), np.zeros(min(k, len(names))), {}
    order = np.lexsort((np.random.default_rng(seed).permutation(len(names)), -counts))
    for g in order:
        fold[names[g]] = int(load.argmin())
        load[fold[names[g]]] += counts[g]
    return np.array([fold[g] for g in groups])


def fold_draws(ys: np.ndarray, k: int, r: np.random.Generator) -> np.ndarray:
    """Stratified folds of each row of labels with equal class counts, so a fold has the same size in every draw."""
    by_class = np.argsort(ys + r.random(ys.shape), 1)  # a class after the other, each shuffled
    n_pos = int(ys[0].sum())
    dealt = np.concatenate([np.arange(ys.shape[1] - n_pos) % k, np.arange(n_pos) % k])
    out = np.empty(ys.shape, int)
    np.put_along_axis(out, by_class, np.broadcast_to(dealt, ys.shape), 1)
    return out


def cv_accuracy_draws(x: np.ndarray, ys: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Cross-validated accuracy of each row of labels with its own folds."""
    hits = np.zeros(len(ys))
    for f in np.unique(fold):
        order = np.argsort(fold == f, 1, kind="stable")
        train, test = np.split(order, [int((fold[0] != f).sum())], 1)
        rows = x[train]
        mean, scale = rows.mean(1, keepdims=True), rows.std(1, keepdims=True)
        scale = np.where(scale == 0, 1.0, scale)
        coef, shift = logistic_draws((rows - mean) / scale, np.take_along_axis(ys, train, 1))
        s = (((x[test] - mean) / scale) @ coef[:, :, None])[:, :, 0] + shift[:, None]
        hits += ((s > 0) == np.take_along_axis(ys, test, 1)).sum(1)
    return hits / ys.shape[1]


def cv_scores(x: np.ndarray, y: np.ndarray, fold: np.ndarray, c: float = 1.0) -> np.ndarray:
    """Decision scores of rows from models that did not see their fold; NaN where a class is missing."""
    out = np.full(len(y), np.nan)
    for f in np.unique(fold):
        train = fold != f
        if len(np.unique(y[train])) == 2:
            out[~train] = decision(x[~train], fit(x[train], y[train], c))
    return out


def _grouped(df: DataFrame, keys: list[str], condition: str, pair: tuple[str, str], order: str, vector: str, body, schema: str, spread: bool = True) -> DataFrame:
    """``body(x, y, key, table)`` on each group's two conditions, the second as 1.

    Fits cost time, not bytes: with ``spread`` they keep the session's number of partitions, which
    adaptive execution would merge to a few as the rows are small.
    """
    kinds = dict(df.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x, y = np.stack(pdf[vector].to_numpy()).astype(float), (pdf[condition] == pair[1]).to_numpy().astype(int)
        out = body(x, y, key, pdf)
        names = [s.split()[0] for s in schema.split(", ")]
        frame = pd.DataFrame(out) if out is not None else pd.DataFrame({n: [] for n in names}, dtype=object)
        for k, v in zip(keys, key, strict=True):
            frame[k] = v
        return frame[[*keys, *names]]

    full = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + schema
    rows = df.where(F.col(condition).isin(*pair))
    if spread:
        rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return rows.groupBy(*keys).applyInPandas(run, full)


#: Draws of a block: refits of a group are spread over tasks by blocks.
PER_BLOCK = 500


def _blocks(df: DataFrame, n_draws: int) -> DataFrame:
    """Each row once for every block of draws, numbered in _block."""
    return df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((n_draws - 1) // PER_BLOCK))))


def _block_size(block: int, n_draws: int) -> int:
    return min(PER_BLOCK, n_draws - block * PER_BLOCK)


def decode(df: DataFrame, keys: list[str], pair: tuple[str, str], condition: str = "condition", order: str = "trial_idx", vector: str = "features", k: int = 4, min_trials: int = 4) -> DataFrame:
    """Cross-validated accuracy and mean margin for each group; NULL under ``min_trials`` or two of a class."""

    def body(x, y, key, _pdf):
        least = min((y == 0).sum(), (y == 1).sum())
        if len(y) < min_trials or least < 2 or x.shape[1] < 2:
            return {"n_trials": [len(y)], "accuracy": [None], "margin": [None]}
        s = cv_scores(x, y, folds(y, int(min(k, least)), seed_of(*key)))
        ok = np.isfinite(s)
        return {"n_trials": [len(y)], "accuracy": [float(((s > 0) == y)[ok].mean())], "margin": [float((2 * s * (2 * y - 1))[ok].mean())]}

    return _grouped(df, keys, condition, pair, order, vector, body, "n_trials bigint, accuracy double, margin double")


def models(df: DataFrame, keys: list[str], pair: tuple[str, str], condition: str = "condition", order: str = "trial_idx", vector: str = "features", c: float = 1.0, sample_rows: int = 20_000) -> DataFrame:
    """A fitted model as a row for each group, for joins; of a larger group, ``sample_rows`` rows by the hashes of ``order``."""
    df = df.where(F.col(condition).isin(*pair))
    # of a large group only rows with hashes in a range that holds about 1.2 times the sample are ordered
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    share = F.xxhash64(order).bitwiseAND(F.lit(2**52 - 1)) / F.lit(float(2**52))
    near = same(df, sizes, keys).where((F.col("_size") <= sample_rows) | (share * F.col("_size") <= 1.2 * sample_rows))
    w = Window.partitionBy(*keys).orderBy(share, order)
    df = near.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= sample_rows).drop("_place", "_size")

    def body(x, y, _key, _pdf):
        if len(np.unique(y)) < 2:
            return None
        mean, scale, coef, intercept = fit(x, y, c)
        return {"mean": [mean.tolist()], "scale": [scale.tolist()], "coef": [coef.tolist()], "intercept": [intercept]}

    return _grouped(df, keys, condition, pair, order, vector, body, MODEL, spread=False)  # already dealt by the windows


def score(vector: str = "features") -> Column:
    """Decision score of a row beside the columns of a model."""
    z = F.zip_with(V.subtract(vector, "mean"), "scale", lambda x, s: x / s)
    return V.dot(z, "coef") + F.col("intercept")


def transfer(df: DataFrame, fitted: DataFrame, keys: list[str], pair: tuple[str, str], condition: str = "condition", vector: str = "features") -> DataFrame:
    """Scores, predictions and probabilities of rows under the models of their keys: decoding across phases or groups."""
    j = df.where(F.col(condition).isin(*pair)).join(fitted, keys).withColumn("score", score(vector))
    j = j.withColumn("predicted", F.when(F.col("score") > 0, pair[1]).otherwise(pair[0])).withColumn("probability", 1 / (1 + F.exp(-F.col("score"))))
    return j.drop("mean", "scale", "coef", "intercept", vector)


def forced_choice(scored: DataFrame, subject: str, pair: tuple[str, str], condition: str = "condition") -> DataFrame:
    """Share of subjects whose mean score is higher for the second condition, and how many subjects have both."""
    of = lambda c: F.avg(F.when(F.col(condition) == c, F.col("score")))
    per = scored.groupBy(subject).agg(of(pair[0]).alias("_low"), of(pair[1]).alias("_high")).where("_low is not null and _high is not null")
    return per.agg(F.count(F.lit(1)).alias("n_subjects"), F.avg((F.col("_high") > F.col("_low")).cast("int")).alias("accuracy"))


def centroid_scores(train: DataFrame, test: DataFrame, keys: list[str], pair: tuple[str, str], width: int, condition: str = "condition", vector: str = "features") -> DataFrame:
    """Rows of both conditions with their place on the axis between the training centroids of their keys: 0 in the middle, over 0 on the second's side. Keys without both centroids give no rows."""
    from trialweave.operators.centroids import mean_vectors

    m = mean_vectors(train.where(F.col(condition).isin(*pair)), [*keys, condition], width, vector)
    of = lambda c, name: m.where(F.col(condition) == c).select(*keys, F.col("centroid").alias(name))
    axis = of(pair[0], "_low").join(of(pair[1], "_high"), keys)
    axis = axis.select(*keys, V.subtract("_high", "_low").alias("_axis"), F.zip_with("_high", "_low", lambda x, y: (x + y) / 2).alias("_middle"))
    j = test.where(F.col(condition).isin(*pair)).join(axis, keys)
    return j.withColumn("score", V.dot(V.subtract(vector, "_middle"), "_axis")).drop("_axis", "_middle", vector)


def shuffled_choice(scored: DataFrame, pair: tuple[str, str], n_perm: int = 5000, subject: str | None = None, condition: str = "condition", trial: str = "trial_idx") -> DataFrame:
    """Accuracy of fixed scores, and how often labels shuffled over all trials reach it, p = (c + 1) / (n + 1).

    Accuracy is the share of trials on the side of their label; with ``subject``, the share of subjects
    whose mean score is higher for the second condition, over those that have both.
    """
    from trialweave.operators.permutation import PER_TASK, _unpacked, member_bits, member_sums

    own = scored.select(*([subject] if subject else []), trial, F.col(condition).alias("_label"), "score")
    own = cut(own)
    rows = own.select(*([subject] if subject else []), trial, "score", (F.col("score") > 0).cast("double").alias("_over"))
    rows = rows.hint("merge").join(member_bits(own, trial, "_label", list(pair), n_perm), trial)
    if subject:
        of = lambda c: F.avg(F.when(F.col("_label") == c, F.col("score")))
        per = own.groupBy(subject).agg(of(pair[0]).alias("_low"), of(pair[1]).alias("_high")).where("_low is not null and _high is not null")
        seen = per.agg(F.avg((F.col("_high") > F.col("_low")).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))

        def choose(table: pa.Table) -> pa.Table:
            block, at = np.unique(table["_block"].to_numpy(), return_inverse=True)
            value, counts, means = table["score"].to_numpy(), [], []
            for name in ("_m0", "_m1"):
                member = _unpacked(table[name].to_numpy()).astype(float)
                n, total = np.zeros((len(block), PER_TASK)), np.zeros((len(block), PER_TASK))
                np.add.at(n, at, member)
                np.add.at(total, at, member * value[:, None])
                counts.append(n > 0)
                means.append(total / np.maximum(n, 1))
            both = counts[0] & counts[1]
            packed = [np.packbits(m, axis=1, bitorder="little").view("<i8")[:, 0] for m in (both, both & (means[1] > means[0]))]
            return pa.table({"_block": pa.array(block, pa.int32()), "_both": pa.array(packed[0], pa.int64()), "_high": pa.array(packed[1], pa.int64())})

        drawn = rows.where(F.col("score").isNotNull()).select(subject, "score", "_block", "_m0", "_m1").groupBy(subject).applyInArrow(choose, "_block int, _both bigint, _high bigint")
        bit = lambda c: F.expr(f"shiftrightunsigned({c}, _d) & 1")
        each = drawn.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(PER_TASK - 1)))).select((F.col("_block") * PER_TASK + F.col("_d") + 1).alias("perm_id"), bit("_both").alias("_both"), bit("_high").alias("_high"))
        null = each.where(F.col("perm_id") <= n_perm).groupBy("perm_id").agg(F.try_divide(F.sum("_high").cast("double"), F.sum("_both").cast("double")).alias("_null")).where("_null is not null")
    else:
        hit = (F.col("score") > 0) == (F.col("_label") == pair[1])
        seen = own.agg(F.avg(hit.cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
        sums = member_sums(rows, [], "_over", 2, n_perm)
        null = sums.select(F.try_divide(F.col("_s1") + F.col("_n0") - F.col("_s0"), F.col("_n0") + F.col("_n1")).alias("_null"))
    null = null.select("_null").crossJoin(F.broadcast(seen))  # one row
    c = F.count(F.when(F.round("_null", 9) >= F.round("accuracy", 9), 1))
    return null.groupBy("accuracy", "n").agg(c.alias("n_beyond"), ((c + 1) / F.lit(float(n_perm + 1))).alias("p"), F.avg("_null").alias("null_mean"))


def separation(scored: DataFrame, keys: list[str], pair: tuple[str, str], condition: str = "condition") -> DataFrame:
    """Mean probability of the second condition in its trials less that in the other's."""
    of = lambda c: F.avg(F.when(F.col(condition) == c, F.col("probability")))
    return scored.groupBy(*keys).agg((of(pair[1]) - of(pair[0])).alias("separation"))


def haufe(scored: DataFrame, keys: list[str], vector: str = "features") -> DataFrame:
    """Sample covariance of each feature with the score: the pattern behind the weights."""
    long = scored.select(*keys, "score", F.posexplode(vector).alias("pos", "_x"))
    return long.groupBy(*keys, "pos").agg(F.covar_samp("_x", "score").alias("pattern"))


def leave_one_out(df: DataFrame, keys: list[str], pair: tuple[str, str], condition: str = "condition", order: str = "trial_idx", vector: str = "features", c: float = 1.0, min_trials: int = 8) -> DataFrame:
    """Probability of the second condition for each trial, from a model of the group's other trials."""

    def body(x, y, _key, pdf):
        if len(y) < min_trials or min(y.sum(), len(y) - y.sum()) < 2:
            return None
        p = []
        for i in range(len(y)):
            rest = np.arange(len(y)) != i
            mean, scale = standardizer(x[rest])
            coef, b = logistic((x[rest] - mean) / scale, y[rest], c, penalize_intercept=True)
            p.append(1 / (1 + np.exp(-((x[i] - mean) / scale @ coef + b))))
        return {order: pdf[order].to_numpy(), condition: pdf[condition].to_numpy(), "probability": p}

    return _grouped(df, keys, condition, pair, order, vector, body, f"{order} bigint, {condition} string, probability double")


def calibration(probabilities: DataFrame, keys: list[str], positive: Column, bins: int = 5, p: str = "probability") -> DataFrame:
    """Mean probability, share of positives, count and Brier score in each bin."""
    b = probabilities.withColumn("bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    y = positive.cast("double")
    return b.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_probability"), F.avg(y).alias("share_positive"), F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"))


def importance(df: DataFrame, keys: list[str], pair: tuple[str, str], repeats: int = 5000, condition: str = "condition", order: str = "trial_idx", vector: str = "features") -> DataFrame:
    """Drop of the mean margin when a feature is shuffled, in sample: mean over repeats, and (c + 1) / (n + 1) for drops of 0 or less.

    The model is linear, so a shuffle of one feature changes scores by its weight alone.
    """

    def body(x, y, key, _pdf):
        if min(y.sum(), len(y) - y.sum()) < 2:
            return None
        mean, scale, coef, _ = fit(x, y)
        z, sign = (x - mean) / scale, (2 * y - 1)[:, None]
        r, drops = np.random.default_rng(seed_of(*key)), []
        for _ in range(repeats):
            drops.append((2 * sign * coef * (z - z[r.permutation(len(y))])).mean(0))
        drops = np.array(drops)
        return {"pos": np.arange(x.shape[1]), "importance": drops.mean(0), "p": ((drops <= 0).sum(0) + 1) / (repeats + 1)}

    return _grouped(df, keys, condition, pair, order, vector, body, "pos bigint, importance double, p double")


#: Strengths of nested cross-validation: 20 from 0.01 to 100, evenly in the logarithm.
STRENGTHS = tuple(float(v) for v in np.logspace(-2, 2, 20))


def permuted_accuracy(df: DataFrame, keys: list[str], pair: tuple[str, str], n_perm: int = 5000, k: int = 4, condition: str = "condition", order: str = "trial_idx", vector: str = "features") -> DataFrame:
    """Cross-validated accuracy, and the share of label shuffles (each with folds of its own) that reach it, as (c + 1) / (n + 1)."""

    def body(x, y, key, _pdf):
        if min((y == 0).sum(), (y == 1).sum()) < k:
            return None
        observed = cv_accuracy_draws(x, y[None], folds(y, k, 0)[None])[0]
        r, n = np.random.default_rng(seed_of(*key)), _block_size(key[-1], n_perm)
        ys = r.permuted(np.tile(y, (n, 1)), axis=1)
        null = cv_accuracy_draws(x, ys, fold_draws(ys, k, r))
        return {"accuracy": [float(observed)], "n": [n], "total": [float(null.sum())], "n_beyond": [int((null >= observed - 1e-12).sum())]}

    each = _grouped(_blocks(df, n_perm), [*keys, "_block"], condition, pair, order, vector, body, "accuracy double, n bigint, total double, n_beyond bigint")
    return each.groupBy(*keys).agg(F.max("accuracy").alias("accuracy"), (F.sum("total") / F.sum("n")).alias("null_mean"), ((F.sum("n_beyond") + 1) / (F.sum("n") + 1)).alias("p"))


def shuffled_fits(df: DataFrame, keys: list[str], pair: tuple[str, str], n_perm: int = 5000, repeats: int = 5000, condition: str = "condition", order: str = "trial_idx", vector: str = "features") -> DataFrame:
    """Weight and importance of each feature beside those of models refitted on shuffled labels.

    ``importance`` is the drop of the mean margin when a feature is shuffled, in sample, over
    ``repeats``; its p counts refits whose drop (one shuffle each) reaches it. ``weight_z`` and
    ``weight_p`` hold the weight against the refits' weights, two-sided. p is (c + 1) / (n + 1).
    Groups with fewer than two trials of a condition give no rows.
    """

    def drops(z, signs, r):
        return 2 / z.shape[0] * (signs - r.permuted(signs, axis=1)) @ z

    def body(x, y, key, _pdf):
        if min(y.sum(), len(y) - y.sum()) < 2:
            return None
        mean, scale = standardizer(x)
        z, own = (x - mean) / scale, np.random.default_rng(seed_of(*key[:-1]))
        weight = logistic_draws(z[None], y[None])[0][0]
        seen = weight * drops(z, np.tile(2 * y - 1, (repeats, 1)), own).mean(0)
        r, n = np.random.default_rng(seed_of(*key)), _block_size(key[-1], n_perm)
        ys = r.permuted(np.tile(y, (n, 1)), axis=1)
        drawn = logistic_draws(z[None], ys)[0]
        lost = drawn * drops(z, 2 * ys - 1, r)
        return {
            "pos": np.arange(x.shape[1]), "weight": weight, "importance": seen, "n": n, "total": drawn.sum(0), "squares": (drawn * drawn).sum(0),
            "n_weight": (np.abs(drawn) >= np.abs(weight) - 1e-9).sum(0), "n_importance": (lost >= seen).sum(0),
        }

    schema = "pos bigint, weight double, importance double, n bigint, total double, squares double, n_weight bigint, n_importance bigint"
    each = _grouped(_blocks(df, n_perm), [*keys, "_block"], condition, pair, order, vector, body, schema)
    n, m = F.sum("n"), F.sum("total") / F.sum("n")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.sum("squares") / n - m * m))
    p = lambda c: (F.sum(c) + 1) / (n + 1)
    return each.groupBy(*keys, "pos").agg(F.max("weight").alias("weight"), ((F.max("weight") - m) / (sd + 1e-12)).alias("weight_z"), p("n_weight").alias("weight_p"), F.max("importance").alias("importance"), p("n_importance").alias("importance_p"))


def platt(score: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve of scores, with the labels drawn in a little as Platt (1999) has it."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.column_stack([score, np.ones(len(y))])
    w = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + 1e-9 * np.eye(2), a.T @ (p - target))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def calibrated(df: DataFrame, keys: list[str], pair: tuple[str, str], k: int = 4, condition: str = "condition", order: str = "trial_idx", vector: str = "features") -> DataFrame:
    """Out-of-fold probability of the second condition for each trial; inside a fold, scores of an inner split fit the curve."""

    def body(x, y, key, pdf):
        if min((y == 0).sum(), (y == 1).sum()) < k:
            return None
        fold, p = folds(y, k, seed_of(*key)), np.full(len(y), np.nan)
        for f in range(k):
            train = fold != f
            inner = cv_scores(x[train], y[train], folds(y[train], 3, seed_of(*key, f)))
            slope, shift = platt(inner, y[train])
            p[~train] = 1 / (1 + np.exp(-(slope * decision(x[~train], fit(x[train], y[train])) + shift)))
        return {order: pdf[order].to_numpy(), condition: pdf[condition].to_numpy(), "probability": p}

    return _grouped(df, keys, condition, pair, order, vector, body, f"{order} bigint, {condition} string, probability double")


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """Covariance shrunk to a multiple of the identity by the Ledoit-Wolf (2004) rule; rows are centred first."""
    n, p = x.shape
    x = x - x.mean(0)
    s = x.T @ x / n
    mu = np.trace(s) / p
    spread = ((s - mu * np.eye(p)) ** 2).sum() / p
    noise = max(0.0, ((np.square(x).sum(1) ** 2).mean() - (s * s).sum()) / (p * n))
    share = 0.0 if spread == 0 else min(noise, spread) / spread
    return share * mu * np.eye(p) + (1 - share) * s


def crossnobis(df: DataFrame, keys: list[str], repeats: int = 50, condition: str = "condition", order: str = "trial_idx", vector: str = "features") -> DataFrame:
    """Cross-validated Mahalanobis distance of each pair of conditions: mean over seeded half splits; groups with a condition of one trial give none."""
    kinds = dict(df.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x, y = np.stack(pdf[vector].to_numpy()).astype(float), pdf[condition].to_numpy()
        names = sorted(set(y))
        at = {c: np.flatnonzero(y == c) for c in names}
        rows = []
        if len(names) >= 2 and min(map(len, at.values())) >= 2:
            rest = np.concatenate([x[a] - x[a].mean(0) for a in at.values()])
            precision = np.linalg.pinv(shrunk_covariance(rest), hermitian=True)
            r, total = np.random.default_rng(seed_of(*key)), {}
            for _ in range(repeats):
                half = {}
                for c in names:
                    mixed = r.permutation(at[c])
                    half[c] = x[mixed[: len(mixed) // 2]].mean(0), x[mixed[len(mixed) // 2 :]].mean(0)
                for i, a in enumerate(names):
                    for b in names[i + 1 :]:
                        d = (half[a][0] - half[b][0]) @ precision @ (half[a][1] - half[b][1])
                        total[a, b] = total.get((a, b), 0.0) + d / repeats
            rows = [(*key, a, b, d) for (a, b), d in total.items()]
        return pd.DataFrame(rows, columns=[*keys, "cond_a", "cond_b", "distance"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", cond_a string, cond_b string, distance double"
    return df.groupBy(*keys).applyInPandas(run, schema)
