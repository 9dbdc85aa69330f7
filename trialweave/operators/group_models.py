"""Many logistic models over one table of any size: tasks sum gradients, the driver holds coefficients only.

A *set* is what a model learns from: a weight for each row (0: not in the set), worked out
from a small array beside the row. One pass sums, for each set and class, count, sums and
products of features: these standardise the set and precondition its models. Then each pass
sums the gradients and losses of all models that have not converged; quasi-Newton steps
follow on the driver, for all models at once. What reaches the driver grows with models and
features, not with rows, and no task holds more than some hundred rows of features.

Folds deal subjects by the rank of an md5 of repeat and id, so that they are equal on any
cluster. As scores are linear, a subject's mean score is that of its mean features: forced
choices need one row a subject.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.functions import vectors as V
from trialweave.operators.centroids import mean_vectors
from trialweave.operators.lineage import PACKED, cut, packed_rows, packed_sums
from trialweave.operators.ordered import digest_rank, same

ROWS = 512
HISTORY = 12

#: Weights of sets [rows, sets], from the arrays beside the rows.
Members = Callable[[np.ndarray], np.ndarray]


class Moments(NamedTuple):
    """By set and class: weight, sum of features and of their products; features are shifted by ``centre`` and divided by ``unit``."""

    n: np.ndarray
    total: np.ndarray
    product: np.ndarray
    centre: np.ndarray
    unit: np.ndarray

    def mean_and_scale(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and population deviation of each set (a deviation of 0 as 1), in shifted units."""
        n = np.maximum(self.n.sum(1), 1e-300)[:, None]
        mean = self.total.sum(1) / n
        var = np.einsum("skii->si", self.product) / n - mean * mean
        return mean, np.sqrt(np.where(var > 1e-12, var, 1.0))

    def covariance(self) -> np.ndarray:
        """Sample covariance of the features of each set, in their own units."""
        n = self.n.sum(1)[:, None, None]
        total = self.total.sum(1)
        c = (self.product.sum(1) - total[:, :, None] * total[:, None, :] / n) / (n - 1)
        return c * self.unit[:, None] * self.unit[None, :]


class Fitted(NamedTuple):
    """Of each model: weights of standardised features, the same in the features' own units, intercept for these, and whether it converged."""

    standard: np.ndarray
    coef: np.ndarray
    intercept: np.ndarray
    converged: np.ndarray


def _batches(batches: Iterator[pa.RecordBatch], centre: np.ndarray, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, classes and arrays of at most ``ROWS`` rows."""
    for whole in batches:
        for lo in range(0, len(whole), ROWS):
            b = whole.slice(lo, ROWS)
            wide = lambda c, kind, b=b: b.column(c).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(b), -1)
            yield (wide("x", float) - centre) / unit, b.column("y").to_numpy(zero_copy_only=False), wide("attrs", np.int64)


def moments(rows: DataFrame, members: Members, n_sets: int, width: int) -> Moments:
    """One pass over rows (x, y of 0 or 1, attrs)."""
    spread = rows.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("pos").collect()
    centre, unit = np.array([r["m"] for r in spread], float), np.array([r["s"] or 1.0 for r in spread], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for x, y, attrs in _batches(batches, centre, unit):
            weight = members(attrs)
            for s in range(n_sets):
                for k in (0, 1):
                    w = np.where(y == k, weight[:, s], 0.0)
                    on = w > 0
                    if on.any():
                        xo, wo = x[on], w[on][:, None]
                        new = np.concatenate([[wo.sum()], (wo * xo).sum(0), (xo.T @ (wo * xo)).ravel()])
                        found[2 * s + k] = found[2 * s + k] + new if 2 * s + k in found else new
        if found:
            yield packed_rows(found)

    out = np.zeros((2 * n_sets, 1 + width + width * width))
    for k, v in packed_sums(rows.mapInArrow(run, PACKED)).items():
        out[k] = v
    out = out.reshape(n_sets, 2, -1)
    return Moments(out[:, :, 0], out[:, :, 1 : 1 + width], out[:, :, 1 + width :].reshape(n_sets, 2, width, width), centre, unit)


class _Preconditioner:
    """The Hessian of each set's models at 0, which bounds it everywhere, inverted for any strength."""

    def __init__(self, m: Moments) -> None:
        n = m.n.sum(1)
        self.usable = (m.n > 0).all(1)
        self.class_weight = n[:, None] / (2 * np.where(m.n > 0, m.n, 1.0))
        mean, scale = m.mean_and_scale()
        w = self.class_weight / 4
        s = (w * m.n).sum(1)
        total = ((w[:, :, None] * m.total).sum(1) - s[:, None] * mean) / scale
        product = np.einsum("sk,skij->sij", w, m.product)
        outer = (w[:, :, None] * m.total).sum(1)
        product = product - outer[:, :, None] * mean[:, None, :] - mean[:, :, None] * outer[:, None, :] + s[:, None, None] * mean[:, :, None] * mean[:, None, :]
        product = product / scale[:, :, None] / scale[:, None, :]
        self.g, self.s = total, np.where(s > 0, s, 1.0)
        centred = product - total[:, :, None] * total[:, None, :] / self.s[:, None, None]
        self.values, self.vectors = np.linalg.eigh(centred)
        self.values = np.maximum(self.values, 0)
        self.mean, self.scale = mean, scale

    def solve(self, of: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
        """H x = r for models of sets ``of`` with strengths c; the intercept comes last."""
        out = np.empty_like(r)
        for s in np.unique(of):
            k = of == s
            g, total, cc = self.g[s], self.s[s], c[k][:, None]
            rhs = r[k, :-1] - r[k, -1:] * g / total
            x = ((rhs @ self.vectors[s]) / (1 + cc * self.values[s])) @ self.vectors[s].T
            out[k, :-1] = x
            out[k, -1] = (r[k, -1] - c[k] * (x @ g)) / (c[k] * total)
        return out


def fit(rows: DataFrame, members: Members, m: Moments, of: np.ndarray, c: np.ndarray, start: np.ndarray | None = None, tolerance: float = 1e-7, passes: int = 400) -> Fitted:
    """L2 logistic models with balanced classes on standardised features: model k learns from set ``of[k]`` with strength ``c[k]``. A set without both classes has NaN."""
    of, c = np.asarray(of), np.asarray(c, float)
    pre, width = _Preconditioner(m), m.total.shape[2]
    centre, unit = m.centre, m.unit
    u = np.zeros((len(of), width + 1)) if start is None else start.copy()
    open_ = pre.usable[of]
    u[~open_] = np.nan

    def evaluate(at: np.ndarray, models: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss and gradient of the models at points, by one pass over the rows."""
        by_set = {int(s): models[of[models] == s] for s in np.unique(of[models])}
        plan = {}
        for s, k in by_set.items():
            coef = at[k, :-1] / pre.scale[s]
            plan[s] = (coef.T.copy(), at[k, -1] - coef @ pre.mean[s], pre.class_weight[s])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for x, y, attrs in _batches(batches, centre, unit):
                weight = members(attrs)
                for s, (coef, shift, by_class) in plan.items():
                    on = weight[:, s] > 0
                    if not on.any():
                        continue
                    xo, yo = x[on], y[on].astype(float)
                    w = (weight[on, s] * by_class[y[on]])[:, None]
                    score = xo @ coef + shift
                    p = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
                    left = w * (p - yo[:, None])
                    loss = (w * (np.logaddexp(0, score) - yo[:, None] * score)).sum(0)
                    new = np.concatenate([(left.T @ xo).ravel(), left.sum(0), loss])
                    found[s] = found[s] + new if s in found else new
            if found:
                yield packed_rows(found)

        f, grad = np.zeros(len(models)), np.zeros((len(models), width + 1))
        place = {int(k): j for j, k in enumerate(models)}
        for s, v in packed_sums(rows.mapInArrow(run, PACKED)).items():
            k = by_set[s]
            j, n = [place[int(x)] for x in k], len(k)
            raw, total, loss = v[: n * width].reshape(n, width), v[n * width : n * width + n], v[n * width + n :]
            grad[j, :-1] = c[k][:, None] * (raw - total[:, None] * pre.mean[s]) / pre.scale[s] + at[k, :-1]
            grad[j, -1] = c[k] * total
            f[j] = c[k] * loss + (at[k, :-1] ** 2).sum(1) / 2
        return f, grad

    size = len(of)
    f, g = np.full(size, np.inf), np.zeros((size, width + 1))
    step, way, trial = np.ones(size), np.zeros((size, width + 1)), u.copy()
    steps, turns = np.zeros((HISTORY, size, width + 1)), np.zeros((HISTORY, size, width + 1))
    curved = np.zeros((HISTORY, size))
    for _ in range(passes):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        new_f, new_g = evaluate(trial, at)
        slope = (g[at] * way[at]).sum(1)
        fine = (new_f <= f[at] + 1e-4 * step[at] * slope + 1e-12 * np.abs(new_f)) | (step[at] < 1e-8)
        back = at[~fine]
        step[back] *= 0.5
        trial[back] = u[back] + step[back][:, None] * way[back]
        go = at[fine]
        s, y = trial[go] - u[go], new_g[fine] - g[go]
        first = np.isinf(f[go])
        sy = np.where(first, 0.0, (s * y).sum(1))
        for h in (steps, turns, curved):
            h[:-1, go] = h[1:, go]
        steps[-1, go], turns[-1, go] = s, y
        curved[-1, go] = np.where(sy > 1e-14, sy, 0.0)
        u[go], f[go], g[go] = trial[go], new_f[fine], new_g[fine]
        # two-loop recursion, all models at once
        q, a = g[go].copy(), np.zeros((HISTORY, len(go)))
        inverse = np.where(curved[:, go] > 0, 1 / np.where(curved[:, go] > 0, curved[:, go], 1.0), 0.0)
        for h in range(HISTORY - 1, -1, -1):
            a[h] = inverse[h] * (steps[h, go] * q).sum(1)
            q -= a[h][:, None] * turns[h, go]
        r = pre.solve(of[go], c[go], q)
        for h in range(HISTORY):
            b = inverse[h] * (turns[h, go] * r).sum(1)
            r += (a[h] - b)[:, None] * steps[h, go]
        open_[go[np.abs(r).max(1) < tolerance]] = False
        way[go], step[go] = -r, 1.0
        trial[go] = u[go] + way[go]
    done = ~open_ & pre.usable[of]
    coef = u[:, :-1] / pre.scale[of]
    intercept = u[:, -1] - (coef * pre.mean[of]).sum(1)
    coef = coef / unit
    return Fitted(u, coef, intercept - coef @ centre, done)


# ---- folds


class Split(NamedTuple):
    """A set of nested folds: the repeat, the outer fold left out and the inner fold left out (-1: none)."""

    repeat: int
    outer: int
    inner: int


def inner_fold(rank: np.ndarray, outer: int, n_outer: int, n_inner: int) -> np.ndarray:
    """Inner fold of subjects, dealt round in the order of their ranks among those outside of the outer fold."""
    before = rank if outer < 0 else rank - (rank - outer + n_outer - 1) // n_outer
    return before % n_inner


def in_test(rank: np.ndarray, s: Split, n_outer: int, n_inner: int) -> np.ndarray:
    """Whether subjects are in the fold that a split leaves out last."""
    own = rank[:, s.repeat]
    if s.inner < 0:
        return own % n_outer == s.outer
    kept = np.ones(len(own), bool) if s.outer < 0 else own % n_outer != s.outer
    return kept & (inner_fold(own, s.outer, n_outer, n_inner) == s.inner)


def split_members(splits: list[Split], n_outer: int, n_inner: int) -> Members:
    def members(rank: np.ndarray) -> np.ndarray:
        out = np.empty((len(rank), len(splits)))
        for k, s in enumerate(splits):
            own = rank[:, s.repeat]
            kept = np.ones(len(own), bool) if s.outer < 0 else own % n_outer != s.outer
            if s.inner >= 0:
                kept &= inner_fold(own, s.outer, n_outer, n_inner) != s.inner
            out[:, k] = kept
        return out

    return members


def ranked(subjects: DataFrame, subject: str, repeats: int, keys: list[str] | None = None) -> DataFrame:
    """keys, subject, attrs: the subject's rank (from 0) in each repeat, by the md5 of repeat and id. A null subject has none."""
    keys = keys or []
    drawn = subjects.where(F.col(subject).isNotNull()).select(*keys, subject).distinct().withColumn("_repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    drawn = drawn.withColumn("_key", F.md5(F.concat(F.col("_repeat").cast("string"), F.lit("-"), F.col(subject).cast("string"))))
    rank = digest_rank(drawn, [*keys, "_repeat"], "_key", subject, "_rank")
    rank = rank.groupBy(*keys, subject).agg(F.transform(F.array_sort(F.collect_list(F.struct("_repeat", F.col("_rank") - 1))), lambda x: x["col2"]).alias("attrs"))
    return rank


def class_means(df: DataFrame, subject: str, condition: str, pair: tuple[str, str], vector: str, width: int, keys: list[str] | None = None) -> DataFrame:
    """keys, subject, difference: mean features of the second condition less those of the first, of subjects with both."""
    keys = keys or []
    m = mean_vectors(df, [*keys, subject, condition], width, vector, "_m")
    of = lambda c: F.any_value(F.when(F.col(condition) == c, F.col("_m")), True)
    both = m.groupBy(*keys, subject).agg(of(pair[0]).alias("_low"), of(pair[1]).alias("_high")).where("_low is not null and _high is not null")
    return both.select(*keys, subject, V.subtract("_high", "_low").alias("difference"))


def forced_choices(subjects: DataFrame, splits: list[Split], coef: dict[int, np.ndarray], n_outer: int, n_inner: int) -> dict[int, np.ndarray]:
    """For each split (by number) subjects in its test fold and, for each model of it, how many have the higher score for the second condition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            wide = lambda c, kind, b=b: b.column(c).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(b), -1)
            d, rank = wide("difference", float), wide("attrs", np.int64)
            for k, w in coef.items():
                on = in_test(rank, splits[k], n_outer, n_inner)
                if on.any():
                    new = np.concatenate([[on.sum()], (d[on] @ w.T > 0).sum(0)]).astype(float)
                    found[k] = found[k] + new if k in found else new
        if found:
            yield packed_rows(found)

    return packed_sums(subjects.mapInArrow(run, PACKED))


class Nested(NamedTuple):
    """Accuracy [repeats, outer folds] of held-out subjects (NaN without any), the strengths chosen, those of the final model, its weights and pattern, and the number of subjects."""

    accuracy: np.ndarray
    chosen: np.ndarray
    strength: float
    coef: np.ndarray
    pattern: np.ndarray
    n_subjects: int


def nested(df: DataFrame, pair: tuple[str, str], subject: str, grid: tuple[float, ...], repeats: int = 10, outer: int = 5, inner: int = 5, condition: str = "condition", vector: str = "features") -> Nested:
    """Repeated nested cross-validation by subjects over all rows of two conditions, and a final model of all rows.

    The strength of each outer fold has the highest mean forced-choice accuracy over the inner
    folds (the first of equals). Subjects with both conditions are tested; rows with a null in
    what is used are left out.
    """
    df = df.where(F.col(condition).isin(*pair) & F.col(subject).isNotNull() & F.col(vector).isNotNull()).select(subject, condition, vector)
    width = df.select(F.max(F.size(vector))).first()[0] or 0
    rank = cut(ranked(df, subject, repeats))
    rows = cut(same(df.select(subject, F.col(vector).cast("array<double>").alias("x"), (F.col(condition) == pair[1]).cast("int").alias("y")), rank, [subject]).select("x", "y", "attrs"))
    tested = cut(same(class_means(df, subject, condition, pair, vector, width), rank, [subject]).select("difference", "attrs"))
    n_subjects, strengths = tested.count(), np.array(grid)
    if not n_subjects:
        raise ValueError("no subject has both conditions")
    inside = [Split(r, o, i) for r in range(repeats) for o in range(outer) for i in range(inner)] + [Split(0, -1, i) for i in range(inner)]
    whole = [Split(r, o, -1) for r in range(repeats) for o in range(outer)] + [Split(0, -1, -1)]
    splits = inside + whole
    members = split_members(splits, outer, inner)
    m = moments(rows, members, len(splits), width)
    of, c = np.repeat(np.arange(len(inside)), len(grid)), np.tile(strengths, len(inside))
    first = fit(rows, members, m, of, c)
    weights = {s: first.coef[of == s] for s in range(len(inside)) if np.isfinite(first.coef[of == s]).all()}
    marks = np.full((len(inside), len(grid)), np.nan)
    for s, v in forced_choices(tested, splits, weights, outer, inner).items():
        marks[s] = v[1:] / v[0]
    with np.errstate(all="ignore"):
        mean = np.nan_to_num(np.array([np.nanmean(marks[[k for k, s in enumerate(inside) if s[:2] == w[:2]]], 0) if np.isfinite(marks[[k for k, s in enumerate(inside) if s[:2] == w[:2]]]).any() else np.full(len(grid), -1.0) for w in whole]), nan=-1.0)
    best = mean.argmax(1)
    start = np.stack([np.nan_to_num(np.nanmean(first.standard[[k * len(grid) + b for k, s in enumerate(inside) if s[:2] == w[:2]]], 0)) for w, b in zip(whole, best, strict=True)])
    last = fit(rows, members, m, np.arange(len(inside), len(splits)), strengths[best], start)
    found = forced_choices(tested, splits, {len(inside) + k: last.coef[k : k + 1] for k in range(len(whole) - 1) if np.isfinite(last.coef[k]).all()}, outer, inner)
    accuracy = np.array([found[k][1] / found[k][0] if k in found else np.nan for k in range(len(inside), len(splits) - 1)]).reshape(repeats, outer)
    final = last.standard[-1, :-1]
    return Nested(accuracy, strengths[best[:-1]].reshape(repeats, outer), float(strengths[best[-1]]), final, m.covariance()[-1] @ final, n_subjects)


# ---- draws of subjects


def bootstrap(df: DataFrame, pair: tuple[str, str], subject: str, n_boot: int = 50, c: float = 1.0, condition: str = "condition", vector: str = "features") -> tuple[np.ndarray, np.ndarray]:
    """Patterns (covariance of features with scores) over draws of subjects with replacement, rows centred by subject: mean and z of each feature.

    A draw takes as many subjects as there are; its k-th is the one whose rank is the md5 of draw and k, modulo their number.
    """
    df = df.where(F.col(condition).isin(*pair) & F.col(subject).isNotNull() & F.col(vector).isNotNull()).select(subject, condition, F.col(vector).cast("array<double>").alias("_x"))
    width = df.select(F.max(F.size("_x"))).first()[0] or 0
    rank = cut(ranked(df, subject, 1).select(subject, F.col("attrs")[0].alias("_rank")))
    n = rank.count()
    number = F.conv(F.substring(F.md5(F.concat(F.col("_draw").cast("string"), F.lit("-"), F.col("_rank").cast("string"))), 1, 12), 16, 10).cast("bigint")
    drawn = rank.select("_rank", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("_draw")).select("_draw", (number % n).alias("_rank"))
    times = drawn.groupBy("_rank").agg(F.array(*[F.count(F.when(F.col("_draw") == d, 1)) for d in range(n_boot)]).alias("attrs"))
    of = rank.join(times, "_rank", "left").select(subject, F.coalesce("attrs", F.array_repeat(F.lit(0).cast("bigint"), n_boot)).alias("attrs"))
    middle = mean_vectors(df, [subject], width, "_x", "_middle").drop("n_trials")
    rows = same(same(df, middle, [subject]), of, [subject])
    rows = cut(rows.select(V.subtract("_x", "_middle").alias("x"), (F.col(condition) == pair[1]).cast("int").alias("y"), "attrs"))
    members = lambda attrs: attrs.astype(float)
    m = moments(rows, members, n_boot, width)
    fitted = fit(rows, members, m, np.arange(n_boot), np.full(n_boot, c))
    ok = np.isfinite(fitted.coef).all(1)
    if not ok.any():
        raise ValueError("no draw has both conditions")
    patterns = np.einsum("dij,dj->di", m.covariance()[ok], fitted.coef[ok])
    return patterns.mean(0), patterns.mean(0) / (patterns.std(0) + 1e-12)


# ---- importance on held-out folds


def importance(df: DataFrame, pair: tuple[str, str], subject: str, trial: str, repeats: int = 10, k: int = 5, c: float = 1.0, condition: str = "condition", vector: str = "features") -> DataFrame:
    """pos, importance: how much the forced-choice accuracy of held-out subjects falls when a feature is shuffled among the trials of their fold, a mean over folds and shuffles.

    A shuffle gives a trial the features of the one that has its rank in another order (md5 of
    repeat and trial); one order serves all features, of which each is shuffled alone.
    """
    df = df.where(F.col(condition).isin(*pair) & F.col(subject).isNotNull() & F.col(vector).isNotNull()).select(subject, trial, condition, F.col(vector).cast("array<double>").alias("x"))
    width = df.select(F.max(F.size("x"))).first()[0] or 0
    rank = cut(ranked(df, subject, 1))
    rows = cut(same(df, rank, [subject]).withColumn("fold", (F.col("attrs")[0] % k).cast("int")).withColumn("y", (F.col(condition) == pair[1]).cast("int")))
    splits = [Split(0, f, -1) for f in range(k)]
    members = split_members(splits, k, 1)
    learn = rows.select("x", "y", "attrs")
    fitted = fit(learn, members, moments(learn, members, k, width), np.arange(k), np.full(k, c))
    spark = df.sparkSession
    models = spark.createDataFrame([(f, fitted.coef[f].tolist()) for f in range(k) if np.isfinite(fitted.coef[f]).all()], "fold int, coef array<double>")  # a row a fold
    own = class_means(rows, subject, condition, pair, "x", width, ["fold"])
    order = lambda repeat: F.md5(F.concat(repeat.cast("string"), F.lit("-"), F.col(trial).cast("string")))
    places = rows.select("fold", trial, F.explode(F.sequence(F.lit(0), F.lit(repeats))).alias("_repeat"))
    places = digest_rank(places.withColumn("_key", order(F.col("_repeat"))), ["fold", "_repeat"], "_key", trial, "_rank").drop("_key")
    base = places.where("_repeat = 0").select("fold", "_rank", F.col(trial).alias("_from"))
    moved = places.where("_repeat > 0").join(base, ["fold", "_rank"]).select("fold", "_repeat", trial, "_from")
    moved = moved.join(rows.select(trial, subject, condition), trial).join(rows.select(F.col(trial).alias("_from"), "x"), "_from")
    other = class_means(moved, subject, condition, pair, "x", width, ["fold", "_repeat"]).withColumnRenamed("difference", "_moved")
    j = other.join(own, ["fold", subject]).join(F.broadcast(models), "fold")
    j = j.withColumn("_score", V.dot("difference", "coef"))
    shifts = F.zip_with(V.subtract("_moved", "difference"), "coef", lambda a, b: a * b)
    lost = F.transform(shifts, lambda s: (F.col("_score") > 0).cast("int") - (F.col("_score") + s > 0).cast("int"))
    each = j.select("fold", "_repeat", F.posexplode(lost).alias("pos", "_lost")).groupBy("fold", "_repeat", "pos").agg(F.avg("_lost").alias("_drop"))
    return each.groupBy("fold", "pos").agg(F.avg("_drop").alias("_drop")).groupBy(F.col("pos").cast("bigint").alias("pos")).agg(F.avg("_drop").alias("importance"), F.count(F.lit(1)).alias("n_folds"))
