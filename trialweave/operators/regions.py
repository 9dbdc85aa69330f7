"""Decoding by region: a wide vector is cut into the ranges of an atlas, and a subject's trials in one region are the unit of the fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.operators.decoding import decision, fit, folds, seed_of, standardizer
from trialweave.operators.ordered import early_late

#: Scores of a region beside subject, region and the four counts of trials.
MEASURES = (
    "accuracy_first", "accuracy_first_early", "accuracy_first_late", "accuracy_first_change",
    "accuracy_second", "accuracy_second_merged", "accuracy_second_early", "accuracy_second_late", "accuracy_second_change",
    "separation", "separation_early", "separation_late", "separation_change",
)
COUNTS = ("n_trials_first", "n_trials_second", "n_usable_first", "n_usable_second")


#: Elements of the scaled rows of fits that are worked on side by side.
SIDE_BY_SIDE = 2_000_000


def _contrast(n_classes: int) -> np.ndarray:
    """Classes by free scores: of two the second class alone (plain logistic regression), of more an orthonormal basis of the scores that add up to 0."""
    if n_classes == 2:
        return np.array([[0.0], [1.0]])
    return np.linalg.qr(np.eye(n_classes) - 1 / n_classes)[0][:, : n_classes - 1]


def softmax_fits(x: np.ndarray, label: np.ndarray, on: np.ndarray, n_classes: int, c: float = 1.0, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """L2 softmax regressions with balanced weights side by side: coefficients [fits, features, classes] and intercepts [fits, classes].

    ``x`` is fits by rows by features, scaled beforehand; only rows that are ``on`` count, so that fits may have
    rows of different number. Each has Newton steps of its own length, and leaves when it moves no more. All classes
    have weights of their own, which add up to 0, but of two the first has none; intercepts are not penalised.
    """
    basis = np.linalg.qr((x * on[:, :, None]).swapaxes(1, 2))[0] if x.shape[2] > x.shape[1] else None  # rows only reach their span
    z = x if basis is None else x @ basis
    z = np.concatenate([z * on[:, :, None], on[:, :, None].astype(float)], 2)
    basis_of, size, free = _contrast(n_classes), z.shape[2], n_classes - 1
    hot = ((label[:, :, None] == np.arange(n_classes)) & on[:, :, None]).astype(float)
    weight = c * (hot * (on.sum(1)[:, None] / (n_classes * hot.sum(1)))[:, None, :]).sum(2)
    ridge = np.ones(size)
    ridge[-1] = 1e-10 if n_classes == 2 else 1e-8
    w = np.zeros((len(x), free, size))

    def state(z: np.ndarray, hot: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss, and probabilities of the classes."""
        s = z @ w.swapaxes(1, 2) @ basis_of.T
        s -= s.max(2, keepdims=True)
        e = np.exp(s)
        total = e.sum(2, keepdims=True)
        return (weight * (np.log(total[:, :, 0]) - (s * hot).sum(2))).sum(1) + (ridge * w * w).sum((1, 2)) / 2, e / total

    at = np.arange(len(x))  # the fits that still move
    value, p = state(z, hot, weight, w)
    for _ in range(steps):
        zs, hots, weights, ws = z[at], hot[at], weight[at], w[at]
        turned = zs.swapaxes(1, 2)
        grad = ((weights[:, :, None] * (p - hots)) @ basis_of).swapaxes(1, 2) @ zs + ridge * ws
        mean, hess = p @ basis_of, np.empty((len(at), free, size, free, size))
        for i in range(free):
            for j in range(i, free):
                bend = weights * (p @ (basis_of[:, i] * basis_of[:, j]) - mean[:, :, i] * mean[:, :, j])
                hess[:, i, :, j] = turned @ (zs * bend[:, :, None])
                hess[:, j, :, i] = hess[:, i, :, j]  # each is its own transpose
        hess = hess.reshape(len(at), free * size, -1)
        hess[:, np.arange(free * size), np.arange(free * size)] += np.tile(ridge, free)
        step = np.linalg.solve(hess, grad.reshape(len(at), -1, 1)).reshape(ws.shape)
        share = np.ones(len(at))
        new, p = state(zs, hots, weights, ws - step)
        while (worse := (new > value + 1e-12 * (1 + np.abs(value))) & (share > 1e-8)).any():
            share[worse] /= 2
            new[worse], p[worse] = state(zs[worse], hots[worse], weights[worse], ws[worse] - share[worse, None, None] * step[worse])
        w[at] = ws - share[:, None, None] * step
        moving = np.abs(step).max((1, 2)) >= 1e-9
        at, value, p = at[moving], new[moving], p[moving]
        if not len(at):
            break
    by_class = w.swapaxes(1, 2) @ basis_of.T
    coef, shift = by_class[:, :-1], by_class[:, -1]
    return (coef if basis is None else basis @ coef), shift


def multinomial(x: np.ndarray, y: np.ndarray, n_classes: int, c: float = 1.0, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """One of :func:`softmax_fits`, of three classes or more: coefficients [classes, features] and intercepts, which add up to 0."""
    coef, shift = softmax_fits(x[None], y[None], np.ones((1, len(y)), bool), n_classes, c, steps)
    return coef[0].T, shift[0]


def _marks(x: np.ndarray, fits: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n_classes: int) -> list[float]:
    """Share of test rows told rightly by each fit (rows to train, rows to test, label of every row)."""
    most, out = max(len(train) for train, _, _ in fits), []
    together = max(1, SIDE_BY_SIDE // (most * x.shape[1]))
    for lo in range(0, len(fits), together):
        part = fits[lo : lo + together]
        rows, label, on, scales = np.zeros((len(part), most, x.shape[1])), np.zeros((len(part), most), int), np.zeros((len(part), most), bool), []
        for k, (train, _, labels) in enumerate(part):
            mean, scale = standardizer(x[train])
            rows[k, : len(train)], label[k, : len(train)], on[k, : len(train)] = (x[train] - mean) / scale, labels[train], True
            scales.append((mean, scale))
        coef, shift = softmax_fits(rows, label, on, n_classes)
        for k, ((_, test, labels), (mean, scale)) in enumerate(zip(part, scales, strict=True)):
            found = ((x[test] - mean) / scale @ coef[k] + shift[k]).argmax(1)
            out.append(float((found == labels[test]).mean()))
    return out


def accuracies(x: np.ndarray, asked: dict[str, tuple[np.ndarray, np.ndarray, int]], k: int) -> dict[str, float]:
    """Mean accuracy over stratified folds of each entry (its rows, the classes of all rows, a seed); the models of all folds of all entries are fitted side by side.

    Folds are as many as the rarest class allows and at most k; NaN under four trials, two features or two trials of a class.
    """
    out, fits, of = dict.fromkeys(asked, np.nan), {}, {}
    for name, (here, y, seed) in asked.items():
        rows = np.flatnonzero(here)
        names, label, counts = np.unique(y[rows], return_inverse=True, return_counts=True)
        if len(rows) < 4 or x.shape[1] < 2 or len(names) < 2 or counts.min() < 2:
            continue
        fold, labels = folds(label, int(min(k, counts.min())), seed), np.zeros(len(y), int)
        labels[rows] = label
        for f in np.unique(fold):
            fits.setdefault(len(names), []).append((rows[fold != f], rows[fold == f], labels))
            of.setdefault(len(names), []).append(name)
    marks: dict[str, list[float]] = {}
    for n_classes, some in fits.items():
        for name, mark in zip(of[n_classes], _marks(x, some, n_classes), strict=True):
            marks.setdefault(name, []).append(mark)
    return out | {name: float(np.mean(m)) for name, m in marks.items()}


def separations(train: np.ndarray, y: np.ndarray, test: np.ndarray, stage: np.ndarray, pair: tuple[str, str]) -> tuple[float, float, float]:
    """Mean probability of the second condition less that of the first, under a model of other trials: of all, early and late ones (NaN under two)."""
    on = np.isin(y, pair)
    if on.sum() < 4 or len(np.unique(y[on])) < 2 or not len(test):
        return np.nan, np.nan, np.nan
    p = 1 / (1 + np.exp(-np.clip(decision(test, fit(train[on], (y[on] == pair[1]).astype(int))), -500, 500)))
    of = lambda at: float((2 * p[at] - 1).mean()) if at.sum() >= 2 else np.nan
    return float((2 * p - 1).mean()), of(stage == "Early"), of(stage == "Late")


def report(df: DataFrame, regions: DataFrame, subject: str, pair: tuple[str, str], third: str, first: str, second: str, k: int = 5, usable: Column | None = None, phase: str = "phase", condition: str = "condition", trial: str = "trial_idx", vector: str = "features") -> DataFrame:
    """A row a subject and region (name, start, size of its range in the vector): counts of trials, ``MEASURES``.

    Three-way accuracy of each phase, of its early and late trials (first and last four of a
    condition) and their difference; of the second phase also with ``pair`` merged against ``third``;
    and how far a model of ``pair`` in the first phase separates them in the second. Trials that
    are not ``usable`` are counted only. What cannot be formed is NULL.
    """
    classes = [*pair, third]
    marked = df.where(F.col(phase).isin(first, second)).withColumn("_usable", F.lit(True) if usable is None else F.coalesce(usable, F.lit(False)))
    staged = early_late(marked, [subject, phase, condition], [trial], name="_stage")
    atlas = regions.select(F.col("region").alias("_region"), F.col("start").cast("int").alias("_start"), F.col("size").cast("int").alias("_size"))
    cuts = staged.crossJoin(F.broadcast(atlas))  # at most as many regions as a vector has elements
    cuts = cuts.select(subject, F.col("_region").alias("region"), F.col(phase).alias("_phase"), F.col(condition).alias("_y"), F.col(trial).alias("_trial"), "_stage", "_usable", F.slice(F.col(vector).cast("array<double>"), F.col("_start") + 1, F.col("_size")).alias("_x"))
    kind = dict(df.dtypes)[subject]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_trial")
        x, y = np.stack(pdf["_x"].to_numpy()).astype(float), pdf["_y"].to_numpy().astype(str)
        at, stage = pdf["_phase"].to_numpy(), pdf["_stage"].to_numpy()
        use = pdf["_usable"].to_numpy(bool) & np.isfinite(x).all(1)
        three, asked = use & np.isin(y, classes), {}
        for n, p in (("first", first), ("second", second)):
            here = three & (at == p)
            asked |= {f"accuracy_{n}": (here, y), f"accuracy_{n}_early": (here & (stage == "Early"), y), f"accuracy_{n}_late": (here & (stage == "Late"), y)}
        asked["accuracy_second_merged"] = three & (at == second), np.where(y == third, "third", "pair")
        out = accuracies(x, {name: (*what, seed_of(*key, name)) for name, what in asked.items()}, k)
        for n in ("first", "second"):
            out[f"accuracy_{n}_change"] = out[f"accuracy_{n}_late"] - out[f"accuracy_{n}_early"]
        before, after = use & (at == first), use & (at == second)
        out["separation"], out["separation_early"], out["separation_late"] = separations(x[before], y[before], x[after], stage[after], pair)
        out["separation_change"] = out["separation_late"] - out["separation_early"]
        counts = ((at == first).sum(), (at == second).sum(), before.sum(), after.sum())
        row = dict(zip(COUNTS, map(int, counts), strict=True)) | {m: out[m] for m in MEASURES}
        return pd.DataFrame({subject: [key[0]], "region": [key[1]]} | {c: [v] for c, v in row.items()})

    schema = f"{subject} {kind}, region string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", " + ", ".join(f"{m} double" for m in MEASURES)
    rows = cuts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), subject, "region")
    made = rows.groupBy(subject, "region").applyInPandas(run, schema)
    return made.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in MEASURES else F.col(c) for c in made.columns])


def write_report(made: DataFrame, path: str, subject: str = "subject") -> None:
    """One folder of CSV a subject."""
    made.repartition(subject).write.mode("overwrite").option("header", True).partitionBy(subject).csv(path)
