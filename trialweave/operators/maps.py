"""Scores of the neighbourhood of every voxel, for each subject: blocks of the grid with halos.

A block holds the voxels that are its own and those within the radius of one of them, so a
task of one subject and block has whatever its centres need. A trial is cut into one short
vector a block; no row is made for a centre, and no centre meets a whole vector. What
goes to all tasks is the layout of the blocks, which has a few times as many entries as one
vector has elements.

Missing values are NULL or NaN. A trial counts in a neighbourhood if at least
``MIN_VALID`` of its elements there are finite, and a cosine if that share of both is.
Centres with fewer than ``min_voxels`` neighbours (themselves included) have no rows;
scores that cannot be formed are NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trialweave.functions.vectors import MIN_VALID
from trialweave.operators.ordered import halves, running

#: Side of a block in voxels.
SIDE = 8
BLOCK = ["_bi", "_bj", "_bk"]
#: Rows of a neighbourhood's result, by columns: from its trials [trials, voxels] and their labels.
Body = Callable[[np.ndarray, dict[str, np.ndarray]], dict[str, list]]


def blocks(grid: DataFrame, radius: float, side: int = SIDE, feature: str = "feature_id") -> DataFrame:
    """One row a block that has voxels of its own: members (place in the vector, own, i, j, k), halo included."""
    placed = grid.select(F.col(feature).cast("bigint").alias("place"), *[F.col(a).cast("bigint").alias(a) for a in "ijk"])
    reach = int(np.ceil(radius / side))
    off = F.lit(0)
    for a, b in zip("ijk", BLOCK, strict=True):
        placed = placed.withColumn(b, F.explode(F.array(*[F.floor(F.col(a) / side) + d for d in range(-reach, reach + 1)])))
        out = F.greatest(F.lit(0), F.col(b) * side - F.col(a), F.col(a) - (F.col(b) * side + side - 1))
        off = off + out * out
    near = placed.where(off.cast("double") <= radius * radius)
    own = F.lit(True)
    for a, b in zip("ijk", BLOCK, strict=True):
        own = own & (F.floor(F.col(a) / side) == F.col(b))
    members = F.array_sort(F.collect_list(F.struct("place", own.alias("own"), "i", "j", "k")))
    return near.groupBy(*BLOCK).agg(members.alias("_members")).where(F.exists("_members", lambda m: m["own"]))


def around(df: DataFrame, grid: DataFrame, radius: float, keys: list[str], labels: list[str], body: Body, schema: str, side: int = SIDE, min_voxels: int = 1, vector: str = "features") -> DataFrame:
    """keys, center and the columns of ``schema``: what ``body`` makes of each neighbourhood of each group of trials.

    A group is bounded by design (a subject's trials); trials come in the order of the last label.
    """
    kinds = dict(df.dtypes)
    layout = blocks(grid, radius, side)
    cuts = df.select(*keys, *labels, F.col(vector).cast("array<double>").alias("_v")).crossJoin(F.broadcast(layout))  # a few times the size of one vector
    cuts = cuts.select(*keys, *BLOCK, *labels, F.transform("_members", lambda m: F.get("_v", m["place"].cast("int"))).alias("_x"))
    on = [*keys, *BLOCK]
    of_group = df.select(*keys).distinct().crossJoin(F.broadcast(layout)).select(*[F.col(c).alias(f"_of_{c}") for c in on], "_members")
    names = [s.split()[0] for s in schema.split(", ")]
    full = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", center bigint, " + schema

    def run(key: tuple, trials: pa.Table, members: pa.Table) -> pa.Table:
        if not len(trials) or not len(members):
            return pa.table({f.name: pa.array([], f.type) for f in target})
        trials = trials.sort_by(labels[-1])
        member = members["_members"][0].as_py()
        place, own = np.array([m["place"] for m in member]), np.array([m["own"] for m in member])
        ijk = np.array([[m["i"], m["j"], m["k"]] for m in member])
        flat = trials["_x"].combine_chunks()
        flat = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(trials), len(place))
        label = {c: np.array(trials[c].to_pylist(), object) for c in labels}
        out: dict[str, list] = {n: [] for n in ["center", *names]}
        for c in np.flatnonzero(own):
            near = np.flatnonzero(((ijk - ijk[c]) ** 2).sum(1) <= radius * radius)
            if len(near) < min_voxels:
                continue
            made = body(x[:, near], label)
            n = len(made[names[0]])
            out["center"] += [int(place[c])] * n
            for name in names:
                out[name] += made[name]
        size = len(out["center"])
        columns = {k: [v.as_py()] * size for k, v in zip(keys, key, strict=False)} | out
        return pa.table({f.name: pa.array([None if isinstance(v, float) and np.isnan(v) else v for v in columns[f.name]], f.type) for f in target})

    target = to_arrow_schema(StructType.fromDDL(full))
    return cuts.groupBy(*on).cogroup(of_group.groupBy(*[f"_of_{c}" for c in on])).applyInArrow(run, full)


# ---- scores of one neighbourhood


def _enough(x: np.ndarray) -> np.ndarray:
    return np.isfinite(x).mean(1) >= MIN_VALID


def pattern(x: np.ndarray) -> np.ndarray:
    """Mean of the trials that are valid here; NaN where none has a value."""
    x = x[_enough(x)]
    count = np.isfinite(x).sum(0)
    return np.where(count > 0, np.nansum(np.where(np.isfinite(x), x, 0.0), 0) / np.maximum(count, 1), np.nan)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    both = np.isfinite(a) & np.isfinite(b)
    if both.mean() < MIN_VALID:
        return np.nan
    a, b = a[both], b[both]
    size = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / size) if size > 0 else np.nan


def units(x: np.ndarray) -> np.ndarray:
    """Trials less their mean, of norm 1; missing elements are 0, constant trials the zero vector."""
    seen = np.isfinite(x)
    x = np.where(seen, x, 0.0)
    x = np.where(seen, x - x.sum(1, keepdims=True) / np.maximum(seen.sum(1, keepdims=True), 1), 0.0)
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size == 0, 1.0, size)


def _within(u: np.ndarray) -> float:
    n, s = len(u), u.sum(0)
    return float((s @ s - (u * u).sum()) / (n * (n - 1))) if n >= 2 else np.nan


def _between(a: np.ndarray, b: np.ndarray) -> float:
    return float(a.sum(0) @ b.sum(0) / (len(a) * len(b))) if len(a) and len(b) else np.nan


def slope(y: np.ndarray) -> float:
    """Of the finite values on their number; NaN with fewer than two."""
    on = np.flatnonzero(np.isfinite(y))
    if len(on) < 2:
        return np.nan
    t = on - on.mean()
    return float(t @ (y[on] - y[on].mean()) / (t @ t))


def _mean(values: list[float]) -> float:
    ok = [v for v in values if np.isfinite(v)]
    return float(np.mean(ok)) if ok else np.nan


# ---- maps


def condition_maps(df: DataFrame, grid: DataFrame, radius: float, keys: list[str], condition: str = "condition", trial: str = "trial_idx", **more) -> DataFrame:
    """keys, center, part, condition, score: similarity within each condition less that to all other trials, over all trials (FULL) and over the first and second half of every condition (H1, H2)."""

    def body(x: np.ndarray, label: dict) -> dict[str, list]:
        out: dict[str, list] = {"part": [], "condition": [], "score": []}
        ok, names = _enough(x), sorted(set(label[condition]))
        u = units(x)
        for part in ("FULL", "H1", "H2"):
            here = ok if part == "FULL" else ok & (label["half"] == part)
            for c in names:
                own = label[condition] == c
                out["part"].append(part)
                out["condition"].append(c)
                out["score"].append(_within(u[here & own]) - _between(u[here & own], u[here & ~own]))
        return out

    split = halves(df.where(F.col(condition).isNotNull()), [*keys, condition], [trial])
    return around(split, grid, radius, keys, [condition, "half", trial], body, "part string, condition string, score double", **more)


def pair_maps(df: DataFrame, grid: DataFrame, radius: float, keys: list[str], condition: str = "condition", trial: str = "trial_idx", **more) -> DataFrame:
    """keys, center, cond_a, cond_b, similarity: mean similarity of the trials of two conditions."""

    def body(x: np.ndarray, label: dict) -> dict[str, list]:
        out: dict[str, list] = {"cond_a": [], "cond_b": [], "similarity": []}
        ok, u = _enough(x), units(x)
        for a, b in combinations(sorted(set(label[condition])), 2):
            out["cond_a"].append(a)
            out["cond_b"].append(b)
            out["similarity"].append(_between(u[ok & (label[condition] == a)], u[ok & (label[condition] == b)]))
        return out

    return around(df.where(F.col(condition).isNotNull()), grid, radius, keys, [condition, trial], body, "cond_a string, cond_b string, similarity double", **more)


def trial_maps(df: DataFrame, grid: DataFrame, radius: float, keys: list[str], condition: str = "condition", trial: str = "trial_idx", **more) -> DataFrame:
    """keys, center, condition, trial, score: of each trial, mean similarity to the others of its condition less that to all other trials."""

    def body(x: np.ndarray, label: dict) -> dict[str, list]:
        ok, u, score = _enough(x), units(x), np.full(len(x), np.nan)
        for c in set(label[condition]):
            own = ok & (label[condition] == c)
            rest = ok & ~own
            if own.sum() >= 2 and rest.any():
                mine, s = u[own], u[own].sum(0)
                score[own] = (mine @ s - (mine * mine).sum(1)) / (own.sum() - 1) - mine @ u[rest].sum(0) / rest.sum()
        return {"condition": label[condition].tolist(), trial: label[trial].tolist(), "score": score.tolist()}

    return around(df.where(F.col(condition).isNotNull()), grid, radius, keys, [condition, trial], body, f"condition string, {trial} bigint, score double", **more)


def cross_phase_maps(df: DataFrame, grid: DataFrame, radius: float, keys: list[str], first: str, second: str, phase: str = "phase", condition: str = "condition", trial: str = "trial_idx", **more) -> DataFrame:
    """keys, center, cond_a, cond_b, similarity: cosine of a condition's mean pattern in the first phase with that in the second; of two conditions, the mean of both ways. Conditions that a phase lacks have NULL."""

    def body(x: np.ndarray, label: dict) -> dict[str, list]:
        out: dict[str, list] = {"cond_a": [], "cond_b": [], "similarity": []}
        names = sorted(set(label[condition]))
        of = {(p, c): pattern(x[(label[phase] == p) & (label[condition] == c)]) for p in (first, second) for c in names}
        for k, a in enumerate(names):
            for b in names[k:]:
                out["cond_a"].append(a)
                out["cond_b"].append(b)
                there, back = cosine(of[first, a], of[second, b]), cosine(of[first, b], of[second, a])
                whole = all((label[phase][label[condition] == c] == p).any() for c in (a, b) for p in (first, second))
                out["similarity"].append(_mean([there, back]) if whole else np.nan)
        return out

    both = df.where(F.col(phase).isin(first, second) & F.col(condition).isNotNull())
    return around(both, grid, radius, keys, [phase, condition, trial], body, "cond_a string, cond_b string, similarity double", **more)


def cross_phase_trial_maps(df: DataFrame, grid: DataFrame, radius: float, keys: list[str], first: str, second: str, phase: str = "phase", condition: str = "condition", trial: str = "trial_idx", **more) -> DataFrame:
    """keys, center, phase, condition, trial, similarity: cosine of each trial with the mean pattern of its condition in the other phase."""

    def body(x: np.ndarray, label: dict) -> dict[str, list]:
        similarity = np.full(len(x), np.nan)
        for c in set(label[condition]):
            for p, other in ((first, second), (second, first)):
                at = np.flatnonzero((label[phase] == p) & (label[condition] == c))
                across = (label[phase] == other) & (label[condition] == c)
                if across.any():
                    middle = pattern(x[across])
                    similarity[at] = [cosine(x[t], middle) for t in at]
        return {"phase": label[phase].tolist(), "condition": label[condition].tolist(), trial: label[trial].tolist(), "similarity": similarity.tolist()}

    both = df.where(F.col(phase).isin(first, second) & F.col(condition).isNotNull())
    return around(both, grid, radius, keys, [phase, condition, trial], body, f"phase string, condition string, {trial} bigint, similarity double", **more)


def _towards(x: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    middle = pattern(x[other])
    return np.array([cosine(t, middle) for t in x[own]])


def dynamic_maps(df: DataFrame, grid: DataFrame, radius: float, keys: list[str], early: int = 4, late: int = 4, condition: str = "condition", trial: str = "trial_idx", **more) -> DataFrame:
    """keys, center, cond_a, cond_b, delta, slope: cosine of two conditions' late patterns less that of the early ones, and the mean slope of each one's trials towards the other's pattern. Pairs with too few trials have no rows."""

    def body(x: np.ndarray, label: dict) -> dict[str, list]:
        out: dict[str, list] = {"cond_a": [], "cond_b": [], "delta": [], "slope": []}
        of = {c: np.flatnonzero(label[condition] == c) for c in sorted(set(label[condition]))}
        for a, b in combinations([c for c, at in of.items() if len(at) >= early + late], 2):
            out["cond_a"].append(a)
            out["cond_b"].append(b)
            out["delta"].append(cosine(pattern(x[of[a][-late:]]), pattern(x[of[b][-late:]])) - cosine(pattern(x[of[a][:early]]), pattern(x[of[b][:early]])))
            out["slope"].append(_mean([slope(_towards(x, of[a], of[b])), slope(_towards(x, of[b], of[a]))]))
        return out

    return around(df.where(F.col(condition).isNotNull()), grid, radius, keys, [condition, trial], body, "cond_a string, cond_b string, delta double, slope double", **more)


def dynamic_trial_maps(df: DataFrame, grid: DataFrame, radius: float, keys: list[str], condition: str = "condition", trial: str = "trial_idx", **more) -> DataFrame:
    """keys, center, condition, other, trial, similarity: cosine of each trial with the mean pattern of every other condition, the series behind the slopes."""

    def body(x: np.ndarray, label: dict) -> dict[str, list]:
        out: dict[str, list] = {"condition": [], "other": [], trial: [], "similarity": []}
        of = {c: np.flatnonzero(label[condition] == c) for c in sorted(set(label[condition]))}
        for a in of:
            for b in of:
                if a != b:
                    out["condition"] += [a] * len(of[a])
                    out["other"] += [b] * len(of[a])
                    out[trial] += label[trial][of[a]].tolist()
                    out["similarity"] += _towards(x, of[a], of[b]).tolist()
        return out

    return around(df.where(F.col(condition).isNotNull()), grid, radius, keys, [condition, trial], body, f"condition string, other string, {trial} bigint, similarity double", **more)


def chunked(grid: DataFrame, count: int, feature: str = "feature_id") -> DataFrame:
    """Adds chunk (from 0): voxels in the order of their number, cut at the whole parts of k * n / count."""
    if count < 1:
        raise ValueError("count is at least 1")
    each = running(grid.select(F.col(feature).alias("_f"), F.lit(1).alias("_one")), [], "_f", ["_one"])
    chunk = F.floor((F.col("_one_upto") * count - 1) / F.col("_one_all")).cast("bigint")
    return grid.join(each.select(F.col("_f").alias(feature), chunk.alias("chunk")), feature)
