"""Neighbourhood maps in blocks against plain loops over centres, with missing values, and blocks of several sizes."""

import numpy as np
import pytest

from trialweave.operators import maps

SCHEMA = "subject long, phase string, condition string, trial_idx long, features array<double>"


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(2)
    ijk = np.array([v for v in np.ndindex(5, 4, 3) if r.random() < 0.9]) - 2
    grid = spark.createDataFrame([(f, *map(int, v)) for f, v in enumerate(ijk)], "feature_id long, i long, j long, k long")
    rows = []
    for s in (1, 2):
        for t in range(40):
            x = r.normal(size=len(ijk))
            if t % 5 == 0:
                x[r.random(len(ijk)) < 0.15] = np.nan
            rows.append((s, "learn" if t < 22 else "test", "ABC"[int(r.integers(3))], t, x))
    df = spark.createDataFrame([(*q[:4], [None if np.isnan(v) and k % 2 else float(v) for k, v in enumerate(q[4])]) for q in rows], SCHEMA).repartition(3)
    return df, grid, ijk, rows


def near(ijk, c, radius):
    return np.flatnonzero(((ijk - ijk[c]) ** 2).sum(1) <= radius**2)


def same(got, want):
    assert set(got) == set(want)
    for k in want:
        assert np.allclose(got[k], want[k], equal_nan=True, atol=1e-9), k


def value(x):
    return np.nan if x is None else x


@pytest.mark.parametrize("side", [2, 3, 8])
@pytest.mark.parametrize("radius", [1.0, 2.3])
def test_condition_and_trial_maps(spark, data, side, radius):
    """Pairs of trials one by one, over all trials and halves."""
    df, grid, ijk, rows = data
    got = {(r.subject, r.center, r.part, r.condition): value(r.score) for r in maps.condition_maps(df, grid, radius, ["subject"], side=side, min_voxels=4).collect()}
    trial = {(r.subject, r.center, r.trial_idx): value(r.score) for r in maps.trial_maps(df, grid, radius, ["subject"], side=side, min_voxels=4).collect()}
    want, each = {}, {}
    for s in (1, 2):
        own = [q for q in rows if q[0] == s]
        label = np.array([q[2] for q in own])
        half = np.empty(len(own), object)
        for c in "ABC":
            at = np.flatnonzero(label == c)
            half[at[: len(at) // 2]], half[at[len(at) // 2 :]] = "H1", "H2"
        for c in range(len(ijk)):
            at = near(ijk, c, radius)
            if len(at) < 4:
                continue
            x = np.stack([q[4][at] for q in own])
            ok = np.isfinite(x).mean(1) >= 0.8
            z = x - np.nanmean(np.where(np.isfinite(x), x, np.nan), 1, keepdims=True)
            z = np.nan_to_num(z)
            z = z / np.linalg.norm(z, axis=1, keepdims=True)
            sim = z @ z.T
            for part in ("FULL", "H1", "H2"):
                here = ok & (True if part == "FULL" else half == part)
                for name in "ABC":
                    a, b = np.flatnonzero(here & (label == name)), np.flatnonzero(here & (label != name))
                    within = np.mean([sim[i, j] for i in a for j in a if i < j]) if len(a) > 1 else np.nan
                    want[s, c, part, name] = within - (sim[np.ix_(a, b)].mean() if len(a) and len(b) else np.nan)
            for k, q in enumerate(own):
                mine, rest = ok & (label == q[2]), ok & (label != q[2])
                others = [j for j in np.flatnonzero(mine) if j != k]
                each[s, c, q[3]] = sim[k, others].mean() - sim[k, rest].mean() if ok[k] and others and rest.any() else np.nan
    same(got, want)
    same(trial, each)


@pytest.mark.parametrize("side", [2, 8])
def test_maps_across_phases_and_in_time(spark, data, side):
    df, grid, ijk, rows = data
    radius, fin = 1.5, np.isfinite
    cross = {(r.subject, r.center, r.cond_a, r.cond_b): value(r.similarity) for r in maps.cross_phase_maps(df, grid, radius, ["subject"], "learn", "test", side=side).collect()}
    towards = {(r.subject, r.center, r.trial_idx): value(r.similarity) for r in maps.cross_phase_trial_maps(df, grid, radius, ["subject"], "learn", "test", side=side).collect()}
    dynamic = {(r.subject, r.center, r.cond_a, r.cond_b): (value(r.delta), value(r.slope)) for r in maps.dynamic_maps(df, grid, radius, ["subject"], 3, 3, side=side).collect()}
    series = {(r.subject, r.center, r.trial_idx, r.other): value(r.similarity) for r in maps.dynamic_trial_maps(df, grid, radius, ["subject"], side=side).collect()}

    def middle(x):
        x = x[fin(x).mean(1) >= 0.8]
        return np.array([np.mean(v[fin(v)]) if fin(v).any() else np.nan for v in x.T]) if len(x) else np.full(x.shape[1], np.nan)

    def cosine(a, b):
        m = fin(a) & fin(b)
        return a[m] @ b[m] / np.linalg.norm(a[m]) / np.linalg.norm(b[m]) if m.mean() >= 0.8 else np.nan

    def fit(y):
        t, on = np.arange(len(y)), fin(y)
        return np.polyfit(t[on], y[on], 1)[0]

    c1, c2, d, e = {}, {}, {}, {}
    for s in (1, 2):
        own = [q for q in rows if q[0] == s]
        label, phase, number = (np.array([q[k] for q in own]) for k in (2, 1, 3))
        for c in range(len(ijk)):
            x = np.stack([q[4][near(ijk, c, radius)] for q in own])
            of = {(p, n): middle(x[(phase == p) & (label == n)]) for p in ("learn", "test") for n in "ABC"}
            for k, n in enumerate("ABC"):
                for m in "ABC"[k:]:
                    c1[s, c, n, m] = np.nanmean([cosine(of["learn", n], of["test", m]), cosine(of["learn", m], of["test", n])])
            for k in range(len(own)):
                c2[s, c, number[k]] = cosine(x[k], of["test" if phase[k] == "learn" else "learn", label[k]])
                for m in "ABC":
                    if m != label[k]:
                        e[s, c, number[k], m] = cosine(x[k], middle(x[label == m]))
            for n, m in ("AB", "AC", "BC"):
                a, b = x[label == n], x[label == m]
                slopes = [fit(np.array([cosine(t, middle(b)) for t in a])), fit(np.array([cosine(t, middle(a)) for t in b]))]
                d[s, c, n, m] = cosine(middle(a[-3:]), middle(b[-3:])) - cosine(middle(a[:3]), middle(b[:3])), np.mean(slopes)
    same(cross, c1)
    same(towards, c2)
    same(dynamic, d)
    same(series, e)


def test_blocks_hold_what_their_centres_need(spark, data):
    _, grid, ijk, _ = data
    for side, radius in ((2, 1.0), (2, 2.3), (3, 4.0), (50, 1.0)):
        found = maps.blocks(grid, radius, side).collect()
        owned = [m["place"] for b in found for m in b["_members"] if m["own"]]
        assert sorted(owned) == list(range(len(ijk)))
        for b in found:
            members = {m["place"] for m in b["_members"]}
            assert all(set(near(ijk, m["place"], radius)) <= members for m in b["_members"] if m["own"])


@pytest.mark.parametrize("count", [1, 3, 7, 80])
def test_chunks(spark, data, count):
    _, grid, ijk, _ = data
    edges = [k * len(ijk) // count for k in range(count + 1)]
    got = {r.feature_id: r.chunk for r in maps.chunked(grid, count).collect()}
    assert all(edges[got[f]] <= f < edges[got[f] + 1] for f in range(len(ijk)))
    with pytest.raises(ValueError):
        maps.chunked(grid, 0)
