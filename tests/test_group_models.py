"""Models over a whole group, against plain NumPy fits of the same folds and draws."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.operators import decoding
from trialweave.operators import group_models as G

PAIR = ("B", "C")
GRID = (0.01, 1.0, 100.0)
SCHEMA = "subject long, trial_idx long, condition string, features array<double>"


def md5(*parts):
    return hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()


def ranks(subjects, repeats):
    """[subjects, repeats]: rank by the md5 of repeat and id."""
    out = np.empty((len(subjects), repeats), int)
    for r in range(repeats):
        for k, s in enumerate(sorted(subjects, key=lambda s: md5(r, s))):
            out[subjects.index(s), r] = k
    return out


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(4)
    n, subjects = 240, 12
    subject, y = np.arange(n) % subjects, (r.random(n) < 0.4).astype(int)
    y[subject == 7] = 0  # has one condition only: in fits, but not tested
    x = r.normal(size=(n, 6)) * [1, 2, 5, 0.1, 1, 3] + y[:, None] * [0.5, 0, 1, 0, 0.3, 0] + subject[:, None] * 0.1 + 7
    x[:, 5] = 2.5  # does not vary
    rows = [(int(subject[k]), k, PAIR[y[k]], x[k].tolist()) for k in range(n)]
    odd = [(1, 900, "A", [0.0] * 6), (None, 901, "B", [0.0] * 6), (1, 902, "B", None)]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumn("attrs", F.lit("other")).repartition(3)
    return df, x, y, subject


def forced(x, y, subject, coef, which):
    hits = []
    for s in which:
        a, b = x[(subject == s) & (y == 1)], x[(subject == s) & (y == 0)]
        if len(a) and len(b):
            hits.append((a.mean(0) - b.mean(0)) @ coef > 0)
    return np.mean(hits) if hits else np.nan


def test_many_models(spark, data):
    """Weights of several sets and strengths in one go, to 1e-5 of Newton fits of each."""
    df, x, y, subject = data
    rank = ranks(list(range(12)), 2)[subject]
    splits = [G.Split(0, 1, 2), G.Split(1, -1, -1), G.Split(1, 3, -1)]
    rows = df.where("condition in ('B', 'C') and subject is not null and features is not null").drop("attrs").join(G.ranked(df, "subject", 2), "subject")
    rows = rows.select(F.col("features").alias("x"), (F.col("condition") == "C").cast("int").alias("y"), "attrs")
    members = G.split_members(splits, 5, 3)
    of, c = np.repeat(np.arange(3), 3), np.tile(GRID, 3)
    m = G.moments(rows, members, 3, 6)
    got = G.fit(rows, members, m, of, c)
    assert got.converged.all()
    weight = members(rank)
    for k in range(9):
        on = weight[:, of[k]] > 0
        mean, scale, coef, shift = decoding.fit(x[on], y[on], c[k])
        assert np.allclose(got.standard[k, :-1], coef, atol=1e-5)
        assert np.allclose(got.coef[k], coef / scale, atol=1e-5)
        assert np.isclose(got.intercept[k], shift - (coef * mean / scale).sum(), atol=1e-4)
        assert np.allclose(m.covariance()[of[k]], np.cov(x[on].T))


def test_sets_without_a_class(spark, data):
    df, *_ = data
    rows = df.where("condition = 'B' and subject = 1 and features is not null").select(F.col("features").alias("x"), F.lit(0).alias("y"), F.array(F.lit(1)).alias("attrs"))
    members = lambda attrs: attrs.astype(float)
    got = G.fit(rows, members, G.moments(rows, members, 1, 6), np.array([0]), np.array([1.0]))
    assert np.isnan(got.coef).all() and not got.converged.any()


def test_nested_over_the_group(spark, data):
    df, x, y, subject = data
    got = G.nested(df, PAIR, "subject", GRID, 2, 5, 3)
    rank = ranks(list(range(12)), 2)

    def choose(r, train):
        order = [s for s in sorted(range(12), key=lambda s: rank[s, r]) if s in train]
        marks = []
        for c in GRID:
            folds = []
            for i in range(3):
                test = [s for k, s in enumerate(order) if k % 3 == i]
                on = np.isin(subject, [s for s in order if s not in test])
                _, scale, coef, _ = decoding.fit(x[on], y[on], c)
                folds.append(forced(x, y, subject, coef / scale, test))
            marks.append(np.nanmean(folds))
        return GRID[int(np.argmax(marks))]

    for r in range(2):
        for o in range(5):
            train = [s for s in range(12) if rank[s, r] % 5 != o]
            c = choose(r, train)
            on = np.isin(subject, train)
            _, scale, coef, _ = decoding.fit(x[on], y[on], c)
            want = forced(x, y, subject, coef / scale, [s for s in range(12) if s not in train])
            assert got.chosen[r, o] == c
            assert np.isclose(got.accuracy[r, o], want, equal_nan=True)
    c = choose(0, list(range(12)))
    _, _, coef, _ = decoding.fit(x, y, c)
    assert got.strength == c and got.n_subjects == 11
    assert np.allclose(got.coef, coef, atol=1e-4) and np.allclose(got.pattern, np.cov(x.T) @ coef, atol=1e-4)


def test_bootstrap_over_the_group(spark, data):
    df, x, y, subject = data
    pattern, z = G.bootstrap(df, PAIR, "subject", 8)
    rank = ranks(list(range(12)), 1)[:, 0]
    by_rank = np.argsort(rank)
    centred = x - np.stack([x[subject == s].mean(0) for s in range(12)])[subject]
    want = []
    for d in range(8):
        picks = [by_rank[int(md5(d, k)[:12], 16) % 12] for k in range(12)]
        at = np.concatenate([np.flatnonzero(subject == s) for s in picks])
        score = decoding.decision(centred[at], decoding.fit(centred[at], y[at]))
        want.append((centred[at] - centred[at].mean(0)).T @ (score - score.mean()) / (len(at) - 1))
    assert np.allclose(pattern, np.mean(want, 0), atol=1e-4)
    assert np.allclose(z[:5], (np.mean(want, 0) / np.std(want, 0))[:5], rtol=1e-3)


def test_importance_on_held_out_folds(spark, data):
    df, x, y, subject = data
    got = {r.pos: r.importance for r in G.importance(df, PAIR, "subject", "trial_idx", 3, 4).collect()}
    rank = ranks(list(range(12)), 1)[:, 0]
    drops = []
    for f in range(4):
        test = [s for s in range(12) if rank[s] % 4 == f]
        on = ~np.isin(subject, test)
        _, scale, coef, _ = decoding.fit(x[on], y[on])
        coef = coef / scale
        trials = np.flatnonzero(~on)
        base = sorted(trials, key=lambda t: md5(0, t))
        each = []
        for r in (1, 2, 3):
            moved = x.copy()
            for k, t in enumerate(sorted(trials, key=lambda t: md5(r, t))):
                moved[t] = x[base[k]]
            row = []
            for j in range(6):
                one = x.copy()
                one[:, j] = moved[:, j]
                row.append(forced(x, y, subject, coef, test) - forced(one, y, subject, coef, test))
            each.append(row)
        drops.append(np.mean(each, 0))
    assert np.allclose([got[j] for j in range(6)], np.mean(drops, 0), atol=1e-9)
