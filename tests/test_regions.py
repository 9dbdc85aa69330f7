"""Softmax fits against their optimum, and the region report against plain loops."""

import numpy as np
import pytest

from trialweave.operators import regions
from trialweave.operators.decoding import folds, seed_of

SCHEMA = "subject long, phase string, condition string, trial_idx long, features array<double>"


def descent(x, hot, weight, steps=4000):
    """Softmax by plain gradient descent."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros((hot.shape[1], z.shape[1]))
    ridge = np.ones(z.shape[1])
    ridge[-1] = 0
    rate = 1 / (0.5 * np.linalg.eigvalsh((z * weight[:, None]).T @ z).max() + 1)
    for _ in range(steps):
        s = z @ w.T
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= rate * ((weight[:, None] * (p - hot)).T @ z + ridge * w)
    return w[:, :-1], w[:, -1] - w[:, -1].mean()


@pytest.mark.parametrize("width", [3, 40])
def test_softmax(width):
    r = np.random.default_rng(width)
    y = np.repeat([0, 1, 2], [12, 8, 5])
    x = r.normal(size=(25, width)) + np.eye(3)[y] @ r.normal(size=(3, width))
    coef, shift = regions.multinomial(x, y, 3)
    hot = np.eye(3)[y]
    want = descent(x, hot, (25 / (3 * hot.sum(0)))[y], 40000)
    assert np.allclose(coef, want[0], atol=1e-4) and np.allclose(shift, want[1], atol=3e-3)  # the descent is slow in the intercepts


def plain_accuracy(x, y, k, seed):
    names, label, counts = np.unique(y, return_inverse=True, return_counts=True)
    if len(y) < 4 or len(names) < 2 or counts.min() < 2:
        return np.nan
    fold, marks = folds(label, min(k, counts.min()), seed), []
    for f in np.unique(fold):
        a, b = fold != f, fold == f
        mean, sd = x[a].mean(0), x[a].std(0)
        hot = np.eye(len(names))[label[a]]
        coef, shift = descent((x[a] - mean) / sd, hot, (a.sum() / (len(names) * hot.sum(0)))[label[a]])
        marks.append((((x[b] - mean) / sd @ coef.T + shift).argmax(1) == label[b]).mean())
    return np.mean(marks)


@pytest.mark.parametrize("width", [5, 40])
def test_fits_side_by_side(monkeypatch, width):
    """Folds of several entries with classes and rows of different number take the Newton steps of one fit, and give what each gives alone."""
    r, solved, solve = np.random.default_rng(width), [], np.linalg.solve
    y = r.choice(list("ABC"), 60)
    x = r.normal(size=(60, width)) + (y == "A")[:, None] * 0.7
    x[:, 0] = 2.5
    asked = {f"a{k}": (r.random(60) < 0.3 + 0.1 * k, y if k % 2 else np.where(y == "A", "A", "other"), k) for k in range(6)}
    asked["few"] = np.arange(60) < 3, y, 9
    monkeypatch.setattr(regions.np.linalg, "solve", lambda a, b: solved.append(len(a)) or solve(a, b))
    got = regions.accuracies(x, asked, 5)
    assert len(solved) < 40 and max(solved) >= 12
    assert np.isnan(got.pop("few"))
    for name, value in got.items():
        here, labels, seed = asked[name]
        assert abs(value - plain_accuracy(x[here][:, 1:], labels[here], 5, seed)) < 1e-9 or len(np.unique(labels)) == 2, name
        assert value == regions.accuracies(x, {name: asked[name]}, 5)[name]


def test_report(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = []
    for s in (1, 2):
        for t in range(60):
            c = "ABC"[int(r.integers(3))]
            x = r.normal(size=9) + ("ABC".index(c) - 1) * np.arange(9) * 0.2
            rows.append((s, "learn" if t < 30 else "test", c, t, x))
    odd = [(2, "other", "A", 90, np.ones(9)), (2, "test", "A", 91, np.full(9, np.nan))]
    df = spark.createDataFrame([(*q[:4], q[4].tolist()) for q in rows + odd], SCHEMA).repartition(3)
    atlas = spark.createDataFrame([("front", 0, 4), ("back", 4, 5)], "region string, start int, size int")
    made = regions.report(df, atlas, "subject", ("B", "C"), "A", "learn", "test", usable=df.trial_idx % 7 != 0)
    got = {(q.subject, q.region): q for q in made.collect()}
    assert set(got) == {(s, g) for s in (1, 2) for g in ("front", "back")} and len(made.columns) == 19
    for (s, g), q in got.items():
        at = slice(0, 4) if g == "front" else slice(4, 9)
        own = [v for v in rows if v[0] == s]
        x, y, phase = np.stack([v[4][at] for v in own]), np.array([v[2] for v in own]), np.array([v[1] for v in own])
        use = np.array([v[3] % 7 != 0 for v in own])
        stage = np.full(len(own), "", object)
        extra = [91] if s == 2 else []
        for p in ("learn", "test"):
            for c in "ABC":
                all_of = [k for k in range(len(own)) if phase[k] == p and y[k] == c] + ([-1] if extra and p == "test" and c == "A" else [])
                for k in all_of[:4]:
                    stage[k] = "Early" if k >= 0 else stage[k]
                for k in all_of[-4:]:
                    if k >= 0:
                        stage[k] = "Late"
        for n, p in (("first", "learn"), ("second", "test")):
            for name, here in ((f"accuracy_{n}", use), (f"accuracy_{n}_early", use & (stage == "Early")), (f"accuracy_{n}_late", use & (stage == "Late"))):
                here = here & (phase == p)
                want = plain_accuracy(x[here], y[here], 5, seed_of(s, g, name))
                assert np.isnan(want) and q[name] is None or abs(q[name] - want) < 1e-9, name
        assert q.n_trials_first == 30 and q.n_trials_second == 30 + len(extra) and q.n_usable_first == (use & (phase == "learn")).sum()
        assert q.n_usable_second == (use & (phase == "test")).sum()  # the trial of missing values is not usable
        if q.accuracy_second_early is not None and q.accuracy_second_late is not None:
            assert abs(q.accuracy_second_change - (q.accuracy_second_late - q.accuracy_second_early)) < 1e-12
        here = use & (phase == "test")
        merged = np.where(y[here] == "A", "third", "pair")
        assert abs(q.accuracy_second_merged - plain_accuracy(x[here], merged, 5, seed_of(s, g, "accuracy_second_merged"))) < 0.08
        assert -1 <= q.separation <= 1
    regions.write_report(made, str(tmp_path / "report"))
    again = spark.read.option("header", True).csv(str(tmp_path / "report"))
    assert again.count() == 4 and set(again.columns) == set(made.columns)
