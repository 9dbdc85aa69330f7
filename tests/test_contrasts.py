"""Contrast tables against weights written out, and their tests against NumPy."""

import math

import numpy as np
import pytest

from trialweave.operators import contrasts as C
from trialweave.operators import design

LEVELS = {"a": ["a1", "a2"], "b": ["b1", "b2", "b3"], "c": ["c1", "c2"]}


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(6)
    rows = []
    for k in range(300):
        cell = tuple(v[int(r.integers(len(v)))] for v in LEVELS.values())
        rows.append((k % 2, *cell, float(r.normal() + (cell[0] == "a2") * 2 + (cell[1] == "b3") * (cell[2] == "c2"))))
    rows += [(0, "a1", None, "c1", 1.0), (0, "a1", "b1", "c1", None), (2, "a1", "b1", "c1", 5.0)]
    return spark.createDataFrame(rows, "voxel long, a string, b string, c string, x double").repartition(3), rows


def weights_of(table, factors):
    out = {}
    for r in table.collect():
        out.setdefault(r.contrast, {})[tuple(r[f] for f in factors)] = r.weight
    return out


def test_two_by_two_as_written_out(spark):
    levels = {"first": ["x", "y"], "second": ["x", "y"]}
    w = weights_of(C.main_effects_and_interactions(spark, levels), list(levels))
    cells = [(a, b) for a in "xy" for b in "xy"]
    for name, of, share in (("first", "first:y-x", -0.5), ("second", "second:y-x", -0.5), ("interaction", "first:y-x x second:y-x", 1)):
        assert [w[of][c] for c in cells] == [share * v for v in design.TWO_BY_TWO[name]]


def test_products(spark):
    terms = {"a": C.factor_terms("a", ["p", "q"], ("each", "difference", "average")), "b": C.factor_terms("b", ["u", "v", "w"], ("rest",))}
    w = weights_of(C.products(spark, terms), ["a", "b"])
    assert len(w) == 4 * 3
    assert w["p>q|v>rest"] == {("p", "u"): -0.5, ("p", "v"): 1.0, ("p", "w"): -0.5, ("q", "u"): 0.5, ("q", "v"): -1.0, ("q", "w"): 0.5}
    assert w["a:all|u>rest"][("q", "u")] == 0.5


def test_two_by_three_by_two(spark, data):
    """Each effect, t and its degrees of freedom from the cells, written out."""
    df, rows = data
    factors = list(LEVELS)
    table = C.main_effects_and_interactions(spark, LEVELS)
    weights = weights_of(table, factors)
    assert len(weights) == 1 + 2 + 1 + 2 + 1 + 2 + 2
    cells = C.moments(df, ["voxel"], factors, "x")
    got = {(r.voxel, r.contrast): r for r in C.tested(cells, table, ["voxel"], factors).collect()}
    assert {v for v, _ in got} == {0, 1}  # voxel 2 has one cell
    for voxel in (0, 1):
        for name, w in weights.items():
            values = {c: np.array([q[4] for q in rows if q[0] == voxel and q[1:4] == c and q[4] is not None]) for c in w}
            error = np.array([v * v * values[c].var(ddof=1) / len(values[c]) for c, v in w.items()])
            free = np.array([len(values[c]) - 1 for c in w])
            r = got[voxel, name]
            assert math.isclose(r.effect, sum(v * values[c].mean() for c, v in w.items()), abs_tol=1e-9)
            assert math.isclose(r.t, r.effect / math.sqrt(error.sum()), rel_tol=1e-9) and math.isclose(r.df, error.sum() ** 2 / (error**2 / free).sum(), rel_tol=1e-9)
            assert 0 <= r.p <= 1


def test_cells_add_up(spark, data):
    df, _ = data
    whole = {r.voxel: r for r in C.moments(df, ["voxel"], [], "x").collect()}
    for r in C.merged(C.moments(df, ["voxel"], list(LEVELS), "x"), ["voxel"]).collect():
        assert (r.n, pytest.approx(r.mean), pytest.approx(r.m2, abs=1e-9)) == (whole[r.voxel].n, whole[r.voxel].mean, whole[r.voxel].m2)


def test_battery_has_q_of_each_map(spark, data):
    df, _ = data
    table = C.products(spark, {"a": C.factor_terms("a", LEVELS["a"])})
    got = C.battery(df.where("voxel < 2"), ["voxel"], [], table, ["a"], "x").collect()
    assert {r.contrast for r in got} == {"a1", "a2", "a1>a2"}
    for name in ("a1", "a2", "a1>a2"):
        p = {r.voxel: round(r.p, 9) for r in got if r.contrast == name}
        for r in got:
            if r.contrast == name:
                assert math.isclose(r.q, min(2 * min(p.values()), max(p.values())) if p[r.voxel] == min(p.values()) else max(p.values()), abs_tol=1e-9)
                assert r.z is None or math.copysign(1, r.z) == math.copysign(1, r.effect)
