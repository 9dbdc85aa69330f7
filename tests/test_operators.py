"""Kernels and models against NumPy or values that can be worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.functions import tails
from trialweave.functions import vectors as V
from trialweave.operators import clusters, decoding, design, drift, enhancement, geometry, group_models, inference, ordered, selection, similarity
from trialweave.operators import permutation as perm
from trialweave.sources import readers


def one(spark, expr, **columns):
    df = spark.range(1)
    for name, value in columns.items():
        df = df.withColumn(name, F.array(*[F.lit(x).cast("double") for x in value]))
    return df.select(expr.alias("x")).first()["x"]


def test_vector_kernels(spark):
    r = np.random.default_rng(1)
    a, b, t = r.normal(size=(3, 9))
    args = {"a": a.tolist(), "b": b.tolist(), "t": t.tolist()}
    assert math.isclose(one(spark, V.cosine("a", "b"), **args), a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert math.isclose(one(spark, V.pearson("a", "b"), **args), np.corrcoef(a, b)[0, 1])
    assert math.isclose(one(spark, V.euclidean("a", "b"), **args), np.linalg.norm(a - b))
    assert math.isclose(one(spark, V.scalar_projection("a", "b"), **args), a @ b / np.linalg.norm(b))
    assert math.isclose(one(spark, V.trajectory("a", "b", "t"), **args), (a - b) @ (t - b) / ((t - b) @ (t - b)))
    c = (a - a.mean()) / np.linalg.norm(a - a.mean())
    assert np.allclose(one(spark, V.center_normalize("a"), **args), c)


def test_missing_and_constant_vectors(spark):
    nan = float("nan")
    assert one(spark, V.cosine_valid("a", "b"), a=[1, 2, 3, nan, nan], b=[1, 2, 3, 4, 5]) is None
    assert math.isclose(one(spark, V.cosine_valid("a", "b"), a=[1, 2, 3, 4, nan], b=[1, 2, 3, 4, 9]), 1)
    assert one(spark, V.finite_fraction("a"), a=[1, nan, float("inf"), 2]) == 0.5
    assert one(spark, V.center_normalize("a"), a=[3, 3, 3]) == [0, 0, 0]
    assert one(spark, V.pearson("a", "b"), a=[3, 3, 3], b=[1, 2, 3]) is None
    assert one(spark, V.cosine("a", "b"), a=[0, 0], b=[1, 2]) is None


def test_tails():
    assert np.allclose(tails.t_upper(np.array([2.0, -1.0, 0.0, 5.0]), np.array([10.0, 5.0, 3.0, 2.0])), [0.03669402, 0.81839127, 0.5, 0.01887478], atol=1e-7)
    assert np.allclose(tails.normal_isf(np.array([0.025, 0.5, 1e-10])), [1.959964, 0, 6.361341], atol=1e-5)


def test_false_discovery_rates(spark):
    df = spark.createDataFrame([(k, p) for k, p in enumerate([0.01, 0.02, 0.03, 0.04, 0.05, None])], "k int, p double")
    for got in (ordered.bh(df, "p"), ordered.bh_within(df, [], "p", "k")):
        assert [None if r["q"] is None else round(r["q"], 9) for r in got.orderBy("k").collect()] == [0.05] * 5 + [None]
    assert [r["rejected"] for r in ordered.bh_reject(df, "p").orderBy("k").collect()] == [True] * 5 + [False]


def test_order_rules(spark):
    df = spark.createDataFrame([(1, k) for k in range(1, 8)] + [(2, k) for k in range(1, 6)], "s int, k int")
    stages = {(r["s"], r["k"]): r["stage"] for r in ordered.early_late(df, ["s"], ["k"]).collect()}
    assert [stages[1, k] for k in range(1, 8)] == ["Early"] * 3 + ["Late"] * 4
    half = {(r["s"], r["k"]): r["half"] for r in ordered.halves(df, ["s"], ["k"]).collect()}
    assert [half[2, k] for k in range(1, 6)] == ["H1"] * 2 + ["H2"] * 3
    assert ordered.slices(df, ["s"], ["k"]).where("stage is not null").count() == 0


def test_neighbours(spark):
    points = spark.createDataFrame([(0, 0, 0, 0), (1, 2, 0, 0), (2, 3, 0, 0), (3, 0, 50, 0)], "feature_id bigint, i bigint, j bigint, k bigint")
    got = {(r["center"], r["neighbor"]) for r in geometry.sphere(points, 2.0).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (0, 1), (1, 0), (1, 2), (2, 1)}
    near = geometry.nearest(points, 2, 1.0).where("rank = 2").collect()
    assert {r["center"]: r["neighbor"] for r in near} == {0: 1, 1: 2, 2: 1, 3: 0}


def test_neighbours_on_any_places_without_broadcasts(spark):
    """Places between grid points and under 0, against all pairs; copied points are never broadcast."""
    r = np.random.default_rng(3)
    place = np.concatenate([r.uniform(-6, 6, (60, 3)), r.integers(-4, 5, (60, 3))])
    points = spark.createDataFrame([(f, *map(float, v)) for f, v in enumerate(place)], "feature_id bigint, i double, j double, k double")
    gap = place[:, None] - place[None]
    for radius in (1.0, 2.5):
        found = geometry.sphere(points, radius)
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted((x["center"], x["neighbor"]) for x in found.collect()) == list(map(tuple, np.argwhere((gap**2).sum(2) <= radius**2)))
    found = geometry.box(points, 2)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == list(map(tuple, np.argwhere(np.abs(gap).max(2) <= 2)))
    for x in geometry.nearest(points, 5, 0.5).groupBy("center").agg(F.sort_array(F.collect_list(F.struct("rank", "distance"))).alias("near")).collect():
        assert np.allclose([d for _, d in x["near"]], np.sort(np.sqrt((gap[x["center"]] ** 2).sum(1)))[:5])


@pytest.mark.parametrize("one", [True, False])
def test_fits_of_many_draws_by_shares_of_rows(monkeypatch, one):
    """Wide rows, centred so that they do not have full rank: as the fits one by one, and without a factorisation a draw."""
    r = np.random.default_rng(9)
    x = r.normal(size=(1 if one else 30, 24, 64))
    x = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    ys = r.permuted(np.tile(np.arange(24) % 3 == 0, (30, 1)).astype(int), axis=1)
    want = [decoding.logistic(x[0 if one else k], ys[k]) for k in range(30)]
    monkeypatch.delattr(np.linalg, "qr")
    coef, shift = decoding.logistic_draws(x, ys)
    assert np.allclose(coef, [w for w, _ in want], atol=1e-8) and np.allclose(shift, [b for _, b in want], atol=1e-8)


@pytest.mark.parametrize("held", [1000, 7])
def test_shuffled_labels_as_bits(spark, held):
    """The labels of every draw, and sums over them, as with a row a draw and subject; with several ranges of keys too."""
    from trialweave.operators import permutation as perm

    r = np.random.default_rng(5)
    people = spark.createDataFrame([(s, "abc"[r.integers(3)], "xy"[r.integers(2)], float(r.normal())) for s in range(40)], "subject long, label string, arm string, value double")
    bits = perm.member_bits(people, "subject", "label", ["a", "b"], 70, ["arm"], held)
    got = {(x["subject"], 64 * x["_block"] + d + 1): "ab"[0 if x["_m0"] >> d & 1 else 1] for x in bits.collect() for d in range(64) if (x["_m0"] | x["_m1"]) >> d & 1}
    want = perm.relabelled(people, "subject", "label", 70, ["arm"]).where("label <> 'c'")
    assert got == {(x["subject"], x["perm_id"]): x["label"] for x in want.collect()}
    sums = {(x["arm"], x["perm_id"]): x for x in perm.member_sums(people.drop("label").join(bits, "subject"), ["arm"], "value", 2, 70).collect()}
    told = want.join(people.select("subject", "value"), "subject").groupBy("arm", "perm_id").pivot("label", ["a", "b"]).agg(F.count("value").alias("n"), F.sum("value").alias("s")).collect()
    assert len(sums) == len(told) == 140
    for x in told:
        y = sums[x["arm"], x["perm_id"]]
        assert np.allclose([y["_n0"], y["_s0"], y["_n1"], y["_s1"]], [x["a_n"], x["a_s"] or 0, x["b_n"], x["b_s"] or 0])


def test_overlay(spark):
    schema = "i int, j int, k int, label int"
    got = geometry.overlay(spark.createDataFrame([(0, 0, 0, 2), (0, 0, 1, 5)], schema), spark.createDataFrame([(0, 0, 1, 1), (9, 9, 9, 3)], schema)).collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, 0, 2), (0, 0, 1, 5), (9, 9, 9, 8)]


def test_permuted_labels_keep_counts(spark):
    df = spark.createDataFrame([(k, "ab"[k % 3 == 0], k % 2) for k in range(20)], "s int, g string, arm int")
    got = perm.relabelled(df, "s", "g", 5, ["arm"]).groupBy("perm_id", "arm", "g").count().collect()
    want = {(r["arm"], r["g"]): r["count"] for r in df.groupBy("arm", "g").count().collect()}
    assert len(got) == 20 and all(want[r["arm"], r["g"]] == r["count"] for r in got)


def test_logistic_meets_its_conditions():
    r = np.random.default_rng(3)
    for n, p in ((40, 5), (20, 60)):
        x, y = r.normal(size=(n, p)), (np.arange(n) % 3 == 0).astype(int)
        w, b = decoding.logistic(x, y, 0.7)
        weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
        off = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        assert np.abs(0.7 * x.T @ off + w).max() < 1e-6 and abs(off.sum()) < 1e-6


def test_decoding_of_separable_and_random_trials(spark):
    r = np.random.default_rng(5)
    rows = []
    for s in range(4):
        for k in range(24):
            y = k % 2
            rows.append((s, k, "BC"[y], (r.normal(size=6) + (6 * y if s < 2 else 0)).tolist()))
    df = spark.createDataFrame(rows, "subject bigint, trial_idx bigint, condition string, features array<double>")
    got = {x["subject"]: x["accuracy"] for x in decoding.decode(df, ["subject"], ("B", "C")).collect()}
    assert got[0] == got[1] == 1.0 and got[2] < 0.95
    m = decoding.models(df, ["subject"], ("B", "C"))
    sep = {x["subject"]: x["separation"] for x in decoding.separation(decoding.transfer(df, m, ["subject"], ("B", "C")), ["subject"], ("B", "C")).collect()}
    assert sep[0] > 0.9
    assert decoding.leave_one_out(df, ["subject"], ("B", "C")).count() == 96


def test_shrunk_covariance():
    x = np.random.default_rng(2).normal(size=(300, 4)) @ np.diag([1, 2, 3, 4])
    c = decoding.shrunk_covariance(x)
    assert np.allclose(np.trace(c), np.trace(np.cov(x.T, ddof=0))) and np.all(np.linalg.eigvalsh(c) > 0)
    assert np.allclose(decoding.shrunk_covariance(np.zeros((5, 3))), 0)


def plain_labels(ijk: np.ndarray) -> np.ndarray:
    """Component number of each voxel, neighbours sharing a face, edge or corner."""
    index = {tuple(v): k for k, v in enumerate(ijk)}
    part = np.arange(len(ijk))

    def find(x: int) -> int:
        while part[x] != x:
            part[x] = part[part[x]]
            x = part[x]
        return x

    moves = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]
    for k, (a, b, c) in enumerate(ijk):
        for da, db, dc in moves:
            other = index.get((a + da, b + db, c + dc))
            if other is not None:
                x, y = find(k), find(other)
                part[max(x, y)] = min(x, y)
    return np.array([find(k) for k in range(len(ijk))], int)


def plain_enhanced(t: np.ndarray, ijk: np.ndarray, step: float = 0.1, e: float = 0.5, h: float = 2.0) -> np.ndarray:
    """Threshold-free enhancement: sum over heights of extent**e * height**h * step, for each side."""
    out = np.zeros(len(t))
    for height in np.arange(step, np.abs(t).max(initial=0) + step, step):
        for side in (1, -1):
            over = np.flatnonzero(side * t >= height)
            if len(over):
                part = plain_labels(ijk[over])
                out[over] += np.bincount(part, minlength=len(over))[part] ** e * height**h * step
    return out


def test_plain_clusters():
    ijk = np.array([(0, 0, 0), (1, 1, 1), (5, 5, 5), (2, 2, 2), (9, 0, 0)])
    assert (plain_labels(ijk) == [0, 0, 2, 0, 4]).all()
    assert (plain_enhanced(np.array([3.0, 4.0, 5.0, 2.5, -6.0]), ijk) > 0).all()


def plain_masses(t, ijk, limit):
    out = np.zeros(len(t))
    for side in (1, -1):
        over = np.flatnonzero(side * t > limit)
        if len(over):
            part = plain_labels(ijk[over])
            out[over] = np.bincount(part, np.abs(t[over]) - limit, minlength=len(over))[part]
    return out


def test_cluster_masses_and_family_wise_p(spark):
    """Masses of every draw, and p, against NumPy on the t-maps; a snake of voxels takes many rounds of labels."""
    r = np.random.default_rng(7)
    ijk = np.array([(x, y, z) for x in range(6) for y in range(6) for z in range(3)])
    grid = spark.createDataFrame([(f, *map(int, v)) for f, v in enumerate(ijk)], "feature_id long, i long, j long, k long")
    values = r.normal(0.4, 1, (12, len(ijk)))
    maps = spark.createDataFrame([(s, f, float(values[s, f])) for s in range(12) for f in range(len(ijk)) if (s + f) % 11], "subject long, feature_id long, value double")
    t = clusters.t_maps(maps, 40).toPandas()
    seen = t[t.perm_id == 0].set_index("feature_id")["t"]
    for f in (0, 5, 50):
        x = np.array([values[s, f] for s in range(12) if (s + f) % 11])
        assert math.isclose(seen[f], x.mean() / (x.std(ddof=1) / math.sqrt(len(x))), rel_tol=1e-9)
    assert t.perm_id.nunique() == 41
    got = clusters.masses(clusters.t_maps(maps, 40), grid, 1.0).toPandas().set_index(["perm_id", "feature_id"])["mass"]
    wide, most = t.pivot(index="perm_id", columns="feature_id", values="t"), {}
    for perm_id, row in wide.iterrows():
        want = plain_masses(row.to_numpy(), ijk, 1.0)
        assert np.allclose([got.get((perm_id, f), 0.0) for f in range(len(ijk))], want)
        most[perm_id] = want.max()
        if perm_id == 0:
            own = want
    p = clusters.family_wise(maps, grid, 40, 1.0).toPandas().set_index("feature_id")["p"]
    null = np.array([v for k, v in most.items() if k])
    assert np.allclose([p[f] for f in range(len(ijk))], [((null >= m - 1e-9).sum() + 1) / 41 for m in own])
    snake = np.array([(x, y, 0) for y in range(0, 20, 2) for x in range(12)] + [(11 if y % 4 == 1 else 0, y, 0) for y in range(1, 19, 2)])
    line = spark.createDataFrame([(f, *map(int, v)) for f, v in enumerate(snake)], "feature_id long, i long, j long, k long")
    one_map = line.select(F.lit(0).alias("perm_id"), "feature_id", F.lit(3.3).alias("t"))
    assert np.allclose(clusters.masses(one_map, line).toPandas()["mass"], len(snake))


def test_models_take_a_bounded_sample(spark):
    """A group over the bound is fitted on about that many rows, one under it on all its rows."""
    r = np.random.default_rng(3)
    rows = [(g, i, "B" if i % 2 else "C", [float(v) for v in r.normal(i % 2, 1, 3)]) for g, n in ((1, 4000), (2, 60)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, trial_idx long, condition string, features array<double>")
    for bound in (10_000, 500):
        got = {m["g"]: m for m in decoding.models(df, ["g"], ("B", "C"), sample_rows=bound).collect()}
        small = np.array([f for g, _, _, f in rows if g == 2])
        assert np.allclose(got[2]["mean"], small.mean(0))
        exact = np.allclose(got[1]["mean"], np.array([f for g, _, _, f in rows if g == 1]).mean(0))
        assert exact == (bound == 10_000)


def test_designs(spark):
    c = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "condition string")
    got = {r["contrast"]: r["weights"] for r in design.pairwise(c).unionByName(design.first_against_rest(c)).unionByName(design.linear_trend(c)).collect()}
    assert got["a>b"] == [1, -1, 0] and got["c>a"] == [-1, 0, 1] and got["a>rest"] == [2, -1, -1] and got["linear_trend"] == [-1, 0, 1] and len(got) == 8
    s = spark.createDataFrame([(1, "x", "p"), (2, "y", "q"), (3, "x", "q")], "subject int, g string, d string")
    assert {r["subject"]: r["cell"] for r in design.cells(s, ["g", "d"]).collect()} == {1: 0, 2: 3, 3: 1}
    lines = [r["line"] for r in design.vest_lines(design.cells(s, ["g", "d"]), "subject").orderBy("line_no").collect()]
    assert lines[:3] == ["/NumWaves 4", "/NumPoints 3", "/Matrix"] and lines[3] == "1.0 0.0 0.0 0.0"


def test_readers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("onset\ttrial_type\n0\tCS-\n1.23456\tCSS\n")
    (tmp_path / "b.csv").write_text("onset,condition\n0,CS-\n")
    assert readers.separator(spark, str(tmp_path / "a.tsv")) == "\t" and readers.separator(spark, str(tmp_path / "b.csv")) == ","
    t = readers.delimited(spark, str(tmp_path / "a.tsv"), "onset double, trial_type string")
    assert readers.condition_column(t) == "trial_type" and t.count() == 2
    assert [r["usable"] for r in readers.events(t.withColumn("subject", F.lit(1))).collect()] == [1, 1]
    with pytest.raises(ValueError, match="nope"):
        readers.require(t, "nope")
    (tmp_path / "labels.txt").write_text("# head\nV1\n\nV2\n")
    assert [(r["label_id"], r["label"]) for r in readers.numbered_labels(spark, str(tmp_path / "labels.txt")).orderBy("label_id").collect()] == [(1, "V1"), (2, "V2")]
    ids = spark.createDataFrame([("sub-N101",), ("N101 ",), ("101.0",)], "s string").select(readers.subject_id("s").alias("s")).collect()
    assert [r["s"] for r in ids] == ["N101", "N101", "101"]
    names = spark.createDataFrame([("V1-rh",), ("7Networks_LH_Default_3",), ("x",)], "s string").select(readers.region_name("s").alias("s")).collect()
    assert [r["s"] for r in names] == ["rh_V1", "lh_Default-3", "x"]
    with pytest.raises(ValueError, match="2"):
        readers.complete(spark.createDataFrame([(0,), (1,), (3,)], "chunk bigint"), 4)


def test_refits_of_all_draws_at_once():
    """Draws together give what a fit a draw gives, with more features than rows and with fewer."""
    r = np.random.default_rng(2)
    for n, d in ((12, 30), (40, 5)):
        x = r.normal(size=(n, d))
        ys = r.permuted(np.tile(np.arange(n) % 2, (7, 1)), axis=1)
        w, b = decoding.logistic_draws(x[None], ys)
        for j, y in enumerate(ys):
            coef, shift = decoding.logistic(x, y)
            assert np.allclose(w[j], coef, atol=1e-6) and math.isclose(b[j], shift, abs_tol=1e-6)
        fold = decoding.fold_draws(ys, 4, r)
        for j, y in enumerate(ys):
            assert all(np.ptp(np.bincount(fold[j][y == v], minlength=4)) <= 1 for v in (0, 1))
        got = decoding.cv_accuracy_draws(x, ys, fold)
        assert np.allclose(got, [((decoding.cv_scores(x, y, f) > 0) == y).mean() for y, f in zip(ys, fold, strict=True)])


def test_shuffled_fits_and_accuracy(spark):
    """One feature carries the condition: it alone is beyond the refits of shuffled labels; a group of noise is not."""
    r = np.random.default_rng(5)
    rows = []
    for i in range(32):
        for g in (1, 2):
            x = r.normal(size=5)
            x[2] += 3.0 * (i % 2) * (g == 1)
            rows.append((g, i, "B" if i % 2 else "C", [float(v) for v in x]))
    rows += [(3, i, "B", [0.0] * 5) for i in range(4)]
    df = spark.createDataFrame(rows, "g long, trial_idx long, condition string, features array<double>")
    f = decoding.shuffled_fits(df, ["g"], ("C", "B"), 700, 300).toPandas().set_index(["g", "pos"]).sort_index()
    assert len(f) == 10  # a group of one condition has none
    own = np.array([v for g, _, _, v in rows if g == 1])
    coef = decoding.fit(own, np.array([i % 2 for g, i, _, _ in rows if g == 1]))[2]
    assert np.allclose(f.loc[1]["weight"], coef, atol=1e-6)
    assert f.loc[(1, 2)]["importance_p"] == f.loc[(1, 2)]["weight_p"] == 1 / 701
    assert (f.loc[1].drop(2)["weight_p"] > 0.02).all() and (f.loc[2]["importance_p"] > 0.001).all()
    p = decoding.permuted_accuracy(df, ["g"], ("C", "B"), 700).toPandas().set_index("g")
    assert p.loc[1]["p"] == 1 / 701 and p.loc[2]["p"] > 0.01 and abs(p.loc[1]["null_mean"] - 0.5) < 0.05 and len(p) == 2


def test_largest_values_with_ties(spark):
    """The same rows as a sort of each group; ties at the edge go to the larger feature."""
    r = np.random.default_rng(11)
    rows = [(g, f, float(v)) for g in (1, 2) for f, v in enumerate(r.integers(-6, 7, 300))] + [(1, 900, None), (1, 901, math.nan)]
    df = spark.createDataFrame(rows, "g long, feature_id long, value double")
    for n in (1, 17, 60, 299, 1000):
        got = {(x["g"], x["feature_id"]) for x in selection.largest(df, ["g"], "value", "feature_id", n).collect()}
        want = {(g, f) for k in (1, 2) for g, f, _ in sorted((x for x in rows if x[0] == k and x[2] is not None and not math.isnan(x[2])), key=lambda x: (-abs(x[2]), -x[1]))[:n]}
        assert got == want


def test_cube_pairs_and_region_matrix(spark):
    """Missing elements and small cubes give NULL; a region without spread has no rows."""
    x = [[1.0, 2.0, 4.0, 1.0], [2.0, 1.0, 5.0, 1.0], [0.0, 3.0, math.nan, 1.0], [4.0, 1.0, 1.0, 1.0]]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "subject long, trial_idx long, features array<double>")
    near = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 1), (2, 0), (2, 1)], "center long, neighbor long")
    pairs = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 3, 4)], "subject long, trial_a long, trial_b long")
    got = {(r["trial_a"], r["center"]): (r["pearson"], r["cosine"]) for r in similarity.cube_pairs(df, pairs, near, ["subject"]).collect()}
    assert set(got) == {(a, c) for a in (0, 1) for c in (0, 1, 2)}
    assert math.isclose(got[0, 0][0], np.corrcoef(x[0][:3], x[1][:3])[0, 1]) and math.isclose(got[0, 2][1], 4 / 5)
    assert got[0, 1] == got[1, 0] == (None, None) and got[1, 2][0] is not None
    m = similarity.region_matrix(df.where("trial_idx <> 2"), ["subject"], {"a": [0], "b": [1, 2], "c": [3]}).collect()
    assert {(r["region_a"], r["region_b"]) for r in m} == {("a", "b"), ("b", "a")}
    assert all(math.isclose(r["r"], np.corrcoef([1, 2, 4], [3, 3, 1])[0, 1]) for r in m)


def test_correlations_of_constants(spark):
    """A group in which one side does not vary has no r, beside groups that have one."""
    rows = [(g, float(i), float(i * i % 5), float(i) if g == 1 else 2.0) for g in (1, 2) for i in range(8)]
    df = spark.createDataFrame(rows, "g long, index double, cov double, m double")
    r = {x["g"]: x["r"] for x in inference.correlations(df, ["g"], ["m"], "index").collect()}
    assert math.isclose(r[1], 1.0) and r[2] is None
    part = {x["g"]: x["partial_r"] for x in inference.partial_correlation(df, ["g"], "cov", "m", "index").collect()}
    assert part[2] is None
    pairs = df.withColumn("no", F.col("index").cast("long"))
    c = {x["g"]: x["r"] for x in drift.coupling(pairs.select("g", "no", "cov"), pairs.select("g", "no", "m"), ["g"], ["no"], "cov", "m").collect()}
    assert c[2] is None and math.isclose(c[1], np.corrcoef([i * i % 5 for i in range(8)], range(8))[0, 1])


def test_resampling_defaults_are_the_reference_counts():
    import inspect

    from trialweave.operators import decoding

    default = lambda f, name: inspect.signature(f).parameters[name].default
    assert default(decoding.importance, "repeats") == default(decoding.permuted_accuracy, "n_perm") == 5000
    assert default(group_models.bootstrap, "n_boot") == 50
    assert default(decoding.shuffled_fits, "n_perm") == default(decoding.shuffled_fits, "repeats") == 5000
    assert [default(group_models.nested, k) for k in ("repeats", "outer", "inner")] == [10, 5, 5] and len(decoding.STRENGTHS) == 20


@pytest.mark.parametrize("seed", [1, 2])
def test_component_trees(seed):
    """Many draws at once, holes, equal values and values on a height, against a labelling at every height."""
    r = np.random.default_rng(seed)
    ijk = np.array([v for v in np.ndindex(7, 6, 5) if r.random() < 0.8])
    t = np.round(r.normal(0.3, 1.5, (9, len(ijk))), 1 if seed == 1 else 3)
    t[0, ::3] = t[0, 0]
    near = enhancement.neighbours(ijk)
    got = sum(enhancement.Trees(sign * t, near).scores() for sign in (1, -1))
    assert np.allclose(got, [plain_enhanced(x, ijk) for x in t], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("side", [48, 4, 3])
def test_enhanced_maps_in_blocks(spark, side):
    """One block and many give the same values as the whole map, in every draw, and so the same p."""
    r = np.random.default_rng(11)
    ijk = np.array([v for v in np.ndindex(9, 6, 5) if r.random() < 0.85]) - 4
    grid = spark.createDataFrame([(f, *map(int, v)) for f, v in enumerate(ijk)], "feature_id long, i long, j long, k long")
    values = r.normal(0.5, 1, (10, len(ijk))) + np.sin(ijk.sum(1) / 2)
    maps = spark.createDataFrame([(s, f, float(values[s, f])) for s in range(10) for f in range(len(ijk)) if (s + f) % 7], "subject long, feature_id long, value double")
    wide = clusters.t_maps(maps, 40).toPandas().pivot(index="perm_id", columns="feature_id", values="t")
    want = {p: plain_enhanced(x.to_numpy(), ijk) for p, x in wide.iterrows()}
    e = enhancement.enhanced(maps, grid, 40, side=side).toPandas()
    own = e[e.perm_id == 0].set_index("feature_id")["statistic"]
    assert np.allclose([own[f] for f in range(len(ijk))], want[0], rtol=1e-6)
    most = e[e.perm_id > 0].groupby("perm_id")["statistic"].max()
    assert sorted(most.index) == list(range(1, 41))
    assert np.allclose([most[p] for p in range(1, 41)], [want[p].max() for p in range(1, 41)], rtol=1e-6)
    p = enhancement.family_wise(maps, grid, 40, side=side).toPandas().set_index("feature_id")["p"]
    null = np.array([want[k].max() for k in range(1, 41)])
    assert np.allclose([p[f] for f in range(len(ijk))], [((null >= x - 1e-9).sum() + 1) / 41 for x in want[0]])


@pytest.mark.parametrize("statistic", ["mean", "t"])
def test_groups_drawn_anew(spark, statistic):
    """All draws one by one: missing values, several keys, a third group that stays out, subjects of one key only."""
    import hashlib

    r = np.random.default_rng(8)
    people = {s: "AABC"[s % 4] for s in range(41)}
    rows = [(s, g, k, float(r.normal()) if r.random() < 0.9 else None) for s, g in people.items() for k in ("x", "y", None) if (s + len(k or "")) % 5]
    df = spark.createDataFrame(rows, "subject long, grp string, key string, value double")
    got = {x["key"]: x for x in perm.group_difference(df, ["key"], "subject", "grp", "A", "B", "value", 50, statistic=statistic).collect()}
    two = sorted({s for s, g, *_ in rows if g in "AB"})
    size = len({s for s, g, *_ in rows if g == "A"})

    def compare(a, b):
        gap = np.mean(a) - np.mean(b)
        pooled = (np.var(a) * len(a) + np.var(b) * len(b)) / (len(a) + len(b) - 2)
        return gap if statistic == "mean" else gap / math.sqrt(pooled * (1 / len(a) + 1 / len(b)))

    def number(d, s):
        return hashlib.md5(f"{d // 4}-{s}".encode()).hexdigest()[8 * (d % 4) : 8 * (d % 4) + 8], s

    for key in ("x", "y", None):
        values = {s: v for s, g, k, v in rows if k == key and v is not None and g in "AB"}
        seen = compare([v for s, v in values.items() if people[s] == "A"], [v for s, v in values.items() if people[s] == "B"])
        null = []
        for d in range(50):
            first = set(sorted(two, key=lambda s: number(d, s))[:size])
            null.append(compare([v for s, v in values.items() if s in first], [v for s, v in values.items() if s not in first]))
        beyond = sum(abs(v) >= abs(seen) - 1e-12 for v in null)
        assert math.isclose(got[key]["observed"], seen, abs_tol=1e-9) and got[key]["n_beyond"] == beyond
        assert math.isclose(got[key]["p"], (beyond + 1) / 51) and math.isclose(got[key]["null_sd"], np.std(null), abs_tol=1e-9)
    whole = perm.group_difference(df, [], "subject", "grp", "A", "B", "value", 50, statistic=statistic).collect()
    assert len(whole) == 1 and 0 < whole[0]["p"] <= 1


@pytest.mark.parametrize("side", [3, 4, 48])
def test_cluster_inference_in_blocks(spark, side):
    """Clusters across faces, edges and corners of blocks, from below 0, against the joins; no sums of draws leave a task."""
    r = np.random.default_rng(17)
    ijk = np.array([(x, y, z) for x in range(-4, 4) for y in range(7) for z in range(5) if (x + y * z) % 9])
    grid = spark.createDataFrame([(f, *map(int, v)) for f, v in enumerate(ijk)], "feature_id long, i long, j long, k long")
    maps = spark.createDataFrame([(s, f, float(r.normal(0.3, 1))) for s in range(10) for f in range(len(ijk)) if (s * f) % 7 < 5] + [(0, 10**6, 1.0), (None, 3, 0.5), (1, 5, None)], "subject long, feature_id long, value double")
    got = clusters.family_wise(maps, grid, 70, 1.0, side=side).toPandas().set_index("feature_id").sort_index()
    m = clusters.masses(clusters.t_maps(maps, 70), grid, 1.0).toPandas()
    most = m[m.perm_id > 0].groupby("perm_id")["mass"].max().to_numpy()
    own = m[m.perm_id == 0].set_index("feature_id")["mass"]
    seen = sorted(f for f in clusters.t_maps(maps, 0).toPandas()["feature_id"] if f < len(ijk))
    assert list(got.index) == seen
    assert np.allclose(got["statistic"], [own.get(f, 0.0) for f in seen])
    assert np.allclose(got["p"], [((most >= own[f] - 1e-9).sum() + 1) / 71 if f in own.index else 1.0 for f in seen])


def test_faces_without_a_block_beyond_send_nothing():
    from trialweave.operators.blocks import Layout

    ijk = np.array(list(np.ndindex(6, 3, 3))) - 3
    layout = Layout(6, (-1, -1, -1), (0, -1, -1), 2, 1)
    assert (layout.inner_faces(ijk) == np.isin(ijk[:, 0], [-1, 0])).all()
    assert not Layout(6, (0, 0, 0), (0, 0, 0), 1, 1).inner_faces(ijk + 3).any()


@pytest.mark.parametrize("twins", [0, 9])
def test_draws_of_enhancement_at_once(twins):
    """The largest value of each draw, with holes and features at one place, is that of all its voxels; draws fall side by side, not a voxel at a time."""
    import time

    import pyarrow as pa

    from trialweave.operators import blocks

    r = np.random.default_rng(5)
    ijk = np.array([v for v in np.ndindex(20, 20, 25) if r.random() < 0.9])
    ijk = np.concatenate([ijk, ijk[:twins]])
    feature, subject = (x.ravel() for x in np.meshgrid(np.arange(len(ijk)), np.arange(8), indexing="ij"))
    rows = {"_subject": subject, "_feature": feature, "_x": r.normal(0.2, 1, len(feature)), **{c: ijk[feature, k].astype(np.int32) for k, c in enumerate("ijk")}}
    corner = [pa.scalar(0)] * 3
    table, layout = blocks._pack(corner, pa.table(rows | dict.fromkeys(blocks.KEYS[:3], np.zeros(len(feature), np.int32)))), blocks.Layout((20, 20, 25), (0, 0, 0), (0, 0, 0), 1, 1)
    begin = time.time()
    sent = enhancement._send_faces(layout, 96)((*corner, pa.scalar(0)), table).to_pandas().set_index("perm_id")["best"]
    assert time.time() - begin < 5  # trees that took a voxel at a time needed 9 s here
    assert sorted(sent.index) == list(range(1, 97))
    numbers, t = blocks.Block(table).t(2, 96)
    block = blocks.Block(table)
    near = enhancement.neighbours(block.ijk)
    whole = sum(enhancement.Trees(np.nan_to_num(s * t[:3], nan=-1.0), near).scores() for s in (1, -1))
    assert np.allclose(sent[numbers[:3]], whole.max(1), rtol=1e-9)
    if not twins:
        assert np.allclose(whole[0], plain_enhanced(np.nan_to_num(t[0]), block.ijk), rtol=1e-9)


def test_thin_grids_are_cut_along_their_length_only():
    from trialweave.operators.blocks import sides

    assert sides([20, 20, 50], 48) == (20, 20, 50)
    assert sides([20, 20, 300], 48) == (20, 20, 150)
    assert sides([100, 100, 100], 48) == (34, 50, 50)
    assert sides([1, 1, 10**6], 3) == (1, 1, 27)


def test_values_at_or_beyond(spark):
    values = sorted([0.0, 1.0, 1.0, 2.5, 7.0])
    df = spark.createDataFrame([(values, x) for x in (-1.0, 0.0, 0.5, 1.0, 2.5, 3.0, 7.0, 8.0)] + [([], 1.0)], "null array<double>, x double")
    got = [r[0] for r in df.select(perm.n_beyond("null", F.col("x"), 6)).collect()]
    assert got == [5, 5, 4, 4, 2, 1, 1, 0, 0]


def test_tails_of_small_t_and_many_degrees_of_freedom():
    """With t near 0 the area between is t times the density, whatever the degrees of freedom; df / (df + t * t) is 1 in doubles."""
    t, df = np.array([1e-9, 1e-6, 1e-4, 5e-4, -1e-6]), np.array([8.0, 89998.0, 89998.0, 89938.99, 5e6])
    density = np.array([math.exp(math.lgamma((f + 1) / 2) - math.lgamma(f / 2)) / math.sqrt(f * math.pi) for f in df])
    assert np.allclose(tails.t_upper(t, df), 0.5 - t * density, rtol=0, atol=1e-10)
    assert np.allclose(2 * tails.t_upper(np.array([1.959964, 11.4]), np.array([1e6, 89932.0])), [0.05000028, 4.38e-30], rtol=1e-2)


def test_t_of_draws_by_chunks():
    """t of voxels with different numbers of values over several chunks, without other arrays of all voxels and draws."""
    import tracemalloc

    import pyarrow as pa

    from trialweave.operators import blocks

    r = np.random.default_rng(3)
    n = 16 * blocks.CHUNK + 100
    rows = [(s, f) for f in range(n) for s in range(1 + f % 6)]
    subject, feature = np.array(rows).T
    x = r.normal(0, 1, len(rows))
    places = {c: v.astype(np.int32) for c, v in zip("ijk", np.unravel_index(feature, (40, 40, 40)), strict=True)}
    block = blocks.Block(blocks._pack([pa.scalar(0)] * 3, pa.table({"_subject": subject, "_feature": feature, "_x": x, **places, **dict.fromkeys(blocks.KEYS[:3], np.zeros(len(rows), np.int32))})))
    tracemalloc.start()
    numbers, t = block.t(2, 5000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * t.nbytes
    assert numbers.tolist() == list(range(33, 65)) and t.shape == (32, n)
    sign = block.signs(2)
    for at in range(0, n, 997):
        own = feature == block.ids[at]
        v = x[own][:, None] * sign[subject[own]]
        want = v.mean(0) / (v.std(0, ddof=1) / np.sqrt(len(v))) if len(v) >= 3 else np.full(32, np.nan)
        assert np.allclose(t[:, at], want, equal_nan=True)
