"""Names, labels and masks of an atlas; designs as text."""

import pytest
from pyspark.sql import functions as F

from trialweave.operators import atlas, design, selection


def test_names(spark, tmp_path):
    text = "V1-rh\n1 20 30\n\n7Networks_LH_Vis_3\n2 0 0\r\nplain name \n3\nbroken\nno number\nHippo-LH\n5 1\n7networks_rh_Default\n6\nV2-rh\n1\nlast without label\n"
    (tmp_path / "names.txt").write_text(text)
    names = atlas.paired_names(spark, f"file://{tmp_path}/names.txt")
    assert {r.label_id: r.label for r in names.collect()} == {1: "rh_V2", 2: "lh_Vis-3", 3: "plain name", 5: "lh_Hippo", 6: "rh_Default"}
    volume = spark.createDataFrame([(0,), (1,), (1,), (2,), (9,), (-3,), (None,)], "label int")
    found = atlas.labels(volume)
    assert {r.label_id: r.n_voxels for r in found.collect()} == {1: 2, 2: 1, 9: 1}
    assert {r.label_id: r.label for r in atlas.named(found, names).collect()} == {1: "rh_V2", 2: "lh_Vis-3", 9: "combined_ROI_9"}
    assert {r.label for r in atlas.named(found).collect()} == {"combined_ROI_1", "combined_ROI_2", "combined_ROI_9"}
    assert [r.order for r in atlas.region_order(found).orderBy("label_id").collect()] == [0, 1, 2]
    for rows in ([(0,), (-1,)], []):
        with pytest.raises(Exception, match="no labels over 0"):
            atlas.labels(spark.createDataFrame(rows, "label int")).collect()


def test_masks_by_hemisphere(spark):
    p = spark.createDataFrame([(1, "a", 20.0, -2), (1, "b", 6.0, -2), (2, "a", 25.0, 3), (3, "a", 30.0, 3), (4, "b", 99.0, 0), (5, "c", 99.0, 1)], "feature_id long, structure string, probability double, x long")
    groups = spark.createDataFrame([("ab", "a"), ("ab", "b")], "region string, structure string")
    assert sorted(map(tuple, atlas.hemisphere_masks(p, groups).collect())) == [("ab", "left", 1), ("ab", "right", 3)]


def test_designs_as_text(spark):
    people = spark.createDataFrame([("101",), ("202",), ("103",)], "subject string")
    for coding, other in (("1/0", 0.0), ("1/-1", -1.0)):
        rows, contrasts = design.flexible(people, F.col("subject").startswith("1"), coding)
        assert {r.subject: r.design_row for r in rows.collect()} == {"101": [1.0, 1.0], "202": [1.0, other], "103": [1.0, 1.0]}
        # what each contrast gives for group means 5 (patients) and 3 (others)
        b = [3.0, 2.0] if coding == "1/0" else [4.0, 1.0]
        assert {n: w[0] * b[0] + w[1] * b[1] for n, w in contrasts.items()} == {"patients>controls": b[1], "patients<controls": -b[1], "patients": 5.0, "controls": 3.0}
        assert list(design.flexible(people, F.lit(True), coding, minimal=True)[1]) == ["patients>controls", "patients<controls"]
    with pytest.raises(ValueError):
        design.flexible(people, F.lit(True), "2/1")
    table = spark.createDataFrame([(k, n, [float(v) for v in w]) for k, (n, w) in enumerate(contrasts.items())], "order int, contrast string, weights array<double>")
    lines = [r.line for r in design.vest_contrasts(table).orderBy("line_no").collect()]
    assert lines == ["/NumWaves\t2", "/NumContrasts\t4", *[f"/ContrastName{k}\t{n}" for k, n in enumerate(contrasts, 1)], "/Matrix", "0.000000\t1.000000", "0.000000\t-1.000000", "1.000000\t1.000000", "1.000000\t-1.000000"]
    assert [r.line for r in design.vest_groups(rows).orderBy("line_no").collect()] == ["/NumWaves\t1", "/NumPoints\t3", "/Matrix", "1", "1", "1"]


def test_ranges_of_trials(spark):
    t = spark.createDataFrame([(k,) for k in range(1, 6)] + [(None,)], "trial int")
    assert sorted(r.trial for r in selection.in_range(t, "trial", (2, 4)).collect()) == [2, 3, 4]
    assert selection.in_range(t, "trial").count() == 6
