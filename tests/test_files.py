"""A made-up tree of files: entities, filters, newest, subjects, missing, paths by preference."""

import os

import pytest

from trialweave.sources import files


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("study")
    names = ["sub-01/func/sub-01_task-rest_run-1_bold.nii.gz", "sub-01/func/sub-01_task-rest_run-2_bold.nii.gz", "sub-01/func/sub-01_task-rest_run-1_events.tsv", "sub-2/func/sub-2_task-walk_run-01_events.tsv", "sub-10/sub-10_task-rest_events.tsv", "old/sub-10_task-rest_events.tsv", "masks/front.nii.gz", "masks/back.nii.gz", "old/front.nii.gz", "dataset.json", "sub-03_sub-04_T1w.nii"]
    for k, name in enumerate(names):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * (k + 1))
        os.utime(path, (1_700_000_000 - 1000 * ("old" in name), 1_700_000_000 - 1000 * ("old" in name)))
    return root


def test_catalog(spark, tree):
    every = files.with_entities(files.scan(spark, f"file://{tree}"))
    by = {r["path"].split(f"{tree}/")[1]: r for r in every.collect()}
    assert len(by) == 11
    r = by["sub-01/func/sub-01_task-rest_run-2_bold.nii.gz"]
    assert (r["entities"], r["suffix"], r["extension"], r["length"]) == ({"sub": "01", "task": "rest", "run": "2"}, "bold", ".nii.gz", 2)
    assert by["dataset.json"]["entities"] == {} and by["dataset.json"]["suffix"] == "dataset"
    assert by["sub-03_sub-04_T1w.nii"]["entities"] == {"sub": "04"}
    names = lambda df: sorted(x["name"] for x in df.collect())
    assert names(files.layout(every, suffix="events", task="rest", sub=["1", "010"])) == ["sub-01_task-rest_run-1_events.tsv", "sub-10_task-rest_events.tsv", "sub-10_task-rest_events.tsv"]
    assert names(files.layout(every, extension=".nii.gz", run="1")) == ["sub-01_task-rest_run-1_bold.nii.gz"]
    assert names(files.layout(every, run="01", suffix="events")) == ["sub-01_task-rest_run-1_events.tsv", "sub-2_task-walk_run-01_events.tsv"]
    latest = {x["name"]: x["path"] for x in files.newest(every, ["name"]).collect()}
    assert latest["sub-10_task-rest_events.tsv"].endswith("/sub-10/sub-10_task-rest_events.tsv") and len(latest) == 9
    assert {x["subject"]: x["n_files"] for x in files.subjects(every, drop=["2"]).collect()} == {"01": 3, "10": 2, "04": 1}
    wanted = spark.createDataFrame([("01", "rest"), ("01", "walk"), ("77", "rest")], "sub string, task string")
    assert sorted(map(tuple, files.missing(every, wanted, ["sub", "task"]).collect())) == [("01", "walk"), ("77", "rest")]
    masks = {x["region"]: x["path"] for x in files.region_masks(files.scan(spark, f"file://{tree}", "*.nii.gz")).where("region in ('front', 'back')").collect()}
    assert masks["front"].endswith("/masks/front.nii.gz") and set(masks) == {"front", "back"}


def test_paths_by_preference(spark, tree):
    there, gone = f"file://{tree}/dataset.json", f"file://{tree}/none.csv"
    assert files.resolve(spark, [gone, there]) == there
    with pytest.raises(FileNotFoundError, match="none.csv"):
        files.resolve(spark, [gone])
