"""Stages broken off and taken up again; flat vectors put into regions and back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.operators import geometry, stages


@pytest.fixture()
def units(spark):
    return spark.createDataFrame([(k if k % 9 else None, k * 1.5) for k in range(60)], "unit long, x double").repartition(3)


def test_a_broken_stage_goes_on_where_it_ended(spark, units, tmp_path):
    folder, done = f"file://{tmp_path}/stage", []

    def work(break_at):
        def go(part):
            if part.isEmpty() and break_at is None:
                return part.withColumn("y", F.col("x") + 1)
            if break_at is not None and len(done) == break_at:
                raise OSError("broken off")
            done.append(sorted(str(r.unit) for r in part.collect()))
            return part.withColumn("y", F.col("x") + 1)

        return go

    with pytest.raises(OSError):
        stages.run(units, ["unit"], work(3), folder, "v1", 8)
    assert stages.commits(spark, folder, "v1").count() == 3
    with pytest.raises(RuntimeError, match="5 of 8 blocks"):
        stages.read(spark, folder, "v1", 8, units.schema)
    first = [tuple(x) for x in done]
    # a folder of an attempt without commit does not count
    units.withColumn("y", F.lit(0.0)).write.parquet(f"{folder}/block-000007-lost")
    out = stages.run(units, ["unit"], work(None), folder, "v1", 8)
    assert sorted(map(str, out.collect())) == sorted(map(str, units.withColumn("y", F.col("x") + 1).collect()))
    worked = [tuple(x) for x in done]
    assert worked[:3] == first and len(set(worked)) == len(worked)  # no block twice
    assert sorted(u for x in worked for u in x) == sorted(str(r.unit) for r in units.collect())
    assert stages.missing(spark, folder, "v1", 8).isEmpty()
    before = len(done)
    again = stages.run(units, ["unit"], work(None), folder, "v1", 8)
    assert len(done) == before and again.count() == 60
    assert stages.missing(spark, folder, "v2", 8).count() == 8 and stages.missing(spark, folder, "v1", 4).count() == 4


def test_a_block_committed_twice_counts_once(spark, units, tmp_path):
    folder = f"file://{tmp_path}/stage"
    out = stages.run(units, ["unit"], lambda d: d, folder, "v", 2)
    assert out.count() == 60
    spark.read.parquet(f"{folder}/{stages.COMMITS}").write.mode("append").parquet(f"{folder}/{stages.COMMITS}")
    assert stages.commits(spark, folder, "v").count() == 2 and stages.run(units, ["unit"], lambda d: d, folder, "v", 2).count() == 60


def test_flat_vectors_of_regions(spark):
    r = np.random.default_rng(1)
    region = r.choice(["front", "back", "side"], 50)
    grid = spark.createDataFrame([(f, str(region[f]), f % 5, f // 5 % 5, f // 25) for f in range(50)], "feature_id long, roi string, i long, j long, k long")
    order = spark.createDataFrame([("side", 1), ("front", 2)], "roi string, order int")
    listed = [f for name in ("side", "front") for f in range(50) if region[f] == name]
    places = {x.feature_id: x.pos for x in geometry.flat_places(grid, order).collect()}
    assert places == {f: k for k, f in enumerate(listed)}
    values = spark.createDataFrame([(k, float(k * 2)) for k in range(len(listed) + 3)], "pos long, value double")
    put = geometry.scatter(values, grid, order)
    assert {x.feature_id: x.value for x in put.collect()} == {f: 2.0 * k for k, f in enumerate(listed)}
    back = geometry.flattened(put, grid, order)
    assert sorted((x.pos, x.value) for x in back.collect()) == [(k, 2.0 * k) for k in range(len(listed))]
    painted = geometry.volume(put.join(grid.drop("roi"), "feature_id"), grid)
    assert painted.count() == 50 and painted.where("value > 0").count() == len(listed) - 1
    with pytest.raises(Exception, match="too short"):
        geometry.scatter(values.where("pos <> 5"), grid, order).collect()
