"""Neighbourhoods on a voxel grid: spheres, boxes and nearest neighbours by joins on grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.operators.lineage import cut
from trialweave.operators.ordered import running

AXES = ("i", "j", "k")


def _near(centers: DataFrame, points: DataFrame, reach: float, key: str, keep: list[str]) -> DataFrame:
    """Pairs of centers and points in one cell, with both places: a cell has twice the side of ``reach``, and a point is in each cell that its surroundings touch, eight at most.

    The hint keeps the join from being broadcast: Spark takes the size of copied points for that of the points.
    """
    side, wide = 2 * reach, reach * (1 + 1e-9)  # a rounded distance of just reach is in reach
    left = centers.select(F.col(key).alias("center"), *[F.col(a).alias(f"_{a}") for a in AXES], *[F.floor(F.col(a) / side).alias(f"_c{a}") for a in AXES])
    right = points.select(F.col(key).alias("neighbor"), *AXES, *keep)
    for a in AXES:
        right = right.withColumn(f"_c{a}", F.explode(F.sequence(F.floor((F.col(a) - wide) / side), F.floor((F.col(a) + wide) / side))))
    return left.hint("merge").join(right, [f"_c{a}" for a in AXES])


def sphere(points: DataFrame, radius: float, key: str = "feature_id", keep: list[str] | None = None, centers: DataFrame | None = None) -> DataFrame:
    """center, neighbor, distance (and columns of the neighbor) of all pairs within the radius, the point itself included; of some centers where these are given."""
    j = _near(points if centers is None else centers, points, radius, key, keep or [])
    square = sum(((F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")) for a in AXES[1:]), (F.col("i") - F.col("_i")) * (F.col("i") - F.col("_i")))
    return j.withColumn("_s", square.cast("double")).where(F.col("_s") <= radius * radius).select("center", "neighbor", F.sqrt("_s").alias("distance"), *(keep or []))


def box(points: DataFrame, half: int, key: str = "feature_id", keep: list[str] | None = None) -> DataFrame:
    """center, neighbor of all pairs within a cube of half side ``half``."""
    j = _near(points, points, float(max(half, 1)), key, keep or [])
    inside = F.greatest(*[F.abs(F.col(a) - F.col(f"_{a}")) for a in AXES]) <= half
    return j.where(inside).select("center", "neighbor", *(keep or []))


def nearest(points: DataFrame, k: int, radius: float, key: str = "feature_id", rounds: int = 24) -> DataFrame:
    """center, neighbor, distance, rank of the k nearest, the point itself included; ties by key.

    Spheres of growing radius: whoever has k neighbours within the radius has its nearest
    among them, the others go on with twice the radius. Each round is written, so none is
    computed again; points left after the last are an error.
    """
    out, left = None, points.select(key, *AXES)
    least = min(k, points.count())
    for step in range(rounds):
        found = sphere(points, radius * 2**step, key, centers=left)
        w = Window.partitionBy("center")
        ranked = found.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least)
        ranked = cut(ranked.withColumn("rank", F.row_number().over(w.orderBy("distance", "neighbor"))).where(F.col("rank") <= k).drop("_n"))
        out = ranked if out is None else out.unionByName(ranked)
        left = cut(left.hint("merge").join(ranked.where("rank = 1").select(F.col("center").alias(key)), key, "left_anti"))
        if left.isEmpty():
            return out
    raise RuntimeError(f"points without {least} neighbours within {radius * 2 ** (rounds - 1)}")


def overlay(base: DataFrame, top: DataFrame, label: str = "label") -> DataFrame:
    """Two label volumes as one: the first where it has a label, else the second with its numbers set after the first's."""
    shift = base.agg(F.coalesce(F.max(label), F.lit(0)).alias("_shift"))
    second = top.crossJoin(F.broadcast(shift)).select(*AXES, (F.col(label) + F.col("_shift")).alias("_second"))
    return base.select(*AXES, F.col(label).alias("_first")).join(second, list(AXES), "full").select(*AXES, F.coalesce("_first", "_second").alias(label))


def volume(values: DataFrame, grid: DataFrame, value: str = "value") -> DataFrame:
    """Values painted into a grid, 0 where there is none."""
    return grid.select(*AXES).join(values.select(*AXES, value), list(AXES), "left").select(*AXES, F.coalesce(value, F.lit(0.0)).alias(value))


def flat_places(grid: DataFrame, regions: DataFrame, feature: str = "feature_id", region: str = "roi") -> DataFrame:
    """feature, region, pos: the place of each voxel in a flat vector that holds one region after the other, in the order of ``regions`` (region, order), and a region's voxels by number. Regions that are not listed have no place."""
    own = grid.join(regions.select(region, F.col("order").alias("_order")), region)
    ranked = running(own.select(F.col(region).alias("_r"), F.col(feature).alias("_f"), F.lit(1).alias("_one")), ["_r"], "_f", ["_one"])
    sizes = own.groupBy(region, "_order").agg(F.count(F.lit(1)).alias("_size"))
    begin = F.coalesce(F.sum("_size").over(Window.orderBy("_order", region).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a region
    offsets = sizes.select(F.col(region).alias("_r"), begin.alias("_begin"))
    return ranked.join(F.broadcast(offsets), "_r").select(F.col("_f").alias(feature), F.col("_r").alias(region), (F.col("_begin") + F.col("_one_upto") - 1).cast("bigint").alias("pos"))


def scatter(values: DataFrame, grid: DataFrame, regions: DataFrame, feature: str = "feature_id", region: str = "roi", value: str = "value") -> DataFrame:
    """feature, region, value: a flat vector (pos, value) put back into the voxels of its regions. A vector without a value for a place is an error; values beyond the last place are left out."""
    placed = flat_places(grid, regions, feature, region).join(values.select("pos", value, F.lit(1).alias("_there")), "pos", "left")
    whole = F.assert_true(F.col("_there").isNotNull(), "the vector is too short for its regions")
    return placed.where(whole.isNull()).select(feature, region, value)


def flattened(values: DataFrame, grid: DataFrame, regions: DataFrame, feature: str = "feature_id", region: str = "roi", value: str = "value") -> DataFrame:
    """pos, value: the values of voxels as a flat vector, the inverse of :func:`scatter`."""
    return flat_places(grid, regions, feature, region).join(values.select(feature, value), feature).select("pos", value)
