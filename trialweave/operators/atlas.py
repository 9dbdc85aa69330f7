"""Labels and names of an atlas, and masks of regions by hemisphere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialweave.sources.readers import region_name


def paired_names(spark: SparkSession, path: str) -> DataFrame:
    """label_id, label of a file in which a line of a name is followed by one that begins with its label; of a label that comes twice the later name. Blank lines, and pairs without a whole number, are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("_at", "_line"))  # the names of one atlas
    pairs = lines.groupBy(F.floor(F.col("_at") / 2).alias("_pair")).agg(F.max(F.when(F.col("_at") % 2 == 0, F.col("_line"))).alias("_name"), F.max(F.when(F.col("_at") % 2 == 1, F.col("_line"))).alias("_numbers"))
    label = F.expr("try_cast(split(_numbers, '\\\\s+')[0] as bigint)")
    found = pairs.select(label.alias("label_id"), "_pair", "_name").where("label_id is not null")
    return found.groupBy("label_id").agg(region_name(F.max_by("_name", "_pair")).alias("label"))


def labels(volume: DataFrame, label: str = "label") -> DataFrame:
    """label_id, n_voxels of the labels over 0; an atlas without any is an error."""
    over = volume.where(F.col(label) > 0)
    if over.isEmpty():
        raise ValueError("the atlas has no labels over 0")
    return over.groupBy(F.col(label).cast("bigint").alias("label_id")).agg(F.count(F.lit(1)).alias("n_voxels"))


def named(found: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Labels with their names, and ``combined_ROI_<label>`` where there is none."""
    default = F.concat(F.lit("combined_ROI_"), F.col("label_id").cast("string"))
    if names is None:
        return found.withColumn("label", default)
    return found.join(names, "label_id", "left").withColumn("label", F.coalesce("label", default))


def hemisphere_masks(probabilities: DataFrame, groups: DataFrame, limit: float = 25.0, feature: str = "feature_id", structure: str = "structure", value: str = "probability", x: str = "x") -> DataFrame:
    """region, hemisphere, feature: voxels in which the probabilities of a region's structures add up to more than ``limit``, by the side of x (0 is on neither)."""
    j = probabilities.join(F.broadcast(groups.select("region", structure)), structure)  # structures of an atlas
    total = j.groupBy("region", feature).agg(F.sum(value).alias("_sum"), F.max(x).alias("_x")).where(F.col("_sum") > limit)
    side = F.when(F.col("_x") < 0, "left").when(F.col("_x") > 0, "right")
    return total.select("region", side.alias("hemisphere"), feature).where("hemisphere is not null")


def region_order(found: DataFrame, by: str = "label_id") -> DataFrame:
    """Adds order, from 0, for vectors that hold one region after the other; labels of an atlas are few."""
    return found.withColumn("order", F.row_number().over(Window.orderBy(by)) - 1)
