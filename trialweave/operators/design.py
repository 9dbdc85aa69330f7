"""Design matrices and contrasts as DataFrames: generated from tables of conditions or subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _vector(n, values):
    return F.transform(F.sequence(F.lit(0), n - 1), values)


def numbered(conditions: DataFrame, name: str = "condition") -> DataFrame:
    """Distinct conditions with pos from 0 and n; a table of conditions is small."""
    c = conditions.select(F.col(name).alias("condition")).distinct()
    w = Window.orderBy("condition")
    return c.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).withColumn("n", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("int"))


def against_baseline(conditions: DataFrame, name: str = "condition") -> DataFrame:
    """One contrast for each condition."""
    return numbered(conditions, name).select(F.concat("condition", F.lit(">baseline")).alias("contrast"), _vector(F.col("n"), lambda k: F.when(k == F.col("pos"), 1.0).otherwise(0.0)).alias("weights"))


def pairwise(conditions: DataFrame, name: str = "condition", both_ways: bool = True) -> DataFrame:
    """A contrast for each pair, in both directions."""
    c = numbered(conditions, name)
    other = c.select(F.col("condition").alias("other"), F.col("pos").alias("at"), "n")
    j = c.join(other, "n").where(F.col("pos") != F.col("at") if both_ways else F.col("pos") < F.col("at"))
    weights = _vector(F.col("n"), lambda k: F.when(k == F.col("pos"), 1.0).when(k == F.col("at"), -1.0).otherwise(0.0))
    return j.select(F.concat("condition", F.lit(">"), "other").alias("contrast"), weights.alias("weights"))


def first_against_rest(conditions: DataFrame, name: str = "condition") -> DataFrame:
    c = numbered(conditions, name).where("pos = 0")
    return c.select(F.concat("condition", F.lit(">rest")).alias("contrast"), _vector(F.col("n"), lambda k: F.when(k == 0, (F.col("n") - 1).cast("double")).otherwise(-1.0)).alias("weights"))


def linear_trend(conditions: DataFrame, name: str = "condition") -> DataFrame:
    c = numbered(conditions, name).where("pos = 0")
    return c.select(F.lit("linear_trend").alias("contrast"), _vector(F.col("n"), lambda k: k - (F.col("n") - 1) / 2.0).alias("weights"))


def cells(subjects: DataFrame, factors: list[str], key: str = "subject") -> DataFrame:
    """One-hot rows of a factorial design with cell means: cell from 0, in the order of the factors' levels."""
    out, size = subjects.select(key, *factors), {}
    cell = F.lit(0)
    for f in factors:
        levels = subjects.select(f).distinct().select(f, (F.row_number().over(Window.orderBy(f)) - 1).alias(f"_{f}"))
        n = F.count(F.lit(1)).over(Window.orderBy(f).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        out = out.join(F.broadcast(levels.withColumn(f"_n{f}", n)), f)  # levels of a factor
        cell = cell * F.col(f"_n{f}") + F.col(f"_{f}")
        size[f] = F.col(f"_n{f}")
    total = F.lit(1)
    for f in factors:
        total = total * size[f]
    return out.withColumn("cell", cell.cast("int")).withColumn("_cells", total.cast("int")).select(key, *factors, "cell", _vector(F.col("_cells"), lambda k: F.when(k == F.col("cell"), 1.0).otherwise(0.0)).alias("design_row"))


#: Contrasts of a two-by-two design over its cells (first factor slow): both main effects and the interaction, each way.
TWO_BY_TWO = {"first": [1, 1, -1, -1], "first_neg": [-1, -1, 1, 1], "second": [1, -1, 1, -1], "second_neg": [-1, 1, -1, 1], "interaction": [1, -1, -1, 1], "interaction_neg": [-1, 1, 1, -1]}


def vest_lines(design: DataFrame, order: str, row: str = "design_row") -> DataFrame:
    """A design as numbered text lines with a header of waves and points."""
    stats = design.agg(F.max(F.size(row)).alias("w"), F.count(F.lit(1)).alias("n"))
    head = stats.select(F.posexplode(F.array(F.concat(F.lit("/NumWaves "), "w"), F.concat(F.lit("/NumPoints "), "n"), F.lit("/Matrix"))).alias("line_no", "line"))
    body = design.select((F.row_number().over(Window.orderBy(order)) + 2).alias("line_no"), F.array_join(F.transform(row, lambda x: x.cast("string")), " ").alias("line"))
    return head.unionByName(body)


def flexible(subjects: DataFrame, patient, coding: str = "1/0", minimal: bool = False, key: str = "subject") -> tuple[DataFrame, dict[str, list[int]]]:
    """Intercept and group of each subject (patients 1; others 0, or -1 with coding ``1/-1``), and its contrasts by name."""
    if coding not in ("1/0", "1/-1"):
        raise ValueError(f"unknown coding: {coding}")
    other = 0.0 if coding == "1/0" else -1.0
    rows = subjects.select(key, F.array(F.lit(1.0), F.when(patient, F.lit(1.0)).otherwise(F.lit(other))).alias("design_row"))
    contrasts = {"patients>controls": [0, 1], "patients<controls": [0, -1]}
    return rows, contrasts if minimal else contrasts | {"patients": [1, 1], "controls": [1, 0] if coding == "1/0" else [1, -1]}


def vest_contrasts(contrasts: DataFrame) -> DataFrame:
    """Contrasts (contrast, weights, order) as numbered text lines: waves, number and names of contrasts, then their weights."""
    w = Window.orderBy("order", "contrast")  # contrasts of a design
    c = contrasts.withColumn("_k", F.row_number().over(w))
    stats = c.agg(F.max(F.size("weights")).cast("string").alias("w"), F.count(F.lit(1)).alias("n"))
    head = stats.select(F.posexplode(F.array(F.concat(F.lit("/NumWaves\t"), "w"), F.concat(F.lit("/NumContrasts\t"), F.col("n").cast("string")))).alias("line_no", "line"))
    names = c.select((F.col("_k") + 1).alias("line_no"), F.concat(F.lit("/ContrastName"), F.col("_k").cast("string"), F.lit("\t"), "contrast").alias("line"))
    mark = stats.select((F.col("n") + 2).cast("int").alias("line_no"), F.lit("/Matrix").alias("line"))
    body = c.crossJoin(F.broadcast(stats.select("n"))).select((F.col("_k") + F.col("n") + 2).cast("int").alias("line_no"), F.array_join(F.transform("weights", lambda x: F.format_string("%.6f", x.cast("double"))), "\t").alias("line"))
    return head.unionByName(names).unionByName(mark).unionByName(body)


def vest_groups(design: DataFrame) -> DataFrame:
    """One variance group for all points, as numbered text lines."""
    n = design.agg(F.count(F.lit(1)).alias("n"))
    lines = F.concat(F.array(F.lit("/NumWaves\t1"), F.concat(F.lit("/NumPoints\t"), F.col("n").cast("string")), F.lit("/Matrix")), F.array_repeat(F.lit("1"), F.col("n").cast("int")))
    return n.select(F.posexplode(lines).alias("line_no", "line"))
