"""Which features, trials and chunks go on: matched counts, percentiles, majorities, parsed orders, sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions import vectors as V
from trialweave.operators.ordered import running, same

#: How trial numbers stand in names, tried in this order.
TRIAL_PATTERNS = [r"trial[-_]?([0-9]+)", r"#([0-9]+)", r"_([0-9]+)$", r"([0-9]+)"]


def trial_number(name: Column | str) -> Column:
    """Number in a name; NULL if there is none."""
    c = F.col(name) if isinstance(name, str) else name
    found = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in TRIAL_PATTERNS]
    return F.coalesce(*found).try_cast("bigint")


def majority(df: DataFrame, value: str) -> DataFrame:
    """Rows with the most common value; of equally common ones the smallest."""
    top = df.groupBy(F.col(value).alias("_top")).agg(F.count(F.lit(1)).alias("_n")).agg(F.max_by("_top", F.struct("_n", -F.col("_top"))).alias("_top"))
    return df.join(F.broadcast(top), df[value] == top["_top"]).drop("_top")


def top_by_size(df: DataFrame, keys: list[str], value: str, feature: str, n: int) -> DataFrame:
    """The n largest absolute values within keys; ties go to the larger feature."""
    w = Window.partitionBy(*keys).orderBy(F.abs(value).desc(), F.col(feature).desc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def largest(df: DataFrame, keys: list[str], value: str, tie: str, n: int) -> DataFrame:
    """The n largest absolute values within keys, ties to the larger ``tie``; NULL and NaN are left out.

    Counts are carried over ranges of the values, so only rows of one value are ordered in a task.
    """
    sized = df.withColumn("_size", F.abs(F.col(value).cast("double"))).where(F.col("_size").isNotNull() & ~F.isnan("_size"))
    counts = running(sized.groupBy(*keys, "_size").agg(F.count(F.lit(1)).alias("_n")), keys, "_size", ["_n"])
    above = counts.select(*keys, "_size", (F.col("_n_all") - F.col("_n_upto")).alias("_above")).where(F.col("_above") < n)
    w = Window.partitionBy(*keys, "_size").orderBy(F.col(tie).desc())
    return same(sized, above, [*keys, "_size"]).withColumn("_at", F.row_number().over(w)).where(F.col("_above") + F.col("_at") <= n).drop("_size", "_above", "_at")


def matched(df: DataFrame, group: str, a: str, b: str, hit: Column, size: str, feature: str, share: float = 0.02) -> DataFrame:
    """Hits of both groups; a group without any takes as many of its largest as the other has, and both the top ``share`` if neither has one."""
    marked = df.where(F.col(group).isin(a, b)).withColumn("_hit", hit)
    c = marked.agg(F.count(F.when(F.col("_hit") & (F.col(group) == a), 1)).alias("a"), F.count(F.when(F.col("_hit") & (F.col(group) == b), 1)).alias("b"), F.count(F.when(F.col(group) == a, 1)).alias("n")).first()
    if c["a"] and c["b"]:
        return marked.where("_hit").drop("_hit")
    n = c["a"] or c["b"] or max(1, round(c["n"] * share))
    bare = [g for g, k in ((a, c["a"]), (b, c["b"])) if not k]
    chosen = largest(marked.where(F.col(group).isin(*bare)), [group], size, feature, n)
    return chosen.unionByName(marked.where(F.col("_hit") & ~F.col(group).isin(*bare))).drop("_hit")


def importance_mask(df: DataFrame, score: str, p: str, alpha: float = 0.05, least: int = 20) -> DataFrame:
    """Positive scores with p under alpha; all positive ones where these are fewer than ``least``."""
    positive = df.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.col(score) > 0))
    primary = positive.agg(F.count(F.when(F.col(p) < alpha, 1)).alias("_n"))
    return positive.crossJoin(F.broadcast(primary)).where((F.col("_n") < least) | (F.col(p) < alpha)).drop("_n")


def valid_features(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose values are all finite and vary: n and population variance."""
    fine = V.is_finite(F.col(value))
    m = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(fine, 1)).alias("_fine"), F.var_pop(F.when(fine, F.col(value))).alias("variance"))
    return m.where("n = _fine and variance > 0").drop("_fine")


def first_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the smallest ``order`` for each of keys, combined before the shuffle; a table joined for display has each key once."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in (order, *rest)])


def group_of_prefix(subject: str, groups: dict[str, str]) -> Column:
    """Group by the first characters of an id; NULL for others."""
    out = F.lit(None).cast("string")
    for prefix, group in groups.items():
        out = F.when(F.col(subject).cast("string").startswith(prefix), group).otherwise(out)
    return out


def coverage(df: DataFrame, keys: list[str], condition: str, least: int) -> DataFrame:
    """For each condition: how many keys have trials, and how many have at least ``least``."""
    n = df.groupBy(*keys, condition).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(condition).agg(F.count(F.lit(1)).alias("n_keys"), F.count(F.when(F.col("_n") >= least, 1)).alias("n_enough"), F.sum("_n").alias("n_trials"))


def one_against_others(df: DataFrame, keys: list[str], trial: str) -> DataFrame:
    """Every trial as the target beside all trials of its keys: role is trial or others. Keys are bounded, as runs are."""
    targets = df.select(*keys, F.col(trial).alias("target"))
    j = targets.join(df, keys)
    return j.withColumn("role", F.when(F.col("target") == F.col(trial), "trial").otherwise("others"))


def event_lists(df: DataFrame, keys: list[str], order: str, *columns: str) -> DataFrame:
    """Ordered lists of onsets, durations or other columns for each key."""
    rows = F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order])))
    return df.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, *[F.col(f"_rows.{c}").alias(f"{c}s") for c in columns])


def beside_others(df: DataFrame, keys: list[str], value: str, own: str = "own", others: str = "others") -> DataFrame:
    """Each row with its value and the mean of the others within keys (NULL without others): sums of the keys less the own value, so no group is squared. NULL values count neither way."""
    x = F.col(value).cast("double")
    sums = df.groupBy(*keys).agg(F.count(x).alias("_n"), F.sum(x).alias("_s"))
    j = same(df, sums, keys)
    rest = F.try_divide(F.col("_s") - F.coalesce(x, F.lit(0.0)), (F.col("_n") - x.isNotNull().cast("int")).cast("double"))
    return j.withColumn(own, x).withColumn(others, rest).drop("_n", "_s")


def in_range(df: DataFrame, number: str, limits: tuple[int, int] | None = None) -> DataFrame:
    """Rows whose number (a trial's or a contrast's) is in a range, both ends included; all rows without a range. NULL is in none."""
    return df if limits is None else df.where(F.col(number).between(*limits))
