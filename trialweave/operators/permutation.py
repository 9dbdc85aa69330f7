"""Permutation nulls from keyed hashes: the same draw on any cluster, and in any engine that has md5.

Permutation k orders subjects by the md5 of "k-subject"; the subject at rank r gets the
label of the subject whose rank in permutation 0 is r. Signs follow from the 32 digits of one md5, so a row
is read once for 32 draws; two groups are drawn by
numbers that tasks work out, all draws at once; other labels become bits of 64 draws for each subject. Only counts and moments of the null are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.operators.lineage import PACKED, cut, packed_rows, packed_sums
from trialweave.operators.ordered import digest_rank, same

#: Draws of signs that one md5 gives, one for each hex digit.
PER_DIGEST = 32
#: Draws of two groups that one md5 serves, with 32 bits each, and bytes of sums that a task holds.
PER_KEY, HELD_SUMS = 4, 64 << 20
#: Draws of shuffled labels in one task, a bit each, and subjects of an arm whose keys it holds at once.
PER_TASK, HELD_KEYS = 64, 200_000


def draw_key(perm: str, subject: str) -> Column:
    return F.md5(F.concat(F.col(perm).cast("string"), F.lit("-"), F.col(subject).cast("string")))


def n_beyond(null: str, x: Column, n_perm: int) -> Column:
    """How many values of a rising array of at most n_perm are x or more, by halving."""
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, n_perm).bit_length()))])
    below = F.aggregate(halves, F.lit(0), lambda at, more: F.when(F.get(null, at + more - 1) < x, at + more).otherwise(at))
    return F.size(null) - below


def draws(df: DataFrame, n_perm: int) -> DataFrame:
    """Each row once for every permutation, with perm_id from 1."""
    return df.withColumn("perm_id", F.explode(F.sequence(F.lit(1), F.lit(n_perm))))


def sign_flip(df: DataFrame, keys: list[str], subject: str, x: str, n_perm: int, tail: str = "two") -> DataFrame:
    """Mean against 0 by random signs of subjects: observed mean, exceedances and p = (c + 1) / (n + 1)."""
    observed = df.groupBy(*keys).agg(F.avg(x).alias("observed"), F.count(x).alias("n"))
    drawn = df.select(*keys, subject, F.col(x).alias("_x")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((n_perm - 1) // PER_DIGEST)))).withColumn("_key", draw_key("_block", subject))
    means = [F.avg(F.when(F.substring("_key", d + 1, 1) < "8", F.col("_x")).otherwise(-F.col("_x"))) for d in range(PER_DIGEST)]
    null = drawn.groupBy(*keys, "_block").agg(F.array(*means).alias("_means")).select(*keys, "_block", F.posexplode("_means").alias("_d", "_null"))
    null = null.withColumn("perm_id", F.col("_block") * PER_DIGEST + F.col("_d") + 1).where(F.col("perm_id") <= n_perm).drop("_block", "_d")
    return _exceed(null, observed, keys, n_perm, tail)


def _exceed(null: DataFrame, observed: DataFrame, keys: list[str], n_perm: int, tail: str) -> DataFrame:
    j = same(null, observed, keys) if keys else null.crossJoin(F.broadcast(observed))  # one row
    # rounding keeps ties of equal sums equal, whatever the order of addition
    a, b = F.round("_null", 9), F.round("observed", 9)
    beyond = F.abs(a) >= F.abs(b) if tail == "two" else a >= b
    c = F.sum(F.when(beyond, 1).otherwise(0))
    return j.groupBy(*keys, "observed").agg(c.alias("n_beyond"), ((c + 1) / F.lit(float(n_perm + 1))).alias("p"), F.avg("_null").alias("null_mean"), F.stddev_pop("_null").alias("null_sd"))


def relabelled(df: DataFrame, subject: str, label: str, n_perm: int, arms: list[str] | None = None) -> DataFrame:
    """perm_id, subject and permuted label, shuffled within arms; one row of ``df`` for each subject.

    Draw 0 says whose label a rank gets. Ranks go by prefixes of the md5, so no task holds an arm.
    """
    arms = arms or []
    people = df.select(*arms, subject, label)

    def place(first: int, last: int) -> DataFrame:
        drawn = people.withColumn("perm_id", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("_key", draw_key("perm_id", subject))
        return digest_rank(drawn, ["perm_id", *arms], "_key", subject, "_rank").drop("_key")

    base = place(0, 0).select(*arms, "_rank", F.col(label).alias("_label"))
    return same(place(1, n_perm).drop(label), base, [*arms, "_rank"]).select("perm_id", subject, *arms, F.col("_label").alias(label))


def member_bits(df: DataFrame, subject: str, label: str, values: list[str], n_perm: int, arms: list[str] | None = None, held: int = HELD_KEYS) -> DataFrame:
    """subject, _block, _m0, _m1 ...: bit d of a value's column says whether the subject has that label in draw 64 * _block + d + 1 of :func:`relabelled`.

    A task takes 64 draws of an arm: the arm's subjects stream by, and those whose keys lie in the
    task's range of keys (about ``held`` a draw) are ordered; of the others it keeps a count and one byte.
    """
    arms = arms or []
    spark, kind = df.sparkSession, dict(df.dtypes)[subject]
    people = df.where(F.col(subject).isNotNull()).select(*arms, subject, F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), F.col(label)), F.lit(0)).cast("tinyint").alias("_code"))
    base = cut(digest_rank(people.withColumn("_key", F.md5(F.concat(F.lit("0-"), F.col(subject).cast("string")))), arms, "_key", subject, "_rank").drop("_key"))
    most = base.groupBy(*arms).count().agg(F.max("count")).first()[0] or 0
    ranges, blocks = max(1, -(-most // held)), -(-n_perm // PER_TASK)
    own = [F.col(a).alias(f"_arm{k}") for k, a in enumerate(arms)]
    every = base.select(*own, F.col(subject).alias("_s"), F.col(subject).cast("string").alias("_t"), "_code", F.col("_rank").cast("bigint").alias("_rank"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    every = every.withColumn("_range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))
    keys = ["_block", "_range", *[f"_arm{k}" for k in range(len(arms))]]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, part = key[0].as_py(), key[1].as_py()
        draws = range(block * PER_TASK + 1, min(n_perm, (block + 1) * PER_TASK) + 1)
        names, texts, code, rank, n = [], [], [], [], 0
        below, near = np.zeros(len(draws), np.int64), [[] for _ in draws]
        for batch in batches:
            text = [t.encode() for t in batch.column("_t").to_pylist()]
            names.append(batch.column("_s"))
            texts.append(text)
            code.append(batch.column("_code").to_numpy())
            rank.append(batch.column("_rank").to_numpy())
            for d, draw in enumerate(draws):
                first = b"%d-" % draw
                number = np.frombuffer(b"".join([hashlib.md5(first + t).digest() for t in text]), ">u8")[::2].astype(np.uint64)
                place = ((number >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                below[d] += (place < part).sum()
                at = np.flatnonzero(place == part)
                near[d].append((number[at], (at + n).astype(np.int32)))
            n += len(text)
        label_at = np.zeros(n, np.int8)
        label_at[np.concatenate(rank) - 1] = np.concatenate(code)
        bits = np.zeros((len(values), n), np.uint64)
        for d, draw in enumerate(draws):
            number, at = (np.concatenate(v) for v in zip(*near[d], strict=True))
            near[d] = None
            order = np.argsort(number, kind="stable")
            if (np.diff(number[order]) == 0).any():  # equal in 64 bits: by the whole digest
                flat, ids = [t for part_of in texts for t in part_of], [x for column in names for x in column.to_pylist()]
                order = np.array(sorted(range(len(at)), key=lambda k: (hashlib.md5(b"%d-" % draw + flat[at[k]]).digest(), ids[at[k]])))
            drawn = label_at[below[d] : below[d] + len(at)]
            for v in range(len(values)):
                bits[v, at[order[drawn == v + 1]]] |= np.uint64(1 << d)
        lo = 0
        for column in names:
            part_of = bits[:, lo : lo + len(column)].view(np.int64)
            lo += len(column)
            yield pa.RecordBatch.from_arrays([column, pa.array(np.full(len(column), block), pa.int32()), *[pa.array(x, pa.int64()) for x in part_of]], names=["_s", "_block", *[f"_m{v}" for v in range(len(values))]])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = f"_s {kind}, _block int, " + ", ".join(f"_m{v} bigint" for v in range(len(values)))
    out = every.repartition(parts, *keys).groupBy(*keys).applyInArrow(run, made).withColumnRenamed("_s", subject)
    if ranges == 1:
        return out
    return out.groupBy(subject, "_block").agg(*[F.bit_or(f"_m{v}").alias(f"_m{v}") for v in range(len(values))])


def _unpacked(bits: np.ndarray) -> np.ndarray:
    """[rows, 64] of zeros and ones from rows of 64 bits, the lowest first."""
    return np.unpackbits(np.ascontiguousarray(bits, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def member_sums(rows: DataFrame, keys: list[str], x: str, n_values: int, n_perm: int) -> DataFrame:
    """keys, perm_id, and _n0, _s0, _n1 ...: count and sum of x (not null) over the members of each value, for rows beside :func:`member_bits`."""
    kinds = dict(rows.dtypes)
    at = {k: f"_k{i}" for i, k in enumerate(keys)}
    named = rows.where(F.col(x).isNotNull()).select(*[F.col(k).alias(n) for k, n in at.items()], "_block", F.col(x).cast("double").alias("_x"), *[f"_m{v}" for v in range(n_values)])
    totals = [f"{c}{v}" for v in range(n_values) for c in ("_n", "_s")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        kind = None

        def send() -> pa.RecordBatch:
            d = np.concatenate([np.arange(PER_TASK) + PER_TASK * k[-1] + 1 for k in found])
            group = [pa.array([k[i] for k in found], kind.field(c).type).take(pa.array(np.repeat(np.arange(len(found)), PER_TASK))) for i, c in enumerate(at.values())]
            whole = np.concatenate(list(found.values()), 1)
            return pa.RecordBatch.from_arrays([*group, pa.array(d, pa.int32()), *[pa.array(c, pa.float64()) for c in whole]], names=[*at.values(), "perm_id", *totals])

        for batch in batches:
            kind = kind or batch.schema
            names = [*at.values(), "_block"]
            group = pa.Table.from_batches([batch.select(names)]).append_column("_row", pa.array(np.arange(len(batch)))).group_by(names).aggregate([("_row", "list")])
            value = batch.column("_x").to_numpy()
            lists = group["_row_list"].combine_chunks()
            order, begin = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])[:-1]
            sums = []
            for v in range(n_values):
                member = _unpacked(batch.column(f"_m{v}").to_numpy()[order]).astype(np.float64)
                sums += [np.add.reduceat(member, begin, 0), np.add.reduceat(member * value[order][:, None], begin, 0)]
            for i, key in enumerate(zip(*[group[c].to_pylist() for c in names], strict=True)):
                new = np.stack([s[i] for s in sums])
                found[key] = found[key] + new if key in found else new
            if len(found) * PER_TASK * 16 * n_values > HELD_SUMS:
                yield send()
                found.clear()
        if found:
            yield send()

    made = "".join(f"{n} {kinds[k]}, " for k, n in at.items()) + "perm_id int, " + ", ".join(f"{t} double" for t in totals)
    each = named.mapInArrow(run, made).where(F.col("perm_id") <= n_perm)
    return each.groupBy(*at.values(), "perm_id").agg(*[F.sum(t).alias(t) for t in totals]).select(*[F.col(n).alias(k) for k, n in at.items()], "perm_id", *totals)


def draw_numbers(subjects: list[str], n_perm: int) -> np.ndarray:
    """[subjects, draws]: numbers of 32 bits; the md5 of "k-subject" serves the draws 4k + 1 to 4k + 4."""
    n = -(-n_perm // PER_KEY)
    digests = b"".join(hashlib.md5(f"{k}-{s}".encode()).digest() for s in subjects for k in range(n))
    return np.frombuffer(digests, ">u4").reshape(len(subjects), n * PER_KEY)[:, :n_perm]


def drawn_limits(people: DataFrame, subject: str, label: str, a: str, b: str, n_perm: int) -> tuple[np.ndarray, list]:
    """The last number, and its subject, that is in the first of two groups in each draw: the group takes the smallest numbers (ties by subject) and keeps its size.

    Counts of the upper eight bits find the range of that number; only numbers of this range are
    ordered, by draw. A number and a subject a draw reach the driver.
    """
    spread = int(people.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    two = cut(people.where(F.col(label).isin(a, b) & F.col(subject).isNotNull()).select(F.col(subject).alias("_s"), F.col(subject).cast("string").alias("_t"), F.col(label).alias("_l")).distinct().repartition(spread, "_s"))
    size = two.where(F.col("_l") == a).count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((n_perm, 256))
        for batch in batches:
            for lo in range(0, len(batch), 64):
                top = draw_numbers(batch.column("_t").slice(lo, 64).to_pylist(), n_perm) >> 24
                found += np.bincount((np.arange(n_perm) * 256 + top).ravel(), minlength=n_perm * 256).reshape(n_perm, 256)
        yield packed_rows({lo: found[lo : lo + 500].ravel() for lo in range(0, n_perm, 500)})

    counts = np.zeros((n_perm, 256))
    for lo, rows in packed_sums(two.select("_t").mapInArrow(count, PACKED)).items():
        counts[lo : lo + 500] = rows.reshape(-1, 256)
    upto = counts.cumsum(1)
    top = (upto < size).sum(1)
    place = size - np.take_along_axis(np.pad(upto, ((0, 0), (1, 0))), top[:, None], 1)[:, 0]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                number = draw_numbers(part.column("_t").to_pylist(), n_perm)
                at, d = np.nonzero((number >> 24) == top)
                yield pa.RecordBatch.from_pydict({"_d": pa.array(d, pa.int32()), "_number": pa.array(number[at, d].astype(np.int64), pa.int64()), "_place": pa.array(place[d].astype(np.int64), pa.int64()), "_s": part.column("_s").take(pa.array(at))})

    kind = dict(two.dtypes)["_s"]
    close = two.select("_s", "_t").mapInArrow(near, f"_d int, _number bigint, _place bigint, _s {kind}")
    last = close.withColumn("_row", F.row_number().over(Window.partitionBy("_d").orderBy("_number", "_s"))).where("_row = _place").select("_d", "_number", "_s").collect()
    numbers, names = np.full(n_perm, -1, np.int64), [None] * n_perm
    for r in last:
        numbers[r["_d"]], names[r["_d"]] = r["_number"], r["_s"]
    return numbers, names


def drawn_sums(df: DataFrame, keys: list[str], subject: str, x: str, limits: tuple[np.ndarray, list]) -> DataFrame:
    """keys, perm_id, _n, _s, _q: count, sum and sum of squares of x (not null) over the members of the first group in each draw.

    Tasks multiply memberships [rows, draws] by values, and their sums are added up; a task
    holds the sums of the keys it has met, up to ``HELD_SUMS``.
    """
    numbers, names = limits
    n_perm, kinds = len(numbers), dict(df.dtypes)
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*keys, F.col(subject).alias("_s"), F.col(subject).cast("string").alias("_t"), F.col(x).alias("_x")).repartition(spread, "_s")
    at = {k: f"_k{i}" for i, k in enumerate(keys)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}

        def send() -> pa.RecordBatch:
            columns = {k: pa.array([key[i] for key in found], schema.field(at[k]).type) for i, k in enumerate(keys)}
            return pa.RecordBatch.from_arrays([*columns.values(), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=[*at.values(), "body"])

        schema = None
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                schema = schema or pa.schema([pa.field(at[k], part.column(k).type) for k in keys])
                subjects, texts = part.column("_s").to_pylist(), part.column("_t").to_pylist()
                order = {t: i for i, t in enumerate(dict.fromkeys(texts))}
                number = draw_numbers(list(order), n_perm)
                member = number < numbers
                own = {t: s for t, s in zip(texts, subjects, strict=True)}
                for i, d in zip(*np.nonzero(number == numbers), strict=True):
                    member[i, d] = own[list(order)[i]] <= names[d]
                v = part.column("_x").to_numpy(zero_copy_only=False)
                value = np.stack([np.ones(len(v)), v, v * v], 1)
                of, group = np.array([order[t] for t in texts]), list(zip(*(part.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * len(part)
                for key in set(group):
                    on = np.array([g == key for g in group])
                    new = value[on].T @ member[of[on]]
                    found[key] = found[key] + new if key in found else new
                if len(found) * n_perm * 24 > HELD_SUMS:
                    yield send()
                    found.clear()
        if found:
            yield send()

    schema_of = "".join(f"{at[k]} {kinds[k]}, " for k in keys)
    sums = rows.mapInArrow(run, schema_of + "body binary")

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float64) for v in table["body"].to_pylist()).reshape(3, n_perm)
        columns = {at[k]: pa.array([table[at[k]][0].as_py()] * n_perm, table.schema.field(at[k]).type) for k in keys}
        return pa.table(columns | {"perm_id": pa.array(np.arange(1, n_perm + 1), pa.int32())} | dict(zip(("_n", "_s", "_q"), total, strict=True)))

    each = sums.groupBy(*at.values()) if keys else sums.withColumn("_all", F.lit(0)).groupBy("_all")
    out = each.applyInArrow(add, schema_of + "perm_id int, _n double, _s double, _q double")
    return out.select(*[F.col(n).alias(k) for k, n in at.items()], "perm_id", "_n", "_s", "_q")


def _compared(n: Column, s: Column, q: Column, statistic: str) -> Column:
    """Difference of two groups' means, or Student's t of it, from the first's count, sum and squares and those of both."""
    m, rest_s, rest_q = F.col("_n_all") - n, F.col("_s_all") - s, F.col("_q_all") - q
    gap = F.try_divide(s, n) - F.try_divide(rest_s, m)
    if statistic == "mean":
        return gap
    spread = (q - F.try_divide(s * s, n)) + (rest_q - F.try_divide(rest_s * rest_s, m))
    error = F.try_divide(spread, n + m - 2) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), m))
    return F.when(error > 1e-18, gap / F.sqrt(error))


def group_difference(df: DataFrame, keys: list[str], subject: str, label: str, a: str, b: str, x: str, n_perm: int, tail: str = "two", statistic: str = "mean") -> DataFrame:
    """Difference of two groups' means (``mean``) or Student's t of it (``t``) against draws of the first group from the subjects of both.

    Tasks sum counts, values and squares of all draws at once; values are taken from
    their mean first, so that squares keep their digits.
    """
    two = df.where(F.col(label).isin(a, b) & F.col(x).isNotNull()).select(*keys, subject, label, F.col(x).cast("double").alias("_x"))
    middle = two.agg(F.avg("_x").alias("_middle"))
    two = two.crossJoin(F.broadcast(middle)).withColumn("_x", F.col("_x") - F.col("_middle")).drop("_middle")
    totals = two.groupBy(*keys).agg(F.count("_x").cast("double").alias("_n_all"), F.sum("_x").alias("_s_all"), F.sum(F.col("_x") * F.col("_x")).alias("_q_all"), *[f(F.when(F.col(label) == a, v)).cast("double").alias(n) for f, v, n in ((F.count, F.col("_x"), "_n"), (F.sum, F.col("_x"), "_s"), (F.sum, F.col("_x") * F.col("_x"), "_q"))])
    observed = totals.select(*keys, "_n_all", "_s_all", "_q_all", _compared(F.col("_n"), F.col("_s"), F.col("_q"), statistic).alias("observed"))
    each = drawn_sums(two, keys, subject, "_x", drawn_limits(df, subject, label, a, b, n_perm))
    sizes = totals.select(*keys, "_n_all", "_s_all", "_q_all")
    each = same(each, sizes, keys) if keys else each.crossJoin(F.broadcast(sizes))  # one row
    null = each.select(*keys, "perm_id", _compared(F.col("_n"), F.col("_s"), F.col("_q"), statistic).alias("_null"))
    return _exceed(null, observed.select(*keys, "observed"), keys, n_perm, tail)


def interaction(df: DataFrame, keys: list[str], subject: str, label: str, a: str, b: str, arm: str, first: str, second: str, x: str, n_perm: int) -> DataFrame:
    """(a - b in the first arm) - (a - b in the second), against labels shuffled within arms."""
    cell = lambda g, d: F.avg(F.when((F.col(label) == g) & (F.col(arm) == d), F.col(x)))
    value = lambda: (cell(a, first) - cell(b, first)) - (cell(a, second) - cell(b, second))
    observed = df.groupBy(*keys).agg(value().alias("observed"))
    bits = member_bits(df.select(subject, label, arm).distinct(), subject, label, [a, b], n_perm, [arm])
    sums = member_sums(df.drop(label).hint("merge").join(bits, subject), [*keys, arm], x, 2, n_perm)
    mean = lambda v, d: F.try_divide(F.sum(F.when(F.col(arm) == d, F.col(f"_s{v}"))), F.sum(F.when(F.col(arm) == d, F.col(f"_n{v}"))))
    null = sums.groupBy(*keys, "perm_id").agg(((mean(0, first) - mean(1, first)) - (mean(0, second) - mean(1, second))).alias("_null"))
    return _exceed(null, observed, keys, n_perm, "two")


def map_similarity(maps: DataFrame, subject: str, label: str, a: str, b: str, vector: str, width: int, n_perm: int = 5000) -> DataFrame:
    """Cosine of the mean maps of two groups against shuffled groups; one row, p = 2 * min(share at or below, share at or above), at most 1."""
    from trialweave.functions import vectors as V
    from trialweave.operators.centroids import mean_vectors

    own = maps.select(subject, label, vector)
    every = relabelled(own.select(subject, label), subject, label, n_perm).unionByName(own.select(F.lit(0).alias("perm_id"), subject, label))
    m = mean_vectors(every.join(own.select(subject, vector), subject), ["perm_id", label], width, vector, "_m")
    of = lambda g: F.any_value(F.when(F.col(label) == g, F.col("_m")), True)
    c = m.groupBy("perm_id").agg(of(a).alias("_a"), of(b).alias("_b")).select("perm_id", F.round(V.cosine("_a", "_b"), 9).alias("_c"))
    seen, null = F.any_value(F.when(F.col("perm_id") == 0, F.col("_c")), True), F.collect_list(F.when(F.col("perm_id") > 0, F.col("_c")))
    one = c.agg(seen.alias("similarity"), null.alias("_null"))  # n_perm numbers
    one = one.withColumn("n_below", F.size(F.filter("_null", lambda x: x <= F.col("similarity"))).cast("bigint")).withColumn("n_above", F.size(F.filter("_null", lambda x: x >= F.col("similarity"))).cast("bigint"))
    return one.select("similarity", "n_below", "n_above", F.least(F.lit(1.0), 2.0 * F.least("n_below", "n_above") / F.lit(float(n_perm))).alias("p"), V.mean("_null").alias("null_mean"))


def within_subject_labels(df: DataFrame, subject: str, trial: str, label: str, n_perm: int) -> DataFrame:
    """perm_id, subject, trial and label, shuffled among a subject's trials."""
    base = df.select(subject, trial, label).withColumn("_rank", F.row_number().over(Window.partitionBy(subject).orderBy(trial)))
    drawn = draws(base.select(subject, trial), n_perm)
    drawn = drawn.withColumn("_rank", F.row_number().over(Window.partitionBy("perm_id", subject).orderBy(draw_key("perm_id", trial), trial)))
    return drawn.join(base.select(subject, "_rank", label), [subject, "_rank"]).select("perm_id", subject, trial, label)
