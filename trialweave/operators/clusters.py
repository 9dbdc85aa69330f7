"""Cluster-mass inference on voxel maps by sign flips of subjects: t-maps by aggregation and clusters by joins of touching voxels, or both in blocks of space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.operators import blocks
from trialweave.operators.lineage import cut
from trialweave.operators.permutation import PER_DIGEST, draw_key, n_beyond


def draw_sums(maps: DataFrame, n_perm: int = 5000, subject: str = "subject", feature: str = "feature_id", value: str = "value") -> DataFrame:
    """_block of draws, feature, _n, _square (of squares) and _sums under the random signs of 32 draws; none under three values. Block 0 is as observed.

    A row is read once for every 32 draws, whose sums are columns of one aggregation; squares do not depend on signs.
    """
    blocks = (n_perm + PER_DIGEST - 1) // PER_DIGEST
    x = F.col(value).cast("double")
    drawn = maps.where(x.isNotNull()).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks)))).withColumn("_x", x)
    # the first eight digits of the md5 are 32 bits, a sign each
    bits = F.conv(F.substring(draw_key("_block", subject), 1, 8), 16, 10).cast("bigint")
    drawn = drawn.withColumn("_bits", F.when(F.col("_block") == 0, F.lit(0).cast("bigint")).otherwise(bits))  # block 0 has one draw, as observed
    signs = [F.when(F.col("_bits").bitwiseAND(F.lit(1 << d)) == 0, F.col("_x")).otherwise(-F.col("_x")) for d in range(PER_DIGEST)]
    return drawn.groupBy("_block", feature).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum(F.col("_x") * F.col("_x")).alias("_square"), F.array(*[F.sum(s) for s in signs]).alias("_sums")).where("_n >= 3")


def t_maps(maps: DataFrame, n_perm: int = 5000, subject: str = "subject", feature: str = "feature_id", value: str = "value") -> DataFrame:
    """perm_id (0 is as observed), feature and t against 0 under random signs of subjects; none under three values or without spread."""
    sums = draw_sums(maps, n_perm, subject, feature, value)
    each = sums.select("_block", feature, "_n", "_square", F.posexplode(F.when(F.col("_block") == 0, F.slice("_sums", 1, 1)).otherwise(F.col("_sums"))).alias("_d", "_s"))
    perm = F.when(F.col("_block") == 0, 0).otherwise((F.col("_block") - 1) * PER_DIGEST + F.col("_d") + 1).cast("int")
    var = (F.col("_square") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_n") - 1)
    t = F.when(var > 1e-12, F.col("_s") / F.col("_n") / F.sqrt(var / F.col("_n")))
    return each.select(perm.alias("perm_id"), feature, t.alias("t")).where(F.col("t").isNotNull() & (F.col("perm_id") <= n_perm))


def masses(tmaps: DataFrame, grid: DataFrame, limit: float = 2.3, feature: str = "feature_id") -> DataFrame:
    """perm_id, feature, mass for voxels with abs(t) over the limit: the sum of abs(t) - limit over the cluster of voxels on the same side that touch by face, edge or corner.

    Each voxel takes the smallest label of its neighbours, and then its label's label, until none
    changes; every round is written to the shared folder.
    """
    key = ["perm_id", "_side"]
    over = tmaps.where(F.abs("t") > limit).join(grid.select(feature, "i", "j", "k"), feature)
    over = cut(over.select("perm_id", F.signum("t").cast("int").alias("_side"), F.col(feature).alias("_a"), "i", "j", "k", (F.abs("t") - limit).alias("_over")))
    moves = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("xyz", m, strict=True)]) for m in np.ndindex(3, 3, 3) if m != (1, 1, 1)])
    places = [(F.col(c) + F.col(f"_m.{m}") - 1).alias(c) for c, m in zip("ijk", "xyz", strict=True)]
    moved = over.select(*key, "_a", "i", "j", "k", F.explode(moves).alias("_m")).select(*key, "_a", *places)
    links = cut(moved.join(over.select(*key, F.col("_a").alias("_b"), "i", "j", "k"), [*key, "i", "j", "k"]).select(*key, "_a", "_b"))
    label = over.select(*key, "_a", F.col("_a").alias("_label"))
    while True:
        near = links.join(label.select(*key, F.col("_a").alias("_b"), F.col("_label").alias("_l")), [*key, "_b"]).groupBy(*key, "_a").agg(F.min("_l").alias("_l"))
        least = label.join(near, [*key, "_a"], "left").select(*key, "_a", F.col("_label").alias("_was"), F.least("_label", "_l").alias("_label"))
        up = least.select(*key, F.col("_a").alias("_label"), F.col("_label").alias("_up"))
        label = cut(least.join(up, [*key, "_label"]).select(*key, "_a", "_was", F.col("_up").alias("_label")))
        if label.where("_label <> _was").isEmpty():
            break
        label = label.drop("_was")
    labelled = over.join(label, [*key, "_a"])
    total = labelled.groupBy(*key, "_label").agg(F.sum("_over").alias("mass"))
    return labelled.join(total, [*key, "_label"]).select("perm_id", F.col("_a").alias(feature), "mass")


#: Rows that blocks send on: the largest mass of a draw's clusters inside (0), clusters at a face (1), voxels of these at faces (2), observed voxels (3).
_SENT = "kind int, perm_id int, side int, cluster bigint, voxel bigint, mass double"
_JOINED = "perm_id int, side int, cluster bigint, mass double"
_TYPES = {"kind": pa.int32(), "perm_id": pa.int32(), "side": pa.int32(), "cluster": pa.int64(), "voxel": pa.int64(), "mass": pa.float64()}


def _clusters_of_block(layout: blocks.Layout, n_perm: int, limit: float):
    def send(key: tuple, table: pa.Table) -> pa.Table:
        block = blocks.Block(table)
        half, codes, face = blocks.neighbours(block.ijk)[:, :13], blocks.code(block.ijk), layout.inner_faces(block.ijk)
        out: list[tuple] = []
        for md5 in layout.draws(key[3].as_py(), n_perm):
            perm, t = block.t(md5, n_perm)
            with np.errstate(invalid="ignore"):
                d, v = np.nonzero(np.abs(t) > limit)
            sign = np.sign(t[d, v]).astype(int)
            number = np.full((len(perm), len(codes) + 1), -1, np.int64)
            number[d, v] = np.arange(len(d))
            there = number[d[:, None], half[v]]
            a, m = np.nonzero((there >= 0) & (sign[there] == sign[:, None]))
            label = blocks.connected(len(d), a, there[a, m])
            mass = np.bincount(label, np.abs(t[d, v]) - limit, len(d))
            open_ = np.zeros(len(d), bool)
            open_[label[face[v]]] = True
            whole = np.zeros(len(perm))
            np.maximum.at(whole, d, np.where(open_, 0.0, mass))
            has = np.flatnonzero((whole > 0) & (perm > 0))
            out.append((0, perm[has], 0, -1, -1, whole[has]))
            root = np.flatnonzero(open_ & (label == np.arange(len(d))))
            out.append((1, perm[d[root]], sign[root], codes[v[root]], -1, mass[root]))
            at = np.flatnonzero(face[v])
            out.append((2, perm[d[at]], sign[at], codes[v[label[at]]], codes[v[at]], 0.0))
            if md5 == 0:
                side, cluster, own = np.zeros(len(codes), int), np.full(len(codes), -1), np.zeros(len(codes))
                side[v], cluster[v], own[v] = sign, np.where(open_[label], codes[v[label]], -1), np.where(open_[label], 0.0, mass[label])
                seen = np.flatnonzero(~np.isnan(t[0]))
                out.append((3, np.zeros(len(seen), int), side[seen], cluster[seen], block.ids[seen], own[seen]))
        columns = [np.concatenate([np.broadcast_to(x, len(part[1])) for x, part in zip(c, out, strict=True)]) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * len(_TYPES)
        return pa.table({name: pa.array(x, kind) for x, (name, kind) in zip(columns, _TYPES.items(), strict=True)})

    return send


def _join_clusters(key: tuple, table: pa.Table) -> pa.Table:
    """Masses of the clusters of one draw and side that go on beyond faces; a row for each cluster of a block."""
    kind, cluster, voxel = (table[c].to_numpy() for c in ("kind", "cluster", "voxel"))
    names, mass = cluster[kind == 1], table["mass"].to_numpy()[kind == 1]
    order = np.argsort(names)
    names, mass = names[order], mass[order]
    order = np.argsort(voxel[kind == 2])
    codes, of = voxel[kind == 2][order], np.searchsorted(names, cluster[kind == 2][order])
    a, b = [], []
    for m in blocks.MOVES[:13]:
        there = blocks.code(blocks.place(codes) + np.array(m) - 1)
        k = np.minimum(np.searchsorted(codes, there), len(codes) - 1)
        hit = np.flatnonzero(codes[k] == there)
        a.append(of[hit])
        b.append(of[k[hit]])
    label = blocks.connected(len(names), np.concatenate(a), np.concatenate(b))
    return pa.table({"perm_id": pa.array(np.full(len(names), key[0].as_py()), pa.int32()), "side": pa.array(np.full(len(names), key[1].as_py()), pa.int32()), "cluster": pa.array(names, pa.int64()), "mass": pa.array(np.bincount(label, mass, len(names))[label], pa.float64())})


def family_wise(maps: DataFrame, grid: DataFrame, n_perm: int = 5000, limit: float = 2.3, subject: str = "subject", feature: str = "feature_id", value: str = "value", side: int = blocks.SIDE) -> DataFrame:
    """For a long map of subjects: feature, statistic (its cluster's mass, 0 outside clusters) and p = (number of draws whose largest mass is at least it + 1) / (n + 1).

    As by :func:`masses` of :func:`t_maps`, but a task works out the draws of one block of space
    and sends on what touches other blocks only; a task of a draw joins these.
    """
    rows, layout = blocks.dealt(*blocks.packed(maps, grid, subject, feature, value, side), n_perm)
    sent = cut(rows.groupBy(*blocks.KEYS).applyInArrow(_clusters_of_block(layout, n_perm, limit), _SENT))
    joined = cut(sent.where("kind in (1, 2)").groupBy("perm_id", "side").applyInArrow(_join_clusters, _JOINED))
    every = sent.where("kind = 0").select("perm_id", "mass").union(joined.where("perm_id > 0").select("perm_id", "mass"))
    null = every.groupBy("perm_id").agg(F.round(F.max("mass"), 9).alias("_most")).agg(F.sort_array(F.collect_list("_most")).alias("_null"))  # n_perm numbers
    beyond_faces = joined.where("perm_id = 0").select("side", "cluster", F.col("mass").alias("_joined"))
    observed = sent.where("kind = 3").join(beyond_faces, ["side", "cluster"], "left").withColumn("mass", F.coalesce("_joined", "mass")).crossJoin(F.broadcast(null))
    beyond = F.when(F.col("side") == 0, n_perm).otherwise(n_beyond("_null", F.round("mass", 9), n_perm))
    return observed.select(F.col("voxel").cast(dict(grid.dtypes)[feature]).alias(feature), F.col("mass").alias("statistic"), ((beyond + 1) / F.lit(float(n_perm + 1))).alias("p"))
