"""Threshold-free enhancement of many t-maps by their components, in blocks of space.

Levels fall for many draws at once: a step joins all that touch at this level, and a component
keeps its size and its best score so far, which give a draw's largest value. The map as
observed needs every voxel's value, so it also keeps what was joined to what, a tree.

A task holds one block of space and works out some of its draws. Where the grid has several
blocks, a component can go on beyond a face, so each block sends what its neighbours need to
know: for voxels at its inner faces, by level, how many voxels hang on them, the largest
score that one of these has before it gets there, and the level from which on two of them are
connected within the block. A task of some draws joins these faces (surfaces, never whole
maps), which gives each draw's largest value. For the map as observed it answers with what
each face voxel gains up to every level; the block joins its voxels again and adds its own
heights above that.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.operators import blocks
from trialweave.operators.blocks import MOVES, SIDE, neighbours
from trialweave.operators.lineage import cut
from trialweave.operators.permutation import n_beyond

#: Places of the draws whose levels fall side by side, of one draw at least; draws whose faces one call joins, shared by the blocks.
TASK_PLACES = 1 << 18
FACE_DRAWS = 32
#: Tasks to which few blocks are dealt: draws cost more time than rows do disk.
TASKS = 24
#: Distance of heights, and the powers of extent and height.
STEP, EXTENT, HEIGHT = 0.1, 0.5, 2.0
_FACES = "perm_id int, side int, _bi int, _bj int, _bk int, best double, body binary"
_GAINS = "perm_id int, side int, voxel bigint, gains array<double>"


def gains(levels: int, step: float = STEP, power: float = HEIGHT) -> np.ndarray:
    """height ** power * step of the heights step, 2 step and so on."""
    return np.arange(step, step * (levels + 0.5), step) ** power * step


def levels_of(x: np.ndarray, step: float = STEP) -> np.ndarray:
    """How many of the heights step, 2 step and so on each value reaches."""
    most = max(float(x.max(initial=0.0)), 0.0)
    return np.searchsorted(np.arange(step, most + 2 * step, step), x, "right").astype(np.int32)


def touching(level: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two nodes and the level from which on both are there, for places that touch in boxes of ``shape`` with an empty rim, one after another.

    Places that a third one joins at that level or above by a shorter way are left out: a move
    along two or three axes is needed only where all between its ends is lower.
    """
    unit = np.array([shape[1] * shape[2], shape[2], 1])
    rim = int(unit.sum())
    there = lambda m: level[rim + int(unit @ m) : len(level) - rim + int(unit @ m)]
    here, found = there((0, 0, 0)), []
    for m in (tuple(x - 1 for x in m) for m in MOVES[13:]):
        between = [c for c in product(*[{0, x} for x in m]) if any(c) and c != m]
        both = np.minimum(here, there(m))
        a = np.flatnonzero(both > reduce(np.maximum, map(there, between)) if between else both)
        found.append((a + rim, a + rim + int(unit @ m), both[a]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class Falling:
    """Components of nodes as levels fall: a node is there from ``last`` on, and the links ``a`` to ``b`` from ``at`` on.

    ``size`` and ``best`` are the nodes' own at first; at the end roots have the size of their
    component, and its best score above the level ``last``. A component that has a node of
    ``open_`` is open: ``rows`` tell what hangs on one (node, -1, level, size, best), and
    which two are connected (node, other, level, 0, 0). With ``keep`` every node's score can be asked.
    """

    def __init__(self, last: np.ndarray, size: np.ndarray, best: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray, open_: np.ndarray | None = None, keep: bool = False) -> None:
        self.last, self.size, self.best = last, size, best
        self.up, self.rep, self._seen = np.arange(len(last)), None, np.empty(len(last), np.int64)
        self.upto = np.concatenate([[0.0], np.cumsum(gains(int(last.max(initial=0))))])
        self.rows: list[tuple] = []
        self.joined: list[tuple] | None = [] if keep else None
        self.own = np.zeros(len(last))  # what the members of each root gained
        if open_ is not None:
            self.rep = np.full(len(last), -1)
            self.rep[open_] = open_
            self._send(open_, -1, last[open_], 1, 0.0)
            if keep:
                self.joined.append((open_, None, self.own[open_], open_, last[open_]))
        order = np.argsort(at, kind="stable")
        a, b, count = a[order], b[order], np.bincount(at)
        end = np.cumsum(count)
        for h in np.flatnonzero(count)[::-1].tolist():
            if h:
                here = slice(end[h] - count[h], end[h])
                self._fall(h, a[here], b[here])

    def _once(self, x: np.ndarray) -> np.ndarray:
        k = np.arange(len(x))
        self._seen[x] = k
        return x[self._seen[x] == k]

    def _root(self, x: np.ndarray) -> np.ndarray:
        root = self.up[x]
        while not np.array_equal(further := self.up[root], root):
            root = further
        self.up[x] = root
        return root

    def _shorten(self, x: np.ndarray) -> None:
        """Lets each of some nodes, with all that were joined to a root since, point at its root."""
        while not np.array_equal(root := self.up[self.up[x]], self.up[x]):
            self.up[x] = root

    def _fall(self, h: int, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self._root(a), self._root(b)
        joined = []
        while len(apart := np.flatnonzero(x != y)):
            x, y = x[apart], y[apart]
            high = np.maximum(x, y)
            self.up[high] = np.minimum(x, y)  # of several for one root any will do, the others come again
            self._shorten(high)
            joined.append(high)
            x, y = self.up[x], self.up[y]
        if not joined:
            return
        gone = self._once(np.concatenate(joined))
        self._shorten(gone)
        to = self.up[gone]
        root = self._once(to)
        for k in (gone, root):
            more = np.sqrt(self.size[k]) * (self.upto[self.last[k]] - self.upto[h])
            self.best[k] += more
            self.last[k] = h
            if self.joined is not None:
                self.own[k] += more
        if self.rep is not None:
            self._open(h, np.concatenate([gone, root]), np.concatenate([to, root]), root)
        if self.joined is not None:
            closed = np.arange(len(to)) if self.rep is None else np.flatnonzero(self.rep[to] < 0)
            self.joined.append((gone[closed], to[closed], self.own[gone[closed]] - self.own[to[closed]]))
        np.add.at(self.size, to, self.size[gone])
        np.maximum.at(self.best, to, self.best[gone])

    def _open(self, h: int, part: np.ndarray, to: np.ndarray, root: np.ndarray) -> None:
        own = self.rep[part]
        np.maximum.at(self.rep, to, own)
        rep = self.rep[to]
        linked = np.flatnonzero((own >= 0) & (own != rep))
        self._send(own[linked], rep[linked], h, 0, 0.0)
        hangs = (own < 0) & (rep >= 0)
        if hangs.any():
            place = self._seen  # of each root among the roots
            place[root] = np.arange(len(root))
            at, part = place[to[hangs]], part[hangs]
            if self.joined is not None:
                self.joined.append((part, None, self.own[part], rep[hangs], np.full(len(part), h)))
            n, best = np.bincount(at, self.size[part], len(root)), np.zeros(len(root))
            np.maximum.at(best, at, self.best[part])
            has = np.flatnonzero(n)
            self._send(self.rep[root[has]], -1, h, n[has], best[has])

    def _send(self, node: np.ndarray, *rest) -> None:
        self.rows.append(tuple(np.broadcast_to(c, len(node)) for c in (node, *rest)))

    def scores(self) -> np.ndarray:
        """The largest score of each closed component, at its root; 0 elsewhere."""
        root = (self.up == np.arange(len(self.up))) & (self.last > 0)
        if self.rep is not None:
            root &= self.rep < 0
        return np.where(root, self.best + np.sqrt(self.size) * self.upto[self.last], 0.0)

    def every(self, gained: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """The score of each node; ``gained`` says what hangs on an open node from a level on gets there."""
        out = self.own + np.sqrt(self.size) * self.upto[self.last]  # holds for roots of closed components
        for node, to, more, *hung in reversed(self.joined):
            out[node] = more + (gained(*hung) if to is None else out[to])
        return out


class Trees:
    """One side of maps [draws, voxels] whole: each voxel is linked with its neighbours that are there before it."""

    def __init__(self, x: np.ndarray, near: np.ndarray, face: np.ndarray | None = None) -> None:
        self.level, n = levels_of(x), x.shape[1]
        other = np.pad(x, ((0, 0), (0, 1)), constant_values=np.nan)[:, near]
        before = (other > x[:, :, None]) | ((other == x[:, :, None]) & (near < np.arange(n)[:, None]))
        draw, v, m = np.nonzero(before & (self.level > 0)[:, :, None])
        self.links = draw * n + near[v, m], draw * n + v, self.level[draw, v]
        self.open_ = None if face is None else np.flatnonzero((self.level > 0) & face)

    def scores(self, gained: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        last = self.level.astype(np.int64).ravel()
        fallen = Falling(last, np.ones(len(last)), np.zeros(len(last)), *self.links, self.open_, keep=True)
        return fallen.every(gained).reshape(self.level.shape)


def _packed(voxel: np.ndarray, other: np.ndarray, level: np.ndarray, n: np.ndarray, best: np.ndarray) -> bytes:
    """Rows of the faces of a block, in the order of their voxels, a column after the other."""
    order = np.argsort(voxel, kind="stable")
    near = np.where(other[order] < 0, -1, other[order])
    columns = [np.diff(voxel[order], prepend=0).astype(np.int32), near.astype(np.int32), level[order].astype(np.int32), n[order].astype(np.int32), best[order].astype(np.float64)]
    return zlib.compress(b"".join(c.tobytes() for c in columns), 1)


def _unpacked(body: bytes) -> list[np.ndarray]:
    raw = zlib.decompress(body)
    n = len(raw) // 24
    voxel, other, level, count = np.frombuffer(raw, np.int32, 4 * n).reshape(4, n).astype(np.int64)
    return [np.cumsum(voxel), other, level, count, np.frombuffer(raw, np.float64, n, 16 * n)]


def _nodes(ijk: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, int, np.ndarray]:
    """Number of each voxel in a box with an empty rim, how many there are, and the voxels at places of others, which come after the box."""
    node, n = np.ravel_multi_index(tuple(ijk.T), shape), int(np.prod(shape))
    holds = np.empty(n, np.int64)
    holds[node] = np.arange(len(node))
    twins = np.flatnonzero(holds[node] != np.arange(len(node)))
    node[twins] = n + np.arange(len(twins))
    return node, n + len(twins), twins


def _links(boxes: np.ndarray, shape: tuple[int, ...], node: np.ndarray, twins: np.ndarray, near: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
    """:func:`touching` of the nodes of some draws; a voxel at the place of another is linked with what is there before it, as in :class:`Trees`."""
    if not len(twins):
        return touching(boxes.ravel(), shape)
    alone, level, n = boxes.copy(), boxes[:, node[twins]], boxes.shape[1]
    alone[:, node[twins]] = 0
    own, other = t[:, twins, None], np.pad(t, ((0, 0), (0, 1)), constant_values=np.nan)[:, near]
    before = (other > own) | ((other == own) & (near < twins[:, None]))
    draw, k, m = np.nonzero(before & (level > 0)[:, :, None])
    linked = draw * n + node[near[k, m]], draw * n + node[twins[k]], level[draw, k]
    return tuple(np.concatenate(c) for c in zip(touching(alone.ravel(), shape), linked, strict=True))


def _send_faces(layout: blocks.Layout, n_perm: int):
    """Largest scores inside and faces of the draws from 1 on, or of the map as observed where there are none."""
    side = np.array(layout.side)

    def send(key: tuple, table: pa.Table) -> pa.Table:
        block = blocks.Block(table)
        low = block.ijk.min(0) - 1
        shape = tuple(int(x) for x in block.ijk.max(0) - low + 2)
        node, n, twins = _nodes(block.ijk - low, shape)
        local, space = np.empty(n, np.int64), [k.as_py() for k in key[:3]]
        local[node] = np.ravel_multi_index(tuple((block.ijk % side).T), tuple(side))
        face = node[layout.inner_faces(block.ijk)]
        near = neighbours(block.ijk)[twins] if len(twins) else None
        together = max(1, TASK_PLACES // n)
        rows: list[tuple] = []
        for md5 in layout.draws(key[3].as_py(), n_perm):
            if n_perm and not md5:
                continue
            numbers, every = block.t(md5, n_perm)
            for k in range(0, len(every), together):
                perm, t = numbers[k : k + together].tolist(), every[k : k + together]
                level = levels_of(np.nan_to_num(np.abs(t)))
                level = level.astype(np.uint8 if level.max(initial=0) < 256 else np.int32)
                most = np.zeros(len(perm))
                for sign in (1, -1):
                    boxes = np.zeros((len(perm), n), level.dtype)
                    boxes[:, node] = np.where(sign * t > 0, level, 0)
                    last = boxes.astype(np.int64).ravel()
                    links = _links(boxes, shape, node, twins, near, sign * t)
                    open_ = (np.arange(len(perm))[:, None] * n + face).ravel()
                    open_ = open_[last[open_] > 0] if len(face) else None
                    fallen = Falling(last, np.ones(len(last)), np.zeros(len(last)), *links, open_)
                    most = np.maximum(most, fallen.scores().reshape(-1, n).max(1))
                    if open_ is None:
                        continue
                    own, other, *rest = (np.concatenate(c) for c in zip(*fallen.rows, strict=True))
                    draw = own // n
                    order = np.argsort(draw, kind="stable")
                    columns = [c[order] for c in (local[own % n], np.where(other < 0, -1, local[other % n]), *rest)]
                    ends = np.searchsorted(draw[order], np.arange(len(perm) + 1))
                    rows += [(p, sign, *space, None, _packed(*[c[a:b] for c in columns])) for p, a, b in zip(perm, ends[:-1], ends[1:], strict=True) if b > a]
                rows += [(p, 0, *space, m, None) for p, m in zip(perm, most.tolist(), strict=True)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary())
        names = [c.split()[0] for c in _FACES.split(", ")]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.table({name: pa.array(list(c), kind) for name, c, kind in zip(names, columns, kinds, strict=True)})

    return send


def _across(code: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of two face voxels (codes in order) that touch and are in different blocks."""
    a, b, ijk = [], [], blocks.place(code)
    for m in MOVES[:13]:
        there = ijk + np.array(m) - 1
        key = blocks.code(there)
        k = np.minimum(np.searchsorted(code, key), len(code) - 1)
        hit = np.flatnonzero((code[k] == key) & (ijk // side != there // side).any(1))
        a.append(hit)
        b.append(k[hit])
    return np.concatenate(a), np.concatenate(b)


def joined(voxel: np.ndarray, other: np.ndarray, level: np.ndarray, n: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Face voxels of all blocks of one map, and what each gains up to every level [voxels, levels].

    Rows with another voxel say from which level on both are connected within a block; the others how many voxels hang on one.
    """
    single = other < 0
    code = np.unique(voxel[single])
    top = np.zeros(len(code), np.int64)
    np.maximum.at(top, np.searchsorted(code, voxel[single]), level[single])
    x, y = _across(code, side)
    a = np.concatenate([np.searchsorted(code, voxel[~single]), x])
    b = np.concatenate([np.searchsorted(code, other[~single]), y])
    at = np.concatenate([level[~single], np.minimum(top[x], top[y])])
    label, size, levels = np.arange(len(code)), np.zeros(len(code)), int(top.max(initial=0))
    extent = np.zeros((len(code), levels))
    hung, hung_at, hung_n = np.searchsorted(code, voxel[single]), level[single], n[single]
    for h in range(levels, 0, -1):
        new = hung_at == h
        np.add.at(size, label[hung[new]], hung_n[new])
        up = blocks.connected(len(code), label[a[at == h]], label[b[at == h]])
        label = up[label]
        size = np.bincount(up, size, len(code))
        extent[:, h - 1] = np.where(top >= h, size[label], 0)
    return code, np.cumsum(extent**EXTENT * gains(levels), 1)


def largest_joined(draw: np.ndarray, voxel: np.ndarray, other: np.ndarray, level: np.ndarray, n: np.ndarray, best: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The largest score of what hangs on face voxels, for draws numbered from 0."""
    single = other < 0
    code = np.unique(voxel[single])
    place = draw * len(code) + np.searchsorted(code, voxel)
    draws = int(draw.max()) + 1
    hung, hung_at = place[single], level[single]
    last = np.zeros(draws * len(code), np.int64)
    np.maximum.at(last, hung, hung_at)
    x, y = (((np.arange(draws) * len(code))[:, None] + c).ravel() for c in _across(code, side))
    across = np.minimum(last[x], last[y])
    # what hangs on a voxel is a node of its own, linked at its level
    a = np.concatenate([place[~single], x, hung])
    b = np.concatenate([draw[~single] * len(code) + np.searchsorted(code, other[~single]), y, len(last) + np.arange(len(hung))])
    at = np.concatenate([level[~single], across, hung_at])
    none = np.zeros(len(last))
    fallen = Falling(np.concatenate([last, hung_at]), np.concatenate([none, n[single]]), np.concatenate([none, best[single]]), a, b, at)
    return fallen.scores()[: len(last)].reshape(draws, len(code)).max(1)


def _faces_of(table: pa.Table, side: np.ndarray) -> list[np.ndarray]:
    """Rows of the faces of all blocks: number of the row of the table, and the rows with the places of their voxels as numbers."""
    out = []
    for k, (*space, body) in enumerate(zip(*[table[c].to_pylist() for c in ("_bi", "_bj", "_bk", "body")], strict=True)):
        voxel, other, *rest = _unpacked(body)
        placed = lambda at: blocks.code(np.array(space) * side + np.stack(np.unravel_index(at, tuple(side)), 1))  # noqa: B023, E731
        out.append((np.full(len(voxel), k), placed(voxel), np.where(other < 0, -1, placed(np.maximum(other, 0))), *rest))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _largest(side: tuple[int, int, int]):
    def largest(_key: tuple, table: pa.Table) -> pa.Table:
        row, *faces = _faces_of(table, np.array(side))
        perm, which = table["perm_id"].to_numpy(), table["side"].to_numpy()
        maps, number = np.unique(np.stack([perm, which], 1), axis=0, return_inverse=True)
        best = largest_joined(number.ravel()[row], *faces, np.array(side))
        return pa.table({"perm_id": pa.array(maps[:, 0], pa.int32()), "best": pa.array(best, pa.float64())})

    return largest


def _join_faces(side: tuple[int, int, int]):
    def join(key: tuple, table: pa.Table) -> pa.Table:
        code, gained = joined(*_faces_of(table, np.array(side))[1:5], np.array(side))
        return pa.table({"perm_id": pa.array([key[0].as_py()] * len(code), pa.int32()), "side": pa.array([key[1].as_py()] * len(code), pa.int32()), "voxel": pa.array(code, pa.int64()), "gains": pa.array(list(gained), pa.list_(pa.float64()))})

    return join


def _enhance(layout: blocks.Layout):
    """Enhanced values of the voxels of a block as observed, with the answers to its faces."""

    def enhance(_key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        made = {"_feature": pa.int64(), "statistic": pa.float64()}
        if not len(table):
            return pa.table({c: pa.array([], kind) for c, kind in made.items()})
        block = blocks.Block(table)
        _, t = block.t(0, 0)
        near, codes, face, out = neighbours(block.ijk), blocks.code(block.ijk), layout.inner_faces(block.ijk), np.zeros(len(block.ids))
        for sign in (1, -1):
            mine = answers.filter(pc.equal(answers["side"], sign))
            lists, voxel = mine["gains"].combine_chunks(), mine["voxel"].to_numpy()
            lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
            begin, flat, order = lists.offsets.to_numpy(), lists.values.to_numpy(), np.argsort(voxel)
            at = lambda rep: order[np.searchsorted(voxel[order], codes[rep])]  # noqa: B023, E731
            out += Trees(np.nan_to_num(sign * t, nan=-1.0), near, face).scores(lambda rep, level: flat[begin[at(rep)] + level - 1])[0]  # noqa: B023
        own = np.flatnonzero(~np.isnan(t[0]))
        return pa.table({"_feature": pa.array(block.ids[own], pa.int64()), "statistic": pa.array(out[own], pa.float64())})

    return enhance


def enhanced(maps: DataFrame, grid: DataFrame, n_perm: int, subject: str = "subject", feature: str = "feature_id", value: str = "value", side: int = SIDE) -> DataFrame:
    """perm_id, feature, statistic: of draw 0 (as observed) the enhanced value of every voxel that has a t; of the others the largest of each block and of what goes on beyond faces, without feature."""
    space = blocks.KEYS[:3]
    packed, whole = blocks.packed(maps, grid, subject, feature, value, side)
    rows, layout = blocks.dealt(packed, whole, 0)
    faces = rows.groupBy(*blocks.KEYS).applyInArrow(_send_faces(layout, 0), _FACES).where("body is not null")
    gained = faces.groupBy("perm_id", "side").applyInArrow(_join_faces(layout.side), _GAINS)
    axes = [F.floor(((F.shiftright("voxel", 40 - 20 * k)).bitwiseAND(0xFFFFF) - (1 << 19)) / n).cast("int").alias(name) for k, (name, n) in enumerate(zip(space, layout.side, strict=True))]
    answers = gained.select("side", "voxel", "gains", *axes)
    enhance = _enhance(layout)
    observed = rows.groupBy(*space).cogroup(answers.groupBy(*space)).applyInArrow(lambda key, table, found: enhance(key, table, found), "_feature bigint, statistic double")
    out = observed.select(F.lit(0).alias("perm_id"), F.col("_feature").alias(feature), "statistic")
    if not n_perm:
        return out
    rows, layout = blocks.dealt(packed, whole, n_perm, TASKS)
    sent = cut(rows.groupBy(*blocks.KEYS).applyInArrow(_send_faces(layout, n_perm), _FACES))
    share = max(1, FACE_DRAWS // layout.blocks)
    beyond = sent.where("body is not null").groupBy(F.floor(F.col("perm_id") / share).alias("_share")).applyInArrow(_largest(layout.side), "perm_id int, best double")
    draws = sent.where("body is null").select("perm_id", "best").union(beyond)
    return out.union(draws.select("perm_id", F.lit(-1).cast("bigint"), F.col("best")))


def family_wise(maps: DataFrame, grid: DataFrame, n_perm: int = 5000, feature: str = "feature_id", side: int = SIDE) -> DataFrame:
    """For a long map of subjects: feature, enhanced statistic, and p = (number of draws whose largest is at least it + 1) / (n + 1)."""
    e = cut(enhanced(maps, grid, n_perm, feature=feature, side=side))
    null = e.where("perm_id > 0").groupBy("perm_id").agg(F.round(F.max("statistic"), 9).alias("_most")).agg(F.sort_array(F.collect_list("_most")).alias("_null"))  # n_perm numbers
    observed = e.where("perm_id = 0").crossJoin(F.broadcast(null))
    beyond = n_beyond("_null", F.round("statistic", 9), n_perm)
    return observed.select(feature, "statistic", ((beyond + 1) / F.lit(float(n_perm + 1))).alias("p"))
