"""Near-duplicate documents: an inverted join of MinHash signatures by coordinate and value.

1. Each document becomes its set of distinct 5-word shingles (hashes) and a signature of
   ``COORDINATES`` minima. Documents with equal sets are one class; one member stands for it.
2. A class is posted under (coordinate, value) pairs. Two sets whose Jaccard likeness is
   ``percent`` in a hundred agree on at least ``matches_at(percent)`` of 64 coordinates but
   for a chance under 1e-8, so they share a pair among any ``COORDINATES - matches + 1`` of
   their own, taken in one common order. That order is by how often pairs occur, rare first (the prefix), so
   pairs that very many documents hold are posted only where a document has hardly any
   others. Any common order will do; this one is by counts in 2**18 cells, whatever the input.
3. The postings of a pair are counted exactly, by a shuffle. A pair that one class alone is
   posted under goes no further. The others get the values of their classes at all
   coordinates (the low byte of each), and collisions are counted coordinate by coordinate:
   classes that collide in at least that many are joined. A class is compared with the
   others of a list only until the list hangs together; a list skips all classes in its
   largest part. A list of more than ``LIST`` classes is dealt in blocks: each two blocks
   meet in one task.
4. The parts so found are confirmed on full shingle sets in the same way, again in blocks
   of at most about ``BLOCK`` classes and ``BLOCK_BYTES`` of sets, and the confirmed links
   give the components.

No step emits all pairs of a group: a group of n emits at most n - 1 links for each two
blocks. Hot copies vanish with the classes (a minimum, combined before the shuffle).

Edge cases: a null or empty text, or one of white space only, has no shingles, is linked
with nothing and is its own component; fewer than five words are one shingle; rows of one
doc_id are one document, whose texts all count; a row without doc_id has a null component
and is kept; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm import words as W
from trialweave.llm.components import components
from trialweave.llm.scratch import materialize

SHINGLE = 5
COORDINATES = 64
LIST = 2048
BLOCK = 1024
BLOCK_BYTES = 16 << 20
#: Links: 100 * intersection >= percent * union.
PERCENT = 85
#: The chance to miss two sets of just that likeness stays under this.
MISS = 1e-8
_CELLS = 18

_RANDOM = np.random.default_rng(20240229)
_XOR = _RANDOM.integers(0, 1 << 32, COORDINATES, np.uint32)
_TIMES = _RANDOM.integers(0, 1 << 32, COORDINATES, np.uint32) | np.uint32(1)
_SALT = W.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64))


def matches_at(percent: int) -> int:
    """The most coordinates on which two sets of that likeness agree but for a chance under ``MISS``; 1 at least."""
    p, missed, matches = percent / 100, 0.0, 0
    while matches < COORDINATES:
        missed += comb(COORDINATES, matches) * p**matches * (1 - p) ** (COORDINATES - matches)
        if missed >= MISS:
            break
        matches += 1
    return max(matches, 1)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; lower-cases A-Z."""
    data, offsets = W.strings(column)
    found = W.words(data, offsets, W.NOT_SPACE, W.LOWER)
    five = W.windows(found.hashes, SHINGLE)
    out = []
    for a, b in zip(found.first[:-1], found.first[1:], strict=True):
        out.append(np.unique(five[a : b - SHINGLE + 1]) if b - a >= SHINGLE else W.windows(found.hashes[a:b], int(b - a))[: int(b > a)])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of every set, which may not be empty: one row a set."""
    size = np.array([len(x) for x in sets])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for j in range(COORDINATES):
        out[:, j] = np.minimum.reduceat((low ^ _XOR[j]) * _TIMES[j], begin)
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two 64-bit sums that name the set, the signature and the low byte of each of its values (null without shingles)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text"):
                sets = shingle_sets(batch.column("text"))
                full = [x for x in sets if len(x)]
                minima = iter(signatures(full)) if full else iter(())
                held = [next(minima) if len(x) else None for x in sets]
                sums = np.array([[W.mix(x + np.uint64(k)).sum(dtype=np.uint64) for k in (1, 2)] for x in sets], np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "n_shingles": pa.array([len(x) for x in sets], pa.int64()),
                        "key1": sums[:, 0],
                        "key2": sums[:, 1],
                        "signature": pa.array([None if x is None else x.tobytes() for x in held], pa.binary()),
                        "values": pa.array([None if x is None else x.astype(np.uint8).tobytes() for x in held], pa.binary()),
                    }
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(measure, "doc_id bigint, n_shingles bigint, key1 bigint, key2 bigint, signature binary, values binary")


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(W.strings(column)[0], kind).reshape(-1, width)


def _pairs(minima: np.ndarray) -> np.ndarray:
    """Names of the (coordinate, value) pairs of each signature."""
    return W.mix(minima.astype(np.uint64) ^ _SALT)


def pair_counts(classes: DataFrame) -> np.ndarray:
    """How many postings fall in each of 2**18 cells; only these counts reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _CELLS, np.int64)
        for batch in batches:
            cells = _pairs(_matrix(batch.column("signature"), np.uint32, COORDINATES)) >> np.uint64(64 - _CELLS)
            total += np.bincount(cells.ravel().astype(np.int64), minlength=1 << _CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": at, "n": total[at]})

    out = np.zeros(1 << _CELLS, np.int64)
    rows = classes.select("signature").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def _post(counts, prefix: int):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for batch in batches:
            node = batch.column("node").to_numpy(zero_copy_only=False)
            names = _pairs(_matrix(batch.column("signature"), np.uint32, COORDINATES))
            held = often[names >> np.uint64(64 - _CELLS)]
            rank = (np.minimum(held, (1 << 23) - 1).astype(np.uint64) << np.uint64(40)) | (names >> np.uint64(24))
            rare = np.argpartition(rank, prefix - 1, axis=1)[:, :prefix]
            yield pa.RecordBatch.from_pydict({"name": np.take_along_axis(names, rare, 1).ravel().view(np.int64), "node": np.repeat(node, prefix)})

    return post


def postings(classes: DataFrame, prefix: int) -> DataFrame:
    """name of a (coordinate, value) pair and node, for the ``prefix`` rarest pairs of each class."""
    counts = classes.sparkSession.sparkContext.broadcast(pair_counts(classes))
    return materialize(classes.select("node", "signature").mapInArrow(_post(counts, prefix), "name bigint, node bigint"), "postings")


def lists(posted: DataFrame) -> DataFrame:
    """list, node: the postings of pairs that several classes have; of a long one, once for each two blocks that meet."""
    shared = posted.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(shared.select("name", F.ceil(F.col("n") / LIST).cast("bigint").alias("blocks")), "shared-pairs")
    held = posted.join(shared, "name")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return dealt.select(F.xxhash64("name", F.least("own", "other"), F.greatest("own", "other")).alias("list"), "node")


def spanning(n: int, linked) -> list[tuple[int, int]]:
    """Links that join what belongs together among n: ``linked(k)`` tells with which all k is linked.

    Whoever is in the largest part need not be asked, as a link between two parts has an end outside of it.
    """
    part, out, asked = np.arange(n), [], np.zeros(n, bool)
    while True:
        size = np.bincount(part, minlength=n)
        rest = np.flatnonzero((part != size.argmax()) & ~asked)
        if not len(rest):
            return out
        k = rest[0]
        asked[k] = True
        met = linked(k)
        for p in np.unique(part[met]):
            if p != part[k]:
                out.append((int(k), int(met[part[met] == p][0])))
                part[part == p] = part[k]


def _collide(matches: int):
    def collide(_key: tuple, table: pa.Table) -> pa.Table:
        names, nodes = table["list"].to_numpy(), table["node"].to_numpy()
        values = np.frombuffer(b"".join(x.as_buffer() for x in table["values"]), np.uint8).reshape(-1, COORDINATES)
        order, seen, links = np.argsort(names, kind="stable"), set(), set()
        names = names[order]
        begin = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        size = np.diff(np.concatenate([begin, [len(names)]]))
        for a, n in zip(begin[size > 1], size[size > 1], strict=True):
            own, first = np.unique(nodes[order[a : a + n]], return_index=True)
            if len(own) < 2 or (key := own.tobytes()) in seen:
                continue
            seen.add(key)
            held = values[order[a : a + n][first]]
            if len(own) == 2:
                if (held[0] == held[1]).sum() >= matches:
                    links.add((int(own[0]), int(own[1])))
                continue
            links.update((int(own[min(x, y)]), int(own[max(x, y)])) for x, y in spanning(len(own), lambda k, v=held: np.flatnonzero((v == v[k]).sum(1) >= matches)))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return collide


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in W.slices(whole, "text"):
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "component": batch.column("component"), "blocks": batch.column("blocks"), "shingles": pa.array([x.tobytes() for x in sets], pa.binary())})


def _confirm(percent: int):
    def confirm(_key: tuple, table: pa.Table) -> pa.Table:
        group, node = table["group"].to_numpy(), table["node"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
        order, links = np.argsort(group, kind="stable"), []
        begin = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
        for a, b in zip(begin, [*begin[1:], len(order)][: len(begin)], strict=True):
            own = order[a:b]
            if len(own) < 2:
                continue
            size = np.array([len(sets[k]) for k in own])
            values, inverse = np.unique(np.concatenate([sets[k] for k in own]), return_inverse=True)
            edge = np.concatenate([[0], np.cumsum(size)])

            def linked(k: int, inverse=inverse, edge=edge, size=size, n=len(values)) -> np.ndarray:
                mine = np.zeros(n, np.int32)
                mine[inverse[edge[k] : edge[k + 1]]] = 1
                both = np.add.reduceat(mine[inverse], edge[:-1])
                return np.flatnonzero(100 * both >= percent * (size + size[k] - both))

            links += [(int(node[own[x]]), int(node[own[y]])) for x, y in spanning(len(own), linked)]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return confirm


def near_duplicates(docs: DataFrame, target_bytes: int = 8 << 20, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    ``target_bytes``: of postings or sets for one task. ``percent``: the least likeness of a link.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and at most 100")
    matches = matches_at(percent)
    prefix = COORDINATES - matches + 1
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketched = materialize(sketch(docs), "sketch")
    full = sketched.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    one = [F.first(c).alias(c) for c in ("n_shingles", "signature", "values")]
    classes = materialize(full.groupBy("key1", "key2").agg(F.min("doc_id").alias("node"), *one), "classes")
    dealt = materialize(lists(postings(classes, prefix)), "lists")
    parts = max(shuffles, dealt.count() * (COORDINATES + 16) // target_bytes)
    valued = dealt.join(classes.select("node", "values"), "node").select(F.pmod(F.xxhash64("list"), F.lit(parts)).alias("part"), "list", "node", "values")
    candidates = components(valued.groupBy("part").applyInArrow(_collide(matches), "a bigint, b bigint"))
    candidates = materialize(candidates.join(classes.select("node", "n_shingles"), "node"), "candidates")
    set_bytes = F.sum(F.col("n_shingles") * 8)
    sizes = candidates.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(set_bytes / BLOCK_BYTES)).cast("bigint").alias("blocks"), set_bytes.alias("bytes"))
    sizes = materialize(sizes, "candidate-sizes")
    parts = max(shuffles, (sizes.agg(F.sum(F.col("bytes") * F.col("blocks"))).first()[0] or 0) // target_bytes)
    named = candidates.drop("n_shingles").join(sizes.drop("bytes"), "component")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), "text").join(named.hint("merge"), "node").select("node", "text", "component", "blocks")
    sets = texts.mapInArrow(_with_sets, "node bigint, component bigint, blocks bigint, shingles binary")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("group", F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")))
    dealt = dealt.select(F.pmod("group", F.lit(parts)).alias("part"), "group", "node", "shingles")
    links = dealt.groupBy("part").applyInArrow(_confirm(percent), "a bigint, b bigint")
    labels = components(links).withColumnRenamed("component", "component_id")
    class_label = classes.select("key1", "key2", "node").join(labels, "node", "left").select("key1", "key2", F.coalesce("component_id", "node").alias("component_id"))
    out = sketched.drop("signature", "values").join(class_label, ["key1", "key2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(component, F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; a row without id stays.

    Rows of one id and one text are one document. Rows of one id but different texts are a document each, so none goes but for a near copy that stays.
    """
    own, text = F.col("doc_id").cast("bigint"), F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.where(F.col("doc_id").isNotNull()).groupBy(own.alias("_id")).agg(F.min(text).alias("_first"), F.max(text).alias("_last"))
    several = materialize(texts.where("_first <> _last").select("_id", "_first"), "repeated-ids")
    # the texts of an id after its first go under a hash with the second highest bit set
    hashed = F.xxhash64("_id", text).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    named = docs.join(several, own == F.col("_id"), "left").withColumn("_node", F.when(F.col("_id").isNull() | (text == F.col("_first")), own).otherwise(hashed))
    near = near_duplicates(named.select(F.col("_node").alias("doc_id"), "text"), percent=percent).where("doc_id is not null").select(F.col("doc_id").alias("_node"), "component_id")
    ids = materialize(named.where("_id is not null").select("_node", "_id").distinct(), "repeated-nodes")
    first = F.min(F.struct(F.coalesce("_id", "_node"), F.col("_node"))).alias("_kept")
    kept = near.join(ids, "_node", "left").groupBy("component_id").agg(first).select(F.col("_kept._node").alias("_node"))
    with_id = named.join(kept, "_node", "left_semi").dropDuplicates(["_node"]).select(*docs.columns)
    return with_id.unionByName(docs.where(F.col("doc_id").isNull()))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[k:k + least(5, len(words)) - 1], ' ') AS shingle FROM w, unnest(range(1, greatest(2, len(words) - 3))) AS u(k) WHERE len(words) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), near AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)
), links AS (SELECT a, b FROM near UNION SELECT b, a FROM near
), reach(node, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other
), c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""
