"""Substring dedup by difference-cover anchors: repeated passages of at least ``WINDOW`` words go, but for their first place.

``COVER`` is a difference cover modulo ``PERIOD``: every difference of two places is a
difference of two of its members. Word windows of ``ANCHOR`` words are hashed only where a
document's word number modulo the period is in the cover. Two equal windows of
``WINDOW = ANCHOR + PERIOD - 1`` words, wherever they start, have such an anchor at one
and the same offset. So a window that has no anchor which occurs elsewhere is unique, and
just the others are extended to the whole window.

Documents go in buckets of ``2**BUCKET_BITS`` consecutive ids, in one shuffle that all
steps share.

1. Each bucket sends its distinct anchors, packed; the answer is those that another bucket
   has too.
2. Each bucket extends these anchors to windows and sends the hashes of the distinct
   windows; the answer is those that an earlier bucket has too.
3. A window goes if an earlier bucket has it, or an earlier place in its own bucket. The
   words that such windows cover are removed.

A bucket sends each hash once, however often it occurs, and no step makes pairs: a passage
in a third of all documents is one hash of every bucket. Windows are told apart by two
64-bit hashes each, made from two independent hashes of each word.

Edge cases: a null or empty text has no words; a text of fewer than 20 words loses
nothing; rows of one doc_id count in the order of their texts, each as a place of its own;
a row without doc_id counts as before all others; an empty table gives no rows; extra
columns are not read. Ids spread widely make small buckets, which is slower, not wrong.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm import words as W

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
BUCKET_BITS = 9
#: Text in one task.
TASK_BYTES = 16 << 20
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_FIRST = -(1 << 62)


def _texts(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Rows in order of id and text: their texts, with bytes and offsets."""
    text = table["text"].combine_chunks()
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) and text.num_chunks else text
    ids = table["doc_id"].fill_null(_FIRST).to_numpy()
    order = np.argsort(ids, kind="stable")
    if len(ids) > 1 and (ids[order][1:] == ids[order][:-1]).any():
        values = text.to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda k: (ids[k], values[k] or "")))
    text = text.take(pa.array(order))
    return order, *W.strings(text)


def _anchors(found: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of the anchors, and the upper 48 bits of their hashes."""
    hashes = W.windows(found.hashes, ANCHOR)
    place = np.arange(len(hashes)) - np.repeat(found.first[:-1], np.diff(found.first))[: len(hashes)]
    at = np.flatnonzero(_IN_COVER[place % PERIOD] & W.inside_text(found.first, ANCHOR))
    return at, hashes[at] >> np.uint64(16)


#: Two hashes of a window, as one value that numpy sorts.
_PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


def _window_hashes(data: np.ndarray, found: W.Words) -> np.ndarray:
    out = np.empty(max(0, len(found.hashes) - WINDOW + 1), _PAIR)
    out["a"] = W.windows(found.hashes, WINDOW)
    out["b"] = W.windows(W.hashes(data, found.starts, found.ends, seed=1), WINDOW, 0x14057B7EF767814F)
    return out


def _pack(values: np.ndarray, width: int) -> bytes:
    return values.tobytes() if width == 16 else values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(packed: list, width: int) -> np.ndarray:
    """Values of several packed columns, one after the other."""
    if width == 16:
        return np.frombuffer(b"".join(packed), _PAIR)
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.reshape(-1).view("<u8")


def _order(*keys: np.ndarray) -> np.ndarray:
    """As np.lexsort: the last key counts first."""
    flat = [c for k in keys for c in ((k["b"], k["a"]) if k.dtype == _PAIR else (k,))]
    return np.lexsort(flat) if len(flat) > 1 else np.argsort(flat[0], kind="stable")


def _distinct(values: np.ndarray) -> np.ndarray:
    values = values[_order(values)]
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _by_part(bucket: int | None, values: np.ndarray, parts: int, width: int) -> pa.Table:
    """Sorted distinct values, dealt by value."""
    part = (W.mix(values["a"] if values.dtype == _PAIR else values) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    at, begin = np.unique(part[order], return_index=True)
    packed = [_pack(values[order[a:b]], width) for a, b in zip(begin, [*begin[1:], len(order)][: len(begin)], strict=True)]
    return pa.table({"part": pa.array(at, pa.int64()), "bucket": pa.array([bucket] * len(at), pa.int64()), "packed": pa.array(packed, pa.binary())})


def _shared(earlier_only: bool, width: int):
    """For each bucket, its values that another bucket (or an earlier one) also sent."""

    def answer(_key: tuple, table: pa.Table) -> pa.Table:
        packed, buckets = table["packed"].to_pylist(), table["bucket"].to_numpy()
        values = _unpack(packed, width)
        bucket = np.repeat(buckets, [len(x) // width for x in packed])
        order = _order(bucket, values)
        values, bucket = values[order], bucket[order]
        as_before = np.concatenate([[False], values[1:] == values[:-1]])
        hit = as_before if earlier_only else as_before | np.concatenate([as_before[1:], [False]])
        values, bucket = values[hit], bucket[hit]
        order = np.argsort(bucket, kind="stable")
        at, begin = np.unique(bucket[order], return_index=True)
        return pa.table({"bucket": pa.array(at, pa.int64()), "packed": pa.array([_pack(values[order[a:b]], width) for a, b in zip(begin, [*begin[1:], len(order)][: len(begin)], strict=True)], pa.binary())})

    return answer


def _among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which values are in another array, by one sort of both."""
    both = np.concatenate([held, values])
    mine = np.arange(len(both)) >= len(held)
    order = _order(mine, both)
    begins = np.concatenate([[True], both[order][1:] != both[order][:-1]]) if len(both) else np.zeros(0, bool)
    has = ~mine[order][np.flatnonzero(begins)][np.cumsum(begins) - 1]
    out = np.empty(len(both), bool)
    out[order] = has
    return out[len(held) :]


def removed_words(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the kept words, one space between two) for every document."""
    text = F.coalesce("text", F.lit(""))
    if parts is None:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    without_id = F.lit(_FIRST) + F.shiftrightunsigned(F.xxhash64(text), 54)
    bucket = F.coalesce(F.shiftright(F.col("doc_id").cast("bigint"), BUCKET_BITS), without_id)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", bucket.alias("bucket")).repartition(parts, "bucket")

    def send_anchors(key: tuple, table: pa.Table) -> pa.Table:
        _, data, offsets = _texts(table)
        return _by_part(key[0].as_py(), np.unique(_anchors(W.words(data, offsets))[1]), parts, 6)

    def send_windows(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table) or not len(answers):
            return _by_part(None, np.zeros(0, _PAIR), parts, 16)
        _, data, offsets = _texts(table)
        found = W.words(data, offsets)
        at, anchors = _anchors(found)
        marked = np.zeros(len(found.hashes) + 1, np.int64)
        marked[at[_among(anchors, _unpack(answers["packed"].to_pylist(), 6))] + 1] = 1
        upto = np.cumsum(marked)
        inside = W.inside_text(found.first, WINDOW)
        start = np.flatnonzero(inside & (upto[PERIOD : PERIOD + len(inside)] > upto[: len(inside)]))
        return _by_part(key[0].as_py(), _distinct(_window_hashes(data, found)[start]), parts, 16)

    def remove(_key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        order, data, offsets = _texts(table)
        found = W.words(data, offsets)
        start = np.flatnonzero(W.inside_text(found.first, WINDOW))
        hashes = _window_hashes(data, found)[start]
        order_of = _order(np.arange(len(start)), hashes)
        again = np.zeros(len(start), bool)
        again[order_of[1:]] = hashes[order_of][1:] == hashes[order_of][:-1]
        if len(answers):
            again |= _among(hashes, _unpack(answers["packed"].to_pylist(), 16))
        change = np.zeros(len(found.hashes) + 1, np.int32)
        np.add.at(change, start[again], 1)
        np.add.at(change, start[again] + WINDOW, -1)
        kept = np.cumsum(change)[:-1] == 0
        texts = []
        for k, (a, b) in enumerate(zip(found.first[:-1], found.first[1:], strict=True)):
            own = data[offsets[k] : offsets[k + 1]].tobytes().split()
            texts.append(b" ".join(own if kept[a:b].all() else [w for w, x in zip(own, kept[a:b].tolist(), strict=True) if x]))
        n_words = np.diff(found.first)
        left = np.array([kept[a:b].sum() for a, b in zip(found.first[:-1], found.first[1:], strict=True)], np.int64)
        ids = table["doc_id"].take(pa.array(order))
        return pa.table({"doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_words - left, pa.int64()), "kept_text": pa.array(texts, pa.binary()).cast(pa.string())})

    sent, answer = "part bigint, bucket bigint, packed binary", "bucket bigint, packed binary"
    anchors = texts.groupBy("bucket").applyInArrow(send_anchors, sent).groupBy("part").applyInArrow(_shared(False, 6), answer)
    windows = texts.groupBy("bucket").cogroup(anchors.groupBy("bucket")).applyInArrow(send_windows, sent)
    earlier = windows.groupBy("part").applyInArrow(_shared(True, 16), answer)
    held = texts.groupBy("bucket").cogroup(earlier.groupBy("bucket"))
    return held.applyInArrow(remove, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    return removed_words(docs).select(F.when(F.col("doc_id") != _FIRST, F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), wins AS (SELECT doc_id, k, array_to_string(words[k:k + 19], ' ') AS win FROM w, unnest(range(1, CAST(len(words) - 18 AS BIGINT))) AS u(k) WHERE len(words) >= 20
), again AS (SELECT doc_id, k FROM wins QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, k) > 1
), gone AS (SELECT DISTINCT doc_id, p FROM again, unnest(range(k, k + 20)) AS u(p)
), kept AS (SELECT doc_id, string_agg(words[p], ' ' ORDER BY p) AS kept, count(*) AS n FROM w, unnest(range(1, CAST(len(words) + 1 AS BIGINT))) AS u(p) WHERE (doc_id, p) NOT IN (SELECT doc_id, p FROM gone) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
