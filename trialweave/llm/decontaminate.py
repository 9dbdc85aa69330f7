"""Benchmark decontamination: a broadcast set of normalised benchmark n-grams, probed with every token window.

A word is a maximal run of ASCII digits, letters (lower-cased A-Z) and characters beyond
ASCII. A window is ``size`` consecutive words of an item; an item with fewer words, but
not none, is one window of all its words. Each task hashes the windows of its documents,
looks them up in the broadcast set and compares the words of every hit, so a hash
collision removes nothing. There is no shuffle.

The set has at most ``block_bytes`` of benchmark text, in flat arrays of a few times that
size. A benchmark of one block (the usual case) takes one pass. A larger one takes a pass
for each block: its set is broadcast, the hits are written (texts are named by 128-bit
hashes, as equal texts have equal hits), and the set is destroyed before the next, so one
set is alive at a time. The hits of all passes then meet the documents in a join.

Edge cases: a null or empty text has no words and is clean; a null or empty item has no
window; repeated items all count, items of equal text each by its own id; items without
an id hit like any other and are one null among the items: ``n_items`` counts it once, as
the SQL does, and ``items_sha256`` leaves it out; repeated documents are each judged alone; extra columns of the
documents stay, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm import words as W
from trialweave.llm.scratch import materialize

WINDOW = 10
#: Benchmark text in one broadcast block.
BLOCK_BYTES = 16 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = bytes(W.LOWER)
_BITS = 22


class NgramSet:
    """The windows of some items: for each length, sorted hashes with the item and the place of the words of each occurrence."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int):
        flat = [b" ".join(_WORD.findall(text.translate(_UPPER))) for _, text in items]
        self.names = [name for name, _ in items]
        self.data, offsets = W.strings(pa.array(flat, pa.large_binary()))
        found = W.words(self.data, offsets, W.ALNUM, W.LOWER)
        count = np.diff(found.first)
        self.lengths = {}
        for n in sorted({min(size, int(x)) for x in np.unique(count) if x}):
            hashes = W.windows(found.hashes, n)
            item = np.searchsorted(found.first, np.arange(len(hashes)), "right") - 1
            at = np.flatnonzero((np.arange(len(hashes)) + n <= found.first[item + 1]) & (np.minimum(count[item], size) == n))
            order = at[np.argsort(hashes[at], kind="stable")]
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[hashes[order] >> np.uint64(64 - _BITS)] = True
            self.lengths[n] = hashes[order], bitmap, item[order].astype(np.int32), found.starts[order], found.ends[order + n - 1]

    def hits(self, data: np.ndarray, found: W.Words) -> list[tuple[int, int, set[str | None]]]:
        """(first word, word after the last, items) of each occurrence; word numbers count over all texts."""
        out = []
        for n, (hashes, bitmap, item, starts, ends) in self.lengths.items():
            probe = W.windows(found.hashes, n)
            at = np.flatnonzero(bitmap[probe >> np.uint64(64 - _BITS)])
            low, high = np.searchsorted(hashes, probe[at], "left"), np.searchsorted(hashes, probe[at], "right")
            at, low, high = (x[low < high] for x in (at, low, high))
            if len(at):
                text = np.searchsorted(found.first, at, "right")
                inside = at + n <= found.first[text]
                for k, a, b in zip(at[inside], low[inside], high[inside], strict=True):
                    window = b" ".join(data[x:y].tobytes().translate(_UPPER) for x, y in zip(found.starts[k : k + n], found.ends[k : k + n], strict=True))
                    ids = {self.names[item[j]] for j in range(a, b) if self.data[starts[j] : ends[j]].tobytes() == window}
                    if ids:
                        out.append((int(k), int(k) + n, ids))
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _scan(held: Broadcast, text: str, names: tuple[str, str, str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ngrams: NgramSet = held.value
        for whole in batches:
            for batch in W.slices(whole, text):
                data, offsets = W.strings(batch.column(text))
                found = W.words(data, offsets, W.ALNUM, W.LOWER)
                spans: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[str | None]] = {}
                for a, b, ids in ngrams.hits(data, found):
                    row = int(np.searchsorted(found.first, a, "right")) - 1
                    spans.setdefault(row, []).append((a - int(found.first[row]), b - int(found.first[row])))
                    items.setdefault(row, set()).update(ids)
                hits = [[{"start": a, "end": b} for a, b in _merged(spans.get(k, []))] for k in range(len(batch))]
                named = [sorted(items.get(k, ()), key=lambda x: (x is not None, x)) for k in range(len(batch))]
                made = (pa.array(np.diff(found.first), pa.int64()), pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(named, pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return scan


def ngram_blocks(benchmark: DataFrame, size: int, block_bytes: int, item: str, text: str) -> Iterator[NgramSet]:
    """The benchmark's windows, ``block_bytes`` of text at a time; at least one set, which may be empty."""
    block: list[tuple[str | None, bytes]] = []
    held = made = 0
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("string"), F.col(text).cast("binary"))
    for key, value in rows.toLocalIterator():
        block.append((key, bytes(value)))
        held += len(value)
        if held >= block_bytes:
            yield NgramSet(block, size)
            block, held, made = [], 0, made + 1
    if block or not made:
        yield NgramSet(block, size)


def _fresh(columns: list[str], *wanted: str) -> tuple[str, ...]:
    """Names like those wanted that no column has."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return tuple(out)


def _scanned(docs: DataFrame, ngrams: NgramSet, text: str, names: tuple[str, str, str]) -> tuple[DataFrame, Broadcast]:
    held = docs.sparkSession.sparkContext.broadcast(ngrams)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    n_words, hits, items = names
    return docs.mapInArrow(_scan(held, text, names), f"{fields}, `{n_words}` bigint, `{hits}` array<struct<start:int,end:int>>, `{items}` array<string>"), held


def _united(spans: list) -> list[tuple[int, int]]:
    return _merged([(x["start"], x["end"]) for x in spans])


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, tuple[str, str, str]]:
    """``docs`` with the number of words, the hits (merged spans of word numbers, end exclusive) and the items (sorted ids as
    strings, first null if an item without id is hit), and the names of these three columns."""
    names = _fresh(docs.columns, "_n_words", "_hits", "_items")
    blocks = ngram_blocks(benchmark, size, block_bytes, item, item_text)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scanned(docs, first, text, names)[0], names
    key = [F.xxhash64(F.lit(k), text).alias(f"h{k}") for k in (1, 2)]
    found, alone = None, docs.select(text)
    for ngrams in chain([first, second], blocks):
        scanned, held = _scanned(alone, ngrams, text, ("n_words", "hits", "items"))
        part = materialize(scanned.where(F.size("hits") > 0).select(*key, "hits", "items").distinct(), "benchmark-hits")
        held.destroy()
        found = part if found is None else found.union(part)
    n_words, hits, items = names
    united = F.udf(_united, "array<struct<start:int,end:int>>")  # rows with hits alone
    merged = found.groupBy("h1", "h2").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # one of each a block
    no_id = F.exists("items", lambda x: x.isNull())
    h1, h2 = _fresh([*docs.columns, *names], "_h1", "_h2")
    merged = merged.select(F.col("h1").alias(h1), F.col("h2").alias(h2), united("hits").alias(hits), F.when(no_id, F.concat(F.array(F.lit(None).cast("string")), F.array_compact("items"))).otherwise(F.col("items")).alias(items))
    counted, _ = _scanned(docs, NgramSet([], size), text, _fresh([*docs.columns, *names], n_words, "_a", "_b"))
    own, a, b = counted.columns[-3:]
    counted = counted.drop(a, b).withColumnRenamed(own, n_words)
    joined = counted.join(merged, (F.xxhash64(F.lit(1), text) == F.col(h1)) & (F.xxhash64(F.lit(2), text) == F.col(h2)), "left")
    none = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<string>")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], n_words, F.coalesce(hits, none[0]).alias(hits), F.coalesce(items, none[1]).alias(items)), names


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, **names) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found, (n_words, hits, items) = find_hits(docs.select("doc_id", "text"), benchmark, size, **names)
    n_hit = F.aggregate(hits, F.lit(0).cast("bigint"), lambda total, x: total + x["end"] - x["start"])
    return found.select(
        "doc_id",
        F.col(n_words).alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _without(text: str | None, spans: list) -> str | None:
    data = (text or "").encode()
    places = [m.span() for m in _WORD.finditer(data)]
    for x in reversed(spans):
        data = data[: places[x["start"]][0]] + data[places[x["end"] - 1][1] :]
    return data.decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = WINDOW, **names) -> DataFrame:
    """``docs`` with their own columns, without what occurs in the benchmark: whole ``documents`` with a hit, or just the ``spans``.

    A span runs from the first to the last character of the hit words. Clean documents stay as they are, null texts too.
    """
    found, (_, hits, _) = find_hits(docs, benchmark, size, **names)
    own = [F.col(f"`{c}`") for c in docs.columns]
    if remove == "documents":
        return found.where(F.size(hits) == 0).select(*own)
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    text = names.get("text", "text")
    cut = F.pandas_udf(lambda t, s: t.combine(s, lambda x, y: _without(x, list(y))), "string")
    return found.withColumn(text, F.when(F.size(hits) == 0, F.col(text)).otherwise(cut(F.col(text), F.col(hits)))).select(*own)


ORACLE = """
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, least(10, len(words)) AS n, array_to_string(words[k:k + least(10, len(words)) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(2, len(words) - 8))) AS u(k) WHERE len(words) > 0
), lengths AS (SELECT DISTINCT n FROM item_windows), doc_windows AS (
  SELECT r, k, n, array_to_string(words[k:k + n - 1], ' ') AS win FROM w, lengths, unnest(range(1, CAST(len(words) - n + 2 AS BIGINT))) AS u(k) WHERE len(words) >= n
), hits AS (SELECT r, k, n, item FROM doc_windows JOIN item_windows USING (n, win)
), covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(k, CAST(k + n AS BIGINT))) AS u(p) GROUP BY r
), named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
