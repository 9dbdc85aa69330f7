"""Scores of texts under an interpolated modified Kneser-Ney model, counted in Spark and read by memory-mapped files.

1. Words are counted and numbered, frequent ones first: one file of sorted word hashes a
   part, with counts.
2. Each task counts n-grams of word numbers over some million tokens and deals them, packed
   in sorted columns, by ranges of their hash. From the highest order down, a part sums
   what it was sent, writes its file, and deals on what the next lower order needs: for
   each n-gram one left neighbour of its end (its continuation count), and for its start
   how many follow it once, twice and more often (its discounts). All of that adds up, so it
   is summed before it is dealt, and a word or pair that is everywhere is one row of a task.
3. A file has the sorted hashes of its n-grams: buckets of about ``BUCKET`` by the upper
   bits, the lower 32 bits of each beside a byte for its counts (a code; rare ones are
   listed apart). Scoring tasks map the files and look up the sorted n-grams of some
   megabytes of text at a time, so their memory does not grow with the model.

No n-gram is left out. An n-gram that was never seen is taken for another with a chance of
about 4e-9 (``BUCKET`` / 2**32), whatever the size of the model.

A text is its lower-cased (A-Z) words and an end, after one start mark that is never
predicted. Orders below the highest have continuation counts; n-grams from a start mark,
which nothing can precede, have plain ones. Unigrams are interpolated with 1 / (V + 1), so
unknown words have a share. A discount that the counts of counts do not give (one of them is
0, or the result is not in its range) is 0.5, 1 or 1.5.

Files lie in the folder that driver and executors share; their names have the task's
attempt, and a table names those that count. In a folder that cannot be mapped (an object
store), a worker takes a copy into an unnamed temporary file first.

Edge cases: a null or empty text is one end; a row without doc_id counts as one with an
empty id; repeated rows count each; without training rows every token has probability 1;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm import words as W
from trialweave.llm.scratch import materialize, new_path

ORDER = 3
#: Fold of the documents that the model does not learn from: crc32(doc_id) mod FOLDS.
FOLDS, HELD_OUT = 5, 1
#: Tokens that a task counts at once, and about as many as the n-grams of one part come from.
TASK_TOKENS, PART_TOKENS = 1 << 21, 1 << 20
#: Text, and tokens of one text, that are looked up at once.
SLICE_BYTES, SLICE_TOKENS = 4 << 20, 1 << 19
BUCKET = 16
START, UNKNOWN = 0, -1
_END = np.uint64(0xE4D1E4D1E4D1E4D1)
_CLASSES = 64
_ROWS = "level int, part int, path string, stats array<bigint>, body binary"
_HALF = np.uint64(32)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


# ---- files of arrays


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Write arrays to one file, whose name has the task's attempt; gives its path."""
    files, path = _open(folder)
    files.create_dir(path, recursive=True)
    task = TaskContext.get()
    name = f"{name}-{task.taskAttemptId() if task else 0}.arrays"
    arrays = {k: np.ascontiguousarray(v) for k, v in arrays.items()}
    head = json.dumps([[k, v.dtype.str, v.shape] for k, v in arrays.items()]).encode()
    with files.open_output_stream(f"{path}/{name}", compression=None) as f:
        f.write(len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8))
        for v in arrays.values():
            f.write(v.tobytes() + bytes(-v.nbytes % 8))
    return f"{folder}/{name}"


@lru_cache(maxsize=1 << 16)
def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory."""
    files, local = _open(path)
    if isinstance(files, fs.LocalFileSystem):
        data = np.memmap(local, np.uint8, "r")
    else:
        with tempfile.TemporaryFile() as copy, files.open_input_stream(local, compression=None) as f:
            while piece := f.read(1 << 22):
                copy.write(piece)
            copy.flush()
            data = np.memmap(copy, np.uint8, "r")
    n = int.from_bytes(data[:8].tobytes(), "little")
    out, at = {}, 8 + n + -n % 8
    for name, kind, shape in json.loads(data[8 : 8 + n].tobytes()):
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = data[at : at + size].view(kind).reshape(shape)
        at += size + -size % 8
    return out


# ---- packed columns


def pack(columns: list[np.ndarray], ascending: int) -> bytes:
    """Columns of whole numbers >= 0, one of which ascends, by planes of bytes, compressed."""
    out, widths = [], []
    for k, c in enumerate(columns):
        c = np.diff(c, prepend=0) if k == ascending else c
        width = next(w for w in (0, 1, 2, 4, 8) if not len(c) or int(c.max()) < 1 << 8 * w)
        widths.append(width)
        if width:
            out.append(c.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())
    body = b"".join(out)
    head = np.array([len(columns[0]), ascending, len(body), *widths], "<i8").tobytes()
    return len(widths).to_bytes(1, "little") + head + (pa.compress(body, codec="zstd", asbytes=True) if body else b"")


def unpack(data: bytes) -> list[np.ndarray]:
    k = data[0]
    n, ascending, size, *widths = np.frombuffer(data, "<i8", 3 + k, 1)
    body = pa.decompress(data[1 + 8 * (3 + k) :], decompressed_size=int(size), codec="zstd", asbytes=True) if size else b""
    out, at = [], 0
    for j, width in enumerate(widths):
        if width:
            planes = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n)
            c = np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.int64)
        else:
            c = np.zeros(n, np.int64)
        at += n * width
        out.append(np.cumsum(c) if j == ascending else c)
    return out


def coded(values: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of counts as bytes: codes of the 255 most frequent rows (of single counts, of 0 to 254); the others are listed with their places."""
    if not len(values):
        return {"code": np.zeros(0, np.uint8), "book": values, "places": np.zeros(0, np.int64), "others": values}
    if values.shape[1] == 1:  # counts up to 254 are their own codes
        code = np.minimum(values[:, 0], 255).astype(np.uint8)
        places = np.flatnonzero(code == 255)
        return {"code": code, "book": np.arange(255)[:, None], "places": places, "others": values[places]}
    mixed = np.zeros(len(values), np.uint64)
    for c in values.T:
        mixed = W.mix(mixed + c.astype(np.uint64))
    _, at, inverse, n = np.unique(mixed, return_index=True, return_inverse=True, return_counts=True)
    code = np.full(len(at), 255)
    often = np.argsort(-n, kind="stable")[:255]
    code[often] = np.arange(len(often))
    code = code[inverse].astype(np.uint8)
    places = np.flatnonzero(code == 255)
    return {"code": code, "book": values[at[often]], "places": places, "others": values[places].astype(np.uint32) if values.max() < 1 << 32 else values[places]}


def decoded(f: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    code = f[f"{name}_code"][at]
    book = f[f"{name}_book"]
    out = np.zeros((len(at), book.shape[1]), np.int64)
    low = code < 255
    out[low] = book[code[low]]
    out[~low] = f[f"{name}_others"][np.searchsorted(f[f"{name}_places"], at[~low])]
    return out


# ---- tokens


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and end, one text after the other, and where each begins."""
    data, offsets = W.strings(column)
    found = W.words(data, offsets, W.NOT_SPACE, W.LOWER)
    return np.insert(found.hashes, found.first[1:], _END), found.first + np.arange(len(found.first))


def sequence(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers with a start mark before each text, and the place of each within its text."""
    seq = np.insert(ids, first[:-1], START)
    begin = first + np.arange(len(first))
    return seq, np.arange(len(seq)) - np.repeat(begin[:-1], np.diff(begin))


def key_of(ids: list[np.ndarray]) -> np.ndarray:
    """The hash of n-grams, given as columns."""
    h = np.full(len(ids[0]), len(ids), np.uint64)
    for c in ids:
        h = W.mix(h ^ (c.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return h


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return (((key >> _HALF) * np.uint64(parts)) >> _HALF).astype(np.int64)


def _bucketed(key: np.ndarray, parts: int, buckets: int) -> np.ndarray:
    """Bucket within the part, in the upper half, and the lower 32 bits of the hash."""
    within = ((key >> _HALF) * np.uint64(parts)) & np.uint64(0xFFFFFFFF)
    return (((within * np.uint64(buckets)) >> _HALF) << _HALF) | (key & np.uint64(0xFFFFFFFF))


# ---- the vocabulary


def _merge(held: tuple[np.ndarray, np.ndarray], pending: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    new, n = np.unique(np.concatenate(pending), return_counts=True) if pending else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    both, counts = np.concatenate([held[0], new]), np.concatenate([held[1], n])
    key, inverse = np.unique(both, return_inverse=True)
    return key, np.bincount(inverse, counts, len(key)).astype(np.int64)


def _count_words(parts: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held, pending, size = empty, [], 0

        def send() -> pa.RecordBatch:
            key, n = held
            part = part_of(key, parts)
            at, begin = np.unique(part, return_index=True)  # hashes ascend, and so do parts
            ends = [*begin[1:], len(key)][: len(begin)]
            return pa.RecordBatch.from_pydict({"part": pa.array(at, pa.int32()), "hashes": pa.array([key[a:b].tobytes() for a, b in zip(begin, ends, strict=True)], pa.binary()), "counts": pa.array([pack([n[a:b]], -1) for a, b in zip(begin, ends, strict=True)], pa.binary())})

        for whole in batches:
            for batch in W.slices(whole, "text", SLICE_BYTES):
                pending.append(tokens(batch.column("text"))[0])
                size += len(pending[-1])
                if size >= TASK_TOKENS:
                    held, pending, size = _merge(held, pending), [], 0
                    if len(held[0]) >= TASK_TOKENS:
                        yield send()
                        held = empty
        held = _merge(held, pending)
        if len(held[0]):
            yield send()

    return count


def _write_words(folder: str):
    def write(key: tuple, table: pa.Table) -> pa.Table:
        hashes = np.frombuffer(b"".join(table["hashes"].to_pylist()), np.uint64)
        counts = np.concatenate([unpack(x)[0] for x in table["counts"].to_pylist()])
        word, inverse = np.unique(hashes, return_inverse=True)
        n = np.bincount(inverse, counts, len(word)).astype(np.int64)
        kind = np.frexp(n.astype(float))[1] - 1  # words of one power of two are of one class
        order = np.argsort(kind, kind="stable")
        rank = np.empty(len(word), np.int64)
        sizes = np.bincount(kind, minlength=_CLASSES)
        rank[order] = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        small = lambda x: x.astype(np.uint32) if x.max(initial=0) < 1 << 32 else x
        path = save(folder, f"words-{key[0].as_py():06d}", {"word": word, "count": small(n), "rank": small(rank), "kind": kind.astype(np.uint8)})
        return pa.table({"level": pa.array([0], pa.int32()), "part": pa.array([key[0].as_py()], pa.int32()), "path": [path], "stats": pa.array([[int(n.sum()), *map(int, sizes)]], pa.list_(pa.int64())), "body": pa.array([None], pa.binary())})

    return write


class Vocabulary:
    """Words by hash: their number (from 1, frequent ones first) and count."""

    def __init__(self, rows: list, parts: int) -> None:
        self.parts, self.paths = parts, [None] * parts
        sizes = np.zeros((parts, _CLASSES), np.int64)
        self.tokens = 0
        for r in rows:
            self.paths[r["part"]], sizes[r["part"]] = r["path"], r["stats"][1:]
            self.tokens += r["stats"][0]
        self.size = int(sizes.sum())
        down = sizes[:, ::-1].T.ravel()  # the class of the most frequent words first, part by part
        self.offset = 1 + (np.cumsum(down) - down).reshape(_CLASSES, parts)[::-1].T

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of each word; ``UNKNOWN`` and 0 if it is none."""
        word, inverse = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(word), UNKNOWN, np.int64), np.zeros(len(word), np.int64)
        edge = np.searchsorted(part_of(word, self.parts), np.arange(self.parts + 1))
        for p, path in enumerate(self.paths):
            a, b = edge[p], edge[p + 1]
            if path is None or a == b:
                continue
            f = mapped(path)
            at = np.minimum(np.searchsorted(f["word"], word[a:b]), len(f["word"]) - 1)
            hit = f["word"][at] == word[a:b]
            at = at[hit]
            ids[a:b][hit] = self.offset[p, f["kind"][at]] + f["rank"][at]
            counts[a:b][hit] = f["count"][at]
        return ids[inverse], counts[inverse]


# ---- n-grams


def _deal(level: int, ids: list[np.ndarray], values: list[np.ndarray], key: np.ndarray, parts: int) -> pa.RecordBatch:
    """Distinct n-grams as one row for each part."""
    mid, part = max(level - 2, 0), part_of(key, parts)
    order = np.argsort((part.astype(np.uint64) << np.uint64(44)) | np.minimum(ids[mid], (1 << 44) - 1).astype(np.uint64))
    part = part[order]
    columns = [c[order] for c in (*ids, *values)]
    at, begin = np.unique(part, return_index=True)
    bodies = [pack([c[a:b] for c in columns], mid) for a, b in zip(begin, [*begin[1:], len(part)][: len(begin)], strict=True)]
    n = len(at)
    return pa.RecordBatch.from_pydict({"level": pa.array([level] * n, pa.int32()), "part": pa.array(at, pa.int32()), "path": pa.array([None] * n, pa.string()), "stats": pa.array([None] * n, pa.list_(pa.int64())), "body": pa.array(bodies, pa.binary())})


def _summed(ids: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Distinct n-grams in the order of their hashes, with the sums of their values."""
    key = key_of(ids)
    order = np.argsort(key)
    begin = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, np.int64)
    first = order[begin]
    return [c[first] for c in ids], [np.add.reduceat(v[order], begin) if len(begin) else v for v in values], key[first]


def _count_ngrams(vocabulary, order: int, parts: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pending, size = vocabulary.value, [], 0

        def send() -> Iterator[pa.RecordBatch]:
            """A text's tokens end an n-gram of the highest order, or of a lower one from the start mark."""
            for level in range(1, order + 1):
                found = [[] for _ in range(level)]
                for seq, place in pending:
                    at = np.flatnonzero((place == level - 1 if level < order else place >= level - 1) & (place > 0))
                    for k in range(level):
                        found[k].append(seq[at - (level - 1 - k)])
                ids = [np.concatenate(x) for x in found]
                if len(ids[0]):
                    ids, (n,), key = _summed(ids, [np.ones(len(ids[0]), np.int64)])
                    zero = np.zeros(len(n), np.int64)
                    yield _deal(level, ids, [n, zero, zero, zero, zero], key, parts)

        for whole in batches:
            for batch in W.slices(whole, "text", SLICE_BYTES):
                hashes, first = tokens(batch.column("text"))
                seq, place = sequence(words.find(hashes)[0], first)
                for lo in range(0, len(seq), SLICE_TOKENS):
                    a, b = max(0, lo - order + 1), lo + SLICE_TOKENS
                    # n-grams that end before the piece were counted with the last one
                    kept = place[a:b].copy()
                    kept[: lo - a] = -1
                    pending.append((seq[a:b], kept))
                    size += min(b, len(seq)) - lo
                    if size >= TASK_TOKENS:
                        yield from send()
                        pending, size = [], 0
        if pending:
            yield from send()

    return count


def _reduce(level: int, order: int, parts: int, folder: str):
    def reduce(key: tuple, table: pa.Table) -> pa.Table:
        mine = np.array([x == level and p is None for x, p in zip(table["level"].to_pylist(), table["path"].to_pylist(), strict=True)], bool)
        out = table.filter(pa.array(~mine)).to_batches()  # of lower orders, and names of files
        if not mine.any():
            return table
        columns = [np.concatenate(c) for c in zip(*(unpack(x) for x in table["body"].filter(pa.array(mine)).to_pylist()), strict=True)]
        ids, values, h = _summed(columns[:level], columns[level:])
        del columns
        n = values[0]
        buckets = max(1, len(h) // BUCKET)
        slot = _bucketed(h, parts, buckets)
        at = np.argsort(slot)
        arrays = {"low": (slot[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32), "offset": np.searchsorted(slot[at] >> _HALF, np.arange(buckets + 1, dtype=np.uint64)).astype(np.uint32)}
        arrays |= {f"n_{k}": v for k, v in coded(n[at][:, None]).items()}
        if level < order:
            arrays |= {f"next_{k}": v for k, v in coded(np.stack(values[1:], 1)[at]).items()}
        path = save(folder, f"grams-{level}-{key[0].as_py():06d}", arrays)
        of = np.bincount(np.minimum(n, 5), minlength=6)
        out.append(pa.RecordBatch.from_pydict({"level": pa.array([level], pa.int32()), "part": pa.array([key[0].as_py()], pa.int32()), "path": [path], "stats": pa.array([[int(n.sum()), *map(int, of[1:5]), int((n >= 3).sum())]], pa.list_(pa.int64())), "body": pa.array([None], pa.binary())}))
        if level > 1:
            seen = n > 0
            n, ids = n[seen], [c[seen] for c in ids]
            zero, one = np.zeros(len(n), np.int64), np.ones(len(n), np.int64)
            lower = [np.concatenate(c) for c in zip(ids[1:], ids[:-1], strict=True)]
            sums = [np.concatenate(c) for c in zip([one, zero, zero, zero, zero], [zero, n, (n == 1) * one, (n == 2) * one, (n >= 3) * one], strict=True)]
            lower, sums, h = _summed(lower, sums)
            if len(h):
                out.append(_deal(level - 1, lower, sums, h, parts))
        return pa.Table.from_batches([x.cast(table.schema) for x in out], table.schema)

    return reduce


def discounts(n: list[int]) -> np.ndarray:
    """For counts 1, 2 and more, from how many n-grams have the counts 1 to 4."""
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0
            if 0 < d <= k:
                out[k] = d
    return out


class Model:
    """The files of a trained model: tasks map them and score texts."""

    def __init__(self, words: Vocabulary, rows: list, order: int, parts: int) -> None:
        self.words, self.order, self.parts = words, order, parts
        self.paths = {k: [None] * parts for k in range(1, order + 1)}
        stats = {k: np.zeros(6, np.int64) for k in range(1, order + 1)}
        for r in rows:
            self.paths[r["level"]][r["part"]] = r["path"]
            stats[r["level"]] += r["stats"]
        self.discount = {k: discounts([int(x) for x in s[1:5]]) for k, s in stats.items()}
        s = stats[1]
        self.empty = np.array([s[0], s[1], s[2], s[5]])  # what follows the empty context

    def find(self, level: int, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray | None]:
        """Count of each n-gram, and what is known of its followers: how many tokens, and words by count 1, 2 and more."""
        key, inverse = np.unique(key_of(ids), return_inverse=True)
        n, after = np.zeros(len(key), np.int64), np.zeros((len(key), 4), np.int64) if level < self.order else None
        edge = np.searchsorted(part_of(key, self.parts), np.arange(self.parts + 1))
        for p, path in enumerate(self.paths[level]):
            a, b = edge[p], edge[p + 1]
            if path is None or a == b:
                continue
            f = mapped(path)
            slot = _bucketed(key[a:b], self.parts, len(f["offset"]) - 1)
            bucket, low = (slot >> _HALF).astype(np.int64), (slot & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            lo, end = f["offset"][bucket].astype(np.int64), f["offset"][bucket + 1].astype(np.int64)
            hi, last = end.copy(), len(f["low"]) - 1
            while (open_ := lo < hi).any():  # all buckets at once
                mid = (lo + hi) >> 1
                less = open_ & (f["low"][np.minimum(mid, last)] < low)
                lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            hit = (lo < end) & (f["low"][np.minimum(lo, last)] == low)
            at = lo[hit]
            n[a:b][hit] = decoded(f, "n", at)[:, 0]
            if after is not None:
                after[a:b][hit] = decoded(f, "next", at)
        return n[inverse], None if after is None else after[inverse]

    def log10(self, seq: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 probability of each token of texts with start marks (0 for the marks)."""
        out = np.zeros(len(seq))
        for lo in range(0, len(seq), SLICE_TOKENS):
            a, b = max(0, lo - self.order), lo + SLICE_TOKENS
            out[lo:b] = self._piece(seq[a:b], place[a:b])[lo - a :]
        return out

    def _piece(self, seq: np.ndarray, place: np.ndarray) -> np.ndarray:
        size = len(seq)
        p = np.full(size, 1.0 / (self.words.size + 1))
        after = np.tile(self.empty, (size, 1))  # of the context before each token
        known = seq != UNKNOWN
        for level in range(1, self.order + 1):
            d = self.discount[level]
            # an n-gram that was seen has a start and an end that were
            ask = known & (place >= level - 1) & (np.arange(size) >= level - 1) & ((after[:, 0] > 0) | (level == 1))
            at = np.flatnonzero(ask)
            n, own = np.zeros(size, np.int64), np.zeros((size, 4), np.int64)
            n[at], found = self.find(level, [seq[at - (level - 1 - k)] for k in range(level)])
            if found is not None:
                own[at] = found
            total = after[:, 0]
            kept = np.maximum(n - d[np.minimum(n, 3)], 0.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(total > 0, (kept + (after[:, 1:] @ d[1:]) * p) / total, p)
            after = np.zeros((size, 4), np.int64)
            after[1:] = own[:-1]
            after[place < level] = 0  # a context does not reach back over its start mark
            known = (n > 0) | ((own[:, 0] > 0) if found is not None else False)
        return np.where(place > 0, np.log10(p), 0.0)


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Count a model of all ``docs`` and write its files to a new shared folder."""
    spark = docs.sparkSession
    folder = new_path(spark, "language-model")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select("text")
    counted = texts.mapInArrow(_count_words(parts), "part int, hashes binary, counts binary")
    named = materialize(counted.groupBy("part").applyInArrow(_write_words(folder), _ROWS), "model-words")
    words = Vocabulary(named.collect(), parts)  # a row a file
    parts = max(parts, -(-words.tokens // PART_TOKENS))
    shared = spark.sparkContext.broadcast(words)
    rows = texts.mapInArrow(_count_ngrams(shared, order, parts), _ROWS)
    for level in range(order, 0, -1):
        rows = rows.repartition(parts, "part").groupBy("part").applyInArrow(_reduce(level, order, parts, folder), _ROWS)
    files = materialize(rows.where("path is not null").select("level", "part", "path", "stats"), "model-files")
    return Model(words, files.collect(), order, parts)  # a row a file


def score(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """doc_id, columns ``more``, n_tokens, n_known, train_tokens, base_score (unigrams with half a count added), score and perplexity of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tokens_, size = m.words.tokens, m.words.size
        for whole in batches:
            for batch in W.slices(whole, "text", SLICE_BYTES):
                hashes, first = tokens(batch.column("text"))
                ids, counts = m.words.find(hashes)
                n = np.diff(first)
                base = np.add.reduceat(np.log10((counts + 0.5) / (tokens_ + 0.5 * (size + 1))), first[:-1])
                known = np.add.reduceat((counts > 0).astype(np.int64), first[:-1])
                seq, place = sequence(ids, first)
                total = np.add.reduceat(m.log10(seq, place), first[:-1] + np.arange(len(n)))
                out = {c: batch.column(c) for c in batch.schema.names if c != "text"}
                yield pa.RecordBatch.from_pydict(out | {"n_tokens": n.astype(np.int64), "n_known": known, "train_tokens": np.full(len(n), tokens_, np.int64), "base_score": base, "score": total, "perplexity": 10 ** (-total / n)})

    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *more, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text")
    return kept.mapInArrow(run, f"{schema}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out fold: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return score(docs, train(docs.where("not held_out"), order), "held_out")

