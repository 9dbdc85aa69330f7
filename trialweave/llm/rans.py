"""Token files: ids under a static range asymmetric numeral system, in segments of independent interleaved blocks.

A segment is one file image. Its frequency table (summing to 2**SCALE) is shared by all
its blocks. A lane is ``STEPS`` consecutive ids with a coder state of its own; ``LANES``
lanes interleave their 32-bit words in one block. For each block the head keeps a
checkpoint (place of its words, number of ids, crc32 of the ids) and each lane's state,
so any block can be decoded without the others and is checked by itself. Documents follow
one another in the segment; the head has their ids and lengths.

:func:`write_tokens` sorts documents by id over range partitions (the one shuffle, of
texts), encodes each with the tokenizer, appends the end id, and has Spark write the
segments as rows of a table in the given folder, so a task that runs again leaves no
second copy. A segment closes at ``SEGMENT`` ids; a document is never split.

Edge cases: a null or empty text is its end id alone; a row without id comes first, rows
with equal ids in the order of their texts; an empty table makes no segment; extra columns
are not read; a damaged segment raises an error that names the block.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialweave.llm import words as W

SCALE = 20
STEPS = 256
LANES = 256
SEGMENT = 1 << 21
END_ID = 2
#: Cached pieces of a Python worker.
CACHED = 1_000_000
_MAGIC = b"RANS"
_LOW, _WORD = np.uint64(1 << 31), np.uint64(32)
_MASK = np.uint64((1 << SCALE) - 1)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, and their frequencies scaled to a sum of 2**SCALE, each at least 1."""
    symbols, counts = np.unique(ids, return_counts=True)
    scaled = np.maximum(1, counts * (1 << SCALE) // max(1, counts.sum()))
    off = (1 << SCALE) - int(scaled.sum())
    order = np.argsort(-scaled, kind="stable")
    if off > 0:
        scaled[order[0]] += off
    while off < 0:
        for k in order:
            take = min(int(scaled[k]) - 1, max(1, -off // 8))
            scaled[k] -= take
            off += take
            if off == 0:
                break
    return symbols, scaled


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """symbols, frequencies, each lane's state, words of each block, all words."""
    symbols, freq = frequencies(ids)
    place = np.searchsorted(symbols, ids)
    lanes = -(-len(ids) // STEPS)
    padded = np.full(lanes * STEPS, int(freq.argmax()), np.int64)
    padded[: len(ids)] = place
    grid = np.ascontiguousarray(padded.reshape(lanes, STEPS).T)
    f, c = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    state = np.full(lanes, _LOW, np.uint64)
    sent: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(STEPS - 1, -1, -1):
        own, base = f[grid[step]], c[grid[step]]
        big = np.flatnonzero(state >= own << np.uint64(63 - SCALE))
        sent.append((big, state[big].astype(np.uint32)))
        state[big] >>= _WORD
        whole = state // own
        state = (whole << np.uint64(SCALE)) + (state - whole * own) + base
    lane = np.concatenate([x for x, _ in reversed(sent)])
    word = np.concatenate([x for _, x in reversed(sent)])
    block = lane // LANES
    return symbols, freq, state, np.bincount(block, minlength=-(-lanes // LANES)), word[np.argsort(block, kind="stable")]


def decode(symbols: np.ndarray, freq: np.ndarray, state: np.ndarray, sizes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Ids of consecutive blocks, with the padding of the last lane."""
    lanes, blocks = len(state), len(sizes)
    wide = np.full(blocks * LANES, _LOW, np.uint64)
    wide[:lanes] = state
    state = wide
    f, c = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    slot = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    at = np.cumsum(sizes) - sizes
    out = np.empty((STEPS, lanes), np.int32)
    for step in range(STEPS):
        low = state & _MASK
        place = slot[low]
        out[step] = place[:lanes]
        state = f[place] * (state >> np.uint64(SCALE)) + low - c[place]
        small = state < _LOW
        small[lanes:] = False
        rows = small.reshape(blocks, LANES)
        take = np.flatnonzero(small)
        index = (at[:, None] + np.cumsum(rows, 1) - 1).ravel()[take]
        state[take] = (state[take] << _WORD) | word[index]
        state[lanes:] = _LOW
        at = at + rows.sum(1)
    return symbols[out.T.ravel()]


def pack_segment(doc_ids: list[int | None], texts: list[np.ndarray]) -> bytes:
    """One segment: head (JSON sizes), document table, frequency table, checkpoints, states, words; a crc32 of all before it ends it."""
    ids = np.concatenate(texts)
    symbols, freq, state, sizes, word = encode(ids)
    per_block = STEPS * LANES
    checks = [zlib.crc32(ids[k : k + per_block].astype("<u4").tobytes()) for k in range(0, len(ids), per_block)]
    tables = [
        zlib.compress(np.array([x or 0 for x in doc_ids], "<i8").tobytes(), 1),
        zlib.compress(np.array([x is None for x in doc_ids], np.uint8).tobytes(), 1),
        zlib.compress(np.array([len(x) for x in texts], "<i8").tobytes(), 1),
        zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes(), 1),
        zlib.compress(freq.astype("<u4").tobytes(), 1),
        sizes.astype("<i8").tobytes() + np.array(checks, "<i8").tobytes(),
        state.astype("<u8").tobytes(),
        word.astype("<u4").tobytes(),
    ]
    head = json.dumps({"ids": len(ids), "docs": len(doc_ids), "tables": [len(x) for x in tables]}).encode()
    body = _MAGIC + struct.pack("<I", len(head)) + head + b"".join(tables)
    return body + struct.pack("<I", zlib.crc32(body))


class Segment:
    """A packed segment; blocks are decoded when asked for."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a token segment, or a damaged one")
        at = 8 + struct.unpack("<I", data[4:8])[0]
        head = json.loads(data[8:at])
        parts = []
        for n in head["tables"]:
            parts.append(data[at : at + n])
            at += n
        self.n_ids = head["ids"]
        absent = np.frombuffer(zlib.decompress(parts[1]), np.uint8)
        self.doc_ids = [None if gone else int(x) for x, gone in zip(np.frombuffer(zlib.decompress(parts[0]), "<i8"), absent, strict=True)]
        self.lengths = np.frombuffer(zlib.decompress(parts[2]), "<i8")
        self.symbols = np.cumsum(np.frombuffer(zlib.decompress(parts[3]), "<u4").astype(np.int64))
        self.freq = np.frombuffer(zlib.decompress(parts[4]), "<u4").astype(np.int64)
        self.sizes, self.checks = np.frombuffer(parts[5], "<i8").reshape(2, -1)
        self.state, self.word = np.frombuffer(parts[6], "<u8"), np.frombuffer(parts[7], "<u4")

    def blocks(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of blocks ``first`` up to before ``last``, each held against its checksum."""
        last = len(self.sizes) if last is None else last
        at, per_block = int(self.sizes[:first].sum()), STEPS * LANES
        ids = decode(self.symbols, self.freq, self.state[first * LANES : last * LANES], self.sizes[first:last], self.word[at : at + int(self.sizes[first:last].sum())])
        ids = ids[: min(self.n_ids, last * per_block) - first * per_block].astype("<u4")
        for k in range(first, last):
            if zlib.crc32(ids[(k - first) * per_block : (k - first + 1) * per_block].tobytes()) != self.checks[k]:
                raise ValueError(f"block {k} of a token segment is damaged")
        return ids


def _byte_names() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(shown)))}


_BYTE_NAMES = _byte_names()


class _Pieces(dict):
    """Ids of pieces, made when first asked for. A piece that begins with neither a line feed nor a carriage return has a space before it."""

    def __init__(self, encoder: _Encoder):
        self.model = encoder.tokenizer.model
        self.encoded = encoder._encoded
        self.marks = dict(zip(".,\n", self.encoded([".", ",", "\n"]), strict=True))

    def __missing__(self, piece: str) -> bytes:
        lead, core = (piece[0], piece[1:]) if piece[:1] in ("\n", "\r") else ("", piece)
        end = core[-1] if core[-1:] in (".", ",") else ""
        core = core[:-1] if end else core
        if not core.isalpha():
            ids = self.encoded([core + end if lead == "\r" else (lead or " ") + core + end])[0]
        elif end or lead == "\n":
            ids = (self.marks["\n"] if lead == "\n" else b"") + self["\r" + core if lead else core] + (self.marks[end] if end else b"")
        else:
            named = (core if lead else " " + core).encode().decode("latin-1").translate(_BYTE_NAMES)
            ids = np.array([t.id for t in self.model.tokenize(named)], "<u4").tobytes()
        if len(self) < CACHED:
            self[piece] = ids
        return ids


class _Encoder:
    """Ids of texts under one tokenizer file.

    Where the tokenizer cuts texts by the usual byte-level pattern, a space or line feed
    between two other characters always begins a new piece, and pieces are encoded on
    their own; so each distinct piece need be encoded only once. A piece of letters, which
    the pattern does not cut, goes straight to the library's model; one that has a line
    feed before or a stop or comma after its letters is put together from such.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        self.by_piece = not spec.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and all(t["content"].strip() and " " not in t["content"] and "\n" not in t["content"] and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens", []))
        self.pieces = _Pieces(self)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list[bytes | None] = [None] * len(texts)
        whole: list[int] = []
        get = self.pieces.__getitem__
        for k, text in enumerate(texts):
            flat = text.replace("\n", " ")
            if self.by_piece and flat and flat.isprintable() and "  " not in flat and flat[0] != " " and flat[-1] != " ":
                pieces = text.replace("\n", " \n").split(" ")
                pieces[0] = "\r" + pieces[0]  # has no space before it; no printable text has this character
                out[k] = b"".join(map(get, pieces))
            else:
                whole.append(k)
        for k, ids in zip(whole, self._encoded([texts[k] for k in whole]), strict=True):
            out[k] = ids
        return [np.frombuffer(x, "<u4") for x in out]


_ENCODERS: dict[str, _Encoder] = {}


def _encoder(path: str) -> _Encoder:
    """One for each Python worker and file, so that pieces stay cached between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def segments(docs: DataFrame, tokenizer: str, end_id: int = END_ID, segment: int = SEGMENT) -> DataFrame:
    """part, seq, n_docs, n_ids, payload: segments in the order of (part, seq), documents in ascending doc_id order over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        part, seq, doc_ids, held, n = TaskContext.get().partitionId(), 0, [], [], 0
        end = np.array([end_id], "<u4")

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([n], pa.int64()), "payload": pa.array([pack_segment(doc_ids, held)], pa.binary())}, schema=_SCHEMA)

        for whole in batches:
            for batch in W.slices(whole, "text", 2 << 20):
                for key, ids in zip(batch.column("doc_id").to_pylist(), encoder([x or "" for x in batch.column("text").to_pylist()]), strict=True):
                    doc_ids.append(key)
                    held.append(np.concatenate([ids, end]))
                    n += len(ids) + 1
                    if n >= segment:
                        yield close()
                        seq, doc_ids, held, n = seq + 1, [], [], 0
        if doc_ids:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "part int, seq int, n_docs bigint, n_ids bigint, payload binary")


_SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    segments(docs, tokenizer, end_id).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if wanted, ids (array) of every document in the files."""
    stored = spark.read.schema("part int, seq int, n_docs bigint, n_ids bigint, payload binary").parquet(path)
    # ids before each segment: within its part, and of the parts before, of which there are as many as writing tasks
    index = stored.select("part", "seq", "n_ids")
    totals = index.groupBy("part").agg(F.sum("n_ids").alias("_total"))
    totals = totals.select("part", (F.sum("_total").over(Window.orderBy("part")) - F.col("_total")).alias("_before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    offsets = index.withColumn("_within", within).join(totals, "part").select("part", "seq", (F.col("_before") + F.col("_within")).alias("_offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("payload"), strict=True):
                held = Segment(data.as_buffer().to_pybytes())
                ids = held.blocks()
                end = np.cumsum(held.lengths)
                start = end - held.lengths
                columns = {
                    "part": pa.array([part] * len(end), pa.int32()),
                    "seq": pa.array([seq] * len(end), pa.int32()),
                    "doc_id": pa.array(held.doc_ids, pa.int64()),
                    "_at": pa.array(start, pa.int64()),
                    "n_tokens": pa.array(held.lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(start, end, strict=True)], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "part int, seq int, doc_id bigint, _at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    read = stored.select("part", "seq", "payload").mapInArrow(run, schema).join(offsets, ["part", "seq"])
    return read.select("doc_id", (F.col("_offset") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
