"""Words of many texts at once: byte tables find them, hashes of their bytes name them.

All functions take the bytes of consecutive UTF-8 texts and the offsets of the texts in
them, as Arrow keeps a string column. A word's hash takes its bytes in blocks of eight and
spreads them over all bits after each, so no words have equal hashes by their form; words
of more than ``LONG`` bytes are hashed by BLAKE2. Hashes of another ``seed`` are
independent of the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
#: Words of more bytes are hashed one by one.
LONG = 128
#: Words hashed at a time.
_MANY = 1 << 18
_BELOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: Bytes that are part of a word: all but space and \t\n\v\f\r.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, ASCII letters and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 32


class Words(NamedTuple):
    """starts, ends: byte places of each word; hashes: of its bytes; first: the number of words before each text, and in all."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is an empty text."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most about ``most`` bytes of text; a longer text comes alone."""
    _, offsets = strings(batch.column(column))
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each word after ``fold``."""
    padded = np.concatenate([fold[data], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))  # the eight bytes from each place on
    out = np.empty(len(starts), np.uint64)
    for lo in range(0, len(starts), _MANY):
        at, length = starts[lo : lo + _MANY], (ends - starts)[lo : lo + _MANY]
        h = mix(length.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1))
        h = mix(h ^ (eight[at] & _BELOW[np.minimum(length, 8)]))
        left, step = np.flatnonzero((length > 8) & (length <= LONG)), 8
        while len(left):
            block = eight[at[left] + step] & _BELOW[np.minimum(length[left] - step, 8)]
            h[left] = mix(h[left] ^ block)
            step += 8
            left = left[length[left] > step]
        for k in np.flatnonzero(length > LONG):
            h[k] = int.from_bytes(hashlib.blake2b(padded[at[k] : at[k] + length[k]], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
        out[lo : lo + _MANY] = h
    return out


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE, fold: np.ndarray = SAME) -> Words:
    """Every maximal run of ``inside`` bytes within one text, hashed after ``fold``."""
    n = len(data)
    is_in = inside[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    starts, ends = is_in.copy(), is_in.copy()
    starts[1:] &= ~is_in[:-1] | begins[1:n]
    ends[:-1] &= ~is_in[1:] | begins[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(starts, ends, hashes(data, starts, ends, fold), np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, size: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of each ``size`` consecutive words, across texts too: see :func:`inside_text`."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(base) + hashes[k : k + n]
    return mix(out)


def inside_text(first: np.ndarray, size: int) -> np.ndarray:
    """Which windows lie within one text."""
    n = max(0, int(first[-1]) - size + 1)
    ok = np.ones(n + size, np.int8)
    for k in range(1, size):
        cut = first[1:] - k
        ok[cut[cut >= 0]] = 0
    ok = ok[:n].astype(bool)
    # a text shorter than the window also invalidates starts that belong to earlier texts, which the loop covers
    return ok
