"""Fill-in-the-middle transformation of whole texts, with cuts at lines or code points.

A text is worked on as its UTF-8 bytes. Its exception index holds only the characters of
more than one byte: their places and the excess bytes up to each. Between two of them a
place in code points and one in bytes differ by a constant, so a cut is converted by one
binary search, and a text of ASCII by none.

A text is cut into prefix, middle and suffix at two units that the hash of its id gives. It
comes out as it is (``plain``), or as ``<P>`` prefix ``<S>`` suffix ``<M>`` middle (``psm``)
or ``<S>`` suffix ``<P>`` prefix ``<M>`` middle (``spm``). :func:`restore` is the inverse.

Edge cases: a null or empty text, and one that contains a mark, stays plain; a text of one
line is cut before or after it; rows of one doc_id are cut by the same hash; a row without
doc_id by that of an empty id; an empty table gives no rows; extra columns are kept by
:func:`transform`. A task holds some megabytes of text at a time, or one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm import words as W

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of the texts that are transformed, and of these the share with the suffix first.
RATE, SPM_RATE = 100, 50
SEED = 7
UNITS = ("line", "char")


class Exceptions(NamedTuple):
    """places: code points of the characters of several bytes; excess: bytes beyond one a character, up to and with each; n_bytes: of the text."""

    places: np.ndarray
    excess: np.ndarray
    n_bytes: int


def exceptions(data: np.ndarray) -> Exceptions:
    """The index of one text's bytes."""
    lead = np.flatnonzero(data >= 0xC0)
    more = 1 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0).astype(np.int64)
    excess = np.cumsum(more)
    return Exceptions(lead - (excess - more), excess, len(data))


def n_chars(index: Exceptions) -> int:
    return index.n_bytes - int(index.excess[-1]) if len(index.excess) else index.n_bytes


def to_bytes(index: Exceptions, char: np.ndarray) -> np.ndarray:
    """Byte places of code point places."""
    before = np.searchsorted(index.places, char, "left")
    return char + np.where(before > 0, index.excess[np.maximum(before - 1, 0)], 0) if len(index.places) else char


def to_chars(index: Exceptions, byte: np.ndarray) -> np.ndarray:
    """Code point places of byte places that begin a character, or end the text."""
    if not len(index.places):
        return byte
    ends = index.places + 1 + index.excess  # the byte after each
    before = np.searchsorted(ends, byte, "right")
    return byte - np.where(before > 0, index.excess[np.maximum(before - 1, 0)], 0)


def dice(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for a document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[k : k + 4], "big") for k in (0, 4, 8, 12))


class Cut(NamedTuple):
    form: str
    n: int
    #: Byte places where the middle begins and ends.
    begin: int
    end: int


def cut(text: bytes, index: Exceptions, drawn: tuple[int, int, int, int], unit: str = "line", rate: int = RATE, spm_rate: int = SPM_RATE) -> Cut:
    """The form of one text, its number of units, and its cuts."""
    if unit == "line":
        line_ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
        n = len(line_ends) + (len(text) > 0 and not text.endswith(b"\n"))
        at = lambda k: 0 if k == 0 else int(line_ends[k - 1]) if k <= len(line_ends) else len(text)
    else:
        n = n_chars(index)
        at = lambda k: int(to_bytes(index, np.array([k]))[0])
    h1, h2, h3, h4 = drawn
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return Cut("plain", n, 0, 0)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return Cut("spm" if h4 % 100 < spm_rate else "psm", n, at(a), at(b))


def arranged(text: bytes, c: Cut) -> bytes:
    if c.form == "plain":
        return text
    prefix, middle, suffix = text[: c.begin], text[c.begin : c.end], text[c.end :]
    first = PREFIX + prefix + SUFFIX + suffix if c.form == "psm" else SUFFIX + suffix + PREFIX + prefix
    return first + MIDDLE + middle


def restore(output: bytes, form: str) -> bytes:
    """The text from its output and form: texts that are cut contain no mark, so each mark is found where it was put."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    middle_at = output.index(MIDDLE)
    second_at = output.index(second)
    if not output.startswith(first) or second_at > middle_at:
        raise ValueError("marks are not in the order of the form")
    a, b, middle = output[len(first) : second_at], output[second_at + len(second) : middle_at], output[middle_at + len(MIDDLE) :]
    return a + middle + b if form == "psm" else b + middle + a


def transform(docs: DataFrame, unit: str = "line", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """Own columns with the text as output, and fim_n (units), fim_form, fim_prefix_chars, fim_middle_chars (code points; null if plain)."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    own = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text"):
                data, offsets = W.strings(batch.column("text"))
                made = {"text": [], "fim_n": [], "fim_form": [], "fim_prefix_chars": [], "fim_middle_chars": []}
                for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    piece = data[offsets[k] : offsets[k + 1]]
                    text, index = piece.tobytes(), exceptions(piece)
                    c = cut(text, index, dice(seed, doc_id), unit, rate, spm_rate)
                    begin, end = to_chars(index, np.array([c.begin, c.end])).tolist() if c.form != "plain" else (None, None)
                    for name, value in zip(made, (arranged(text, c), c.n, c.form, begin, None if end is None else end - begin), strict=True):
                        made[name].append(value)
                kinds = {"text": pa.binary(), "fim_form": pa.string()}
                out = {name: pa.array(values, kinds.get(name, pa.int64())) for name, values in made.items()}
                out["text"] = out["text"].cast(pa.string())
                yield pa.RecordBatch.from_pydict({c: out.pop("text") if c == "text" else batch.column(c) for c in own} | {k: v for k, v in out.items() if k != "text"})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, fim_n bigint, fim_form string, fim_prefix_chars bigint, fim_middle_chars bigint")


def restored(outputs: DataFrame) -> DataFrame:
    """The same rows with the text that each output was made of."""
    own = outputs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text"):
                data, offsets = W.strings(batch.column("text"))
                texts = [restore(data[a:b].tobytes(), form) for a, b, form in zip(offsets[:-1], offsets[1:], batch.column("fim_form").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pydict({c: pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else batch.column(c) for c in own})

    return outputs.mapInArrow(run, outputs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    made = transform(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    made = made.withColumn("output_sha256", F.sha2(F.col("text").cast("binary"), 256))
    made = restored(made)
    return made.select("doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"), "output_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("restored_sha256"))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (SELECT *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS lines, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t
), v AS (SELECT *, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), w AS (SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix FROM v)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM w
"""
