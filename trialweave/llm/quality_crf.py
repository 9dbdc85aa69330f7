"""Document quality from a linear-chain conditional random field over lines.

Each line of a document is good or bad. Its features are the shares of byte classes, its
length, its words and whether it repeats within the document, beside the same features of
the line before and the line after. A chain with learned transitions joins neighbouring
lines; forward-backward gives each line's probability of being good. The mean of these,
weighted by line length, is the document's quality, put on the scale of the labels by a
logistic curve of two parameters.

The model is fitted on a bounded sample: at most ``sample_docs`` labelled documents of at
most ``sample_bytes`` bytes each, those with the smallest hashes of their ids, as far as
they have at most ``sample_lines`` lines in all, and never one of the held-out fold (crc32
of the id as text, modulo 4, is 2). Emissions and transitions maximise one likelihood, in
which both labels weigh alike and the lines of a document share its weight. A line of a
sampled document takes the document's label, as no line has one of its own: so the chain
learns how strongly neighbours agree, not where quality changes within a document. Scoring covers every line of every document, in the
tasks that read them: there is no shuffle.

Edge cases: a null or empty text is one empty line and gets a score; labels that are null
or neither 0 nor 1 are not used, of repeated labels of an id the smaller counts; where the
sample lacks a class the score is the share of label 1 in it (0.5 without any label);
repeated documents get equal scores; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm import words as W

SAMPLE_DOCS = 2000
SAMPLE_BYTES = 32 << 10
SAMPLE_LINES = 200_000
THRESHOLD = 0.7

_GROUPS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b".", b",", b"|", b"#", b"%", b"&", b"*", b"$", b"()[]{}<>", b"=;/\\", b"@:_-+", b"!?'\"`~^")
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _k, _group in enumerate(_GROUPS):
    _CLASS[list(_group)] = _k
_CLASS[0xC0:] = len(_GROUPS) + 1
_CLASS[0x80:0xC0] = len(_GROUPS) + 2
_CLASSES = len(_GROUPS) + 3
#: Features of one line: class shares, length, words, word length, repeated line, repeated words, ends with a stop.
OWN = _CLASSES + 6


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line, and the number of lines before each text; an empty text is one empty line."""
    stops = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], stops + 1]), kind="stable")
    # a text that ends with a line feed has an empty last line, whose start may equal the next text's start
    ends = np.sort(np.concatenate([offsets[1:], stops]), kind="stable")
    per_text = 1 + np.searchsorted(stops, offsets[1:]) - np.searchsorted(stops, offsets[:-1])
    return starts, ends, np.concatenate([[0], np.cumsum(per_text)])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrix of line features with those of both neighbours, length of each line, lines before each text."""
    starts, ends, first = lines(data, offsets)
    n = len(starts)
    length = ends - starts
    own = np.zeros((n, OWN), np.float32)
    for lo in range(0, len(data), W.PIECE):  # arrays of 8 bytes a byte are made for a piece only
        place = np.arange(lo, min(lo + W.PIECE, len(data)))
        line = np.searchsorted(starts, place, "right") - 1
        line, kinds = line[place < ends[line]], _CLASS[data[place[place < ends[line]]]]
        if len(line):
            a, many = line[0], line[-1] - line[0] + 1
            own[a : a + many, :_CLASSES] += np.bincount((line - a) * _CLASSES + kinds, minlength=many * _CLASSES).reshape(many, _CLASSES)
    own[:, :_CLASSES] /= np.maximum(length, 1)[:, None]
    found = W.words(data, offsets)
    word_line = np.searchsorted(starts, found.starts, "right") - 1
    n_words = np.bincount(word_line, minlength=n)
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    # a line's hash is the sum of its words' hashes, each turned by its place in the line
    place = np.arange(len(found.hashes)) - np.concatenate([[0], np.cumsum(n_words)[:-1]])[word_line]
    hashed = np.zeros(n, np.uint64)
    np.add.at(hashed, word_line, W.mix(found.hashes + place.astype(np.uint64)))
    order = np.lexsort((hashed, text_of))
    again = np.zeros(n, bool)
    again[order[1:]] = (hashed[order[1:]] == hashed[order[:-1]]) & (text_of[order[1:]] == text_of[order[:-1]]) & (length[order[1:]] > 0)
    pair = np.lexsort((found.hashes, word_line))
    same = np.zeros(len(pair), bool)
    same[1:] = (found.hashes[pair[1:]] == found.hashes[pair[:-1]]) & (word_line[pair[1:]] == word_line[pair[:-1]])
    repeated = np.bincount(word_line[pair[same]], minlength=n)
    own[:, _CLASSES] = np.log1p(length)
    own[:, _CLASSES + 1] = np.log1p(n_words)
    own[:, _CLASSES + 2] = np.log1p(length / np.maximum(n_words, 1))
    own[:, _CLASSES + 3] = again
    own[:, _CLASSES + 4] = repeated / np.maximum(n_words, 1)
    if len(data):
        own[:, _CLASSES + 5] = (length > 0) & (data[np.maximum(ends - 1, 0)] == 46)
    full = np.zeros((n, 3 * OWN + 2), np.float32)
    full[:, :OWN] = own
    inner = np.ones(n, bool)
    inner[first[:-1]] = False  # has a line before
    full[1:, OWN : 2 * OWN] = own[:-1] * inner[1:, None]
    full[:-1, 2 * OWN : 3 * OWN] = own[1:] * inner[1:, None]
    full[:, 3 * OWN] = ~inner
    full[first[1:] - 1, 3 * OWN + 1] = 1
    return full, length, first


def chain(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains side by side.

    ``emission``: log-odds of good for each line; ``transition``: scores [from, to], 1 is good.
    Returns each line's probability of good, the expected number of each transition (each to a line counts by its ``weight``) and log Z of each chain.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, steps = first[:-1][order], int(size.max(initial=0))
    active = len(size) - np.searchsorted(size[order][::-1], np.arange(steps), "right")
    score = np.stack([np.zeros_like(emission), emission], 1)
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    alpha[start] = score[start]
    for t in range(1, steps):
        now = start[: active[t]] + t
        alpha[now] = np.logaddexp(alpha[now - 1, :1] + transition[0], alpha[now - 1, 1:] + transition[1]) + score[now]
    for t in range(steps - 2, -1, -1):
        now = start[: active[t + 1]] + t
        ahead = beta[now + 1] + score[now + 1]
        beta[now] = np.logaddexp(ahead[:, :1] + transition[:, 0], ahead[:, 1:] + transition[:, 1])
    last = first[1:] - 1
    log_z = np.logaddexp(alpha[last, 0], alpha[last, 1])
    z = np.repeat(log_z, size)
    good = np.exp(alpha[:, 1] + beta[:, 1] - z)
    inner = np.ones(len(emission), bool)
    inner[first[:-1]] = False
    to = np.flatnonzero(inner)
    pair = np.exp(alpha[to - 1, :, None] + transition + (score[to] + beta[to])[:, None, :] - z[to, None, None])
    pair = pair.sum(0) if weight is None else np.tensordot(weight[to], pair, 1)
    return np.clip(good, 0, 1), pair, log_z


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    transition: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def quality(self, full: np.ndarray, length: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text, and each line's probability of being good."""
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant), np.full(len(length), self.constant)
        good, _, _ = chain(((full - self.mean) / self.scale) @ self.weight + self.bias, first, self.transition)
        weight = length + 1.0
        mean = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        return 1 / (1 + np.exp(-(self.slope * _odds(mean) + self.shift))), good


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _adam(parts: list[np.ndarray], gradient, steps: int, rate: float) -> None:
    """Lower a loss in place; ``gradient`` gives one array for each part."""
    m, v = [np.zeros_like(x) for x in parts], [np.zeros_like(x) for x in parts]
    for k in range(1, steps + 1):
        for x, g, a, b in zip(parts, gradient(), m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x -= rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)


def objective(x: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray, bias: np.ndarray, transition: np.ndarray, penalty: float) -> tuple[float, list[np.ndarray]]:
    """Minus the weighted log-likelihood of the label sequences, with a ridge on all but the bias, and its gradient."""
    size = np.diff(first)
    # both classes weigh alike; a document's lines share its weight
    by_doc = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean())) / len(label) / size
    by_line, y = np.repeat(by_doc, size), np.repeat(label, size).astype(float)
    emission = (x @ weight + bias[0]).astype(float)
    good, pair, log_z = chain(emission, first, transition, by_line)
    stays = np.array([[np.sum(by_doc * (size - 1) * (label == k)) if j == k else 0.0 for j in (0, 1)] for k in (0, 1)])
    loss = by_doc @ log_z - by_line @ (emission * y) - (stays * transition).sum() + penalty / 2 * (weight @ weight + (transition**2).sum())
    off = (good - y) * by_line
    return float(loss), [off @ x + penalty * weight, np.array([off.sum()]), pair - stays + penalty * transition]


def fit(full: np.ndarray, length: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = 80, penalty: float = 1e-3) -> Model:
    """The chain of the greatest likelihood, then the logistic curve of the documents' means."""
    if len(label) == 0 or label.min() == label.max():
        return Model(*[np.zeros(0)] * 3, 0.0, np.zeros((2, 2)), constant=float(label.mean()) if len(label) else 0.5)
    mean, scale = full.mean(0), full.std(0) + 1e-3
    x = ((full - mean) / scale).astype(np.float32)
    weight, bias, transition = np.zeros(x.shape[1]), np.zeros(1), np.zeros((2, 2))

    def gradient() -> list[np.ndarray]:
        return objective(x, first, label, weight, bias, transition, penalty)[1]

    _adam([weight, bias, transition], gradient, steps, 0.08)
    model = Model(mean, scale, weight.astype(np.float32), float(bias[0]), transition)
    good, _, _ = chain(x @ model.weight + model.bias, first, transition)
    share = np.add.reduceat(good * (length + 1.0), first[:-1]) / np.add.reduceat(length + 1.0, first[:-1])
    odds, curve = _odds(share), np.array([1.0, 0.0])

    def slope() -> list[np.ndarray]:
        off = 1 / (1 + np.exp(-(curve[0] * odds + curve[1]))) - label
        return [np.array([(off * odds).mean() + 1e-3 * curve[0], off.mean()])]

    _adam([curve], slope, 400, 0.05)
    model.slope, model.shift = max(float(curve[0]), 1e-3), float(curve[1])
    return model


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, sample_lines: int = SAMPLE_LINES) -> Model:
    """Fit on the sample; the driver gets the features of its lines only."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = F.broadcast(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))  # sample_docs rows
    texts = docs.select("doc_id", "text").join(sample, "doc_id").where(F.octet_length(F.coalesce("text", F.lit(""))) <= sample_bytes)
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)  # of sample_docs ids
    lines_of = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    texts = texts.withColumn("_lines", F.sum(lines_of).over(order)).where(F.col("_lines") <= sample_lines).drop("_lines")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text"):
                full, length, first = features(*W.strings(batch.column("text")))
                part = [slice(first[k], first[k + 1]) for k in range(len(batch))]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "full": [full[p].tobytes() for p in part], "length": [length[p].astype(np.int64).tobytes() for p in part]})

    rows = sorted(texts.mapInArrow(measure, "doc_id bigint, quality int, full binary, length binary").collect())
    if not rows:
        return fit(np.zeros((0, 3 * OWN + 2)), np.zeros(0), np.zeros(1, int), np.zeros(0))
    length = [np.frombuffer(r["length"], np.int64) for r in rows]
    full = np.frombuffer(b"".join(bytes(r["full"]) for r in rows), np.float32).reshape(-1, 3 * OWN + 2)
    return fit(full, np.concatenate(length), np.concatenate([[0], np.cumsum([len(x) for x in length])]), np.array([r["quality"] for r in rows]))


def with_quality(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, text):
                scores, _ = model.quality(*features(*W.strings(batch.column(text))))
                kept = {n: batch.column(n) for n in batch.schema.names}
                yield pa.RecordBatch.from_pydict(kept | {score: pa.array(scores, pa.float64())})

    plain = docs.drop(score)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(rate, f"{schema}, `{score}` double")


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **sample) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = with_quality(docs.select("doc_id", "text"), train(docs, labels, **sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **sample) -> DataFrame:
    """``docs`` without those that score under the threshold."""
    name = "_quality_score"
    return with_quality(docs, train(docs, labels, **sample), score=name).where(F.col(name) >= threshold).select(*docs.columns)
