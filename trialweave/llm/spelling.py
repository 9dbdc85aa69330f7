"""Spelling variants: words one edit apart, by sorted rotations of terminator-marked words.

A word ``xcy`` with the terminator ``$`` has, for each of its characters c, the rotation
``y$xc``: all words that differ in that character alone have rotations with the prefix
``y$x``, so they follow one another when all rotations are sorted. The word ``xy``, one
character shorter, has the whole rotation ``y$x``: it stands at the head of the same
range, before the characters that are skipped. So a scan of the sorted rotations meets each
pair of a replacement in one range, and each pair of an inserted or deleted character in
one range, too, if of several equal neighbours only the first counts as the edited one.

A range has at most one row for each character of the alphabet and one more, whatever
the corpus. The scan (a window over each range) tells each row how many near words it has
there and the most frequent of them; these are summed by word. No pairs are written.

A word's form is its most frequent near word, if that is at least ``RATIO`` times as
frequent as the word itself (ties: the first in code-point order). Forms are followed to
the last, the root, by doubling.

Edge cases: a null or empty text has no words; a row without doc_id counts as one with an
empty id; repeated rows count each; extra columns are not read; without words of enough
occurrences there are no rows. A null word or count in a table of words is left out, words
that repeat there are added up, and words with a NUL character, the terminator, are an
error.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm import words as W
from trialweave.llm.scratch import materialize

MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
#: One in so many occurrences, by crc32 of id and word, loses a character before words are counted.
DAMAGE = 31
#: Words that a task holds before it sends them.
HELD = 1 << 19
END = "\u0000"
# letters A-Z are lower-cased before; the two-byte characters are U+00C0 to U+00FF
_RUN = re.compile(rb"(?:[a-z]++|\xc3[\x80-\xbf])++")


def _damaged(word: bytes, crc: int) -> bytes:
    text = word.decode()
    at = crc % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, damage: int | None = None) -> DataFrame:
    """word, n: runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of at least so many code points and occurrences.

    With ``damage``, occurrences whose crc32 of ``<doc_id>:<run>`` it divides lose the code point crc32 % length, which makes misspellings that are known.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def send() -> pa.RecordBatch:
            kept = [(w, n) for w, n in total.items() if len(w) - w.count(b"\xc3") >= min_chars]
            return pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in kept], pa.binary()).cast(pa.string()), "n": pa.array([n for _, n in kept], pa.int64())})

        for whole in batches:
            for batch in W.slices(whole, "text"):
                data, offsets = W.strings(batch.column("text"))
                lower = W.LOWER[data].tobytes()
                for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    own = Counter(_RUN.findall(lower, offsets[k], offsets[k + 1]))
                    if not damage:
                        total.update(own)
                    else:
                        begin = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                        for w, n in own.items():
                            if len(w) >= min_chars:  # bytes: a shorter run cannot count, damaged or not
                                crc = zlib.crc32(w, begin)
                                total[w if crc % damage else _damaged(w, crc)] += n
                    if len(total) >= HELD:
                        yield send()
                        total.clear()
        yield send()

    each = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(count, "word string, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """rotation, skipped, first, n: of each word the rotations without one character, and the whole ones (skipped is empty)."""
    size = F.length("word")
    at = words.where(F.assert_true(~F.contains("word", F.lit(END)), "a word has a NUL character").isNull()).select("word", "n", F.explode(F.sequence(-size, size)).alias("_at"))
    place = F.abs("_at")  # below 0: the character at that place is skipped; else: so many characters go behind the terminator
    skip = F.col("_at") < 0
    before = F.when(skip, F.substring("word", F.lit(1), place - 1)).otherwise(F.substring("word", F.lit(1), place))
    skipped = F.when(skip, F.substring("word", place, F.lit(1))).otherwise(F.lit(""))
    first = skip & ((place == 1) | (F.substring("word", place - 1, F.lit(1)) != skipped))
    return at.select(F.concat(F.substring("word", place + 1, size), F.lit(END), before).alias("rotation"), skipped.alias("skipped"), first.alias("first"), "n")


def _ranked(n: Column, word: Column) -> Column:
    """Smaller for more frequent words, then in code-point order."""
    return F.struct((-n).alias("less"), word.alias("word"))


def near(words: DataFrame) -> DataFrame:
    """word, n, n_near, best (less: minus its count, word) of every word; best is null without near words."""
    turned = rotations(words).repartition("rotation")
    after, before = F.substring_index("rotation", END, 1), F.substring_index("rotation", END, -1)
    turned = turned.withColumn("word", F.concat(before, "skipped", after)).withColumn("whole", F.col("skipped") == "")
    everyone = Window.partitionBy("rotation")
    in_order = everyone.orderBy("whole", F.desc("n"), "word")
    me = _ranked(F.col("n"), F.col("word"))
    edited, single = F.when(~F.col("whole"), me), F.when(F.col("whole"), me)
    scanned = turned.select(
        "word", "n", "whole", "first",
        ((F.col("skipped") == "") & (before == "")).alias("own"),
        F.row_number().over(in_order).alias("rank"),
        F.lead(edited).over(in_order).alias("next"),
        F.min(edited).over(everyone).alias("best_edited"),
        F.min(F.when(F.col("first"), me)).over(everyone).alias("best_first"),
        F.min(single).over(everyone).alias("single"),
        F.count(edited).over(everyone).alias("n_edited"),
        F.count(F.when(F.col("first"), 1)).over(everyone).alias("n_first"),
    )
    other = F.when(F.col("rank") == 1, F.col("next")).otherwise(F.col("best_edited"))
    best = F.when(F.col("whole"), F.col("best_first")).otherwise(F.least(other, F.when(F.col("first"), F.col("single"))))
    n_near = F.when(F.col("whole"), F.col("n_first")).otherwise(F.col("n_edited") - 1 + (F.col("first") & F.col("single").isNotNull()).cast("bigint"))
    found = scanned.select("word", F.when(F.col("own"), F.col("n")).alias("n"), n_near.alias("n_near"), best.alias("best")).where("n_near > 0 or n is not null")
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of words and counts (word, n)."""
    words = words.where("word is not null and n is not null").groupBy("word").agg(F.sum(F.col("n").cast("bigint")).alias("n"))
    has_form = -F.col("best.less") >= ratio * F.col("n")
    found = near(words).select("word", "n", "n_near", F.when(has_form, F.col("best.word")).alias("form"), F.when(has_form, -F.col("best.less")).alias("form_n"))
    found = materialize(found, "spelling-near")
    links = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # a form is `ratio` times as frequent, so chains are short and end
        up = links.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        links = materialize(links.join(up, "root", "left").select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")), "spelling-roots")
        if links.where("_moved").isEmpty():
            break
        links = links.drop("_moved")
    out = found.join(links.drop("_moved"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Variants among the words of all documents, of which one occurrence in ``DAMAGE`` has lost a character."""
    return variants(word_counts(docs, damage=DAMAGE))
