"""Document fingerprints: a homomorphic hash of a document's multiset of paragraphs.

A paragraph is a non-empty line. It hashes to a wide vector with two parts: ``STRONG``
lanes of 32 bits from the whole paragraph, summed modulo 2**32, and ``SIGNS`` lanes, also
summed modulo 2**32, each the sum of signs (+1 or -1) hashed from the paragraph's
pieces of up to ``PIECE`` characters. The fingerprint of a document is the sum of its
paragraphs' vectors. Hence it does not depend on their order; a paragraph is inserted by
adding its vector (:func:`added`) and deleted by subtracting it (:func:`removed`). Equal
texts have equal fingerprints; texts of different paragraphs meet in the strong lanes with
a chance of 2**-256.

Likeness comes from the sign lanes: the mean product of two documents' lanes estimates the
inner product of their counts of pieces. :func:`likeness` is twice that over the sum of
both own products, held to 0 to 1: 1 for equal multisets, near 0 without a common piece,
with a standard error of about 1 / sqrt(SIGNS).

Everything is SQL expressions in the JVM. For the text that follows each document,
documents are dealt once by ``2**BUCKET_BITS`` consecutive ids; only the first of each
bucket travels again, to the bucket before.

Edge cases: a null text is empty; an empty text has the zero vector, likeness 1 to another
empty text and 0 to any other; a lone document is its own next; rows with equal ids follow
one another in the order of their texts; rows without id come first, in the order of the first
10 bits of their texts' hashes, then of their texts (so there are 1,024 buckets of them);
an empty table gives no rows; extra columns are not read; widely spread ids make small
buckets, which is slower, not wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.scratch import materialize

STRONG = 8
SIGNS = 128
PIECE = 32
BUCKET_BITS = 6
_LOW = (1 << 32) - 1
_FIRST = -(1 << 62)


def vectors(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` with ``strong`` and ``signs`` (arrays of bigint): the vectors of each text. Rows with equal keys add up.

    A sum of signs is kept as the number of ones; two such counts share a bigint, since no
    text has 2**31 pieces.
    """
    lines = df.select(*keys, F.explode_outer(F.split(text, "\n")).alias("_line"))
    pieces = lines.select(*keys, "_line", F.posexplode_outer(F.regexp_extract_all("_line", F.lit(f"[^\\n]{{1,{PIECE}}}"), F.lit(0))).alias("_at", "_piece"))
    hashes = [F.xxhash64("_piece", F.lit(k)).alias(f"_h{k}") for k in range(SIGNS // 64)]
    pieces = pieces.select(*keys, "_line", "_at", "_piece", *hashes)
    begins = F.col("_at") == 0
    wide = []
    for k in range(STRONG // 2):
        whole = F.xxhash64("_line", F.lit(k))
        wide += [F.sum(F.when(begins, whole.bitwiseAND(F.lit(_LOW))).otherwise(0)), F.sum(F.when(begins, F.shiftrightunsigned(whole, 32)).otherwise(0))]
    both = [F.sum(F.when(F.col("_piece").isNotNull(), F.shiftrightunsigned(F.col(f"_h{k}"), j).bitwiseAND(F.lit((1 << 32) | 1))).otherwise(0)) for k in range(SIGNS // 64) for j in range(32)]
    summed = pieces.groupBy(*keys).agg(F.count("_piece").alias("_n"), *[x.alias(f"_w{k}") for k, x in enumerate(wide)], *[x.alias(f"_b{k}") for k, x in enumerate(both)])
    ones = F.array(*[x for k in range(len(both)) for x in (F.col(f"_b{k}").bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(F.col(f"_b{k}"), 32))])
    signs = F.transform(ones, lambda x: _centred(2 * x - F.col("_n")))
    return summed.select(*keys, F.array(*[F.col(f"_w{k}").bitwiseAND(F.lit(_LOW)) for k in range(STRONG)]).alias("strong"), signs.alias("signs"))


def _centred(x: Column) -> Column:
    """Modulo 2**32, from -2**31."""
    return F.pmod(x + (1 << 31), F.lit(1 << 32)) - (1 << 31)


def added(strong: tuple[Column, Column], signs: tuple[Column, Column]) -> tuple[Column, Column]:
    """The vectors of both multisets together."""
    return F.zip_with(*strong, lambda x, y: (x + y).bitwiseAND(F.lit(_LOW))), F.zip_with(*signs, lambda x, y: _centred(x + y))


def removed(strong: tuple[Column, Column], signs: tuple[Column, Column]) -> tuple[Column, Column]:
    """The vectors of the first multiset without the second."""
    return F.zip_with(*strong, lambda x, y: F.pmod(x - y, F.lit(1 << 32))), F.zip_with(*signs, lambda x, y: _centred(x - y))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda total, x: total + x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two documents' sign lanes."""
    own = _dot(a, a) + _dot(b, b)
    return F.when(own == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * _dot(a, b) / own)))


def as_text(strong: Column, signs: Column) -> Column:
    """A fingerprint as hexadecimal digits, lane by lane."""
    digits = [F.transform(strong, lambda x: F.lpad(F.hex(x), 8, "0")), F.transform(signs, lambda x: F.lpad(F.hex(F.pmod(x, F.lit(1 << 32))), 8, "0"))]
    return F.lower(F.array_join(F.concat(*digits), ""))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each id: strong, signs and fingerprint of its text (of its texts together, if it has several)."""
    made = vectors(docs.select(key, F.coalesce(text, F.lit("")).alias("_text")), [key], "_text")
    return made.withColumn("fingerprint", as_text(F.col("strong"), F.col("signs")))


def following(keys: DataFrame, key: str) -> DataFrame:
    """``key`` and ``next``: each distinct key (a bigint) with the one after it, the last with the first.

    Range partitions come in order, so only the first key of each partition is ordered over all.
    """
    placed = materialize(keys.select(key).distinct().repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "ordered")
    first = placed.groupBy("_p").agg(F.min(key).alias("_first"))
    over = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = first.select("_p", F.coalesce(F.lead("_first").over(Window.orderBy("_p")), F.first("_first").over(over)).alias("_ahead"))
    within = placed.withColumn("_next", F.lead(key).over(Window.partitionBy("_p").orderBy(key)))
    return within.join(first, "_p").select(key, F.coalesce("_next", "_ahead").alias("next"))


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document."""
    without_id = F.lit(_FIRST) + F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 54)
    bucket = F.coalesce(F.shiftright(F.col("doc_id").cast("bigint"), BUCKET_BITS), without_id)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), bucket.alias("bucket"))
    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    rows = base.select(
        "bucket", "doc_id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("ahead"), F.lag(F.lit(1)).over(order).isNull().alias("first"), F.lead(F.lit(1)).over(order).isNull().alias("last")
    )
    after = following(base.select("bucket"), "bucket").withColumnRenamed("bucket", "before")
    heads = rows.where("first").select(F.col("bucket").alias("next"), F.col("text").alias("head")).join(after, "next").select(F.col("before").alias("bucket"), "head")
    # a merge join at any size: it keeps the deal by bucket, which all that follows relies on
    both = rows.join(heads.hint("merge"), "bucket").withColumn("ahead", F.when(F.col("last"), F.col("head")).otherwise(F.col("ahead")))
    both = both.withColumn("n_chars", F.length("text").cast("bigint"))
    edited = F.expr("concat(left(text, cast(n_chars - n_chars div 2 as int)), left(ahead, cast(n_chars div 2 as int)))")
    both = both.withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    versions = [F.struct(F.lit(k).alias("kind"), F.col(c).alias("content")) for k, c in enumerate(("text", "edited"))]
    each = F.concat(F.array(*versions), F.when(F.col("last"), F.array(F.struct(F.lit(2).alias("kind"), F.col("ahead").alias("content")))).otherwise(F.array()))
    keys = ["bucket", "place", "doc_id", "n_chars", "edited_sha256"]
    flat = both.select(*keys, F.inline(each))
    made = vectors(flat, [*keys, "kind"], "content")
    # of each document: its text, its edited text, then the next document's text
    line = Window.partitionBy("bucket").orderBy("place", "kind")
    made = made.select("*", *[F.lead(c, k).over(line).alias(f"{c}{k}") for c, k in (("strong", 1), ("signs", 1), ("signs", 2))]).where("kind = 0")
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("strong"), F.col("signs")).alias("fingerprint"),
        as_text(F.col("strong1"), F.col("signs1")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("signs1")).alias("near_edited"),
        likeness(F.col("signs"), F.col("signs2")).alias("near_next"),
    )
