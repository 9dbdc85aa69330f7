"""Line dedup by a segment-partition edit join: lines within ``EDITS`` edits of one another are one class.

Equal lines are one line first. A line of n characters is cut into ``EDITS + 1`` segments
of near equal length. Of two lines within ``EDITS`` edits, the longer holds at least one
segment of the shorter unchanged, at a place that the segment's number and the difference
in length bound. So each line is posted under its own segments and probes with those
substrings of its own that could be a segment of a line of its length, or up to ``EDITS``
characters shorter; a segment's length and number tell the lengths of the lines that have
it, so the index need not name them. A text of at most ``EDITS`` characters has no
segments: it is posted under a key of all such texts, which texts of at most
``2 * EDITS`` characters probe.

A key with more than ``LIST`` lines makes no pairs. What its lines have beside the shared
segment is within ``EDITS`` edits too for every link, so these rests are joined in the same
way, within the key, as often as needed. Before, the longest common begin and end of all
rests of a key are taken off (they follow from the least and the greatest rest, forwards
and backwards), so that the next segments lie where the lines differ. So a line meets at
most ``LIST`` others for each of its keys, however many lines share a footer, and a key is
never one task's group: counts, minima and joins are all that is made of it.

Counts of letters tell most pairs that meet apart: of a few letters in the join itself, which
makes no row of lines that only share a segment, then of more beside the text. The others are
verified by a banded bit-parallel automaton: a set of bits for each number of edits has the diagonals of the
band that are reachable, and all sets move by one character in a few bit operators on one
bigint. Pairs of rests are verified at once, so few whole lines are. Everything is joins
and expressions; the text of the lines is shuffled once by line, and then only for pairs
that meet.

Links are pairs of different lines, so a line has no more of them than there are different
lines within ``EDITS`` edits; copies make none.

Edge cases: empty lines are not lines; a null or empty text has none; a line of fewer than
``min_chars`` characters is linked with nothing, and its class is its copies (1 links all
lines, as the query does; the default leaves out lines of which two edits are a large
part, as nearly all of the shortest lines hang together); rows of one doc_id each have
their lines, and equal places among them are ties, of which all are kept; a row without
doc_id comes first; an empty table gives no rows; extra columns are not read. Lines are
told apart by 128-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trialweave.llm.components import components
from trialweave.llm.scratch import materialize

EDITS = 2
MIN_CHARS = 20
#: Lines that may meet all others of a key; with more, their rests are joined.
LIST = 128
#: Letters whose counts tell most texts apart before they are verified, common ones in several languages.
LETTERS = "eanirtsohd"
#: A line's shape has its length modulo 16, then counts of the first letters in so many bits each; a probe's has OWN if the key is one of the line's own.
SHAPE_LETTERS, SHAPE_BITS, OWN = LETTERS[:5], 5, 1 << 29


def _segments(length: int, base: int, edits: int) -> list[tuple[int, int, int]]:
    """Number, place (from 1) and length of each segment of a text of ``length`` characters, the last ones longer by one.

    As for a text with ``base`` times ``edits + 1`` characters more: place and length are given less
    ``base * (number - 1)`` and ``base``.
    """
    parts = edits + 1
    short, longer = divmod(length, parts)
    out = []
    for i in range(1, parts + 1):
        before = max(0, i - 1 - (parts - longer))
        out.append((i, (short - base) * (i - 1) + before + 1, short - base + (i > parts - longer)))
    return out


def slots(residue: int, edits: int) -> tuple[list[tuple[int, int, int]], dict[tuple[int, int, int], int]]:
    """For texts of ``residue`` characters beyond a multiple of ``edits + 1``: their own segments, and the other
    substrings that they probe, each with the least number of characters by which a line that has it is shorter.
    """
    parts = edits + 1
    base = 10  # any number will do
    length = base * parts + residue
    own, probed = _segments(length, base, edits), {}
    for shorter in range(edits + 1):
        for i, at, size in _segments(length - shorter, base, edits):
            low, high = max(-(i - 1), shorter - (parts - i)), min(i - 1, shorter + parts - i)
            for move in range(low, high + 1):
                slot = i, at + move, size
                if slot not in own:
                    probed[slot] = min(shorter, probed.get(slot, shorter))
    return own, probed


def _entries(edits: int, probes: bool, places: bool) -> Column:
    """Array of keys (with ``places``: structs of key, at and size) of ``rest`` (n characters, also as ``bytes``) under ``prefix``.

    The text's own keys come first, ``edits + 1`` of them, or one for a text without segments; with ``probes`` then the others, of which some are null.
    """
    parts = edits + 1

    def entry(number: int, at: str, size: str) -> str:
        # a substring of bytes where each character is one need not count characters
        cut = f"if(n = octet_length(rest), substring(bytes, {at}, {size}), cast(substring(rest, {at}, {size}) as binary))"
        key = f"xxhash64(prefix, {number}, {cut})"
        return f"named_struct('key', {key}, 'at', {at}, 'size', {size})" if places else key

    everything = entry(0, "1", "0")  # the key of all short texts
    cases = []
    for residue in range(parts):
        own, probed = slots(residue, edits)
        place = lambda i, at, size: entry(i, f"(n div {parts}) * {i - 1} + {at}", f"(n div {parts}) + {size}")
        exprs = [place(*slot) for slot in own]
        if probes:
            exprs += [f"if(n >= {parts + least}, {place(*slot)}, null)" for slot, least in probed.items()]
            exprs.append(f"if(n <= {2 * edits}, {everything}, null)")
        cases.append(f"when {residue} then array({', '.join(exprs)})")
    return F.expr(f"if(n <= {edits}, array({everything}), case n % {parts} {' '.join(cases)} end)")


def _flat(texts: DataFrame) -> DataFrame:
    return texts.withColumn("n", F.length("rest")).withColumn("bytes", F.col("rest").cast("binary"))


def _hot(texts: DataFrame, edits: int, most: int) -> DataFrame:
    """Keys with more than ``most`` postings of different texts, but for those of texts without segments: near texts all.

    ``texts`` may have copies: only keys that are frequent with them are counted without.
    """
    postings = _flat(texts).where(F.col("n") > edits).select(F.explode(_entries(edits, False, False)).alias("key"), "id")
    often = materialize(postings.groupBy("key").count().where(F.col("count") > most).select("key"), "line-often")
    if often.isEmpty():
        return often
    counted = postings.join(often, "key").distinct().groupBy("key").count()
    return materialize(counted.where(F.col("count") > most).select("key"), "line-keys")


def _rests(texts: DataFrame, hot: DataFrame, edits: int) -> DataFrame:
    """id, prefix (the hot key) and rest of the texts that have a key in ``hot``, less the begin and end that all rests of the key have."""
    every = _flat(texts).select("id", "prefix", F.xxhash64("rest").alias("form"), F.explode(_entries(edits, True, True)).alias("e")).where("e is not null")
    # narrow rows first: texts travel only for what has such a key
    held = materialize(every.select("id", "prefix", "form", "e.*").join(hot, "key").distinct(), "line-hot")
    own = texts.withColumn("form", F.xxhash64("rest"))
    rest = F.expr("concat(substring(rest, 1, at - 1), substring(rest, at + size))")
    joined = materialize(held.join(own, ["id", "prefix", "form"]).select("id", "key", rest.alias("rest")).distinct(), "line-rests")
    back = F.reverse("rest")
    ends = joined.groupBy("key").agg(F.min("rest").alias("a"), F.max("rest").alias("b"), F.min(back).alias("c"), F.max(back).alias("d"), F.min(F.length("rest")).alias("least"))
    begin, end = _common(F.col("a"), F.col("b")), _common(F.col("c"), F.col("d"))
    ends = ends.select("key", begin.alias("begin"), F.least(end, F.col("least") - begin).alias("end"))
    core = F.expr("substring(rest, begin + 1, length(rest) - begin - end)")
    return materialize(joined.join(materialize(ends, "line-ends"), "key").select("id", F.col("key").alias("prefix"), core.alias("rest")), "line-cores")


def _common(a: Column, b: Column) -> Column:
    """Characters that two texts have in common at their begin."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    differ = F.array_position(same, False)
    return F.when(a == b, F.length(a)).otherwise(F.greatest(differ - 1, F.lit(0))).cast("int")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is made once: in a lambda, what is no variable is made again for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _same(x: Column, y: Column) -> Column:
    """Elements that two arrays have in common at their begin."""
    differ = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
    return F.when(differ == 0, F.size(x)).otherwise(differ - 1).cast("int")


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two texts, of which ``b`` is not the shorter, are within so many edits.

    Their common begin and end are left out. Lane e of the state, of 2 * edits + 1 bits, has the diagonals
    on which the part of ``a`` read so far is within e edits of that part of ``b`` which ends there. A
    character keeps the diagonals on which it is equal; one edit more replaces it, leaves it out (a diagonal
    down), or takes one more of ``b`` (a diagonal up).
    """
    width, lanes = 2 * edits + 1, edits + 1
    if width * lanes > 63:
        raise ValueError("at most 4 edits fit a bigint")
    each = sum(1 << (width * e) for e in range(lanes))
    below_last = (1 << (width * edits)) - 1
    not_bottom = each * ((1 << width) - 2)

    def both(p: Column, mask: int) -> Column:
        return p.bitwiseAND(F.lit(mask).cast("bigint"))

    def inserted(s: Column) -> Column:
        out = s
        for e in range(1, edits + 1):  # e more characters of b: e lanes on, e diagonals up
            free = (each * ((1 << (width - e)) - 1)) & ((1 << (width * (lanes - e))) - 1)
            out = out.bitwiseOR(F.shiftleft(both(s, free), e * (width + 1)))
        return out

    def step(s: Column, mask: Column) -> Column:
        s = inserted(s)
        return s.bitwiseAND(mask).bitwiseOR(F.shiftleft(both(s, below_last), width)).bitwiseOR(F.shiftleft(both(s, below_last & not_bottom), width - 1))

    def diagonals(y: Column, c: Column, i: Column) -> Column:
        bits = [F.when(F.get(y, i + d) == c, F.lit(each << (d + edits)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for d in range(-edits, edits + 1)]
        return sum(bits[1:], bits[0])

    def run(x: Column, y: Column) -> Column:
        masks = F.transform(x, lambda c, i: diagonals(y, c, i))
        end = F.aggregate(masks, F.lit(each << edits).cast("bigint"), step, inserted)
        return F.call_function("shiftright", end, F.size(y) - F.size(x) + F.lit(width * edits + edits)).bitwiseAND(F.lit(1)) == 1

    def inner(x: Column, y: Column, begin: Column, end: Column) -> Column:
        return _let(F.slice(y, begin + 1, F.size(y) - begin - end), lambda rest: run(F.slice(x, begin + 1, F.size(x) - begin - end), rest))

    def ends(x: Column, y: Column, begin: Column) -> Column:
        return _let(F.least(_same(F.reverse(x), F.reverse(y)), F.size(x) - begin), lambda end: inner(x, y, begin, end))

    found = _let(F.split(a, ""), lambda x: _let(F.split(b, ""), lambda y: _let(_same(x, y), lambda begin: ends(x, y, begin))))
    gap = F.length(b) - F.length(a)
    return F.when((F.length(a) == 0) | (gap > edits), gap <= edits).otherwise(found)


def letter_counts(text: str, letters: str = LETTERS, bits: int = 6) -> Column:
    """How often each of ``letters`` is in a text, modulo ``2 ** bits``, side by side in one bigint."""
    counts = [f"shiftleft(cast((octet_length({text}) - octet_length(replace({text}, '{c}', ''))) & {(1 << bits) - 1} as bigint), {bits * k})" for k, c in enumerate(letters)]
    return F.expr(" | ".join(counts))


def may_be_near(a: Column, b: Column, edits: int, letters: str = LETTERS, bits: int = 6) -> Column:
    """One edit takes a letter away, brings one, or both; so counts of near texts differ by ``2 * edits`` in all at most."""
    most = (1 << bits) - 1
    gaps = [(F.shiftright(a, bits * k).bitwiseAND(F.lit(most)) - F.shiftright(b, bits * k).bitwiseAND(F.lit(most))).bitwiseAND(F.lit(most)) for k in range(len(letters))]
    return sum((F.least(g, most + 1 - g) for g in gaps[1:]), F.least(gaps[0], most + 1 - gaps[0])) <= 2 * edits


def shape(text: str) -> Column:
    """Length and some letter counts of a text in one int: what goes along with each of its keys."""
    counts = F.shiftleft(letter_counts(text, SHAPE_LETTERS, SHAPE_BITS), 4)
    return counts.bitwiseOR(F.length(text).bitwiseAND(F.lit(15)).cast("bigint")).cast("int")


def _gap(a: Column, b: Column) -> Column:
    """Characters by which the text of shape ``b`` is longer, from -8 to 7: near texts have at most 4."""
    return (b.bitwiseAND(F.lit(15)) - a.bitwiseAND(F.lit(15)) + 8).bitwiseAND(F.lit(15)) - 8


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0, empty lines count), line, line_id of every line."""
    lines = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return lines.where("line <> ''").withColumn("line_id", F.struct(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")))


def _meet(texts: DataFrame, hot: DataFrame | None, edits: int, verify: bool = False) -> DataFrame:
    """a, b (a < b): texts of which one is posted under a key, not in ``hot``, that the other is posted under or probes.

    ``verify``: only those within ``edits`` edits, for short texts that may travel with their keys.
    """
    more = ["rest", "letters"] * verify
    if "shape" not in texts.columns:
        texts = texts.withColumn("shape", shape("rest"))
    if verify:
        texts = texts.withColumn("letters", letter_counts("rest"))
    # a struct's fields take less room in a shuffle than the struct
    kind = texts.schema["id"].dataType
    names = kind.names if isinstance(kind, StructType) else []

    def fields(c: str) -> list[Column]:
        return [F.col(f"id.{x}").alias(f"{c}_{x}") for x in names] or [F.col("id").alias(c)]

    a, b = (F.struct(*[F.col(f"{c}_{x}").alias(x) for x in names]) if names else F.col(c) for c in "ab")
    flat = _flat(texts)
    held = flat.select(F.explode(_entries(edits, False, False)).alias("key"), *fields("a"), F.col("shape").alias("shape_a"), *[F.col(c).alias(f"{c}_a") for c in more])
    if hot is not None:
        held = held.join(hot, "key", "left_anti")
    asked = flat.select(F.posexplode(_entries(edits, True, False)).alias("at", "key"), *fields("b"), "n", "shape", *more).where("key is not null")
    own = F.col("at") < F.when(F.col("n") <= edits, 1).otherwise(edits + 1)
    asked = asked.withColumn("shape", F.when(own, F.col("shape").bitwiseOR(F.lit(OWN))).otherwise(F.col("shape"))).drop("at", "n")
    gap = _gap(F.col("shape_a"), F.col("shape"))
    counts = [F.shiftright(c, 4) for c in ("shape_a", "shape")]
    # of two texts that are posted, each meets the other
    once = F.when(F.col("shape") >= OWN, (gap >= -edits) & (a < b)).otherwise(gap >= 0)
    met = held.join(asked, "key").where((gap <= edits) & may_be_near(*counts, edits, SHAPE_LETTERS, SHAPE_BITS) & (a != b) & once)
    if verify:
        met = met.where(may_be_near(F.col("letters_a"), F.col("letters"), edits) & _near("rest_a", "rest", edits))
    return met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def _near(a: str, b: str, edits: int) -> Column:
    swap = F.length(a) > F.length(b)
    return within(F.when(swap, F.col(b)).otherwise(F.col(a)), F.when(swap, F.col(a)).otherwise(F.col(b)), edits)


def links(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """a, b: ids of distinct lines within ``edits`` edits, each pair once."""
    every = occurrences(docs).where(F.length("line") >= min_chars)
    # one struct: all that use these lines share one shuffle, whichever of the two they need
    lines = every.groupBy("line_id").agg(F.first(F.struct(F.col("line").alias("rest"), shape("line").alias("shape"))).alias("text"))
    texts = lines.select(F.col("line_id").alias("id"), F.lit(0).cast("bigint").alias("prefix"), "text.*")
    # with copies, as that takes no shuffle of texts
    rows = every.select(F.col("line_id").alias("id"), F.lit(0).cast("bigint").alias("prefix"), F.col("line").alias("rest"))
    hot, met = _hot(rows, edits, LIST), []
    first = now = None if hot.isEmpty() else hot
    while now is not None:
        rests = _rests(rows, now, edits).distinct()
        hot, rows = _hot(rests, edits, LIST), rests
        now = None if hot.isEmpty() else hot
        met.append(materialize(_meet(rests, now, edits, verify=True).distinct(), "line-pairs"))
    pairs = _meet(texts, first, edits)
    for more in met:
        pairs = pairs.union(more)
    # a row an end, so that the lines are read once for both
    ends = pairs.distinct().select("a", "b", F.explode(F.array("a", "b")).alias("line_id")).join(lines, "line_id")
    both = ends.groupBy("a", "b").agg(*[F.max(F.when(F.col("line_id") == F.col(c), F.col("text.rest"))).alias(f"line_{c}") for c in "ab"])
    counts = [letter_counts(c) for c in ("line_a", "line_b")]
    return both.where(may_be_near(*counts, edits) & _near("line_a", "line_b", edits)).select("a", "b")


def line_classes(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, line_no, class_doc_id, class_line_no, n_links, kept for every line.

    The class is named by its first line in the order of (doc_id, line_no), which alone is
    kept; n_links counts the distinct other lines within ``edits`` edits of the line.
    """
    linked = materialize(links(docs, edits, min_chars), "line-links")
    n_links = linked.select(F.explode(F.array("a", "b")).alias("line_id")).groupBy("line_id").agg(F.count(F.lit(1)).alias("n_links"))
    places = materialize(occurrences(docs).select("doc_id", "line_no", "line_id"), "line-places")
    counted = places.groupBy("line_id").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"))
    members = components(linked).withColumnRenamed("node", "line_id").join(n_links, "line_id")
    # a line that occurs once and is near no other is its own class: only the others need be looked up
    special = materialize(counted.join(members, "line_id", "left").where("n > 1 or component is not null"), "line-members")
    linked_lines, copies = special.where("component is not null"), special.where("component is null")
    heads = linked_lines.groupBy("component").agg(F.min("first").alias("head"))
    special = linked_lines.join(heads, "component").select("line_id", "head", "n_links").union(copies.select("line_id", "first", "n_links"))
    # tables on both sides of the last join: the partition of a very frequent line can be split
    out = places.join(materialize(special, "line-heads"), "line_id", "left")
    own = F.struct("doc_id", "line_no")
    out = out.select("doc_id", "line_no", F.coalesce("head", own).alias("head"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    kept = F.struct("doc_id", "line_no") == F.col("head")
    return out.select("doc_id", "line_no", F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").alias("class_line_no"), "n_links", kept.alias("kept"))


def deduplicate(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the lines that are kept; a text's empty lines stay. Ids must tell rows apart."""
    gone = line_classes(docs, edits, min_chars).where("not kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone"))
    gone = gone.withColumnRenamed("doc_id", "_gone_id")
    kept = F.array_join(F.filter(F.transform(F.split("text", "\n"), lambda x, k: F.when(~F.array_contains(F.col("_gone"), k), x)), lambda x: x.isNotNull()), "\n")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone_id"]), "left").withColumn("text", text).select(*docs.columns)


#: DuckDB's distance is one of bytes: characters beyond ASCII, if there are at most 26 of them, are put on control characters first.
ORACLE = """
WITH RECURSIVE t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), o AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS line_no, lines[k] AS line FROM t, unnest(range(1, CAST(len(lines) + 1 AS BIGINT))) AS u(k) WHERE lines[k] <> ''
), wide AS (SELECT DISTINCT unnest(string_split(regexp_replace(line, '[\\x00-\\x7F]', '', 'g'), '')) AS c FROM o
), ranked AS (SELECT c, row_number() OVER (ORDER BY c) AS r FROM wide WHERE c <> ''
), m AS (SELECT coalesce(string_agg(c, '' ORDER BY r), '') AS a, coalesce(string_agg(chr(CAST(r + CASE WHEN r > 8 THEN 5 ELSE 0 END AS INTEGER)), '' ORDER BY r), '') AS b FROM ranked
), d AS (SELECT line, length(line) AS n, translate(line, a, b) AS flat, min((doc_id, line_no)) AS place, row_number() OVER (ORDER BY line) AS id FROM o, m GROUP BY line, a, b
), near AS (SELECT x.id AS a, y.id AS b FROM d x JOIN d y ON y.n >= x.n AND y.n <= x.n + 2 WHERE x.id <> y.id AND (y.n > x.n OR x.id < y.id) AND levenshtein(x.flat, y.flat) <= 2
), links AS (SELECT a, b FROM near UNION SELECT b, a FROM near
), reach(node, other) AS (SELECT id, id FROM d UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other
), heads AS (SELECT node, min(place) AS head FROM reach JOIN d ON d.id = other GROUP BY node
), counted AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, line_no, head[1] AS class_doc_id, head[2] AS class_line_no, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, (doc_id, line_no) = head AS kept
FROM o JOIN d USING (line) JOIN heads ON heads.node = d.id LEFT JOIN counted ON counted.a = d.id
"""
