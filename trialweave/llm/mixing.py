"""Mixing sources to target weights: a token budget goes down a domain-language-source tree, and leaves give prefixes of seeded epochs.

The budget of a node is divided among its children by weight. A child cannot take more
than ``max_epochs`` times the tokens below it; what it leaves goes to its siblings by
weight, so a shortage stays among siblings as long as they can take it, and only what a
whole subtree cannot take goes to the subtree's own siblings. Shares are whole tokens: parts
are rounded down, and the tokens left over go one each to those that lost most by it, so
the leaves' budgets add up to the total (or to all that there is, if that is less).

A leaf with budget b and t tokens gives ``b // t`` whole epochs and of the next one the
prefix of ``b % t`` tokens, the last document of which is cut. Epoch e orders the leaf's documents by
the md5 of ``seed``, e and doc_id. The prefix is found from token sums of the
``BINS`` ranges of that md5; only documents in the range where the prefix ends are put in
order, so no task holds a leaf, however large. The result for a leaf is one cut point, and
a document's copies follow from its own md5 and the cut of its leaf: the texts are not
shuffled, unless there are more than ``BROADCAST_LEAVES`` leaves.

Edge cases: null domain, language or source are values of their own; a null or empty text
has no tokens and comes in no whole epoch's count, so it is taken with the prefix it falls
in; rows with equal ids are taken together, and where a prefix ends among them each of the k
rows with tokens gives the k-th part of what is left, rounded down, or all it has if that is less; a weight that is missing is 1, a
weight of 0 gives nothing; an empty table gives no rows; extra columns stay in
:func:`mix`, except for those named ``_mix_*``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.scratch import materialize

BINS = 4096
BROADCAST_LEAVES = 50_000
SEED = 20240229
#: Target weights of the domains and languages of the test corpus; sources weigh alike.
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The test corpus has no domains: every five sources, by their number, make one."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("domain"), F.when(number == "", F.lit(0)).otherwise(F.floor(F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) as int)") / 5) % 4).cast("string"))


def _weight(column: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1).cast("bigint")
    for name, weight in weights.items():
        out = F.when(column == name, F.lit(weight).cast("bigint")).otherwise(out)
    return out


def divide(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``share`` to rows with parent columns, ``budget`` of the parent, ``weight`` and ``capacity``.

    Children in order of capacity by weight take all they can, while that is no more than
    their part by weight of what is left; the others divide the rest by weight.
    """
    group = Window.partitionBy(*parent)
    order = group.orderBy(F.col("capacity") / F.col("weight"), F.col(name))
    nodes = nodes.withColumn("_c", F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nodes = nodes.withColumn("_w", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    nodes = nodes.withColumn("_full", F.col("capacity").cast("decimal(38,0)") * F.col("_w") <= (F.col("budget") - F.col("_c")).cast("decimal(38,0)") * F.col("weight"))
    # capacity by weight ascends, so the full ones come first
    nodes = nodes.withColumn("_full", F.min(F.col("_full").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(group), F.lit(0))
    among = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(group)
    nodes = nodes.withColumn("_left", left).withColumn("_among", among)
    exact = F.col("_left").cast("decimal(38,0)") * F.col("weight")
    nodes = nodes.withColumn("_part", F.when(~F.col("_full"), F.floor(exact / F.col("_among")).cast("bigint")))
    nodes = nodes.withColumn("_lost", F.when(~F.col("_full"), (exact - F.col("_part").cast("decimal(38,0)") * F.col("_among")).cast("bigint")))
    # whole tokens that rounding left: fewer than there are children that share
    over = F.col("_left") - F.sum("_part").over(group)
    rank = F.row_number().over(group.orderBy(F.desc_nulls_last("_lost"), F.col(name)))
    nodes = nodes.withColumn("_more", F.when(rank <= over, 1).otherwise(0))
    nodes = nodes.withColumn("share", F.when(F.col("_full"), F.col("capacity")).otherwise(F.col("_part") + F.col("_more")))
    return nodes.drop("_c", "_w", "_full", "_left", "_among", "_part", "_lost", "_more")


def budgets(leaves: DataFrame, total: int, max_epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens and the weights w_domain, w_lang, w_source) with ``budget``."""
    tree = leaves.where("w_domain > 0 and w_lang > 0 and w_source > 0").withColumn("capacity", F.col("tokens") * max_epochs)
    held = tree.withColumnRenamed("capacity", "_cap")
    for depth in range(1, len(LEVELS) + 1):
        path, parent, name = list(LEVELS[:depth]), list(LEVELS[: depth - 1]), LEVELS[depth - 1]
        nodes = held.groupBy(*path).agg(F.sum("_cap").alias("capacity"), F.max(f"w_{name}").alias("weight"))
        if depth == 1:
            nodes = nodes.withColumn("budget", F.lit(total).cast("bigint")).withColumn("_root", F.lit(1))
            parent = ["_root"]
        else:
            above = given.select(*[F.col(p).alias(f"_{p}") for p in parent], F.col("share").alias("budget"))
            nodes = nodes.join(above, [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in parent]).drop(*[f"_{p}" for p in parent])
        given = divide(nodes, parent, name)
    return given.select(*LEVELS, F.col("share").alias("budget"))


def _order(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def plan(docs: DataFrame, total: int | None = None, share: float = 1.0, max_epochs: int = 4, seed: int = SEED, domain: Column | None = None, domain_weights: dict[str, int] | None = None, language_weights: dict[str, int] | None = None, source_weights: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Measures of each document (no text), and of each leaf: tokens, budget, epochs, remainder, cut point, and the key where the prefix ends with the tokens that each of its rows gives.

    ``total``: tokens to give; by default ``share`` of all tokens of ``docs``.
    """
    domain = domain_of(F.col("source")) if domain is None else domain
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")
    measured = materialize(docs.select("doc_id", domain.alias("domain"), "lang", "source", words.alias("n_tokens")), "mix-measures")
    leaves = measured.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    leaves = leaves.select("*", _weight(F.col("domain"), DOMAIN_WEIGHTS if domain_weights is None else domain_weights).alias("w_domain"), _weight(F.col("lang"), LANGUAGE_WEIGHTS if language_weights is None else language_weights).alias("w_lang"), _weight(F.col("source"), source_weights or {}).alias("w_source"))
    leaves = materialize(leaves, "mix-leaves")
    if total is None:
        total = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * share)
    given = _null_safe(leaves.drop("w_domain", "w_lang", "w_source"), budgets(leaves, total, max_epochs), "budget")
    given = given.withColumn("budget", F.coalesce("budget", F.lit(0)))
    given = given.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("bigint"))
    given = materialize(given.withColumn("remainder", F.col("budget") - F.col("epochs") * F.col("tokens")), "mix-budgets")
    marked = _join_leaves(measured, given.select(*LEVELS, "epochs", "remainder"))
    marked = marked.withColumn("_key", _order(seed, F.col("epochs") + 1)).withColumn("_bin", F.substring("_key", 1, 3))
    leaf = Window.partitionBy(*LEVELS)
    bins = marked.groupBy(*LEVELS, "_bin").agg(F.sum("n_tokens").alias("_in"), F.first("remainder").alias("remainder"))
    bins = bins.withColumn("_to", F.sum("_in").over(leaf.orderBy("_bin")))
    # the first range that goes over the remainder; ranges before it are taken whole
    over = bins.where("_to > remainder").groupBy(*LEVELS).agg(F.min(F.struct("_bin", (F.col("_to") - F.col("_in")).alias("_before"))).alias("_x"))
    over = materialize(over.select(*LEVELS, F.col("_x._bin").alias("cut_bin"), F.col("_x._before").alias("_before")), "mix-ranges")
    last = _join_leaves(marked, over).where(F.col("_bin") == F.col("cut_bin"))
    running = F.sum("n_tokens").over(leaf.orderBy("_key"))  # a range frame: equal keys count together
    last = materialize(last.withColumn("_sum", F.col("_before") + running).select(*LEVELS, "_key", "_sum", "_before", "n_tokens", "remainder"), "mix-last")
    cuts = last.groupBy(*LEVELS).agg(F.max(F.when(F.col("_sum") <= F.col("remainder"), F.col("_key"))).alias("cut_key"), F.min(F.when(F.col("_sum") > F.col("remainder"), F.col("_key"))).alias("end_key"), F.coalesce(F.max(F.when(F.col("_sum") <= F.col("remainder"), F.col("_sum"))), F.max("_before")).alias("_taken"), F.max("remainder").alias("_of"))
    end = _join_leaves(last.where("n_tokens > 0").select(*LEVELS, "_key"), cuts.select(*LEVELS, "end_key", "_taken", "_of")).where("_key = end_key").groupBy(*LEVELS).agg(F.floor((F.max("_of") - F.max("_taken")) / F.count(F.lit(1))).cast("bigint").alias("end_tokens"))
    given = _null_safe(_null_safe(_null_safe(given, over.drop("_before"), "cut_bin"), cuts, "cut_key", "end_key"), end, "end_tokens")
    return measured, materialize(given, "mix-cuts")


def _null_safe(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """Left join on the levels, in which null equals null."""
    right = right.select(*[F.col(x).alias(f"_{x}") for x in LEVELS], *columns)
    return left.join(right, [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in LEVELS], "left").drop(*[f"_{x}" for x in LEVELS])


def _join_leaves(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """Inner join on the levels; leaves are broadcast up to a number of rows."""
    names = [c for c in leaves.columns if c not in LEVELS]
    right = leaves.select(*[F.col(x).alias(f"_{x}") for x in LEVELS], *names)
    few = right.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    on = [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in LEVELS]
    return docs.join(F.broadcast(right) if few else right, on).drop(*[f"_{x}" for x in LEVELS])


_CUT = ("epochs", "remainder", "cut_bin", "cut_key", "end_key", "end_tokens")


def _taken(seed: int, at: str = "") -> tuple[Column, Column]:
    """Whole copies of a row, and the tokens of one more that is cut, from the columns of its leaf (with a prefix to their names)."""
    c = lambda name: F.col(f"{at}{name}")
    key = _order(seed, c("epochs") + 1)
    in_prefix = c("cut_bin").isNull() | (F.substring(key, 1, 3) < c("cut_bin")) | F.coalesce(key <= c("cut_key"), F.lit(False))
    copies = c("epochs") + F.when((c("remainder") > 0) & in_prefix, 1).otherwise(0)
    return copies.cast("bigint"), F.when((c("remainder") > 0) & F.coalesce(key == c("end_key"), F.lit(False)), c("end_tokens")).otherwise(F.lit(0).cast("bigint"))


def copies(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies, cut_tokens (of one more copy that is cut), leaf_budget for every document."""
    measured, leaves = plan(docs, seed=seed, **options)
    joined = _join_leaves(measured, leaves.select(*LEVELS, "budget", *_CUT))
    whole, cut = _taken(seed)
    return joined.select("doc_id", *LEVELS, "n_tokens", whole.alias("copies"), F.least(cut, F.col("n_tokens")).alias("cut_tokens"), F.col("budget").alias("leaf_budget"))


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    words = F.lit("[^\\x20\\x09-\\x0D]+")
    spaces = F.split(F.regexp_replace(text, words, "\u0001"), "\u0001")  # what stands before, between and behind words
    kept = F.zip_with(F.slice(spaces, 1, n.cast("int")), F.slice(F.regexp_extract_all(text, words, F.lit(0)), 1, n.cast("int")), lambda a, b: F.concat(a, b))
    return F.array_join(kept, "")


def mix(docs: DataFrame, seed: int = SEED, domain: Column | None = None, **options) -> DataFrame:
    """``docs`` in the target mixture: each row as often as its leaf's epochs take it, and the last of a leaf's prefix with its first words only, so that each leaf gives its budget."""
    domain = domain_of(F.col("source")) if domain is None else domain
    _, leaves = plan(docs, seed=seed, domain=domain, **options)
    right = leaves.select(*[F.col(x).alias(f"_mix_{x}") for x in (*LEVELS, *_CUT)])
    if leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES:
        right = F.broadcast(right)
    on = domain.eqNullSafe(F.col("_mix_domain")) & F.col("lang").eqNullSafe(F.col("_mix_lang")) & F.col("source").eqNullSafe(F.col("_mix_source"))
    whole, cut = _taken(seed, "_mix_")
    taken = docs.join(right, on).withColumn("_mix_times", whole.cast("int")).withColumn("_mix_cut", F.when(cut > 0, cut))
    copies_of = F.transform(F.when(F.col("_mix_times") > 0, F.sequence(F.lit(1), F.col("_mix_times"))).otherwise(F.array().cast("array<int>")), lambda _k: F.lit(0).cast("bigint"))
    taken = taken.where("_mix_times > 0 or _mix_cut is not null")
    taken = taken.withColumn("_mix_copy", F.explode(F.concat(copies_of, F.when(F.col("_mix_cut").isNotNull(), F.array("_mix_cut")).otherwise(F.array().cast("array<bigint>")))))
    text = F.when(F.col("_mix_copy") > 0, first_words(F.col("text"), F.col("_mix_copy"))).otherwise(F.col("text"))
    return taken.withColumn("text", text).select(*docs.columns)


_SPLIT = """
{out}_0 AS (SELECT *, coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY capacity / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
  sum(weight) OVER (PARTITION BY {parent} ORDER BY capacity / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM {nodes}),
{out}_1 AS (SELECT *, min(CASE WHEN CAST(capacity AS HUGEINT) * w <= CAST(budget - c AS HUGEINT) * weight THEN 1 ELSE 0 END) OVER (PARTITION BY {parent} ORDER BY capacity / weight, {name} ROWS UNBOUNDED PRECEDING) AS is_full FROM {out}_0),
{out}_2 AS (SELECT *, CAST(budget AS HUGEINT) - coalesce(sum(CASE WHEN is_full = 1 THEN capacity END) OVER (PARTITION BY {parent}), 0) AS rest, sum(CASE WHEN is_full = 0 THEN weight END) OVER (PARTITION BY {parent}) AS among FROM {out}_1),
{out}_3 AS (SELECT *, CASE WHEN is_full = 0 THEN rest * weight // among END AS part, CASE WHEN is_full = 0 THEN rest * weight % among END AS lost FROM {out}_2),
{out}_4 AS (SELECT *, rest - sum(part) OVER (PARTITION BY {parent}) AS over, row_number() OVER (PARTITION BY {parent} ORDER BY lost DESC NULLS LAST, {name}) AS place FROM {out}_3),
{out} AS (SELECT * EXCLUDE (c, w, is_full, rest, among, part, lost, over, place), CAST(CASE WHEN is_full = 1 THEN capacity ELSE part + CASE WHEN place <= over THEN 1 ELSE 0 END END AS BIGINT) AS share FROM {out}_4),
"""

ORACLE = (
    """
WITH measured AS (
  SELECT doc_id, 'domain' || CAST((coalesce(TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1), '') AS INTEGER), 0) // 5) % 4 AS VARCHAR) AS domain, lang, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), leaves AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END AS w_domain,
    CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS w_lang FROM measured GROUP BY ALL
), n1 AS (SELECT 1 AS root, domain, sum(tokens * 4) AS capacity, max(w_domain) AS weight, (SELECT sum(tokens) FROM leaves) AS budget FROM leaves GROUP BY domain),"""
    + _SPLIT.format(out="g1", parent="root", name="domain", nodes="n1")
    + "n2 AS (SELECT domain, lang, sum(tokens * 4) AS capacity, max(w_lang) AS weight, max(share) AS budget FROM leaves JOIN g1 USING (domain) GROUP BY domain, lang),"
    + _SPLIT.format(out="g2", parent="domain", name="lang", nodes="n2")
    + "n3 AS (SELECT domain, lang, source, tokens * 4 AS capacity, 1 AS weight, share AS budget FROM leaves JOIN g2 USING (domain, lang)),"
    + _SPLIT.format(out="g3", parent="domain, lang", name="source", nodes="n3")
    + """
given AS (SELECT domain, lang, source, share AS budget, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN share % tokens ELSE share END AS remainder FROM g3 JOIN leaves USING (domain, lang, source)),
ordered AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('20240229|' || CAST(epochs + 1 AS VARCHAR) || '|' || CAST(doc_id AS VARCHAR))) AS upto FROM measured JOIN given USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN remainder > 0 AND upto <= remainder THEN 1 ELSE 0 END AS BIGINT) AS copies,
  CAST(CASE WHEN remainder > 0 AND upto > remainder AND upto - n_tokens < remainder THEN remainder - (upto - n_tokens) ELSE 0 END AS BIGINT) AS cut_tokens, CAST(budget AS BIGINT) AS leaf_budget FROM ordered
"""
)
