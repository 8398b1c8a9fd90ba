"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

The leaves of a tree domain - language - source hold the documents. A budget of tokens is handed down level by level: children share
their parent's budget by weight, and what a child can't use (its tokens times the most epochs) goes to its siblings by weight; only
what all children together can't use stays with the parent's siblings, as a parent is never given more than its leaves can hold.
The shares have a closed form over windows: with children sorted by capacity over weight, the common level is the largest of
(budget - capacities before) / (weights from here on), and each child gets the lesser of its capacity and weight times level.

A leaf's share is read as whole epochs and the rest as a token-prefix of one more epoch, whose order is a seeded hash of doc_id.
Prefix sums are taken in two steps, over hash buckets of a leaf and inside a bucket, so no leaf is gathered in one task; the leaf's
share reaches its documents by a salted join.

Very long texts count all their words; other columns, whatever their names, are not read. Null domain, lang or source form leaves of their own (as empty strings). Null texts have 0 tokens; a document without tokens is as
often chosen as its epochs say. Repeated rows are chosen each. Weights of 0 or less, or unknown ones, give nothing. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_in, spare, written

LEVELS = ("domain", "lang", "source")
SALTS, DIGITS = 64, 2

#: Production parameters: the domain is the source's number modulo 4; weights of domains and languages; sources weigh the same.
DOMAIN = "coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 4, 4)"
DOMAIN_WEIGHT = "case domain when '0' then 4.0 when '1' then 3.0 when '2' then 2.0 else 1.0 end"
LANG_WEIGHT = "case when lang = 'en' then 2.0 else 1.0 end"
SOURCE_WEIGHT = "1.0"
WEIGHTS = {"domain": DOMAIN_WEIGHT, "lang": LANG_WEIGHT, "source": SOURCE_WEIGHT}
SHARE, EPOCHS, SEED = 0.5, 2, "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hand_down(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """children: parent's keys, key, cap, weight, budget (the parent's). Adds share: the child's part, in whole tokens."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), key)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    held = children.where("weight > 0").withColumn("level", (F.col("budget") - before) / rest)
    level = F.max("level").over(Window.partitionBy(*parent))
    return held.withColumn("share", F.floor(F.least(F.col("cap").cast("double"), F.col("weight") * level)).cast("long")).drop("level")


def budgets(leaves: DataFrame, budget: DataFrame, epochs: int = EPOCHS, weights: dict[str, str] = WEIGHTS) -> DataFrame:
    """leaves: domain, lang, source, tokens. budget: one row, one column budget. weights: SQL over a level and those above it, a weight for
    each child. Returns each leaf's tokens and share."""
    above = None
    for k, level in enumerate(LEVELS):
        parent = list(LEVELS[:k])
        own = leaves.groupBy(*parent, level).agg((F.sum("tokens") * epochs).alias("cap")).withColumn("weight", F.expr(weights[level]).cast("double"))
        own = own.crossJoin(F.broadcast(budget)) if above is None else own.join(above, parent)
        above = hand_down(own, parent, level).select(*parent, level, F.col("share").alias("budget"))
    return leaves.join(above, list(LEVELS)).withColumnRenamed("budget", "share")


def choose(rows: DataFrame, leaves: DataFrame, seed: str = SEED) -> DataFrame:
    """rows: doc_id, the leaf, n_tokens. leaves: the leaf, tokens, share. Returns the rows with copies > 0."""
    leaf = list(LEVELS)
    salted = leaves.select(*leaf, "tokens", "share", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*leaf, "salt"]).drop("salt")
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("share") / F.col("tokens"))).otherwise(0).cast("long")
    own = own.withColumn("whole", whole).withColumn("rest", F.col("share") - F.col("whole") * F.col("tokens"))
    own = own.withColumn("place", F.md5(F.concat_ws(":", F.lit(seed), F.col("whole"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    own = own.withColumn("bucket", F.substring("place", 1, DIGITS)).drop("share", "tokens")
    own = written(own, "mix")
    sums = own.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("own"))
    earlier = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("own").over(earlier), F.lit(0))).drop("own")
    inside = Window.partitionBy(*leaf, "bucket").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    upto = own.withColumn("upto", F.sum("n_tokens").over(inside)).join(sums, [*leaf, "bucket"])
    return upto.withColumn("copies", F.col("whole") + F.when(F.col("base") + F.col("upto") <= F.col("rest"), 1).otherwise(0)).where("copies > 0").select("doc_id", "row", *leaf, "n_tokens", "copies")


def chosen(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, domain: str = DOMAIN, weights: dict[str, str] = WEIGHTS) -> DataFrame:
    """doc_id, row (a hash of the text), domain, lang, source, n_tokens and copies (how often the document goes into the mix) of the documents chosen.

    The budget is ``share`` of all tokens there are. ``domain`` is SQL over a document's columns that says where in the tree its source
    stands, ``weights`` SQL for the weight of a domain, language or source. Texts are read once and not shuffled.
    """
    narrow = docs.select("doc_id", F.xxhash64("text").alias("row"), F.coalesce(F.expr(f"cast({domain} as string)"), F.lit("")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), n_words(F.col("text")).alias("n_tokens"))
    rows = written(narrow, "mix-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budget = rows.agg(F.floor(F.coalesce(F.sum("n_tokens"), F.lit(0)) * F.lit(float(share))).cast("long").alias("budget"))
    return choose(rows, budgets(leaves, budget, epochs, weights), seed)


def mix(docs: DataFrame, **how) -> DataFrame:  # noqa: ANN003
    """doc_id, domain, lang, source, n_tokens and copies of the documents chosen; ``how`` as in ``chosen``."""
    return chosen(docs, **how).drop("row")


def mixed(docs: DataFrame, **how) -> DataFrame:  # noqa: ANN003
    """The documents chosen, with all their columns and domain, n_tokens and copies (under names of their own where docs has such columns).
    Equal rows of one doc_id are one row, with the copies of all. Only texts that may be chosen are dealt."""
    d, r, domain, n, copies = spare(docs.columns, "_d", "_r", "domain", "n_tokens", "copies")
    picked = chosen(docs, **how).groupBy(F.col("doc_id").alias(d), F.col("row").alias(r)).agg(F.min("domain").alias(domain), F.min("n_tokens").alias(n), F.sum("copies").alias(copies))
    picked = written(picked, "picked")
    (row,) = spare([*docs.columns, d, r, domain, n, copies], "_row")
    near = maybe_in(docs.withColumn(row, F.xxhash64("text")), F.col(row), picked.select(r), picked.count())
    joined = near.join(picked, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(row) == F.col(r)))
    return joined.dropDuplicates([d, r]).drop(d, r, row)


ORACLE = f"""
WITH words AS (SELECT doc_id, CAST(coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 4, 4) AS VARCHAR) AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT), 0) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM words GROUP BY ALL),
b AS (SELECT CAST(floor(sum(n_tokens) * CAST({SHARE} AS DOUBLE)) AS BIGINT) AS budget FROM words),
d0 AS (SELECT domain, CAST(sum(tokens) * {EPOCHS} AS BIGINT) AS cap, CAST({DOMAIN_WEIGHT} AS DOUBLE) AS w FROM leaves GROUP BY domain),
d1 AS (SELECT *, ((SELECT budget FROM b) - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM d0),
d2 AS (SELECT domain, CAST(floor(least(CAST(cap AS DOUBLE), w * max(level) OVER ())) AS BIGINT) AS budget FROM d1),
l0 AS (SELECT domain, lang, CAST(sum(tokens) * {EPOCHS} AS BIGINT) AS cap, CAST({LANG_WEIGHT} AS DOUBLE) AS w FROM leaves GROUP BY domain, lang),
l1 AS (SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l0 JOIN d2 USING (domain)),
l2 AS (SELECT domain, lang, CAST(floor(least(CAST(cap AS DOUBLE), w * max(level) OVER (PARTITION BY domain))) AS BIGINT) AS budget FROM l1),
s0 AS (SELECT domain, lang, source, tokens * {EPOCHS} AS cap, CAST({SOURCE_WEIGHT} AS DOUBLE) AS w, tokens FROM leaves),
s1 AS (SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s0 JOIN l2 USING (domain, lang)),
s2 AS (SELECT domain, lang, source, tokens, CAST(floor(least(CAST(cap AS DOUBLE), w * max(level) OVER (PARTITION BY domain, lang))) AS BIGINT) AS share FROM s1),
p AS (SELECT doc_id, domain, lang, source, n_tokens, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS whole,
    share - (CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END) * tokens AS rest FROM words JOIN s2 USING (domain, lang, source)),
q AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || whole || ':' || doc_id), doc_id, n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM p)
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM q WHERE whole > 0 OR upto <= rest
"""
