r"""Document fingerprints by spot signatures, in DataFrame functions only.

A signature is a chain: the first CHAIN content words after a common word, up to the next common word. A document's fingerprint is the
sorted set of its chains' 32-bit hashes, written in hexadecimal. A text without chains, but not without words, has one signature of
all its words; a text without letters or digits, but not empty, one of the text itself; the empty text (and null) has none.
Likeness is the Jaccard similarity of two sets, 1 for two empty ones.

Near pairs are found by partitions of set length: sets whose lengths differ by more than the threshold allows are never met, a set is
compared within its partition and the next one only, on the least codes that two similar sets can't both avoid (a prefix), and pairs
whose lengths rule the threshold out are pruned before their sets are intersected.

Rows are in the order of (doc_id, text), nulls first; the row after the last is the first. Repeated rows follow each other. Other
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

#: Common words of English, French, German and Spanish (fixed values; a parameter of the functions below).
COMMON = (
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was were which will with you "
    "au aux avec ce dans de des du elle en est et il la le les ne ou par pas pour que qui sa se son sur un une "
    "als auch auf aus bei das dem den der des die durch ein eine einem einen einer er es für ich im ist mit nach nicht sich sie sind um und von vor war wie wird zu zum zur "
    "al como con del el esta este la las lo los más no o para pero por su sus una y"
).split()
CHAIN, BLOCK, THRESHOLD = 2, 1024, 0.8


def _trie(words: list[str]) -> str:
    """One expression for all the words, shared beginnings written once, so that a match tries few alternatives."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    optional = "" in heads
    heads.pop("", None)
    parts = [h + _trie(sorted(set(t))) for h, t in sorted(heads.items())]
    if not parts:
        return ""
    return f"(?:{'|'.join(parts)})" + ("?" if optional else "") if optional or len(parts) > 1 else parts[0]


def chains(text: Column, common: list[str] = COMMON, length: int = CHAIN) -> Column:
    """array<int>: the text's signatures, sorted and distinct."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    anchor = f" {_trie(sorted(set(common)))}(?= )"
    pieces = F.split(F.concat(F.lit(" "), words, F.lit(" ")), anchor)
    after = F.filter(F.transform(F.filter(pieces, lambda p, i: i > 0), lambda p: F.substring_index(F.trim(p), " ", length)), lambda c: c != "")
    codes = F.array_sort(F.array_distinct(F.transform(after, lambda c: F.hash(c))))
    alone = F.when(words != "", F.array(F.hash(words))).when(text != "", F.array(F.hash(text))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.when(F.size(codes) > 0, codes).otherwise(alone)


def written_out(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c.cast("long").bitwiseAND(F.lit(4294967295)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(1.0))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, codes) with next_text and next_codes, of the row after it.

    Rows are dealt by blocks of doc_ids and each block also gets the first row of the block after it, so the order needs no single
    task; only the list of blocks (one number each) is sorted in one.
    """
    block = F.coalesce(F.floor(F.col("doc_id") / BLOCK), F.lit(-(2**53))).cast("long")
    own = docs.withColumn("block", block).withColumn("ghost", F.lit(0))
    first = own.groupBy("block").agg(F.min(F.struct("doc_id", "text", "codes")).alias("f"))
    order = Window.orderBy("block")
    everything = Window.partitionBy()
    blocks = own.select("block").distinct()
    before = blocks.select("block", F.coalesce(F.lag("block").over(order), F.max("block").over(everything)).alias("before"))
    ghosts = first.join(before, "block").select("f.*", F.col("before").alias("block"), F.lit(1).alias("ghost"))
    line = Window.partitionBy("block").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    after = own.unionByName(ghosts).withColumns({"next_text": F.lead("text").over(line), "next_codes": F.lead("codes").over(line)})
    return after.where("ghost = 0").drop("ghost", "block")


def fingerprints(df: DataFrame) -> DataFrame:
    docs = text_of(df)
    return docs.select("doc_id", "text", chains(F.col("text")).alias("codes"))


def against_edits(df: DataFrame) -> DataFrame:
    """Each text's fingerprint beside that of its edited text (the last half replaced by the beginning of the next) and of the next text."""
    rows = with_next(fingerprints(df))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - half), F.left(F.col("next_text"), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "codes", "next_codes", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "codes", "next_codes", F.sha2("edited", 256).alias("edited_sha256"), chains(F.col("edited")).alias("edited_codes"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written_out(F.col("codes")).alias("fingerprint"),
        written_out(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
    )


def near_pairs(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, likeness: pairs of different fingerprints (each by its least doc_id) at or over the threshold; documents of one fingerprint share one row."""
    sets = fingerprints(df).where(F.size("codes") > 0).groupBy("codes").agg(F.min("doc_id").alias("doc_id")).withColumn("n", F.size("codes"))
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9).cast("int")
    short = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1
    cut = sets.withColumn("part", part).select("doc_id", "n", "part", F.explode(F.slice("codes", 1, short)).alias("code"))
    left = cut.select("code", "part", F.col("doc_id").alias("a"), F.col("n").alias("na"))
    right = cut.select("code", F.explode(F.array("part", F.col("part") - 1)).alias("part"), F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("part").alias("pb"))
    met = left.join(right, ["code", "part"]).where("(pb > part or a < b) and least(na, nb) >= greatest(na, nb) * %r - 1e-9" % threshold)
    pairs = met.select("a", "b").distinct()
    own = sets.select("doc_id", "codes")
    both = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("codes").alias("ca")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("codes").alias("cb")), "b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("ca"), F.col("cb")).alias("likeness")).where(F.col("likeness") >= threshold - 1e-12)
