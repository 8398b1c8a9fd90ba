r"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared in normal form: lower case, white space squeezed and trimmed, numbers as written. The edit bound grows with length:
lines of at most ``short`` characters have bound 0 (an edit makes another word of them), longer ones of fewer than ``words`` words
are near if at most one character is inserted, deleted or substituted, and lines of at least ``words`` words if at most one word is, however
many characters that changes. Lines on two sides of these limits aren't near. Each line but the earliest of those it is near is removed:
a line goes if an earlier one, by (doc_id, row, line number), is equal or near. A line with an empty normal form is never removed.

All variants of a line with one unit (character or word) deleted are emitted as hashed keys, of two kinds: with the place of the
deletion (equal keys: a substitution there) and without it (equal to another line's own hash: an insertion or deletion). All lines with
an equal key of the first kind are near each other, and all with a variant equal to a whole line are near that line; so one minimum for
each key finds the earliest, without pairs. The edit distance of each line and the earliest found for it is then verified.

Variants are only emitted where they can meet: of two near lines cut in half (at the shorter one's length), one half is equal; so lines
that share neither half (of units, rounded down to an even number) with another distinct line are left out. Variants' keys are running XORs of hashes of (unit, place), so a line
of n units costs n rows, not n squared. Lines are named by 128-bit hashes of their normal forms.

Null texts stay null, empty ones empty; an empty table gives an empty one. Very long texts and lines are rows like others. Documents of
one doc_id are told apart by the hash of their text; equal rows of one doc_id count once (all their lines are judged alike). Rows without doc_id
come first. Other columns, whatever their names, are carried through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_in, spare, written

#: Characters up to which a line goes only for an equal one, and words from which a line's unit is the word, in the query and the pipeline.
SHORT, WORDS = 12, 10
BLANK = r"[\x09\x0B-\x0D\x20]+"


def squeezed(line: Column) -> Column:
    """The normal form of a line in lower case; the expression only runs where there is something to squeeze."""
    odd = F.contains(line, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.trim(F.when(odd, F.regexp_replace(line, BLANK, " ")).otherwise(line))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), at (the line's number), norm (empty for blank lines) of every line."""
    each = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split(F.lower("text"), "\n")).alias("at", "line"))
    return each.select("doc_id", "row", "at", squeezed(F.col("line")).alias("norm"))


def place() -> Column:
    """Where a line stands; the least is the earliest. Null doc_ids come first."""
    return F.struct("doc_id", "row", "at")


def name_of(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def n_words(norm: Column) -> Column:
    return F.size(F.split(norm, " "))


def units(norm: Column, words: int) -> Column:
    return F.when(n_words(norm) >= words, F.split(norm, " ")).otherwise(F.regexp_extract_all(norm, F.lit("(?s)(.)"), F.lit(1)))


HALVES = ["h0", "h1", "h2", "h3"]


def half_keys() -> list[Column]:
    """Hashes of a line's first and last 2 * (n div 4) units, at the two lengths that a line near it may go by. From norm, by (words or not) and n."""

    def ends(k: Column) -> list[Column]:
        head = F.when(F.col("by"), F.call_function("substring_index", "norm", F.lit(" "), k)).otherwise(F.left("norm", k))
        tail = F.when(F.col("by"), F.call_function("substring_index", "norm", F.lit(" "), -k)).otherwise(F.right("norm", k))
        return [F.xxhash64(F.lit(0), "by", k, head), F.xxhash64(F.lit(1), "by", k, tail)]

    return [*ends(F.col("half")), *(F.when(F.col("n") % 4 == 0, k) for k in ends(F.col("half") - 2))]


def line_table(docs: DataFrame, short: int, words: int) -> DataFrame:
    """doc_id, row, at, line (its name) and the halves' keys (null for short lines) of every line that isn't blank, written once: the texts are read and folded in one pass."""
    sized = lines_of(docs).withColumn("n", n_words(F.col("norm"))).withColumn("by", F.col("n") >= words)
    sized = sized.withColumn("n", F.when(F.col("by"), F.col("n")).otherwise(F.length("norm"))).withColumn("half", F.floor(F.col("n") / 4).cast("int") * 2)
    keys = [F.when(F.col("by") | (F.col("n") > short), k).alias(h) for h, k in zip(HALVES, half_keys(), strict=True)]
    # blank lines are left out after the table is written: a filter before it would have lines folded twice
    return written(sized.select("doc_id", "row", "at", F.when(F.col("norm") != "", name_of(F.col("norm"))).alias("line"), *keys), "lines").where("line is not null")


def first_places(table: DataFrame) -> DataFrame:
    """line, first (its earliest place), n (how many places) and the halves' keys of the distinct lines."""
    return written(table.groupBy("line").agg(F.min(place()).alias("first"), F.count(F.lit(1)).alias("n"), *(F.min(h).alias(h) for h in HALVES)), "first-places")


def sharing(firsts: DataFrame) -> DataFrame:
    """x, a hash of the name, of the distinct lines that have a half in common with another one."""
    each = firsts.where("h0 is not null").select(F.xxhash64("line").alias("x"), F.explode(F.array(*HALVES)).alias("key")).where("key is not null")
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return each.join(shared, "key", "left_semi").select("x").distinct()


def candidates(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """line, first, norm and id (a number of its own) of the distinct lines that may have near ones."""
    chosen = firsts.select(F.xxhash64("line").alias("x"), "first").join(sharing(firsts), "x", "left_semi")
    # the text of a candidate comes from its earliest place; only documents with such places are dealt
    wanted = chosen.groupBy("first.doc_id", "first.row").agg(F.collect_set("first.at").alias("ats")).select(F.col("doc_id").alias("d"), F.col("row").alias("w"), "ats")
    wanted = written(wanted, "wanted")
    held = maybe_in(docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("row"), "text"), F.col("row"), wanted.select("w"), wanted.count())
    held = held.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("w")))
    each = held.select("doc_id", "row", "ats", F.posexplode(F.split(F.lower("text"), "\n")).alias("at", "line")).where(F.array_contains("ats", F.col("at")))
    text = each.select(place().alias("first"), squeezed(F.col("line")).alias("norm"))
    return written(text.select(name_of(F.col("norm")).alias("line"), "first", "norm").dropDuplicates(["line"]).withColumn("id", F.monotonically_increasing_id()), "candidates")


def variant_keys(text: DataFrame, words: int) -> DataFrame:
    """id, kind, key. Kind 0: one unit deleted, with its place; 1: one unit deleted; 2: the whole line."""
    xor = lambda shift: F.aggregate(F.transform("units", lambda u, i: F.xxhash64(u, i - shift)), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    lines = text.select("id", (n_words(F.col("norm")) >= words).alias("by"), units(F.col("norm"), words).alias("units")).withColumn("n", F.size("units"))
    own = lines.select("id", F.xxhash64(F.col("n") - 1, "by").bitwiseXOR(xor(1)).alias("moved"), "units")
    each = own.select("id", "moved", F.posexplode("units").alias("i", "u"))  # a step of its own, or each unit's row would hold the array
    # what the units before a place and, moved by one, those after it come to: a line's own share is added at its first unit
    here, step = F.xxhash64("u", "i"), F.xxhash64("u", "i").bitwiseXOR(F.xxhash64("u", F.col("i") - 1))
    each = each.select("id", "i", here.alias("here"), F.when(F.col("i") == 0, step.bitwiseXOR(F.col("moved"))).otherwise(step).alias("step"))
    order = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = each.select("id", "i", F.bit_xor("step").over(order).bitwiseXOR(F.col("here")).alias("rest"))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.xxhash64("rest", "i").alias("key")), F.struct(F.lit(1).alias("kind"), F.col("rest").alias("key")))
    entire = lines.select("id", F.lit(2).alias("kind"), F.xxhash64("n", "by").bitwiseXOR(xor(0)).alias("key"))
    return written(cut.select("id", F.inline(kinds)).unionByName(entire), "variants")


def meeting(keys: DataFrame) -> DataFrame:
    """The variants whose key another line has too: kind 0 meets kind 0; kind 1 meets kind 2."""
    kinds = F.bit_or(F.call_function("shiftleft", F.lit(1), "kind"))
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), kinds.alias("kinds")).where("n > 1 and (kinds & 1 = 1 or kinds & 6 = 6)").select("key")
    return keys.join(met, "key", "left_semi")


def within_one(a: Column, b: Column) -> Column:
    """Whether the edit distance of two arrays is at most one."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    at = F.array_position(F.zip_with(short, long, lambda x, y: x.eqNullSafe(y)), False).cast("int")  # 1 for the first unit; 0: none differs
    rest = lambda x, k: F.slice(x, k, F.size(x))
    inserted, other = rest(short, at) == rest(long, at + 1), rest(short, at + 1) == rest(long, at + 1)
    return (at == 0) | ((at > 0) & F.when(F.size(short) == F.size(long), other).otherwise((F.size(short) + 1 == F.size(long)) & inserted))


def near_lines(docs: DataFrame, firsts: DataFrame, words: int) -> DataFrame:
    """line and near: the earliest place of an earlier near line, for the distinct lines that have one."""
    text = candidates(docs, firsts)
    keys = written(meeting(variant_keys(text, words)).join(text.select("id", "line", "first"), "id"), "meeting")
    earliest = lambda k: F.min(F.when(F.col("kind") == k, F.struct("first", "line")))
    table = keys.groupBy("key").agg(earliest(0).alias("e0"), earliest(1).alias("e1"), earliest(2).alias("e2"))
    other = F.when(F.col("kind") == 0, F.col("e0")).when(F.col("kind") == 1, F.col("e2")).otherwise(F.col("e1"))
    pairs = keys.join(table, "key").select("line", "first", other.alias("other")).where(F.col("other.first") < F.col("first")).groupBy("line").agg(F.min("other").alias("other"))
    sides = pairs.select("line", F.col("other.line").alias("partner"), F.col("other.first").alias("near"))
    norms = text.select("line", "norm")
    both = sides.join(norms, "line").join(norms.select(F.col("line").alias("partner"), F.col("norm").alias("norm2")), "partner")
    return written(both.where(within_one(units(F.col("norm"), words), units(F.col("norm2"), words))).select("line", "near"), "near")


def removed_lines(docs: DataFrame, short: int = 0, words: int = WORDS) -> DataFrame:
    """doc_id, row and the numbers of the lines that go, for documents with such lines."""
    table = line_table(docs, short, words)
    firsts = first_places(table)
    near = near_lines(docs, firsts, words)
    # a line's first place stays unless the line is near an earlier one; its other places go
    marks = firsts.where("n > 1").select("line", "first").join(near, "line", "full").select("line", "first", F.col("near").isNotNull().alias("near"))
    gone = table.drop(*HALVES).join(marks, "line").where(F.col("near") | (F.col("first").isNotNull() & ~place().eqNullSafe(F.col("first"))))
    return gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("at")).alias("gone"))


def marked(docs: DataFrame, short: int = 0, words: int = WORDS, gone: str = "_gone") -> DataFrame:
    """docs with a column ``gone``: the numbers of the lines that go (null: none)."""
    d, r = spare(docs.columns, "_d", "_r")
    found = removed_lines(docs.select("doc_id", "text"), short, words).select(F.col("doc_id").alias(d), F.col("row").alias(r), F.col("gone").alias(gone))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(r)), "left").drop(d, r)


def kept_text(gone: str = "_gone") -> Column:
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    flag = lambda a, keep: F.transform(a, lambda i: F.struct(i.alias("i"), F.lit(keep).alias("keep")))
    flags = F.array_sort(F.concat(flag(stay, True), flag(F.col(gone), False)))  # one for each line, in order
    kept = F.filter(F.arrays_zip(lines.alias("line"), flags.alias("flag")), lambda x: x["flag"]["keep"])
    return F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))


def dedup_lines(docs: DataFrame, short: int = 0, words: int = WORDS) -> DataFrame:
    """The documents without the lines that go; a document that had such lines and has no other left goes too."""
    (gone,) = spare(docs.columns, "_gone")
    out = marked(docs, short, words, gone).withColumn("text", kept_text(gone))
    empty = F.col(gone).isNotNull() & (F.regexp_replace("text", r"[\x09-\x0D\x20]+", "") == "")
    return out.where(~empty).select(*docs.columns)
