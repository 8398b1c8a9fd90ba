"""N-gram Jaccard join: documents whose sets of word shingles are alike, and the components that such links make.

Rare-first prefix filtering: shingles are in one order for all documents, by an estimate of how frequent they are in the whole corpus
(a count sketch of fixed size over every document) and then by hash. Two sets that are similar enough share a shingle among the first
n - ceil(t * n) + 1 of each, and one more for each that the prefix is longer; so sets only meet on their prefixes, which are n / EXTRA
longer here, and a set that has fewer prefix shingles in common with others than that asks for is alone. Length, positional and suffix filters (bounds of the overlap from lengths,
places in the prefix, and counts by hash range) leave the pairs that are verified, each once at most, by exact intersection.

Nothing is made for all pairs of a group:
1. Documents of equal sets are one class from the start; only one of them is shingled further.
2. A prefix shingle's postings come sorted by length. Those in a run of compatible lengths are counted for each class; of classes with
   enough of them, each posting is tied to the first of its run. The components of these ties hold every possible link.
3. The sets of a tied group go to one task, or, over BLOCK shingles, in blocks, each two of which meet in one task. A task joins on
   prefixes and verifies a pair only if its documents aren't in one component yet; it returns a tree for each component.
4. The components of the trees are those of the links: no link between different texts is lost.

Empty texts and null have an empty set, no links and component_id = their own doc_id. Rows without doc_id belong to a component but
never name it (component_id is null if no row has a doc_id). Repeated rows are kept, each with the same result; equal texts are one class. A
very long text is one set like others; an empty table gives an empty one. Other columns are not read, or carried through by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spare, trimmed, written
from .graph import components
from .shingles import shingle_set

#: Counters of the frequency sketch (two rows), slices in which it is summed, shingles of a block, bits of the filter of texts needed,
#: and the share (1 / EXTRA) of a set by which its prefix is longer than it must be.
WIDTH, SLICES, BLOCK, BITS, EXTRA = 1 << 18, 16, 1 << 20, 1 << 23, 10
RANGES, SIEVES = 256, 3
THRESHOLD = Fraction(85, 100)


def class_of(s: np.ndarray) -> int:
    """A set's name: a signed 64-bit hash of the whole set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))) if len(s) else 0


def columns_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(WIDTH - 1)).astype(np.int64), ((h >> np.uint64(24)) & np.uint64(WIDTH - 1)).astype(np.int64)


def first_pass(docs: DataFrame, k: int) -> DataFrame:
    """A row for each document (doc_id, row, cls, n), and the counts of the task's shingles by slice of the sketch (slice, counts)."""
    names = ["doc_id", "row", "cls", "n", "slice", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, n = np.zeros((2, WIDTH), np.int64), [], 0

        def counted() -> None:
            nonlocal n
            for r, c in zip(sketch, columns_of(np.concatenate(held)) if held else (), strict=False):
                r += np.bincount(c, minlength=WIDTH)
            held.clear()
            n = 0

        for b in batches:
            out = []
            for doc, row, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                s = shingle_set(text, k)
                held.append(s)
                n += len(s)
                if n > WIDTH:
                    counted()
                out.append((doc, row, class_of(s), len(s), None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        counted()
        packed = pa.Codec("zstd")
        parts = sketch.reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(SLICES, t) for t in kinds[:4]), pa.array(range(SLICES), pa.int32()), pa.array([packed.compress(p.tobytes(), asbytes=True) for p in parts], pa.binary())], names)

    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text")
    return written(source.mapInArrow(trimmed(run), "doc_id long, row long, cls long, n long, slice int, counts binary"), "shingled")


def frequency(first: DataFrame) -> Broadcast:
    """The sketch of the whole corpus: 2 * WIDTH counters, whatever the input."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        packed = pa.Codec("zstd")
        size = 2 * WIDTH // SLICES * 8
        out = sum((np.frombuffer(packed.decompress(c, size, asbytes=True), np.int64) for c in pdf["counts"]), np.zeros(size // 8, np.int64))
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "counts": [np.minimum(out, 2**31 - 1).astype(np.int32).tobytes()]})

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf

    rows = first.where("slice is not null").select("slice", "counts").mapInPandas(part, "slice int, counts binary").groupBy("slice").applyInPandas(total, "slice int, counts binary").collect()
    sketch = np.zeros(2 * WIDTH, np.int32).reshape(SLICES, -1)
    for r in rows:
        sketch[r["slice"]] = np.frombuffer(r["counts"], np.int32)
    return first.sparkSession.sparkContext.broadcast(sketch.reshape(2, WIDTH))


def order_of(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """A key that sorts a set's shingles (which are sorted by hash) rare first; equal keys stay in the order of hashes."""
    a, b = columns_of(s)
    return (np.minimum(np.minimum(sketch[0][a], sketch[1][b]), 2**20 - 1).astype(np.uint64) << np.uint64(44)) | (s >> np.uint64(20))


def rare_first(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    key = order_of(s, sketch)
    by = np.argsort(key)  # several times as fast as a stable sort, which only equal keys need
    ordered = key[by]
    return s[by if (ordered[1:] != ordered[:-1]).all() else np.argsort(key, kind="stable")]


def least_overlap(n: int, t: Fraction) -> int:
    return -(-t.numerator * n // t.denominator)


def prefix_length(n: int, t: Fraction) -> int:
    return n - least_overlap(n, t) + 1 + n // EXTRA


def needed(na, nb, t: Fraction):  # noqa: ANN001, ANN201
    """The least intersection with which two sets of these sizes are linked: i >= t * (na + nb - i)."""
    return -(-t.numerator * (na + nb) // (t.numerator + t.denominator))


def postings(docs: DataFrame, sketch: Broadcast, t: Fraction, k: int) -> DataFrame:
    names = ["token", "cls", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            tokens, classes, sizes = [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, k)
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(c)
                m = prefix_length(len(s), t)
                p = rare_first(s, sketch.value)[:m] if m < len(s) else s
                tokens.append(p)
                classes.append(np.full(len(p), c, np.int64))
                sizes.append(np.full(len(p), len(s), np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(sizes))], names)

    return docs.select("text").mapInArrow(trimmed(run), "token long, cls long, n int")


def shared(found: DataFrame, t: Fraction) -> DataFrame:
    """The postings that have another class's beside them, with a compatible length; repeated ones of a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # the last posting, as the next batch decides on it
        was = np.zeros(0, bool)
        for b in batches:
            tk, cl, n = (np.concatenate([h, b.column(c).to_numpy().astype(np.int64)]) for h, c in zip(held, ("token", "cls", "n"), strict=True))
            fresh = np.ones(len(tk), bool)
            fresh[1:] = (tk[1:] != tk[:-1]) | (cl[1:] != cl[:-1])
            tk, cl, n = tk[fresh], cl[fresh], n[fresh]
            if not len(tk):
                continue
            before = np.zeros(len(tk), bool)
            before[: len(was)] = was
            before[1:] = (tk[1:] == tk[:-1]) & (n[:-1] * t.denominator >= n[1:] * t.numerator)
            keep = before.copy()
            keep[:-1] |= before[1:]
            held, was = [tk[-1:], cl[-1:], n[-1:]], before[-1:]
            pick = np.flatnonzero(keep[:-1])
            if len(pick):
                yield pa.RecordBatch.from_arrays([pa.array(tk[pick]), pa.array(cl[pick]), pa.array(n[pick].astype(np.int32))], ["token", "cls", "n"])
        if len(was) and was[0]:
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), pa.array(held[2].astype(np.int32))], ["token", "cls", "n"])

    return written(found.repartition("token").sortWithinPartitions("token", "n", "cls").mapInArrow(trimmed(run), "token long, cls long, n int"), "shared")


def enough(postings: DataFrame, t: Fraction) -> DataFrame:
    """The postings of classes that have as many of them as a link asks for: a partner's prefix may be that of a set t times as long."""
    least = f"1 + floor(floor((n * {t.numerator}L + {t.denominator - 1}L) / {t.denominator}) / {EXTRA})"
    good = postings.groupBy("cls", "n").agg(F.count(F.lit(1)).alias("held")).where(f"held >= {least}").select("cls")
    return postings.join(good, "cls", "left_semi")


def ties(found: DataFrame, t: Fraction) -> DataFrame:
    """u, v: each posting beside the first of its run; in a run, each set is long enough for the next longer one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = before = first = None  # of the posting before
        for b in batches:
            tk, cl, n = (b.column(c).to_numpy() for c in ("token", "cls", "n"))
            if not len(tk):
                continue
            new = np.ones(len(tk), bool)
            new[1:] = (tk[1:] != tk[:-1]) | (n[:-1].astype(np.int64) * t.denominator < n[1:].astype(np.int64) * t.numerator)
            new[0] = token is None or tk[0] != token or before * t.denominator < int(n[0]) * t.numerator
            start = np.maximum.accumulate(np.where(new, np.arange(len(tk)), -1))
            head = np.where(start >= 0, cl[np.maximum(start, 0)], first if first is not None else 0)
            token, before, first = tk[-1], int(n[-1]), head[-1]
            differ = head != cl
            pairs = np.unique(np.stack([head[differ], cl[differ]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["u", "v"])

    return found.repartition("token").sortWithinPartitions("token", "n", "cls").mapInArrow(trimmed(run), "u long, v long").distinct()


def places(first: DataFrame, labels: DataFrame) -> DataFrame:
    """cls, row (of one of its texts), tied, i, j, block: the tasks (pairs of blocks of a tied group) in which a class's set is needed."""
    one = first.where("n > 0").groupBy("cls").agg(F.min("n").alias("n"), F.min("row").alias("row"))
    member = labels.select(F.col("node").alias("cls"), F.col("label").alias("tied")).join(one, "cls")
    blocks = member.groupBy("tied").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    dealt = member.join(blocks, "tied").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return written(dealt.select("cls", "row", "tied", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block"), "places")


def wanted(found: DataFrame) -> Broadcast:
    """A bit for each text that is needed: lets most other documents be passed over where they are read, before they are shingled.
    Its size is fixed; when it fills up at scale, it only lets more through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for b in batches:
            bits[b.column("row").to_numpy() & (BITS - 1)] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["part", "bits"])

    def either(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(BITS // 8, np.uint8)
        for x in pdf["bits"]:
            out |= np.frombuffer(x, np.uint8)
        return pd.DataFrame({"part": [0], "bits": [out.tobytes()]})

    rows = found.select("row").coalesce(64).mapInArrow(trimmed(run), "part int, bits binary").groupBy("part").applyInPandas(either, "part int, bits binary").collect()
    bits = np.unpackbits(np.frombuffer(rows[0]["bits"], np.uint8)).astype(bool) if rows else np.zeros(BITS, bool)
    return found.sparkSession.sparkContext.broadcast(bits)


def sets_of(docs: DataFrame, asked: Broadcast, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            pick = np.flatnonzero(asked.value[b.column("row").to_numpy() & (BITS - 1)])
            out = []
            for text in b.column("text").take(pa.array(pick)).to_pylist():
                s = shingle_set(text, k)
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(c)
                out.append((c, s.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([s for _, s in out], pa.binary())], ["cls", "shingles"])

    return docs.select(F.xxhash64("text").alias("row"), "text").mapInArrow(trimmed(run), "cls long, shingles binary")


def link(classes: np.ndarray, sets: list[np.ndarray], sketch: np.ndarray, t: Fraction, side: np.ndarray | None = None) -> tuple[list[tuple[int, int]], int]:
    """A tree (pairs of classes) for each component of the links among these sets, and how many pairs were verified.
    side: 0 or 1; pairs of one side are another task's."""
    size = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((classes, size))
    classes, sets, size = classes[order], [sets[i] for i in order], size[order]
    side = None if side is None else side[order]
    count = np.zeros((len(sets), RANGES), np.uint16)
    tokens, owner, place = [], [], []
    for i, s in enumerate(sets):
        count[i] = np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=RANGES), 65535)
        p = rare_first(s, sketch)[: prefix_length(len(s), t)]
        tokens.append(p)
        owner.append(np.full(len(p), i, np.int64))
        place.append(np.arange(len(p)))
    token, own, at = np.concatenate(tokens), np.concatenate(owner), np.concatenate(place)
    by = np.lexsort((own, token))
    token, own, at = token[by], own[by], at[by]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    first = np.repeat(start, np.diff(np.append(start, len(token))))
    entry = np.argsort(own, kind="stable")  # the places of each set's postings
    edge = np.searchsorted(own[entry], np.arange(len(sets) + 1))
    root, flag = np.arange(len(sets)), np.zeros(len(sets), bool)
    tree, verified = [], 0
    for x in range(len(sets)):
        met = []
        for e in entry[edge[x] : edge[x + 1]]:
            if first[e] < e:
                y, p = own[first[e] : e], at[first[e] : e]
                room = np.minimum(p, at[e]) + np.minimum(size[y] - p, size[x] - at[e])  # positional filter
                met.append(y[room >= needed(size[y], size[x], t)])
        if not met:
            continue
        y = np.concatenate(met)
        flag[y] = True
        y = np.flatnonzero(flag)
        flag[y] = False
        y = y[(root[y] != root[x]) & (size[y] * t.denominator >= size[x] * t.numerator)]
        if side is not None:
            y = y[side[y] != side[x]]
        if len(y) and size[x] < 65535:  # suffix filter
            y = y[np.minimum(count[y], count[x]).sum(1) >= needed(size[y], size[x], t)]
        while len(y):
            z = y[-1]
            verified += 1
            both = len(np.intersect1d(sets[x], sets[z], assume_unique=True))
            if both * t.denominator >= t.numerator * (size[x] + size[z] - both):
                tree.append((int(classes[z]), int(classes[x])))
                root[root == root[x]] = root[z]
                y = y[root[y] != root[z]]
            else:
                y = y[:-1]
    return tree, verified


def verified_links(sets: DataFrame, found: DataFrame, sketch: Broadcast, t: Fraction) -> DataFrame:
    """u, v: a tree for each component of the links, by tasks that hold two blocks of a tied group at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("cls")
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        side = None if i == j else (pdf["block"].to_numpy() == j).astype(np.int8)
        tree, _ = link(pdf["cls"].to_numpy(), [np.frombuffer(s, np.uint64) for s in pdf["shingles"]], sketch.value, t, side)
        return pd.DataFrame(tree, columns=["u", "v"], dtype="int64")

    dealt = sets.join(found.drop("row"), "cls")
    return dealt.groupBy("tied", "i", "j").applyInPandas(run, "u long, v long")


def link_components(docs: DataFrame, threshold: Fraction = THRESHOLD, k: int = 4) -> DataFrame:
    """doc_id, row (a hash of the text), n_shingles and component_id of every document."""
    first = first_pass(docs, k)
    sketch = frequency(first)
    held = postings(docs, sketch, threshold, k)
    for _ in range(SIEVES):  # a class that goes may leave others with too few
        held = enough(shared(held, threshold), threshold)
    tied = components(ties(held, threshold))
    found = places(first, tied)
    links = verified_links(sets_of(docs, wanted(found), k), found, sketch, threshold)
    joined = components(links).select(F.col("node").alias("cls"), "label")
    rows = first.where("slice is null").select("doc_id", "row", "cls", F.col("n").alias("n_shingles"))
    least = rows.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = least.join(joined, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = named.join(names, "label").select("cls", "component_id")
    return rows.join(of_class, "cls", "left").select("doc_id", "row", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, threshold: Fraction = THRESHOLD, k: int = 4) -> DataFrame:
    """The documents with all their columns, whatever their names: one (the least doc_id, then the least text hash) for each component; rows
    without doc_id and rows of empty texts stay. Equal rows of one doc_id count once."""
    found = link_components(docs.select("doc_id", "text"), threshold, k)
    d, r, row = spare(docs.columns, "_d", "_r", "_row")
    keep = found.where("n_shingles > 0 and doc_id is not null").groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("k"))
    keep = keep.select(F.col("k.doc_id").alias(d), F.col("k.row").alias(r))
    ided = docs.where("doc_id is not null").withColumn(row, F.xxhash64("text"))
    empty = F.coalesce(F.regexp_replace("text", r"[\x20\x09-\x0D]+", ""), F.lit("")) == ""
    whole = ided.where(~empty).join(keep, (F.col("doc_id") == F.col(d)) & (F.col(row) == F.col(r))).dropDuplicates([d, r]).select(*docs.columns)
    return whole.unionByName(docs.where(F.col("doc_id").isNull() | empty))
