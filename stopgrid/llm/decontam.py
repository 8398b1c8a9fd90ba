"""Benchmark decontamination with suffix arrays over the training texts.

Each shard (some million characters of whole documents) gets a word-level suffix array in the task that read it: the suffixes that
begin with a word of the benchmark, as no other can match, sorted by their first words and, where a search goes on, by the next ones. Every
test suffix, those at the ends of items too, is binary-searched in every shard for each of its lengths. From the places found come the
words hit, the items and the longest verbatim match of each document (of one word too); documents over the limit are contaminated and
can be removed in the same pass. There is no shuffle, and what a task holds is one shard and one block of test suffixes; the benchmark
is sent in blocks of bounded size, whatever its size.

Words are [0-9a-z] and all beyond ASCII, after lower-casing A-Z. A window is 13 consecutive words of an item; an item with fewer,
but not none, is one window. A document's word inside an occurrence of a window is hit; a document is contaminated if it has hit
words and they are at least a twentieth of its words. Null or empty texts have no words, and are never contaminated. Items without
id count under the empty string; rows of an item that are repeated count once. Documents that are repeated are judged each; a very
long one is a shard of its own. Empty tables give no rows, or no hits. Other columns, whatever their names, are not read, or carried through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

WINDOW = 13
#: Bytes to bytes: A-Z to a-z; 0-9, a-z and all beyond ASCII stay; the rest is a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Suffixes:
    """A block of the benchmark: its vocabulary and its distinct suffixes (their first WINDOW words), with the items and places that have them."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.bits = max(1, len(self.ids).bit_length())
        self.per = max(1, min(WINDOW, 62 // self.bits))
        owners: dict[tuple[int, ...], list[tuple[str, int]]] = {}
        for item, ws in items:
            own = tuple(self.ids[w] for w in ws)
            for i in range(len(own)):
                # a suffix that is no window of its own (the end of a longer item) has no owner
                owners.setdefault(own[i : i + WINDOW], []).extend([(item, i)] if i == 0 or i + WINDOW <= len(own) else [])
        self.words = np.zeros((len(owners), WINDOW), np.int64)
        self.length = np.array([len(k) for k in owners], np.int64)
        for row, k in zip(self.words, owners, strict=True):
            row[: len(k)] = k
        self.owners = list(owners.values())

    def pack(self, columns: list[np.ndarray]) -> np.ndarray:
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns:
            key = (key << self.bits) | c
        return key

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, list[tuple[str, int]]]]]:
        """ids: the shard's words, 0 for what ends a match, and at least WINDOW zeros at the end. Returns, for each place, how many words
        from there on are also in the benchmark in that order (WINDOW at most), and length, places and owners of each window found.

        The suffix array of the shard is made as deep as the searches go: all suffixes are sorted by as many words as a key packs, and
        each test suffix is binary-searched for each of its lengths; the ranges in which longer ones may still be are then sorted by the
        next words, all at once, and searched in the same way.
        """
        match = np.zeros(len(ids), np.int8)
        found = []
        array = np.flatnonzero(ids)
        part = np.zeros(len(array), np.int64)  # which range of the level before a suffix is in
        asked, asked_part, depth = np.arange(len(self.length)), np.zeros(len(self.length), np.int64), 0
        while len(array) and len(asked):
            width = min(self.per, WINDOW - depth)
            key = self.pack([ids[array + depth + j] for j in range(width)])
            distinct = np.unique(key)
            size = len(distinct) + 1
            code = part * size + np.searchsorted(distinct, key)
            order = np.argsort(code, kind="stable")
            array, code = array[order], code[order]
            for n in range(1, width + 1):
                fits = self.length[asked] >= depth + n
                asked, asked_part = asked[fits], asked_part[fits]
                free = self.bits * (width - n)
                low = self.pack([self.words[asked, depth + j] for j in range(n)])
                bound = lambda x: np.searchsorted(code, asked_part * size + np.searchsorted(distinct, x << free))  # noqa: B023, E731
                a, b = bound(low), bound(low + 1)
                met = b > a
                asked, asked_part, a, b = asked[met], asked_part[met], a[met], b[met]
                covered = np.zeros(len(array) + 1, np.int64)
                np.add.at(covered, a, 1)
                np.add.at(covered, b, -1)
                match[array[np.cumsum(covered[:-1]) > 0]] = depth + n
                for k in np.flatnonzero(self.length[asked] == depth + n):
                    if self.owners[asked[k]]:
                        found.append((depth + n, array[a[k] : b[k]], self.owners[asked[k]]))
            depth += width
            deeper = self.length[asked] > depth
            asked, a, b = asked[deeper], a[deeper], b[deeper]
            starts, asked_part = np.unique(a, return_inverse=True)
            ends = b[np.unique(a, return_index=True)[1]]
            part = np.repeat(np.arange(len(starts)), ends - starts)
            array = array[np.repeat(starts - np.concatenate([[0], np.cumsum(ends - starts)[:-1]]), ends - starts) + np.arange(len(part))] if len(starts) else array[:0]
        return match, found


def blocks_of(benchmark: DataFrame, most_words: int = 1_000_000) -> list[Broadcast]:
    """The test suffixes in blocks of about ``most_words`` words (an item is never cut), one at a time on the driver."""
    sc, blocks, items, held = benchmark.sparkSession.sparkContext, [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        ws = words_of(row["text"])
        items.append(("" if row["item_id"] is None else str(row["item_id"]), ws))
        held += len(ws)
        if held >= most_words:
            blocks.append(sc.broadcast(Suffixes(items)))
            items, held = [], 0
    if items or not blocks:
        blocks.append(sc.broadcast(Suffixes(items)))
    return blocks


def longest(places: list[tuple[str, int, int, int]]) -> int:
    """places: item, its position, the document's position, length. Windows that follow each other in both make one match."""
    reach: dict[tuple[str, int], tuple[int, int]] = {}
    best = 0
    for item, i, p, n in sorted(places, key=lambda x: x[2]):
        first, last = reach.get((item, p - i), (p, p - 1))
        first = first if p <= last + 1 else p
        reach[(item, p - i)] = (first, p)
        best = max(best, p + n - first)
    return best


def judge(texts: list[str | None], blocks: list[Broadcast]) -> list[tuple[int, list[tuple[int, int]], list[str], int]]:
    """For each text of a shard: its number of words, the spans of words hit, the items found, the longest match."""
    split = [words_of(t) for t in texts]
    ends = np.cumsum([len(ws) + 1 for ws in split])
    starts = ends - np.array([len(ws) + 1 for ws in split], dtype=ends.dtype)
    total = int(ends[-1]) if len(ends) else 0
    step = np.zeros(total + WINDOW + 1, np.int64)
    items: dict[int, set[str]] = {}
    places: dict[int, list[tuple[str, int, int, int]]] = {}
    best = np.zeros(len(split), np.int64)
    for block in blocks:
        suffixes: Suffixes = block.value
        ids = np.zeros(total + WINDOW + 1, np.int64)
        ids[:total] = np.fromiter(chain.from_iterable(chain(map(suffixes.ids.get, ws, repeat(0)), (0,)) for ws in split), np.int64, total)
        match, windows = suffixes.search(ids)
        if total:
            best = np.maximum(best, np.maximum.reduceat(match[:total], starts))
        for n, at, owners in windows:
            np.add.at(step, at, 1)
            np.add.at(step, at + n, -1)
            docs = np.searchsorted(ends, at, "right")
            for d in np.unique(docs):
                items.setdefault(int(d), set()).update(item for item, _ in owners)
            if n == WINDOW:
                for d, p in zip(docs.tolist(), at.tolist(), strict=True):
                    places.setdefault(d, []).extend((item, i, p, n) for item, i in owners)
        if len(blocks) > 1:
            block._value = None
            del block._value
    hit = np.cumsum(step[:total]) > 0
    edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    spans: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        d = int(np.searchsorted(ends, a, "right"))
        spans.setdefault(d, []).append((a - int(starts[d]), b - int(starts[d])))
    return [(len(ws), spans.get(d, []), sorted(items.get(d, ())), max(int(best[d]), longest(places.get(d, [])))) for d, ws in enumerate(split)]


def is_contaminated(n_words: int, spans: list[tuple[int, int]]) -> bool:
    n_hit = sum(b - a for a, b in spans)
    return n_hit > 0 and 20 * n_hit >= n_words


def shards(texts: list[str | None], most: int = 4_000_000) -> Iterator[list[str | None]]:
    out, n = [], 0
    for t in texts:
        out.append(t)
        n += len(t or "")
        if n >= most:
            yield out
            out, n = [], 0
    if out:
        yield out


HITS = "doc_id long, n_words long, n_hit long, hit_starts array<long>, hit_ends array<long>, items array<string>, longest_match long, contaminated boolean"


def find_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: words, words hit, their spans, the items found in it, the longest match, contaminated or not."""
    blocks = blocks_of(benchmark)
    names = [x.split()[0] for x in HITS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for part in shards(b.column("text").to_pylist()) for x in judge(part, blocks)]
            rows = [(n, sum(e - s for s, e in spans), [s for s, _ in spans], [e for _, e in spans], items, best, is_contaminated(n, spans)) for n, spans, items, best in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    blocks = blocks_of(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for part in shards(b.column("text").to_pylist()) for x in judge(part, blocks)]
            yield b.filter(pa.array([not is_contaminated(n, spans) for n, spans, _, _ in found], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)

