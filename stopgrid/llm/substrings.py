"""Substring dedup over a log-structured index of window fingerprints.

A window is 13 consecutive words of one document. The index is a row of sorted immutable runs, tables in the shared folder: a run has,
for each bucket of fingerprints, the sorted distinct fingerprints of one batch of documents. A new batch, whose documents come after
all those indexed, is merge-joined with the runs bucket by bucket; then its own new fingerprints become a run. A run that is not twice
as long as the one after it is compacted with it, so there are few runs and a fingerprint is rewritten a few times only. Runs are tables
bucketed by the bucket's number: the merge and the compaction of two runs read them where they are, without a shuffle.

A fingerprint has two parts. Its search key (48 bits) is the least hash of the window's 6-word grams, so neighbouring windows share it
and sorted keys pack small; a meeting of keys is verified by a 56-bit hash of all 13 words in their order. A batch's windows
are judged together by segments of doc_ids: a segment sends each bucket its distinct fingerprints only, so a passage that a third of
all documents share costs a row for each segment and not for each document; which document of a segment comes first is settled
inside it. The answer is one bit for each fingerprint sent, in the order in which it was sent, and the segment works its
fingerprints out again from the texts.

Words are [^\\x20\\x09-\\x0D]+, unchanged. A word goes if it is in a window whose words also start in a document of a smaller doc_id;
windows are judged on the input. Null and empty texts have no words. Documents with fewer than 13 words lose none. Rows without doc_id
come after all others and count as one document; repeated rows of a doc_id are one document to each other (none removes the other's
words). Other columns are not read, or carried through.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, shared_dir, tasks_of, trimmed
from .shingles import ODD, WORDS, Words, mixed, windows, words_of

WINDOW, GRAM, SEGMENT = 13, 6, 1024
CHECK_BITS = 56
#: Buckets for each task of a shuffle, so that one bucket is a small part of what a task has, and parts in which two runs are compacted.
BUCKETS, SLICES = 8, 4
LAST = 2**62


def fingerprints(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Search key (48 bits) and check (56 bits) of each window of a document, given its words' hashes."""
    grams = windows(h, GRAM) >> np.uint64(16)
    n = len(h) - WINDOW + 1
    key = grams[:n].copy()
    for j in range(1, WINDOW - GRAM + 1):
        np.minimum(key, grams[j : n + j], out=key)
    check = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        check = check * np.uint64(0xC2B2AE3D27D4EB4F) + (h[j : n + j] ^ ODD)
    return key, mixed(check) >> np.uint64(64 - CHECK_BITS)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(key) % np.uint64(buckets)).astype(np.int64)


def pack(key: np.ndarray, check: np.ndarray) -> bytes:
    """Sorted keys as differences, and the checks, by bytes' places, compressed."""
    step = np.diff(key, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    low = check.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : CHECK_BITS // 8]
    raw = np.uint32(len(key)).tobytes() + np.concatenate([step.T.ravel(), low.T.ravel()]).tobytes()
    return np.uint32(len(raw)).tobytes() + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[4:], int(np.frombuffer(blob[:4], np.uint32)[0]), asbytes=True)
    n = int(np.frombuffer(raw[:4], np.uint32)[0])
    body = np.frombuffer(raw[4:], np.uint8)
    step, check = np.zeros((n, 8), np.uint8), np.zeros((n, 8), np.uint8)
    step[:, :6] = body[: 6 * n].reshape(6, n).T
    check[:, : CHECK_BITS // 8] = body[6 * n :].reshape(CHECK_BITS // 8, n).T
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64), check.view("<u8").ravel()


def in_order(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by key and check, equal ones in any order, and whether each in that order is the first of its equals."""
    start = (key << np.uint64(16)) | (check >> np.uint64(CHECK_BITS - 16))
    order = np.argsort(start)
    start, end = start[order], check[order]
    alike = start[1:] == start[:-1]
    unlike = alike & (end[1:] != end[:-1])
    if unlike.any():  # equal in the first 64 bits only: those few are sorted by all
        group = np.cumsum(np.append(True, ~alike)) - 1
        again = np.zeros(group[-1] + 1, bool)
        again[group[1:][unlike]] = True
        at = np.flatnonzero(again[group])
        order[at] = order[at[np.lexsort((end[at], group[at]))]]
        end = check[order]
    new = np.ones(len(order), bool)
    new[1:] = ~alike | (end[1:] != end[:-1])
    return order, new


def least(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The least of the values of each group of equals."""
    return np.minimum.reduceat(values, np.flatnonzero(new)) if len(values) else values


def distinct(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, new = in_order(key, check)
    return key[order[new]], check[order[new]]


class Segment:
    """The windows of some documents of one segment: document (its place among the ids), first word, key and check of each."""

    def __init__(self, ids: list[int], texts: list[str | None], words: Words):
        self.split = [words_of(t, False) for t in texts]
        parts = [(i, *fingerprints(words.of(ws))) for i, ws in enumerate(self.split) if len(ws) >= WINDOW]
        self.doc = np.repeat(np.array([ids[i] for i, _, _ in parts], np.int64), [len(k) for _, k, _ in parts])
        self.row = np.repeat(np.array([i for i, _, _ in parts], np.int64), [len(k) for _, k, _ in parts])
        self.at = np.concatenate([np.arange(len(k)) for _, k, _ in parts] or [np.zeros(0, np.int64)])
        self.key = np.concatenate([k for _, k, _ in parts] or [np.zeros(0, np.uint64)])
        self.check = np.concatenate([c for _, _, c in parts] or [np.zeros(0, np.uint64)])

    def later_here(self, order: np.ndarray, new: np.ndarray) -> np.ndarray:
        """In the given order (by key and check): whether a smaller document of the segment has the same window."""
        d = self.doc[order]
        return d > least(d, new)[np.cumsum(new) - 1]


def sent(docs: DataFrame, buckets: int) -> DataFrame:
    """segment, bucket, packed: the distinct fingerprints of a segment's documents in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WORDS
        for b in batches:
            segments, ids, texts = b.column("segment").to_numpy(), b.column("id").to_numpy(), b.column("text").to_pylist()
            for seg in np.unique(segments):
                pick = np.flatnonzero(segments == seg)
                s = Segment([int(ids[i]) for i in pick], [texts[i] for i in pick], words)
                if not len(s.key):
                    continue
                key, check = distinct(s.key, s.check)
                to = bucket_of(key, buckets)
                order = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), seg), pa.int64()), pa.array(full, pa.int32()), pa.array([pack(key[o], check[o]) for o in (order[edges[f] : edges[f + 1]] for f in full)], pa.binary())], ["segment", "bucket", "packed"])

    return docs.mapInArrow(trimmed(run), "segment long, bucket int, packed binary")


def merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: runs (segment -1) and the batch's segments. Returns each segment's answer, and the bucket's new run (segment -1)."""
    parts = [(int(s), *unpack(p)) for s, p in zip(pdf["segment"], pdf["packed"], strict=True)]
    key = np.concatenate([k for _, k, _ in parts])
    check = np.concatenate([c for _, _, c in parts])
    seg = np.repeat(np.array([s for s, _, _ in parts], np.int64), [len(k) for _, k, _ in parts])
    order, new = in_order(key, check)
    first = least(seg[order], new)
    fresh = order[new][first >= 0]
    run = pack(key[fresh], check[fresh])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    bucket = int(pdf["bucket"].iloc[0])
    sends: dict[int, list[np.ndarray]] = {}
    at = 0
    for s, k, _ in parts:  # each is sorted, so its places ascend
        sends.setdefault(s, []).append(place[at : at + len(k)])
        at += len(k)
    rows = []
    for s, own in sends.items():
        if s < 0:
            continue
        places = own[0] if len(own) == 1 else np.unique(np.concatenate(own))  # a segment read by several tasks may send a fingerprint twice
        earlier = s > first[places]
        if earlier.any():
            rows.append((s, bucket, np.packbits(earlier).tobytes()))
    rows.append((-1, bucket, run))
    return pd.DataFrame(rows, columns=["segment", "bucket", "packed"])


def met(batch: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    """One bucket of a batch, merged with the same bucket of the runs; a bucket that the batch has nothing in has no answers and no new run."""
    return merge(pd.concat([batch, runs], ignore_index=True)) if len(batch) else batch


def compacted(older: pd.DataFrame, newer: pd.DataFrame) -> pd.DataFrame:
    """One bucket of two runs as one. They have no fingerprint in common, and both are sorted, which the stable sort makes use of."""
    both = pd.concat([older, newer], ignore_index=True)
    if len(both) < 2:
        return both
    parts = [unpack(p) for p in both["packed"]]
    key, check = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(key, kind="stable")
    return pd.DataFrame({"segment": [-1], "bucket": [int(both["bucket"].iloc[0])], "packed": [pack(key[order], check[order])]})


SENT = "segment long, bucket int, packed binary"


class FingerprintIndex:
    """The runs of all batches so far. Batches must come in the order of doc_id.

    A run is a Parquet table in the shared folder, bucketed by bucket; the session's catalog has an entry for it until ``close``.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, path: str | None = None):
        self.spark, self.buckets = spark, buckets or BUCKETS * tasks_of(spark)
        self.path = path or f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
        self.runs: list[str] = []
        self.compactions = 0

    def write(self, rows: DataFrame, name: str) -> None:
        kind = F.when(F.col("segment") < 0, "run").otherwise("answer")
        parts = rows.withColumns({"kind": kind, "slice": F.col("bucket") % SLICES})
        parts.write.partitionBy("kind", "slice").bucketBy(tasks_of(self.spark), "bucket").option("path", f"{self.path}/{name}").mode("append").saveAsTable(name)
        release(self.spark)

    def run(self, *names: str, part: Column | None = None) -> DataFrame:
        """The runs' fingerprints, or some slices of them; those of one run are dealt by bucket as they are stored."""
        found = [self.spark.table(n).where("kind = 'run'").where(F.lit(True) if part is None else part).drop("kind", "slice") for n in names]
        return functools.reduce(DataFrame.unionByName, found)

    def folder(self, name: str, below: str = "") -> tuple[Any, Any]:
        """The file system and the folder of a run's fingerprints."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/kind=run{below}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def length(self, name: str) -> int:
        fs, path = self.folder(name)
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    def add(self, docs: DataFrame) -> DataFrame:
        """docs: segment, id, text. Indexes them; returns the answers (segment, bucket, bits) of those segments that meet earlier windows."""
        batch = sent(docs, self.buckets).groupBy("bucket")
        found = batch.cogroup(self.run(*self.runs).groupBy("bucket")).applyInPandas(met, SENT) if self.runs else batch.applyInPandas(merge, SENT)
        name = f"windows_{uuid.uuid4().hex}"
        self.write(found, name)
        self.runs.append(name)
        while len(self.runs) > 1 and self.length(self.runs[-2]) < 2 * self.length(self.runs[-1]):
            self.compact()
        return self.spark.read.schema(f"{SENT}, kind string, slice int").parquet(f"{self.path}/{name}").where("kind = 'answer'").drop("kind", "slice")

    def compact(self) -> None:
        """The last two runs become one, slice by slice; a slice of theirs (not the answers) is deleted once it is written anew."""
        older, newer = self.runs[-2:]
        name = f"windows_{uuid.uuid4().hex}"
        for i in range(SLICES):
            part = F.col("slice") == i
            both = self.run(older, part=part).groupBy("bucket").cogroup(self.run(newer, part=part).groupBy("bucket"))
            self.write(both.applyInPandas(compacted, SENT), name)
            for old in (older, newer):
                fs, path = self.folder(old, f"/slice={i}")
                fs.delete(path, True)
        self.runs[-2:] = [name]
        self.compactions += 1
        for old in (older, newer):
            self.spark.sql(f"DROP TABLE {old}")

    def close(self) -> None:
        """Forgets the catalog's entries; the files stay."""
        for name in self.runs:
            self.spark.sql(f"DROP TABLE {name}")


def numbered(docs: DataFrame) -> DataFrame:
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    # segments are never negative, and follow the order of the ids
    return docs.select(F.floor(ident / SEGMENT).cast("long").alias("segment"), ident.alias("id"), "doc_id", "text").withColumn("segment", F.col("segment") + 2**53)


def removed(ids: list[int], texts: list[str | None], answers: dict[int, bytes], buckets: int, words: Words) -> list[tuple[int, int, bytes]]:
    """For each document of a segment: words, words removed, the words kept joined by a space."""
    s = Segment(ids, texts, words)
    order, new = in_order(s.key, s.check)
    gone = s.later_here(order, new)
    to = bucket_of(s.key[order[new]], buckets)
    earlier = np.zeros(len(to), bool)
    for b, bits in answers.items():
        own = np.flatnonzero(to == b)
        earlier[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
    gone |= earlier[np.cumsum(new) - 1] if len(new) else gone
    row, at = s.row[order][gone], s.at[order][gone]
    by = np.lexsort((at, row))
    row, at = row[by], at[by]
    out = []
    edges = np.searchsorted(row, np.arange(len(texts) + 1))
    for i, ws in enumerate(s.split):
        hits = at[edges[i] : edges[i + 1]]
        if not len(hits):
            out.append((len(ws), 0, b" ".join(ws)))
            continue
        step = np.zeros(len(ws) + 1, np.int64)
        step[hits] += 1
        np.subtract.at(step, hits + WINDOW, 1)
        cover = np.cumsum(step[:-1]) > 0
        out.append((len(ws), int(cover.sum()), b" ".join(w for w, c in zip(ws, cover.tolist(), strict=True) if not c)))
    return out


def dedup_substrings(docs: DataFrame, batches: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by a space) of every document.

    The documents are indexed in ``batches`` ranges of doc_id, as batches that arrive one after another would be.
    """
    spark = docs.sparkSession
    rows = numbered(docs)
    low, high = rows.where("doc_id is not null").agg(F.min("segment"), F.max("segment")).first()
    index = FingerprintIndex(spark)
    answers = None
    low, high = (low, high) if low is not None else (0, 0)
    cuts = [low + (high - low + 1) * i // batches for i in range(1, batches)]
    for i in range(batches):
        part = rows
        if i:
            part = part.where(F.col("segment") >= cuts[i - 1])
        if i < batches - 1:
            part = part.where(F.col("segment") < cuts[i])
        own = index.add(part.select("segment", "id", "text"))
        answers = own if answers is None else answers.unionByName(own)
    index.close()
    buckets = index.buckets
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = left.column("id").to_pylist(), left.column("text").to_pylist()
        bits = dict(zip(right.column("bucket").to_pylist(), right.column("packed").to_pylist(), strict=True))
        found = removed(ids, texts, bits, buckets, WORDS)
        kept = [k for _, _, k in found]
        return pa.Table.from_arrays([left.column("doc_id").combine_chunks(), pa.array([n for n, _, _ in found], pa.int64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())], names)

    return rows.groupBy("segment").cogroup(answers.groupBy("segment")).applyInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
