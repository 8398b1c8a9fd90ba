"""Exact token counts of every prefix of a text, by dynamic programming.

For a byte-pair vocabulary, the tokens of a prefix end in the one token t for which (last token before t, t) stays as it is when
the two are encoded together; so count[end] = count[end - len(t)] + 1, and a table over the prefixes answers any question about
truncation or budgets without encoding again. No piece of the vocabulary holds a space mark after another character, nor a line
end, so the table begins anew at each such place: a text's table is the running sum over its chunks plus one chunk's own table.
Equal chunks share their table (a bounded store in each worker), which counts, truncation and budgets are all read from.

Null texts are empty and have 0 tokens. Characters outside the vocabulary count one token for each UTF-8 byte. Strings of control
tokens inside texts are ordinary text. Very long texts are tables like others; an empty table of documents gives an empty one. Rows are kept as they are, repeated ones too; other columns are not read.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
NONE = 1 << 30
CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+")


def pieces_of(model_file: str) -> list[str]:
    """The normal pieces, best first; checks what the tables rely on."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    ids.sort(key=lambda i: (-m.get_score(i), i))
    pieces = [m.id_to_piece(i) for i in ids]
    if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
        raise ValueError("a piece of this vocabulary goes on over a space or a line end; its prefix tables can't be cut there")
    return pieces


class PrefixCounter(dict):
    """chunk -> its table: the number of tokens of each of its prefixes, the last entry that of the whole (a cache bounded in chunks and characters)."""

    def __init__(self, pieces: list[str], most: int = 600_000, most_chars: int = 8_000_000):
        super().__init__()
        self.rank = {p: i for i, p in enumerate(pieces)}
        self.width = max(map(len, pieces))
        self.most, self.most_chars, self.chars = most, most_chars, 0
        self.split: dict[str, tuple[str, str] | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.good = {p for p in pieces if len(p) == 1 or self.halves(p)}

    def halves(self, t: str) -> tuple[str, str] | None:
        """The two tokens whose merge made t; None for a single character, and for a piece that isn't its own encoding."""
        found = self.split.get(t, 0)
        if found == 0:
            part, found = list(t), None
            while len(part) > 1:
                best, at = min((self.rank.get(part[i] + part[i + 1], NONE), i) for i in range(len(part) - 1))
                if best == NONE:
                    found = None
                    break
                found = (part[at], part[at + 1])
                part[at : at + 2] = [part[at] + part[at + 1]]
            self.split[t] = found
        return found

    def stays(self, a: str, b: str) -> bool:
        """Whether a and b, encoded together, stay as they are: undo their merges, the latest first, and look for one over the border that would have come before."""
        rank, limit = self.rank, NONE
        while True:
            if rank.get(a + b, NONE) < limit:
                return False
            ra, rb = rank.get(a, -1) if len(a) > 1 else -2, rank.get(b, -1) if len(b) > 1 else -2
            if ra == rb == -2:
                return True
            if ra > rb:
                limit, a = ra, self.halves(a)[1]
            else:
                limit, b = rb + 1, self.halves(b)[0]

    def extend(self, chunk: str, count: list[int], last: list[str]) -> None:
        """Fills in count and last for the chunk's prefixes that they don't have. Only one last token fits a prefix, so the search may begin with the shortest."""
        good, fits, width = self.good, self.fits, self.width
        for end in range(len(count), len(chunk) + 1):
            for start in range(end - 1, max(-1, end - width - 1), -1):
                t = chunk[start:end]
                if t in good or start == end - 1:
                    if start:
                        pair = (last[start], t)
                        ok = fits.get(pair)
                        if ok is None:
                            if len(fits) > self.most:
                                fits.clear()
                            ok = fits[pair] = self.stays(*pair)
                        if not ok:
                            continue
                    count.append(count[start] + (1 if t in good else len(t.encode("utf-8", "surrogatepass"))))
                    last.append(t)
                    break

    def learn(self, chunks: set[str]) -> None:
        """Stores the tables that are missing, in sorted order: a chunk goes on from the prefix that it has in common with the one before."""
        new = sorted(chunks.difference(self))
        if len(self) + len(new) > self.most or self.chars > self.most_chars:
            self.clear()
            self.chars = 0
            new = sorted(chunks)
        before, count, last = "", [0], [""]
        for c in new:
            k, n = 0, min(len(c), len(before))
            while k < n and c[k] == before[k]:
                k += 1
            del count[k + 1 :], last[k + 1 :]
            self.extend(c, count, last)
            self[c] = bytes(count[1:]) if count[-1] < 256 else array("L", count[1:])
            self.chars += len(c)
            before = c

    def chunks(self, text: str) -> list[str]:
        return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []

    def counts(self, text: str) -> list[int]:
        """The number of tokens of text[:k] for k = 0 to len(text)."""
        out, base = [0], 0
        parts = self.chunks(text)
        self.learn(set(parts))
        for c in parts:
            own = self[c]
            out += [base + x for x in own]
            base += own[-1]
        return [0, *out[2:]] if text else [0]

    def measure(self, texts: list[str], limit: int) -> list[tuple[int, int]]:
        """For each text its tokens, and how many characters its longest prefix of at most ``limit`` tokens has."""
        split = [self.chunks(t) for t in texts]
        self.learn(set().union(*split))
        out = []
        for text, parts in zip(texts, split, strict=True):
            total = sum([self[c][-1] for c in parts])
            out.append((total, len(text) if total <= limit else self.longest(parts, limit)))
        return out

    def longest(self, parts: list[str], limit: int) -> int:
        """Characters of the longest prefix within the limit, from the stored tables: the chunk in which it ends, then the place in that chunk's table."""
        sums = list(accumulate(self[c][-1] for c in parts))
        k = bisect_right(sums, limit)
        base = sums[k - 1] if k else 0
        inner = max((i + 1 for i, x in enumerate(self[parts[k]]) if base + x <= limit), default=0) if k < len(parts) else 0
        return max(0, sum(map(len, parts[:k])) + inner - 1)

    def within(self, text: str, limits: list[int]) -> list[int]:
        """For each limit, how many characters of the text fit it; the text is encoded by no question."""
        parts = self.chunks(text)
        self.learn(set(parts))
        return [min(len(text), self.longest(parts, n)) for n in limits]


def portions(texts: list[str], most: int = 2_000_000) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``most`` characters."""
    out, n = [], 0
    for t in texts:
        out.append(t)
        n += len(t)
        if n >= most:
            yield out
            out, n = [], 0
    if out:
        yield out


_held: dict[int, PrefixCounter] = {}


def token_counts(df: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and keep_chars: characters of the longest prefix within the limit.

    One pass over the texts, no shuffle; the vocabulary (a few hundred KB, whatever the input) goes to the workers.
    """
    spark: SparkSession = df.sparkSession
    pieces = spark.sparkContext.broadcast(pieces_of(model_file))
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "keep_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _held.get(hash(model_file)) or _held.setdefault(hash(model_file), PrefixCounter(pieces.value))
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [x for part in portions(texts) for x in counter.measure(part, limit)]
            total = [n for n, _ in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(total, pa.int64()), pa.array([n > limit for n in total], pa.bool_()), pa.array([k for _, k in found], pa.int64())], names)

    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, keep_chars long")
