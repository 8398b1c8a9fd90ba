"""Word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ODD = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """word (bytes) -> 64-bit hash; a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One cache for all tasks of a worker.
WORDS = Words()


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        out = out * ODD + h[j : len(h) - k + 1 + j]
    return mixed(out)


def words_of(text: str | None, lower: bool) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.translate(LOWER) if lower else raw).split()  # bytes split at ASCII white space only


#: Of word_hashes: the bytes of a piece of text and of a word that are hashed so (longer words are hashed by themselves), the powers of a
#: factor and of its inverse (modulo 2^64), and white space.
PIECE, MOST = 1 << 16, 64
FACTOR = 0x9FB21C651E98DF25
POWER = np.cumprod(np.append(np.uint64(1), np.full(PIECE + MOST + 1, FACTOR, np.uint64)))
INVERSE = np.cumprod(np.append(np.uint64(1), np.full(PIECE + MOST + 1, pow(FACTOR, -1, 2**64), np.uint64)))
BREAK = re.compile(rb"[\x20\x09-\x0D]")


def pieces(raw: bytes) -> list[bytes]:
    """raw cut at white space, so that pieces are about PIECE bytes long, or longer only by the rest of a word."""
    out, at = [], 0
    while len(raw) - at > PIECE:
        found = BREAK.search(raw, at + PIECE)
        end = found.start() if found else len(raw)
        out.append(raw[at:end])
        at = end
    return [*out, raw[at:]]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, by sums over the text's bytes instead of one call for each word."""
    if len(raw) > PIECE + MOST:
        return np.concatenate([word_hashes(p) if len(p) <= PIECE + MOST else np.concatenate([one_word(w) for w in p.split()]) for p in pieces(raw)])
    b = np.frombuffer(raw, np.uint8)
    blank = np.ones(len(b) + 2, bool)
    blank[1:-1] = (b == 32) | (b - np.uint8(9) < 5)
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b * POWER[: len(b)], out=total[1:])
    h = mixed((total[end] - total[start]) * INVERSE[start] + (end - start).astype(np.uint64) * ODD)
    for i in np.flatnonzero(end - start > MOST):
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
    return h


def one_word(word: bytes) -> np.ndarray:
    return word_hashes(word) if len(word) <= MOST else np.array([xxhash.xxh3_64_intdigest(word)], np.uint64)


def distinct(h: np.ndarray) -> np.ndarray:
    """h (which is sorted in place) without repetitions."""
    h.sort()
    fresh = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=fresh[1:])
    return h[fresh]


def shingle_set(text: str | None, k: int = 4) -> np.ndarray:
    """Sorted distinct shingles; with fewer words, the whole sequence as one; none without words."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if not len(h):
        return h
    return distinct(windows(h, k)) if len(h) >= k else mixed(windows(h, len(h)) + np.uint64(len(h)))
