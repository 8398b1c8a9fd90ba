"""Hashes of words by sums over bytes name words as bytes.split finds them."""

import random

from stopgrid.llm import shingles as S


def test_word_hashes_name_words():
    r, named = random.Random(1), {}
    for n in (0, 1, 5, 40, 30000):
        words = [bytes(r.choice(b"abc\x00\x1c\xc3\xa9\xff") for _ in range(r.choice((1, 2, 9, 63, 64, 65, 200)))) for _ in range(n)]
        if n == 40:
            words[20] = b"x" * 200_000  # longer than a piece of text
        raw = b"".join(w + r.choice((b" ", b"\t\n", b"\x0b\x0c", b"  \r")) for w in words)
        for text in (raw, b" " + raw.rstrip()):
            found = S.word_hashes(text).tolist()
            assert text.split() == words and len(found) == n
            for w, h in zip(words, found, strict=True):
                assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)


def test_shingle_sets_are_those_of_word_runs():
    for text, n in ((None, 0), (" \n", 0), ("a", 1), ("a b c", 1), ("A b c d", 1), ("a b c d e", 2), ("a b a b a b a", 2)):
        assert len(S.shingle_set(text)) == n
    assert S.shingle_set("A b\tC d").tolist() == S.shingle_set(" a B c  D ").tolist()
    assert S.shingle_set("a b").tolist() != S.shingle_set("b a").tolist()
