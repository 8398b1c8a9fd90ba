import random
import re

import numpy as np

from stopgrid.llm import decontam as D
from stopgrid.llm import quality as Q

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        own = words(t)
        n = min(13, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == own[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w), longest(w, [words(t) for _, t in items])


def longest(w, items):
    best = 0
    for own in items:
        for i in range(len(own)):
            for j in range(len(w)):
                n = 0
                while i + n < len(own) and j + n < len(w) and own[i + n] == w[j + n]:
                    n += 1
                best = max(best, n)
    return best


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)] + ["Éa", "x9"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 12, 13, 14, 40])))) for i in range(12)] + [(None, "only this"), (3, "w1 w2 w3"), (50, None)]
    docs = []
    for d in range(60):
        w = rng.choices(vocabulary + ["zz"], k=rng.randint(0, 60))
        if rng.random() < 0.6:
            own = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(w) + 1)
            w[at:at] = own
        docs.append((d, rng.choice([" ", ", ", "-"]).join(w).upper() if rng.random() < 0.3 else " ".join(w), 7))
    docs += [(100, None, 7), (101, "", 7), (102, "w1 " * 900, 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = D.blocks_of
    for most in (1_000_000, 20):  # the second: many blocks
        monkeypatch.setattr(D, "blocks_of", lambda b, most=most: blocks(b, most))
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"], r["longest_match"]) for r in D.find_matches(df, bench).collect()}
        want = {d: brute(t, items) for d, t, _ in docs}
        assert got == want
        kept = D.decontaminate(df, bench)
        assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, x in want.items() if not x[3]}
    assert D.find_matches(df.limit(0), bench).collect() == [] and len(D.find_matches(df, bench.limit(0)).collect()) == len(docs)


def test_quality(spark):
    rng = random.Random(1)
    syllables = ["an", "er", "the", "in", "ou", "st", "re"]

    def text(good):
        w = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(5, 80))]
        return " ".join(w) if good else rng.choice([" ".join(x.upper() + "!!" for x in w), " ".join([w[0]] * 30), " | ".join(w)])

    rows = [(i, text(i % 4 > 0), i % 4 > 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(9000, None, "en"), (None, "", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(g), 0) for i, _, g in rows] + [(5, None, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = Q.fit_on(docs, labels)
    out = Q.score(docs, model).collect()
    held = [(r["predicted"], int(r["doc_id"] % 4 > 0)) for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert len(out) == len(rows) + 2 and np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)
    assert Q.keep_good(docs, model).columns == docs.columns
    none = Q.fit_on(docs, labels.limit(0))
    assert {r["score"] for r in Q.score(docs.limit(3), none).collect()} == {0.5}
    assert Q.score(docs.limit(0), model).collect() == []


def test_suffixes_deeper_than_a_key(spark):
    """A vocabulary so large that a key packs a few words only: matches of every length are found."""
    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(1, 40)))) for i in range(150)]
    flat = [t.split() for _, t in items]
    docs = []
    for d in range(80):
        w = [f"w{rng.randrange(3000)}" for _ in range(30)]
        for _ in range(2):
            own = rng.choice(flat)
            i = rng.randrange(len(own))
            w[10:10] = own[i : i + rng.randint(1, 20)]
        docs.append((d, " ".join(w)))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"], r["longest_match"]) for r in D.find_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {d: brute(t, items) for d, t in docs}
    assert got == want and {x[4] for x in want.values()} > {5, 9, 13, 15}


def test_fit_keeps_its_bounds(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(i, "word " * 50) for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    rows = Q.sample(docs, labels, 4000, 10**9)
    ids = [r["doc_id"] for r in rows]
    assert len(ids) == len(set(ids)) > 30 and all(Q.zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)
    assert len(Q.sample(docs, labels, 7, 10**9)) == 7
    assert sum(len(r["text"]) for r in Q.sample(docs, labels, 4000, 1000)) <= 1000
    scored = Q.score(spark.createDataFrame([(None, "x", 1.0), (3, "y " * 100000, 2.0)], "doc_id long, text string, score double"), Q.fit_on(docs, labels)).collect()
    assert {r["doc_id"]: r["held_out"] for r in scored}[None] is False and len(scored) == 2
