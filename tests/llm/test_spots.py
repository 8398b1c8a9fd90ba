import hashlib
import re

from stopgrid.llm import spots as S


def codes(text):
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    out, run = set(), None
    for w in [*words, None]:
        if w is None or w in S.COMMON:
            if run:
                out.add(" ".join(run[: S.CHAIN]))
            run = []
        elif run is not None:
            run.append(w)
    return out


TEXTS = {
    1: "The cat sat on the mat, and the dog ran to a hill. The cat sat!",
    2: "The cat sat on the mat, and the dog ran to a hill. The cat sat?",
    5: "",
    6: None,
    2000: "no anchors-here really: nothing",
    2001: "le chat est sur la table et der Hund ist im Haus é",
    9000: "!!!",
    9001: "The cat sat on the mat, and the dog ran to a hill. The cat sat! And the end of it is here now.",
}


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "codes") for i, t in TEXTS.items()], "doc_id long, text string, codes string")
    rows = {r["doc_id"]: r for r in S.against_edits(df).collect()}
    ids = sorted(TEXTS)
    assert sorted(rows) == ids
    for k, i in enumerate(ids):
        a, b = TEXTS[i] or "", TEXTS[ids[(k + 1) % len(ids)]] or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        r = rows[i]
        assert r["n_chars"] == len(a)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if codes(a):
            assert len(r["fingerprint"]) == 8 * len(codes(a))
            for other, got in ((edited, r["near_edited"]), (b, r["near_next"])):
                if codes(other):
                    assert abs(got - len(codes(a) & codes(other)) / len(codes(a) | codes(other))) < 1e-12
    assert rows[1]["fingerprint"] == rows[2]["fingerprint"] and rows[1]["near_next"] == 1.0
    assert rows[5]["fingerprint"] == rows[6]["fingerprint"] == "" and rows[5]["near_next"] == 1.0
    assert len(rows[2000]["fingerprint"]) == len(rows[9000]["fingerprint"]) == 8


def test_ties_empty_and_one_row(spark):
    schema = "doc_id long, text string"
    assert S.against_edits(spark.createDataFrame([], schema)).collect() == []
    one = S.against_edits(spark.createDataFrame([(None, "the cat sat on the mat")], schema)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    two = S.against_edits(spark.createDataFrame([(1, "the cat"), (1, "the cat"), (1, "the dog")], schema)).collect()
    assert sorted(r["near_next"] for r in two) == [0.0, 0.0, 1.0]


def test_near_pairs(spark):
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(80):
        base = random.Random(i % 8).choices(words, k=30)
        for _ in range(rng.randint(0, 4)):
            base[rng.randrange(30)] = rng.choice(words)
        docs.append((i, " the ".join(["x", *base])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = {}
    for i, t in docs:
        sets.setdefault(frozenset(codes(t)), i)
    flat = [(i, s) for s, i in sets.items()]
    want = {(min(a, b), max(a, b)) for a, s in flat for b, u in flat if a < b and len(s & u) / len(s | u) >= 0.8}
    assert want and {(r["a"], r["b"]) for r in S.near_pairs(df).collect()} == want
