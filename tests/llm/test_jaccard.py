import random

from stopgrid.llm import jaccard as J


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(docs):
    sets = {d: shingles(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            s, u = sets[a], sets[b]
            if s and u and 100 * len(s & u) >= 85 * len(s | u):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), find(d)) for d in docs}


def corpus(seed, n, spread):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 3, 5, 40, 80, 120]))] for _ in range(n // 5)]
    docs = {}
    for d in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, spread])):
            i = rng.randrange(len(w))
            k = rng.random()
            if k < 0.4:
                w[i] = f"z{rng.randrange(30)}"
            elif k < 0.7 and len(w) > 1:
                del w[i]
            else:
                w.insert(i, "new")
        docs[d * 3 + 1] = rng.choice([" ", "\n", " \t"]).join(w).upper() if rng.random() < 0.2 else " ".join(w)
    docs[0], docs[2] = "", "  \n "
    return docs


def test_against_brute_force(spark, monkeypatch):
    for seed, block in ((1, 1 << 17), (2, 200)):  # the second: groups in many blocks
        monkeypatch.setattr(J, "BLOCK", block)
        docs = corpus(seed, 200, 4)
        df = spark.createDataFrame([(d, t, 5) for d, t in docs.items()] + [(5000, None, 5)], "doc_id long, text string, n long")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.link_components(df).collect()}
        want = brute(docs) | {5000: (0, 5000)}
        assert got == want
        kept = sorted(r["doc_id"] for r in J.one_of_each(df).collect())
        assert kept == sorted(d for d, (n, c) in want.items() if c == d)


def test_rows_without_id_repeated_and_empty(spark):
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "only this one here")], schema)
    assert sorted(str(r["component_id"]) for r in J.link_components(df).collect()) == ["7", "7", "7", "None"]
    assert J.link_components(df.limit(0)).collect() == []


def test_other_columns_with_names_of_ours(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(2, text, "a", "b", 1, 5), (1, text, "c", "d", 2, 6), (None, text, "e", "f", 3, 7), (3, "", "g", "h", 4, 8), (4, None, "i", "j", 5, 9)], "doc_id long, text string, _d string, _r string, _row int, component_id int")
    out = J.one_of_each(df)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} == {tuple(r) for r in df.where("doc_id is null or doc_id <> 2").collect()}


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 5000}x{i // 7}" for i in range(60000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, long[: len(long) // 2])], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in J.link_components(df).collect()} == {1: 1, 2: 1, 3: 3}
