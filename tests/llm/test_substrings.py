import hashlib
import random

from stopgrid.llm import substrings as S


def words(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [x for x in (text or "").split(" ") if x]


def brute(rows):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, 1 << 63), 1 << 62 if d is None else d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < (1 << 62 if d is None else d):
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    passages = [[f"p{k}_{rng.randrange(9)}" for _ in range(rng.choice([12, 13, 14, 30]))] for k in range(6)] + [["same"] * 20, ["a", "b"] * 10]
    rows = []
    for d in rng.sample(range(0, 9000), 150):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 20))]
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(w)))
    return [*rows, (9999, None), (9998, ""), (None, rows[0][1]), (rows[3][0], rows[3][1]), (-5, rows[4][1])]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 64)
    rows = corpus()
    df = spark.createDataFrame([(d, t, 3, "x") for d, t in rows], "doc_id long, text string, segment int, id string").repartition(5)
    for batches in (1, 2, 6):
        got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.dedup_substrings(df, batches).collect()), key=str)
        assert got == brute(rows)


def test_runs_are_merged_where_they_are_and_compacted(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 64)
    rows = S.numbered(spark.createDataFrame(corpus(), "doc_id long, text string")).select("segment", "id", "text")
    index = S.FingerprintIndex(spark)
    cuts = [0, 4000, 7000, 7500, 10000]
    for a, b in zip(cuts, cuts[1:], strict=False):
        index.add(rows.where(f"id >= {a} and id < {b}")).count()
        lengths = [index.length(n) for n in index.runs]
        assert all(a >= 2 * b for a, b in zip(lengths, lengths[1:], strict=False))
    assert index.compactions >= 1
    held = [S.unpack(r["packed"]) for r in index.run(*index.runs).collect()]
    want = set()
    for _, text in [(d, t) for d, t in corpus() if d is not None and 0 <= d < 10000]:
        ws = S.words_of(text, False)
        if len(ws) >= S.WINDOW:
            want |= set(zip(*(x.tolist() for x in S.fingerprints(S.Words().of(ws))), strict=True))
    got = [p for k, c in held for p in zip(k.tolist(), c.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want
    merged = S.sent(rows, index.buckets).groupBy("bucket").cogroup(index.run(index.runs[0]).groupBy("bucket")).applyInPandas(S.met, S.SENT)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    names = list(index.runs)
    index.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_empty(spark):
    assert S.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_packing_round_trip():
    import numpy as np

    rng = np.random.default_rng(1)
    k, c = S.distinct(rng.integers(0, 1 << 48, 5000, dtype=np.uint64), rng.integers(0, 1 << S.CHECK_BITS, 5000, dtype=np.uint64))
    a, b = S.unpack(S.pack(k, c))
    assert (a == k).all() and (b == c).all()
    assert len(S.unpack(S.pack(k[:0], c[:0]))[0]) == 0


def test_order_of_fingerprints_that_begin_alike():
    import numpy as np

    rng = np.random.default_rng(2)
    k = rng.integers(0, 20, 4000, dtype=np.uint64)
    c = rng.integers(0, 3, 4000, dtype=np.uint64) << np.uint64(S.CHECK_BITS - 16) | rng.integers(0, 5, 4000, dtype=np.uint64)
    order, new = S.in_order(k, c)
    pairs = list(zip(k[order].tolist(), c[order].tolist(), strict=True))
    assert sorted(order.tolist()) == list(range(4000)) and pairs == sorted(pairs)
    assert new.tolist() == [i == 0 or pairs[i] != pairs[i - 1] for i in range(4000)]
    values = rng.integers(0, 1000, 4000)
    want = {}
    for p, v in zip(zip(k.tolist(), c.tolist(), strict=True), values.tolist(), strict=True):
        want[p] = min(v, want.get(p, v))
    assert S.least(values[order], new).tolist() == [want[p] for p, n in zip(pairs, new, strict=True) if n]
    empty = np.zeros(0, np.uint64)
    assert all(len(x) == 0 for x in S.in_order(empty, empty))
