from stopgrid.llm import mixing as M


def level(children, budget):
    """children: name -> (cap, weight). Water filling by bisection."""
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(c, w * mid) for c, w in children.values()) < budget:
            low = mid
        else:
            high = mid
    return {k: min(c, w * high) for k, (c, w) in children.items()}


def test_hand_down_redistributes_shortages(spark):
    rows = [("a", 10, 1.0), ("b", 1000, 1.0), ("c", 50, 2.0), ("d", 400, 1.0), ("e", 5, 0.0)]
    for budget in (0, 30, 100, 500, 1460, 5000):
        df = spark.createDataFrame([(*r, budget) for r in rows], "k string, cap long, weight double, budget long")
        got = {r["k"]: r["share"] for r in M.hand_down(df, [], "k").collect()}
        want = level({k: (c, w) for k, c, w in rows if w > 0}, budget)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) <= 1 for k in got)


def test_mix_edges(spark):
    schema = "doc_id long, text string, lang string, source string, domain int, copies int"
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "en" if i % 3 else None, f"src{i % 5}" if i % 11 else None, 1, 1) for i in range(300)] + [(7, None, "en", "src0", 1, 1), (None, "x y", "en", "src1", 1, 1), (9, "a b", "en", "src2", 1, 1)], schema)
    rows = M.mix(docs).collect()
    total = sum(r["n_tokens"] * r["copies"] for r in rows)
    have = sum(len((r["text"] or "").split()) for r in docs.collect())
    assert 0.4 * have < total <= 0.5 * have and all(1 <= r["copies"] <= M.EPOCHS for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, M.mix(docs.repartition(7)).collect()))
    assert M.mix(docs.limit(0)).collect() == []
    assert {r["copies"] for r in M.mix(docs.where("text is not null"), share=2.0).collect()} == {2}


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline as C

    good = " ".join(f"word{i} of the line" for i in range(30))
    docs = spark.createDataFrame([(1, good, "en", "src0", 5), (2, good, "en", "src1", 5), (3, "another text that is nothing like it " * 2, "en", "src2", 5), (4, None, "en", "src2", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "mixing_to_weights"]
    lined = C.line_dedup(spark, docs, str(tmp_path))
    assert lined.columns == docs.columns and {r["doc_id"] for r in lined.collect()} == {1, 3, 4}
    alone = C.ngram_jaccard_join(spark, docs, str(tmp_path))
    assert alone.columns == docs.columns and {r["doc_id"] for r in alone.collect()} == {1, 3, 4}
    assert C.benchmark_decontamination(spark, docs, str(tmp_path)).count() == 4
    assert C.quality_classifier(spark, docs, str(tmp_path)).columns == docs.columns


def test_near_duplicate_stage_against_brute_force(spark):
    """The stage links from four fifths of five words, also where four words and 0.85 wouldn't."""
    import random

    import corpus_pipeline as C

    rng, docs = random.Random(4), {}
    for g in range(40):
        base = [f"v{rng.randrange(900)}" for _ in range(rng.choice([3, 60, 100, 150]))]
        for j in range(3):
            w = list(base)
            for _ in range(j and rng.choice([0, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"new{rng.randrange(900)}"
            docs[3 * g + j] = " ".join(w)

    def alike(k):
        split = {d: t.split(" ") for d, t in docs.items()}
        sets = {d: {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for d, w in split.items()}
        return {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in docs for b in docs if a < b}

    five, four = alike(5), alike(4)
    links = {p for p, (x, y) in five.items() if 5 * x >= 4 * y}
    assert any(100 * four[p][0] < 85 * four[p][1] for p in links)
    root = dict(zip(docs, docs, strict=True))
    for a, b in sorted(links) * len(docs):
        root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in C.ngram_jaccard_join(spark, df, "").collect())
    assert got == sorted(d for d in docs if root[d] == d)


def test_mixed_documents_keep_their_texts(spark):
    schema = "doc_id long, text string, lang string, source string, copies string, _d int"
    docs = spark.createDataFrame([(i, f"w{i} " * (i % 5 + 1), "en", f"s{i % 3}", "own", 1) for i in range(60)] + [(7, "other", "en", "s0", "own", 2), (8, None, None, None, None, None), (None, "no id", "en", "s1", "own", 3)] + [(500, "twice", "en", "s2", "own", 4)] * 2, schema)
    short, out = M.mix(docs), M.mixed(docs)
    assert out.columns == [*docs.columns, "domain", "n_tokens", "copies_"]
    rows = out.collect()
    assert sum(r["copies_"] * r["n_tokens"] for r in rows) == sum(r["copies"] * r["n_tokens"] for r in short.collect()) > 0
    assert all(r["n_tokens"] == len((r["text"] or "").split()) for r in rows) and len({(r["doc_id"], r["text"]) for r in rows}) == len(rows)
    assert {(r["doc_id"], r["text"]) for r in rows} <= {(r["doc_id"], r["text"]) for r in docs.collect()} and M.mixed(docs.limit(0)).collect() == []


def test_mix_with_another_tree(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en", f"s{i % 4}", "x") for i in range(80)], "doc_id long, text string, lang string, source string, weight string")
    rows = M.mix(docs, share=0.25, epochs=1, domain="if(source in ('s0', 's1'), 'a', 'b')", weights={"domain": "if(domain = 'a', 1.0, 0.0)", "lang": "1.0", "source": "if(source = 's0', 3.0, 1.0)"}).collect()
    tokens = {s: sum(r["n_tokens"] for r in rows if r["source"] == s) for s in ("s0", "s1", "s2", "s3")}
    assert tokens == {"s0": 150, "s1": 50, "s2": 0, "s3": 0}


def test_run_against_plain_code(spark, tmp_path):
    """The whole pipeline over a small corpus: what each stage must drop and keep, and empty tables."""
    import random

    import corpus_pipeline as C

    rng = random.Random(12)
    syllables = ["an", "er", "the", "in", "ou", "st", "re", "mo", "li"]
    prose = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))
    bench = [prose(25) for _ in range(3)]
    rows = [(i, "\n".join(prose(40) for _ in range(3))) for i in range(300)]
    rows += [(1000 + i, " ".join(w.upper() + "!!" for w in prose(60).split())) for i in range(100)]  # poor ones
    rows += [(2000 + i, rows[i][1]) for i in range(10)]  # exact copies: all their lines are gone
    near = rows[20][1].split()
    rows += [(2100, " ".join(["changed", *near[1:]])), (2200, prose(30) + " " + bench[0]), (2201, rows[30][1].split("\n")[0] + "\n" + prose(50))]
    docs = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, df in (
        ("documents", spark.createDataFrame(docs, schema)),
        ("labels", spark.createDataFrame([(i, int(not 1000 <= i < 1100), 0) for i, _ in rows], "doc_id long, quality int, toxic int")),
        ("benchmark", spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")),
    ):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    out = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in C.STAGES:
        out = C.written(stage(spark, out, str(tmp_path)), "t")
        kept.append({r["doc_id"]: r for r in out.collect()})
    assert not [i for i in kept[0] if 1000 <= i < 1100] and len([i for i in kept[0] if i < 300]) > 290
    assert not [i for i in kept[1] if 2000 <= i < 2010] and kept[1][2201]["text"].count("\n") == 0
    assert kept[1][2201]["n_chars"] == len(kept[1][2201]["text"])
    assert 2100 not in kept[2] and 20 in kept[2] and {i for i in kept[2] if i < 300} == {i for i in kept[1] if i < 300}
    assert 2200 not in kept[3] and set(kept[2]) - set(kept[3]) == {2200}
    total = sum(len(r["text"].split()) for r in kept[3].values())
    mixed = kept[4].values()
    assert 0.4 * total < sum(r["n_tokens"] * r["copies"] for r in mixed) <= 0.5 * total and set(kept[4]) <= set(kept[3])
    assert all(r["text"] == kept[3][d]["text"] for d, r in kept[4].items())
    assert sorted(map(str, C.run(spark, str(tmp_path)).collect())) == sorted(map(str, mixed))
    nothing = spark.createDataFrame([], schema)
    for _, stage in C.STAGES[:-1]:
        nothing = stage(spark, nothing, str(tmp_path))
        assert nothing.columns == schema.replace(" long", "").replace(" string", "").split(", ") and nothing.collect() == []
    assert C.mixing_to_weights(spark, nothing, str(tmp_path)).collect() == []
