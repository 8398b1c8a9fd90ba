import random

from stopgrid.llm import linededup as L


def fold(line):
    out = line.lower()
    for c in "\t\r\x0b\x0c":
        out = out.replace(c, " ")
    return " ".join(x for x in out.split(" ") if x)


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def near(a, b, short=0, words=10):
    if a == b:
        return True
    if min(len(a), len(b)) <= short or (a.count(" ") + 1 >= words) != (b.count(" ") + 1 >= words):
        return False
    return one_apart(a.split(" "), b.split(" ")) if a.count(" ") + 1 >= words else one_apart(a, b)


def brute(docs, rows_of):
    seen, out = [], {}
    for doc, text in sorted(docs.items(), key=lambda x: (x[0] is not None, x[0], rows_of.get(x[0], 0))):
        gone = []
        for i, line in enumerate(text.split("\n")):
            n = fold(line)
            if n:
                if any(near(n, x) for x in seen):
                    gone.append(i)
                seen.append(n)
        out[doc] = gone
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    base = ["the cat sat on the mat", "page 12 of 90", "é è ü 😀 unusual line", "x", "ab", "long " * 60, "nine words of one line and the bound changes", "ten words of a line and the edit bound changes here"]
    docs = {}
    for d in range(90):
        lines = []
        for _ in range(rng.randint(1, 6)):
            s = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i = rng.randrange(len(s) + 1)
                k = rng.random()
                if k < 0.3:
                    s.insert(i, rng.choice("abz 7"))
                elif s and i < len(s):
                    if k < 0.6:
                        del s[i]
                    else:
                        s[i] = rng.choice("abz 7")
            lines.append("".join(s))
        docs[d] = "\n".join(lines)
    docs[95] = ""
    docs[96] = "\n\n  \n"
    docs[97] = "aaaa\naaa\naa\n\ta\n"
    rows = [(d, t, "en", "s", 1, 9) for d, t in docs.items()] + [(99, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, line int")
    want = brute(docs, {})
    got = {r["doc_id"]: r for r in L.marked(df).collect()}
    assert {d: r["_gone"] or [] for d, r in got.items() if d != 99} == want
    out = {r["doc_id"]: r["text"] for r in L.dedup_lines(df).collect()}
    for d, t in docs.items():
        kept = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d])
        assert out.get(d, "") == kept if kept.strip() or not want[d] else d not in out
    assert out[99] is None and L.dedup_lines(df).columns == df.columns


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "same line"), (1, "same line"), (2, "same  LINE"), (None, "other line")], "doc_id long, text string")
    assert sorted((str(r[0]), r[1]) for r in L.dedup_lines(df).collect()) == [("1", "same line"), ("1", "same line"), ("None", "other line")]
    assert L.dedup_lines(df.limit(0)).collect() == []


def test_long_line(spark):
    long = "ab" * 20000
    df = spark.createDataFrame([(1, long), (2, long[:9999] + "x" + long[10000:]), (3, long + "yz")], "doc_id long, text string")
    assert [r[0] for r in L.dedup_lines(df).orderBy("doc_id").collect()] == [1, 3]


def test_query_and_stage_keep_short_lines_of_other_words(spark, tmp_path):
    import hashlib

    import corpus_pipeline as C
    from stopgrid.llm.queries import op8_line_dedup

    rng = random.Random(8)
    base = ["for.", "it.", "a line of 12", "a line of 013", "page 10 of 100", "some longer line"]
    docs = {0: "for.\nF\u00fcr.\nMit.\nit.\nFOR.\nit."}
    for d in range(1, 40):
        lines = [list(rng.choice(base)) for _ in range(rng.randint(1, 5))]
        for s in lines:
            s[rng.randrange(len(s))] = rng.choice("abz")
        docs[d] = "\n".join(map("".join, lines))
    seen, kept = [], {}
    for d, text in docs.items():
        kept[d] = []
        for line in text.split("\n"):
            n = fold(line)
            if not any(near(n, x, 12) for x in seen):
                kept[d].append(line)
            seen.append(n)
    assert kept[0] == ["for.", "F\u00fcr.", "Mit.", "it."]
    rows = [(d, t, "en", "s", len(t)) for d, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["kept_sha256"] for r in op8_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: hashlib.sha256("\n".join(k).encode()).hexdigest() for d, k in kept.items()}
    assert {r["doc_id"]: r["text"] for r in C.line_dedup(spark, df, "").collect()} == {d: "\n".join(k) for d, k in kept.items() if k}


def test_a_word_of_a_long_line(spark):
    """A line of ten words or more is near one with a word changed, added or gone, whatever its characters; a shorter one only by a character."""
    rng, rows, want, seen = random.Random(11), [], [], []
    base = [[f"{c}{i}word" for i in range(n)] for c, n in (("p", 8), ("q", 9), ("r", 10), ("s", 11), ("t", 40), ("u", 200))]
    for d in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2])):
            i, k = rng.randrange(len(w)), rng.random()
            if k < 0.4:
                w[i] = rng.choice(["x" * 30, "2024", "2025"])
            elif k < 0.7:
                del w[i]
            else:
                w.insert(i, rng.choice(["y", "inserted"]))
        line = " ".join(w)
        rows.append((d, line))
        if not any(near(line, x, 12) for x in seen):
            want.append(d)
        seen.append(line)
    got = sorted(r[0] for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), L.SHORT).collect())
    assert got == want and 20 < len(want) < 100


def test_other_columns_with_names_of_ours(spark):
    df = spark.createDataFrame([(1, "a line that is here twice", "x", "y", "z", 1, "p"), (2, "a line that is here twice\nand another", "x", "y", "z", 2, "q")], "doc_id long, text string, _d string, _r string, _gone string, row int, place string")
    out = L.dedup_lines(df)
    assert out.columns == df.columns and sorted(tuple(r) for r in out.collect()) == [(1, "a line that is here twice", "x", "y", "z", 1, "p"), (2, "and another", "x", "y", "z", 2, "q")]


def test_repeated_ids_and_null_ids(spark):
    rows = [(None, "first of all the lines"), (1, "a text of one id"), (1, "another text of one id"), (1, "a text of one id"), (2, "first of all the lineS\nanother text of one  id\n")]
    got = sorted((str(r[0]), r[1]) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", "a text of one id"), ("1", "a text of one id"), ("1", "another text of one id"), ("None", "first of all the lines")]
