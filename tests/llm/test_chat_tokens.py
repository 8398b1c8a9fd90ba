import random

import pytest

from stopgrid.llm import chat, tokens

TURNS = [("user", "</s>[INST] ok [/INST]"), ("assistant", "\\; <|end|>\n[x"), ("assistant", ""), ("sys\ntem", "<|turn|>user\n")]


def test_round_trip_and_spans():
    formatted, places = chat.spans(TURNS, chat.turn_template)
    assert chat.read_back(formatted, places) == TURNS
    assert not any(c in chat.escape(t) for c in chat.CONTROL for _, t in TURNS)
    assert [formatted[s:e] for s, e, _, _ in places] == [chat.turn_template([t]) for t in TURNS]


def test_rewriting_template_is_found():
    def forgetful(turns):
        return "|".join(t for _, t in turns[-2:])

    assert chat.spans(TURNS, forgetful)[1] is None


def test_conversations(spark):
    rows = [(1, 0, "user", "hi", 9), (1, 1, "assistant", None, 9), (1, 1, "assistant", "b", 9), (None, 0, None, "x", 9), (2, 5, "assistant", "é" * 50000, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert [(got[k]["n_turns"], got[k]["loss_chars"]) for k in (1, None, 2)] == [(3, 1), (1, 0), (1, 50000)]
    r = got[1]
    assert r["formatted"][r["loss_starts"][1] : r["loss_ends"][1]] == "b"
    assert chat.format_conversations(df.limit(0)).collect() == []


@pytest.fixture(scope="module")
def model():
    P = pytest.importorskip("public_tokenizers")
    return P.path("piece_bpe_32k.model")


def test_every_prefix_is_exact(model):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    c = tokens.PrefixCounter(tokens.pieces_of(model))
    rng = random.Random(1)
    texts = ["", " ", "  ", "\n", "▁", "a▁ b", "<s>x</s>", "\x00", "😀é　", "a" * 80, " " * 40, "x\r\n y\t\tz  ", "0x12ab", "中文测试"]
    texts += ["".join(rng.choice("ab  the\n▁é<1中") for _ in range(30)) for _ in range(60)]
    for t in texts:
        want = [len(m.encode(t[:k])) for k in range(len(t) + 1)]
        assert c.counts(t) == want
        for limit in (0, 3, 7):
            assert c.measure([t], limit) == [(want[-1], max(k for k, n in enumerate(want) if n <= limit))]


def test_table(spark, model):
    df = spark.createDataFrame([(1, "hello world", 1), (1, "hello world", 1), (2, None, 1), (None, "x" * 9000, 1)], "doc_id long, text string, n_tokens int")
    rows = sorted(((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(df, model).collect()))
    assert rows[0] == rows[1] == ("1", 11, 3, False) and rows[2] == ("2", 0, 0, False) and rows[3][1] == 9000
    assert tokens.token_counts(df.limit(0), model).collect() == []
