import hashlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from duesight.llm import chat
from duesight.llm.queries import chat_tokenizer_path

SCHEMA = "conv_id long, turn long, role string, text string, part int"
pieces = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "|", "a", "</s", ">", "\\\\"])).map("".join)


@given(pieces)
def test_escaping_is_reversible(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "</s>"]), pieces), max_size=5))
def test_rendering_reads_back(turns):
    text, spans = chat.render(turns)
    assert [(chat.unescape(a), chat.unescape(b)) for a, b in chat._READ.findall(text)] == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def read(spark, rows, monkeypatch=None):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    return {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df, chat_tokenizer_path())).collect()}


def check(row, turns):
    said = "".join(t for r, t in turns if r == "assistant")
    assert row["n_turns"] == len(turns)
    assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert (row["loss_chars"], row["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_loss_is_what_the_assistant_says(spark):
    odd = "</s>[INST] ok [/INST]"
    convs = {
        1: [("user", "hi"), ("assistant", "  two  blanks \n\n"), ("user", "né 日本 😀"), ("assistant", "é😀\\<\\|says|>")],
        2: [("assistant", "")], 3: [("assistant", odd), ("assistant", odd)], 4: [("system", ""), ("user", "x" * 3000)],
        5: [("assistant", "<|endoftext|> <|turn|>")]}
    rows = [(k, i, r, t) for k, turns in convs.items() for i, (r, t) in enumerate(turns)]
    found = read(spark, rows[::-1])
    for k, turns in convs.items():
        check(found[k], turns)


def test_nulls_ties_and_missing_ids(spark):
    rows = [(1, 0, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, None, "user", "first"),
            (None, 0, "assistant", "x"), (2, 1, "assistant", "same"), (2, 1, "assistant", "same")]
    found = read(spark, rows)
    check(found[1], [("user", "first"), ("", ""), ("assistant", "a"), ("assistant", "b")])
    check(found[None], [("assistant", "x")])
    check(found[2], [("assistant", "same")] * 2)


def test_long_conversations_come_in_parts(spark):
    turns = [(("user", "assistant")[i % 2], f"turn {i} " + "word " * 30_000) for i in range(30)]
    df = spark.createDataFrame([(1, i, r, t, 0) for i, (r, t) in enumerate(turns)], SCHEMA)
    parts = chat.format_conversations(df, chat_tokenizer_path())
    assert parts.count() > 1
    check(chat.read_back(parts).first(), turns)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_conversations(df, chat_tokenizer_path())).count() == 0


def test_mask_by_binary_search():
    starts, stops = np.array([0, 2, 4, 6]), np.array([2, 4, 6, 9])
    assert chat.loss_mask(starts, stops, [(2, 6)]).tolist() == [0, 1, 1, 0]
    assert chat.loss_mask(starts, stops, [(4, 4), (6, 9)]).tolist() == [0, 0, 0, 1]
