import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duesight.llm import packing
from duesight.llm.queries import tokenizer_path


def check_plan(counts, capacity):
    ranks, load = {}, {}
    for length, low, n, sequence, offset in packing.plan(counts, capacity):
        for i in range(n):
            ranks.setdefault(length, []).append(low + i)
            load.setdefault(sequence + i, []).append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items() if n}
    for pieces in load.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(load)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=40))
def test_plan_places_every_piece_once(counts):
    n = check_plan(counts, 64)
    assert n <= max(1, 2 * sum(k * v for k, v in counts.items()) / 64 + 1)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    counts = Counter(np.clip(rng.lognormal(6, 1, 20_000), 1, 2048).astype(int).tolist())
    bound = -(-sum(k * v for k, v in counts.items()) // 2048)
    assert check_plan(counts, 2048) <= 1.01 * bound + 1


def test_words_are_encoded_as_whole_texts():
    tokens = packing.WordTokens(tokenizer_path())
    texts = ["Don't can't 's 'tis (''s", "a<|endoftext|>B", "É́ \x1c x", "", "  ", "12,5 €3", "A\tb\r\nc.,;d", "x" * 500,
             "one, two. THREE-four", "日本語 ΑΣ"]
    assert tokens.encode(texts) == [tokens.whole(t) for t in texts] == tokens.encode(texts)


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    tokens = packing.WordTokens(tokenizer_path())
    texts = ["alpha beta gamma", "alpha delta", "epsilon zeta eta theta", "alpha"]
    for _ in range(3):
        assert tokens.encode(texts) == [tokens.whole(t) for t in texts]


def test_odd_documents(spark, odd):
    tokens = packing.WordTokens(tokenizer_path())
    rows = packing.pack_documents(odd, tokenizer_path(), ids=True).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    by = {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["start"] == 2048 * r["piece"]
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[6]) == 2 and len(by[None]) == 2
    assert by[1][0]["length"] == by[2][0]["length"] == 1
    long = b"".join(r["ids"] for r in sorted(by[3], key=lambda r: r["piece"]))
    text = odd.where("doc_id = 3").first()["text"]
    assert long == tokens.whole(text) + np.array([0], "<u4").tobytes()
    used = Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048


def test_empty_table(spark, empty):
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize("capacity", [1, 7])
def test_small_capacity(spark, odd, capacity):
    rows = packing.pack_documents(odd.where("doc_id IN (1, 5, 6, 9)"), tokenizer_path(), capacity).collect()
    assert max(r["offset"] + r["length"] for r in rows) <= capacity


class _LookedUp(dict):
    def __iter__(self):
        raise AssertionError("gone through")


def test_words_put_aside_are_looked_up_only():
    tokens = packing.WordTokens(tokenizer_path())
    texts = ["one two three.", "four, five"]
    ids = tokens.encode(texts)
    tokens.words, tokens.old = {}, _LookedUp(tokens.words)
    assert tokens.encode(texts) == ids
    assert set(tokens.words) == {"one", "two", "three.", "four,", "five"}
