import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from duesight.llm import scoring
from duesight.llm.shingles import LETTERS_AND_SIGNS, hashed_words
from tests.llm.helpers import prose


def tokens(text):
    return re.findall(r"[^\W_]+|[^\w\s]+|_+", (text or "").lower())


def brute(texts, most):
    docs = [tokens(t) for t in texts]
    counts = Counter(w for d in docs for w in d)
    hashed = {w: int(hashed_words([w], LETTERS_AND_SIGNS)[0].view(np.int64)[0]) for w in counts}
    known = set(sorted(counts, key=lambda w: (-counts[w], hashed[w]))[:most])
    docs = [[w if w in known else None for w in d] for d in docs]
    one, two = Counter(w for d in docs for w in d), Counter(p for d in docs for p in zip(d, d[1:]))
    n = sum(one.values())
    return [sum([math.log(one[d[0]] / n)] + [
        math.log(two[a, b] / one[a]) if two[a, b] >= 2 else math.log(0.4 * one[b] / n) for a, b in zip(d, d[1:])])
        if d else 0.0 for d in docs]


@pytest.mark.parametrize("most, partitions", [(scoring.WORDS, None), (30, 7), (scoring.WORDS, 5)])
def test_same_scores_as_brute_force(spark, monkeypatch, most, partitions):
    monkeypatch.setattr(scoring, "GATHERED", 3000)
    rng = random.Random(4)
    vocabulary = prose(9, 300).split()
    texts = [" ".join(rng.choice(vocabulary[: rng.choice((5, 50, 300))]) + rng.choice(("", "", ",", " !")) for _ in range(rng.randrange(90)))
             for _ in range(400)] + ["", None, "x", "X", "one, two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = brute(texts, most)
    found = scoring.scored(df, most, partitions).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r["n_words"] == len(tokens(texts[r["doc_id"]]))
        assert r["log_score"] == pytest.approx(want[r["doc_id"]], abs=1e-4)
        assert (r["per_word"] is None) == (r["n_words"] == 0)


def test_vocabulary_numbers():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2)
    words = scoring.Vocabulary(hashes, np.arange(5000), 10**9)
    assert (words.hashes[words.numbers(hashes)] == hashes).all()
    assert (words.numbers(hashes + np.uint64(1)) == words.unknown).all()


def test_odd_documents(spark, odd, empty):
    rows = scoring.scored(odd).collect()
    assert len(rows) == odd.select("doc_id").distinct().count()
    assert {r["doc_id"]: r["n_words"] for r in rows}[6] == 2
    assert scoring.scored(empty).count() == 0


def same_as_brute_force(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = brute(texts, None)
    found = {r["doc_id"]: r["log_score"] for r in scoring.scored(df).collect()}
    assert found == {i: pytest.approx(w, abs=1e-3) for i, w in enumerate(want)}


def test_more_distinct_words_than_2_to_18_stay_apart(spark):
    texts = [" ".join(f"w{i * 1000 + j}" for j in range(1000)) + " the end of the text" for i in range(300)]
    same_as_brute_force(spark, texts + texts[:20])


def test_words_that_no_task_knows_are_joined(spark, monkeypatch):
    monkeypatch.setattr(scoring, "COMMON", 1 / 100)
    rng = random.Random(6)
    vocabulary = prose(10, 400).split()
    same_as_brute_force(spark, [" ".join(rng.choice(vocabulary[: rng.choice((5, 60, 400))]) for _ in range(rng.randrange(60)))
                                for _ in range(300)] + ["", vocabulary[-1], vocabulary[-1]])


def test_rows_of_rare_words_are_not_dealt_out_again_for_a_count(spark, monkeypatch, capsys):
    monkeypatch.setattr(scoring, "COMMON", 1 / 100)
    texts = ["a b rare word a b", "rare word", "word a", "b rare a word rare word", "lone", "a lone"] * 2 + ["a a b b"] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scoring.scored(df).explain()
        assert "hashpartitioning(key" not in capsys.readouterr().out
        same_as_brute_force(spark, texts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
