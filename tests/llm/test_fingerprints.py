import hashlib

import numpy as np
import pytest

from duesight.llm import fingerprints
from tests.llm.helpers import prose


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(texts):
    out = []
    for i, t in enumerate(texts):
        half = len(t) // 2
        out.append(t[: len(t) - half] + texts[(i + 1) % len(texts)][:half])
    return out


@pytest.mark.parametrize("start", [0, 5 << 40, -3])
def test_edited_texts_and_likeness(spark, start):
    texts = [prose(i % 30, 20 + 13 * (i % 17)) for i in range(200)] + ["", "one", "one", "Ünïcode 😀 text", "a b c d"]
    ids = [start + 997 * i * i for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(df).collect()}
    assert len(found) == len(texts)
    errors = []
    for i, (t, e) in enumerate(zip(texts, edited(texts))):
        r = found[ids[i]]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        errors += [r["near_edited"] - jaccard(t, e), r["near_next"] - jaccard(t, texts[(i + 1) % len(texts)])]
    assert np.abs(errors).max() < 0.17 and abs(np.mean(errors)) < 0.02
    by = {}
    for i, t in enumerate(texts):
        assert by.setdefault(t, found[ids[i]]["fingerprint"]) == found[ids[i]]["fingerprint"]


def test_next_document_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ALONE", 2)
    monkeypatch.setattr(fingerprints, "NEAR", 2)
    ids = sorted({i * i * 7 - 50 for i in range(60)} | {10**12, 10**12 + 1, -10**15})
    texts = [f"text {i} number" for i in ids]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(7)
    found = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.edited_fingerprints(df).collect()}
    for i, e in zip(ids, edited(texts)):
        assert found[i] == hashlib.sha256(e.encode()).hexdigest()


def test_one_document_follows_itself(spark):
    r = fingerprints.edited_fingerprints(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and r["near_next"] == 1.0


def test_likeness_is_unbiased(spark):
    base = prose(1, 1500).split()
    rows = []
    for i in range(60):
        cut = 25 * i
        rows.append((" ".join(base), " ".join(base[:1500 - cut] + prose(1000 + i, cut).split())))
    df = spark.createDataFrame(rows, "x string, y string")
    df = fingerprints.packed(fingerprints.packed(df, "x", "a"), "y", "b")
    got = [(r["l"], jaccard(r["x"], r["y"])) for r in df.select("x", "y", fingerprints.likeness("a", "b").alias("l")).collect()]
    error = np.array([a - b for a, b in got])
    assert abs(error.mean()) < 0.02 and error.std() < 0.05


def test_no_python_in_the_plan(spark, odd):
    plan = fingerprints.edited_fingerprints(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_documents(spark, odd, empty):
    rows = fingerprints.edited_fingerprints(odd).collect()
    assert len(rows) == odd.count()
    same = [r["fingerprint"] for r in rows if r["doc_id"] in (3, 4)]
    assert same[0] == same[1] != ""
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2, 7)} == {""}
    assert fingerprints.edited_fingerprints(empty).count() == 0
    assert fingerprints.fingerprints(odd).count() == odd.count()
