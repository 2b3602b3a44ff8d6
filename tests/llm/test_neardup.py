import random
import re
from itertools import combinations

import numpy as np
import pytest

from duesight.llm import neardup
from duesight.llm.components import components
from duesight.llm.shingles import LETTERS, LETTERS_AND_SIGNS, hashed_words, shingle_sets
from tests.llm.helpers import prose


def exact_sets(texts, width):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def brute(ids, texts, width, per_100):
    sets = exact_sets(texts, width)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in combinations(zip(ids, sets), 2):
        if a and b and 100 * len(a & b) >= per_100 * len(a | b):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in zip(ids, sets)}


def copies(seed, n, words, most):
    """A text and copies with up to `most` words changed."""
    rng, base, out = random.Random(seed), prose(seed, words).split(), []
    for k in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, most)):
            copy[rng.randrange(words)] = prose(rng.randrange(10**6), 1)
        out.append(" ".join(copy))
    return out


@pytest.fixture(scope="module")
def texts():
    out = [t for s in range(40) for t in copies(s, 1 + s % 4, 30 + 5 * s, 3)]
    out += copies(777, 150, 150, 7) + ["", None, "one", "ONE", "a b", "a  b\n", "É", "é", " \x0b "] * 2
    random.Random(1).shuffle(out)
    return out


@pytest.mark.parametrize("width, per_100, block", [(3, 85, 1024), (5, 80, 1024), (3, 85, 20)])
def test_same_components_as_brute_force(spark, texts, monkeypatch, width, per_100, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    ids = [7 * i + 3 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    want = brute(ids, texts, width, per_100)
    for r in neardup.near_duplicates(df, width, per_100).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_sets_are_those_of_the_words(texts):
    for width in (1, 3, 5):
        assert [len(s) for s in shingle_sets(texts, width)] == [len(s) for s in exact_sets(texts, width)]
    a, b = shingle_sets(["x Y z", "X y\tz"], 2)
    assert (a == b).all()
    words, starts = hashed_words(["a,b", "a b", None], LETTERS)
    assert starts.tolist() == [0, 2, 4, 4] and (words[:2] == words[2:]).all()
    assert np.diff(hashed_words(["a,b %%"], LETTERS_AND_SIGNS)[1]).tolist() == [4]


def test_packing_keeps_a_set():
    s = shingle_sets([prose(3, 500)], 3)[0]
    assert len(neardup.unpacked(neardup.packed(s))) == len(s)
    assert len(neardup.unpacked(neardup.packed(s[:0]))) == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000 + rng.randrange(80), 5000 + rng.randrange(80)) for _ in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for a, b in edges for x in (a, b) if a != b or x in found}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(spark, odd, empty):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["component_id"] == 3 and by[9]["component_id"] == 8 and by[6]["component_id"] == 5
    assert by[1]["n_shingles"] == by[7]["n_shingles"] == 0 and by[1]["kept"] and by[7]["kept"]
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    kept = neardup.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [-5, 1, 2, 3, 5, 7, 8, 1 << 60]
    assert neardup.near_duplicates(empty).count() == neardup.deduplicated(empty).count() == 0
