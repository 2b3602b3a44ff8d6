import hashlib
import random

import numpy as np
import pytest

from duesight.llm import suffixes
from duesight.llm.queries import op13_suffix_array_dedup
from tests.llm.helpers import prose


def brute_force(docs):
    """Every string of 100 bytes in a dictionary, in order of documents. `docs`: (id, text)."""
    seen, out = set(), []
    for key, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            s = data[i : i + 100]
            if s in seen:
                gone[i : i + 100] = True
            seen.add(s)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((key, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def by_key(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0))


def planted(seed: int, n: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    passages = [prose(k, 40) for k in range(6)] + ["a" * 300, "ab" * 130, "x" * 99, "\0" * 170]
    docs = []
    for key in range(n):
        parts = [prose(1000 + key, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            if rng.random() < 0.6:
                a = rng.randint(0, len(p) // 2)
                p = p[a : a + rng.randint(90, 140)]
            parts += [p, prose(rng.randint(0, 10**6), rng.randint(0, 5))]
        docs.append((key * 3 - 7, "é ".join(parts)))
    copies = [(10_000 + k, docs[5][1] if k % 2 else docs[5][1][:-3] + str(k)) for k in range(40)]
    return docs + copies


def test_against_brute_force(spark):
    docs = planted(1, 150)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    wanted = brute_force(docs)
    assert sum(r[2] > 0 for r in wanted) > 60 and any(r[3] > 1 for r in wanted)
    assert by_key(suffixes.suffix_report(frame).collect()) == wanted


@pytest.mark.parametrize("rows, parts", [(1, 3), (2, 40), (20_000, 64)])
def test_groups_that_spread_over_ranges(spark, monkeypatch, rows, parts):
    """Most rows share their seeds; those above the limit go through Spark start by start."""
    monkeypatch.setattr(suffixes, "CLASS_ROWS", rows)
    monkeypatch.setattr(suffixes, "GROUP_ROWS", 3)
    common = prose(77, 30)
    docs = [(k, f"{prose(k, 3)} {common[k % 7:]} {prose(k // 2, 4)}") for k in range(200)]
    docs += [(1000 + k, common) for k in range(100)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = by_key(suffixes.suffix_report(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got == brute_force(docs)


def test_slices_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE", 700)
    docs = planted(3, 40)
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert by_key(suffixes.suffix_report(frame).collect()) == brute_force(docs)


def test_the_given_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert by_key(op13_suffix_array_dedup(spark, sf_dir).collect()) == brute_force(docs)


def test_odd_documents(spark, odd, empty):
    """Rows of one id and text are one document, returned as often as they come."""
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = suffixes.suffix_report(odd).collect()
    assert len(got) == len(rows)
    single = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    docs = [(r["doc_id"], r["text"]) for r in single.select("doc_id", "text").collect()]
    assert by_key(suffixes.suffix_report(single).collect()) == brute_force(docs)
    twice = [(1, prose(5, 50))] * 3 + [(2, prose(5, 50)), (None, prose(6, 50)), (None, prose(6, 50) + " more"), (3, None)]
    got = by_key(suffixes.suffix_report(spark.createDataFrame(twice, "doc_id long, text string")).collect())
    n = len(prose(5, 50))
    assert [r[2] for r in got if r[0] == 1] == [0, 0, 0] and [r[2] for r in got if r[0] == 2] == [n]
    assert sorted(r[2] for r in got if r[0] is None) == [0, len(prose(6, 50))]
    assert suffixes.suffix_report(empty).collect() == []


def test_texts_that_are_left(spark):
    docs = [(1, prose(5, 50)), (2, "head " + prose(5, 50) + " tail")]
    got = {r["doc_id"]: r for r in suffixes.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1]["text"] == docs[0][1] and got[1]["spans"] == []
    assert got[2]["text"] == "head  tail" and [tuple(s) for s in got[2]["spans"]] == [(5, 5 + len(docs[0][1]))]
