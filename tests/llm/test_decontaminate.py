import itertools
import random

import numpy as np
import pytest

from duesight.llm import decontaminate
from tests.llm.helpers import prose

ITEMS = [prose(100 + i, 30 + i) for i in range(20)]


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(i, t, "x") for i, t in enumerate(ITEMS)] + [(90, None, "x"), (91, "", "x"), (92, "too short", "x"),
                                                         (93, "exactly these six rare words here", "x"), (94, ITEMS[0], "x")]
    return spark.createDataFrame(rows, "item_id long, text string, matches string")


def substituted(text, every, seed=0):
    words = text.split()
    for i in range(every // 2, len(words), every):
        words[i] = f"other{i}"
    return " ".join(words)


def test_passages_are_found_and_clean_texts_are_not(spark, benchmark):
    rng = random.Random(0)
    rows, want = [], {}
    for i in range(60):
        own = prose(i, 200).split()
        at = rng.randrange(200)
        kind = i % 6
        item = ITEMS[i % 20]
        part = {0: item, 1: item.upper().replace(" ", ",  "), 2: substituted(item, 9), 3: "", 4: " ".join(item.split()[:10]), 5: substituted(item, 2)}[kind]
        rows.append((i, " ".join(own[:at] + [part] + own[at:]), "x"))
        want[i] = kind < 3
    rows += [(100, None, "x"), (101, "", "x"), (102, "exactly these six rare words here", "x"), (103, "too short", "x"),
             (104, ITEMS[3], "x"), (104, ITEMS[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    found = decontaminate.overlaps(docs, benchmark)
    ids = {r["doc_id"] for r in found.collect()}
    assert ids == {i for i, w in want.items() if w} | {102, 104}
    assert found.where("doc_id = 104 AND item_id = 3").count() == 2
    assert found.where("item_id = 94").count() == found.where("item_id = 0").count() > 0
    kept = decontaminate.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - ids


def test_filter_without_room_changes_nothing(spark, benchmark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 60) + " " + t + " " + prose(50 + i, 60)) for i, t in enumerate(ITEMS)],
                                 "doc_id long, text string")
    want = sorted(decontaminate.overlaps(docs, benchmark).collect())
    assert {(r["doc_id"], r["item_id"]) for r in want} == {(i, i) for i in range(20)} | {(0, 94)}
    monkeypatch.setattr(decontaminate, "FILTER", 10)
    assert sorted(decontaminate.overlaps(docs, benchmark).collect()) == want


def test_one_text_never_completes_another(spark, benchmark):
    words = ITEMS[5].split()
    docs = spark.createDataFrame([(1, " ".join(words[:10])), (2, " ".join(words[10:20])), (3, " ".join(words[20:30]))],
                                 "doc_id long, text string")
    assert decontaminate.overlaps(docs, benchmark).count() == 0


def test_odd_and_empty_tables(spark, odd, empty, benchmark):
    assert decontaminate.overlaps(odd, benchmark).count() == 0
    assert decontaminate.decontaminated(odd, benchmark).count() == odd.count()
    assert decontaminate.overlaps(empty, benchmark).count() == 0
    assert decontaminate.decontaminated(odd, benchmark.limit(0)).count() == odd.count()
    assert decontaminate.overlaps(odd, benchmark.limit(0)).count() == 0


def share_or_run(equal, n):
    """The rule, written apart: 80 % of the item equal, or a stretch of 13 equal words that outweigh its changes."""
    total = sum(equal)
    if 5 * total >= 4 * n:
        return True
    stretches = [(sum(1 if e else -2 for e in equal[i:j]), sum(equal[i:j])) for i in range(n) for j in range(i + 1, n + 1)]
    best = max(stretches, default=(0, 0))
    return best[1] >= 13 or 5 * best[1] >= 4 * n


def test_every_place_of_substitutions(spark):
    """Whichever words are changed, up to a fifth of an item and beyond."""
    rng = random.Random(8)
    items, rows, want = [], [], {}
    for n in range(5, 31):
        item = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        for changes in range(n // 5 + 2):
            places = list(itertools.combinations(range(n), changes))
            if len(places) > 1500:
                places = rng.sample(places, 300)
            for chosen in places:
                equal = [i not in chosen for i in range(n)]
                want[len(rows)] = (n, share_or_run(equal, n))
                rows.append((len(rows), " ".join(["before"] * 3 + [w if e else "other" for w, e in zip(item, equal)] + ["after"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(
        docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, n) for i, (n, good) in want.items() if good}
    # A fifth of the item changed is always found.
    assert all(want[i][1] for i, t in rows if t.split().count("other") * 5 <= want[i][0])


def test_no_overlap_is_without_a_seed():
    """All places of a fifth of the words, for items of every length to 25, against the masks alone."""
    for n in range(5, 26):
        changes = n // 5
        places = np.array(list(itertools.combinations(range(n), changes)))
        equal = np.ones((len(places), n), bool)
        np.put_along_axis(equal, places, False, axis=1)
        hit = np.zeros(len(places), bool)
        for mask in decontaminate.MASKS:
            for at in range(n - mask[-1]):
                hit |= equal[:, [at + i for i in mask]].all(axis=1)
        assert hit.all(), n


def test_items_with_a_common_phrase(spark):
    items = [(i, prose(60, 12) + " " + prose(61 + i, 8)) for i in range(30)]
    docs = spark.createDataFrame([(i, prose(1, 50) + " " + t + " " + prose(2, 40)) for i, t in items], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(
        docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(i, i) for i in range(30)} <= found
    assert all(i == j or sum(a == b for a, b in zip(items[i][1].split(), items[j][1].split())) >= 13 for i, j in found)


def test_rows_without_an_id_and_clashing_names(spark, benchmark):
    rows = [(None, ITEMS[0], 1, "a"), (None, "clean words only in this text", 2, "b"), (None, None, 3, "c"), (7, ITEMS[0].upper(), 4, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class long, digest string")
    assert sorted(r["class"] for r in decontaminate.decontaminated(docs, benchmark).collect()) == [2, 3]
    assert decontaminate.overlaps(docs, benchmark).where("item_id = 0").count() == 2
