import random

import numpy as np

from duesight.llm import quality
from tests.llm.helpers import prose

INSULTS = "oafish twerpy gormless dimwit".split()


def corpus(n, seed=0):
    """(doc_id, text, verdict): 0 junk, 1 good, 2 toxic."""
    rng = random.Random(seed)
    vocabulary = prose(50, 400).split()
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        kind = (1, 1, 1, 0, 2)[i % 5]
        if kind == 2:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        if kind == 0:
            words = [w + " %%%" for w in words] if i // 10 % 2 else [w for w in words[:4] for _ in range(20)]
        out.append((i, " ".join(words), kind))
    return out


def tables(spark, rows, labelled):
    docs = spark.createDataFrame([(i, t, 1.0, "k") for i, t, _ in rows], "doc_id long, text string, log_weight double, draw_key string")
    labels = spark.createDataFrame([(i, int(k != 0), int(k == 2)) for i, _, k in rows if i % 10 < labelled],
                                   "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_documents_are_judged_right(spark):
    rows = corpus(3000)
    docs, labels = tables(spark, rows, 5)
    kept = quality.resampled(docs, labels)
    assert kept.columns[:4] == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    held = [(i, k) for i, _, k in rows if i % 10 >= 5]
    assert np.mean([i in ids for i, k in held if k == 1]) > 0.98
    assert np.mean([i in ids for i, k in held if k != 1]) < 0.02


def test_a_repeated_run_draws_the_same_sample(spark):
    docs, labels = tables(spark, corpus(300), 10)
    a, b = ([r["doc_id"] for r in quality.resampled(docs, labels, columns=["doc_id"]).orderBy("doc_id").collect()] for _ in range(2))
    assert a == b


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=5000), np.repeat(0.25, 3000), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    for k in (1, 2, 500, 2500, 5000, 8001):
        assert quality.kth_largest(df, "x", k) == np.sort(values)[-k]
    assert quality.kth_largest(df, "x", len(values)) is None


def test_noise_is_gumbel():
    g = quality.noise(np.arange(200_000))
    assert abs(g.mean() - 0.5772) < 0.02 and abs(g.std() - 1.2825) < 0.02


def test_runs_stay_within_a_text():
    doc, gram = quality.features(["a a a a", "a a a a", "b " * 8, None, ""])
    assert [d for d, g in zip(doc, gram) if g == 1 << quality.BITS] == [2]


def test_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (5, None, 0), (None, 1, 0), (999, 1, 1), (8, 1, None)],
                                   "doc_id long, quality int, toxic int")
    for part in (labels, labels.limit(0)):
        assert quality.resampled(odd, part).count() == odd.count()
        assert quality.resampled(empty, part).count() == 0
