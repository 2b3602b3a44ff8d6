"""Quality selection by importance resampling.

Two generative models of hashed n-grams, one of the target (labelled rows of
good quality that aren't toxic) and one of raw text (all labelled rows), give
each document a log weight: the sum of the log ratios of the n-grams it
contains. The models are of documents: an n-gram counts once in a text, so that
a text that repeats itself doesn't outvote others. A run of eight equal words is
one n-gram of its own kind. Ratios that chance could give, or within a factor of
`FACTOR`, count as 1, and so do those above 1: a document is as likely as its
least likely words make it, whatever its length.

The models are fitted on at most `FIT_ROWS` labelled rows (the bound of the
sample, drawn by the hash of the text, one row for equal texts). All documents
are scored. The sample that is kept is drawn without replacement by Gumbel
top-k: of `log weight / TEMPERATURE + Gumbel noise`, the k largest, where k is
the number of documents above the log weight that best separates the labelled
rows. The noise comes from the id, so a repeated run draws the same sample.

Null text counts as empty, and has weight 0 as an empty text has. Null labels
and labels without a document are left out; without usable labels nothing is
rejected. Rows with the same id and text stand or fall together. Further
columns of the input are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duesight.llm.shingles import LETTERS_AND_SIGNS, batches, hashed_words, mix
from duesight.session import materialise

FIT_ROWS = 60_000
#: Buckets of hashed n-grams, as a power of two.
BITS = 22
RUN = 8
#: Standard errors and factor from which a ratio counts.
ERRORS, FACTOR = 4.0, 3.0
TEMPERATURE = 0.1


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, n-gram) once each, sorted by document. N-gram 2^BITS is the run of equal words."""
    words, starts = hashed_words(texts, LETTERS_AND_SIGNS)
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    gram = (words >> np.uint64(64 - BITS)).astype(np.int64)
    plain, begin = hashed_words(texts)
    if len(plain) >= RUN:
        at = np.repeat(np.arange(len(texts)), np.diff(begin))
        # Equal neighbours in one text, RUN - 1 times in a row.
        equal = np.concatenate([[0], np.cumsum((plain[1:] == plain[:-1]) & (at[1:] == at[:-1]))])
        runs = at[RUN - 1 :][equal[RUN - 1 :] - equal[: len(equal) - RUN + 1] == RUN - 1]
        doc, gram = np.concatenate([doc, runs]), np.concatenate([gram, np.full(len(runs), 1 << BITS)])
    both = np.unique(doc * ((1 << BITS) + 1) + gram)
    return both // ((1 << BITS) + 1), both % ((1 << BITS) + 1)


@dataclass(frozen=True)
class Model:
    """The n-grams whose ratio counts, sorted, their log ratios, and the log weight that separates."""

    grams: np.ndarray
    ratios: np.ndarray
    cutoff: float = 0.0

    def log_weights(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in batches(texts):
            doc, gram = features(texts[a:b])
            if len(self.grams):
                at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
                out[a:b] = np.bincount(doc, np.where(self.grams[at] == gram, self.ratios[at], 0), b - a)
        return out


def labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """text, good: the sample that is fitted."""
    verdict = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        ((F.min("quality") > 0) & (F.max("toxic") == 0)).alias("good"))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"))
    known = materialise(hashed.join(verdict, "doc_id").groupBy(F.bitwise_not("h").alias("order")).agg(
        F.min("doc_id").alias("doc_id"), F.min("good").alias("good")), "labelled")
    least = kth_largest(known, "order", rows)
    chosen = (known if least is None else known.where(F.col("order") >= least)).select("doc_id", "good")
    # At most `rows` rows of 9 bytes.
    return docs.select("doc_id", "text").join(F.broadcast(materialise(chosen, "fitted")), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    sample = labelled(docs, labels, rows)

    def count(parts):
        total, target, n = np.zeros((1 << BITS) + 1, np.int32), np.zeros((1 << BITS) + 1, np.int32), [0, 0]
        for part in parts:
            texts, good = part.column("text").to_pylist(), np.array(part.column("good").to_pylist(), bool)
            n = [n[0] + len(texts), n[1] + int(good.sum())]
            for a, b in batches(texts):
                doc, gram = features(texts[a:b])
                total += np.bincount(gram, minlength=len(total)).astype(np.int32)
                target += np.bincount(gram[good[a:b][doc]], minlength=len(total)).astype(np.int32)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], n[0]).astype(np.int64)),
                               pa.array(np.append(target[seen], n[1]).astype(np.int64))],
                              names=["gram", "total", "target"])

    counts = materialise(
        sample.mapInArrow(count, "gram long, total long, target long").groupBy("gram").agg(
            F.sum("total").alias("total"), F.sum("target").alias("target")), "grams")
    n = counts.where("gram = -1").first()
    if n is None or not n["target"] or n["total"] == n["target"]:
        return Model(np.zeros(0, np.int64), np.zeros(0))
    share = n["target"] / n["total"]
    expected = F.col("total") * share
    ratio = F.log((F.col("target") + 0.5) / (expected + 0.5))
    # As many rows as there are buckets, at most.
    kept = counts.where("gram >= 0").select("gram", ratio.alias("ratio")).where(
        (ratio < -np.log(FACTOR)) & (F.col("target") - expected < -ERRORS * F.sqrt(expected))
    ).orderBy("gram").toPandas()
    model = Model(kept["gram"].to_numpy(np.int64), kept["ratio"].to_numpy(float))

    def weigh(parts):
        for part in parts:
            yield pa.record_batch([part.column("good"), pa.array(model.log_weights(part.column("text").to_pylist()))],
                                  names=["good", "w"])

    bins = sample.mapInArrow(weigh, "good boolean, w double").groupBy(
        F.greatest(F.floor(F.col("w") * 4), F.lit(-400)).alias("bin")).agg(
        F.sum(F.col("good").cast("long")).alias("good"), F.count("*").alias("n")).orderBy(F.desc("bin")).collect()
    return Model(model.grams, model.ratios, separating([(r["bin"], r["good"], r["n"] - r["good"]) for r in bins]))


def separating(bins: list[tuple[int, int, int]]) -> float:
    """From (quarter, good rows, bad rows), best first: the weight with the least sum of both error rates."""
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    kept_good = kept_bad = 0
    best, found = 1e9, []
    for quarter, g, b in bins:
        kept_good, kept_bad = kept_good + g, kept_bad + b
        error = 1 - kept_good / max(good, 1) + kept_bad / max(bad, 1)
        if error < best - 1e-12:
            best, found = error, [quarter]
        elif abs(error - best) <= 1e-12:
            found.append(quarter)
    # Of equally good weights the middle one.
    return (found[0] + found[-1]) / 8


def noise(ids: np.ndarray, seed: int = 8) -> np.ndarray:
    """Standard Gumbel numbers from ids."""
    uniform = (mix(mix(ids.astype(np.uint64)) + np.uint64(seed)) >> np.uint64(11)).astype(float) / (1 << 53)
    return -np.log(-np.log(np.clip(uniform, 1e-18, 1 - 1e-16)))


def unused(df: DataFrame, name: str) -> str:
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def scored(docs: DataFrame, model: Model, weight: str, key: str) -> DataFrame:
    """The rows of `docs` with their log weight and the key of the draw."""
    schema = T.StructType([*docs.schema.fields, T.StructField(weight, T.DoubleType()), T.StructField(key, T.DoubleType())])

    def run(parts):
        for part in parts:
            w = model.log_weights(part.column("text").to_pylist())
            ids = np.array([i or 0 for i in part.column("doc_id").to_pylist()], np.int64)
            yield pa.record_batch([*part.columns, pa.array(w), pa.array(w / TEMPERATURE + noise(ids))],
                                  names=[*part.schema.names, weight, key])

    return docs.mapInArrow(run, schema)


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value, exactly, by histograms of ever narrower ranges; None if there are no more rows than k."""
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("n")).first()
    if k >= ends["n"]:
        return None
    if k <= 0:
        return float("inf")
    low, high, left = ends["low"], ends["high"], k
    while low < high:
        width = (high - low) / 4096
        # At most 4097 rows.
        found = df.where(F.col(column).between(low, high)).groupBy(
            F.floor((F.col(column).cast("double") - low) / F.lit(width)).alias("b")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("b")).collect()
        for r in found:
            if left <= r["n"]:
                low, high = r["low"], r["high"]
                break
            left -= r["n"]
        if len(found) == 1:
            break
    return low


def resampled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, columns: list[str] | None = None) -> DataFrame:
    """The documents that are drawn: their columns (or those named), and the log weight as the last."""
    model = fit(docs, labels, rows)
    weight, key = unused(docs, "log_weight"), unused(docs, "draw_key")
    full = scored(docs, model, weight, key)
    if columns is not None:
        full = full.select(*columns, weight, key)
    table = materialise(full, "scored")
    if not len(model.grams):
        return table.drop(key)
    k = table.where(F.col(weight) >= model.cutoff).count()
    least = kth_largest(table.select(key), key, k)
    return (table if least is None else table.where(F.col(key) >= least)).drop(key)
