"""Benchmark passages in documents, by spaced seeds.

A seed is the hash of `WEIGHT` words of a stretch under one of `MASKS`; the word
that a mask ignores may be any. The seeds of the benchmark form a table, joined
by hash with those of the documents. A hit says where an item would lie in a
document. There all words are compared in place, and the two overlap if

* `SHARE` of the item's words are equal, wherever the changed ones stand, or
* the best stretch (an equal word counts 1, another -2; of ties, the longest) has
  `MATCHES` equal words, or `SHARE` of the item's.

No overlap is without a seed. Four equal neighbours are one. Otherwise runs of
equal words have three words at most. If `SHARE` of the item is equal, there is
a run of three, or of two and two, with a single changed word beside it and an
equal word behind that; a best stretch begins with three equal words, a changed
and an equal one, or with two, a changed one and two. `tests/llm` goes through the
places of the changes.

Most seeds of the documents occur in no item. A Bloom filter of the benchmark's
seeds (`BITS` bits for a seed, `FILTER` at most; beyond that it lets more through,
which changes no result) keeps these from the join. Items with the same words
are one item until the end.

Words are runs of letters and digits without regard to case. Items of fewer than
`SHORTEST` words, empty and null ones among them, never match: texts that don't
quote them hold them, too. Null text counts as empty.
Every row is looked at, texts are read whole; repeated rows, and rows that share
an id or have none, have results each. Other columns are not looked at, whatever
their names, and `decontaminated` hands them on. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duesight.llm.shingles import LETTERS, batches, hashed_words, mix
from duesight.session import materialise

#: Places of the words that count; the others are ignored.
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
WEIGHT = 4
SHORTEST = 5
MATCHES, SHARE = 13, 0.8
#: Bits of the filter for each seed, the bits that a seed sets, and the filter's largest size as a power of two (32 MB).
BITS, PROBES, FILTER = 32, 6, 28


def seeds(words: np.ndarray, mask: int) -> np.ndarray:
    """The hash under a mask from each position."""
    places = MASKS[mask]
    n = max(len(words) - places[-1], 0)
    out = np.full(n, mask + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in places:
            out = (out ^ words[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
    return mix(out)


def seeds_of_texts(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word's place in it, hash) of all seeds that lie in one text."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    out = []
    for mask, places in enumerate(MASKS):
        h = seeds(words, mask)
        inside = np.flatnonzero(text[: len(h)] == text[places[-1] :][: len(h)])
        out.append((text[inside], inside - starts[text[inside]], h[inside]))
    return tuple(np.concatenate(c) for c in zip(*out))


def item_words(benchmark: DataFrame) -> DataFrame:
    """item_id, words (hashes) of the items that are long enough."""

    def run(parts):
        for part in parts:
            words, starts = hashed_words(part.column("text").to_pylist(), LETTERS)
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(words.view(np.int64)))
            yield pa.record_batch([part.column("item_id"), lists], names=["item_id", "words"])

    found = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, words array<long>")
    return found.where(F.size("words") >= SHORTEST)


def item_seeds(classes: DataFrame) -> DataFrame:
    """class, at, hash: one row per seed of each class of equal items."""

    def run(parts):
        for part in parts:
            column = part.column("words")
            words, starts = column.flatten().to_numpy().view(np.uint64), np.asarray(column.offsets) - column.offsets[0].as_py()
            text, at, h = seeds_of_texts(words, starts)
            kinds = part.column("class").to_numpy()
            yield pa.record_batch([pa.array(kinds[text]), pa.array(at), pa.array(h.view(np.int64))], names=["class", "at", "hash"])

    return classes.select("class", "words").mapInArrow(run, "class long, at long, hash long")


def bits_of(h: np.ndarray, probe: int, size: int) -> np.ndarray:
    """The bit that a seed sets in a filter of 2^size bits."""
    with np.errstate(over="ignore"):
        return (mix(h + np.uint64(probe) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size)).astype(np.int64)


def seed_filter(seed_table: DataFrame) -> tuple[int, np.ndarray]:
    """The size, as a power of two, and the bytes of the benchmark's Bloom filter."""
    size = min(FILTER, max(10, int(seed_table.count() * BITS).bit_length()))

    def run(parts):
        bits = np.zeros(1 << size, bool)
        for part in parts:
            h = part.column("hash").to_numpy().view(np.uint64)
            for probe in range(PROBES):
                bits[bits_of(h, probe, size)] = True
        packed = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.record_batch([pa.array(at), pa.array(packed[at])], names=["at", "bits"])

    # At most 2^22 rows of 16 bytes.
    found = seed_table.select("hash").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    packed = np.zeros((1 << size) // 64, np.int64)
    packed[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return size, packed.view(np.uint8)


def suspects(docs: DataFrame, size: int, packed: np.ndarray) -> DataFrame:
    """row, doc_id, digest (SHA-256 of the text), words, hits (place and hash of a seed): the rows with a seed in the filter."""
    schema = "row long, doc_id long, digest string, words array<long>, hits array<struct<place: long, hash: long>>"
    bits = docs.sparkSession.sparkContext.broadcast(packed)  # 2^FILTER bits at most

    def run(parts):
        held = bits.value
        for part in parts:
            texts, rows = part.column("text").to_pylist(), part.column("row").to_pylist()
            ids = part.column("doc_id").to_pylist()
            for a, b in batches(texts):
                words, starts = hashed_words(texts[a:b], LETTERS)
                text, place, h = seeds_of_texts(words, starts)
                for probe in range(PROBES):
                    at = bits_of(h, probe, size)
                    found = held[at >> 3] & (np.uint8(128) >> (at & 7).astype(np.uint8)) != 0
                    text, place, h = text[found], place[found], h[found]
                order = np.argsort(text, kind="stable")
                text, place, h = text[order], place[order], h[order].view(np.int64)
                for k in np.unique(text).tolist():
                    low, high = np.searchsorted(text, [k, k + 1])
                    yield pa.RecordBatch.from_pylist([{
                        "row": rows[a + k], "doc_id": ids[a + k],
                        "digest": hashlib.sha256(texts[a + k].encode("utf-8")).hexdigest(),
                        "words": words[starts[k] : starts[k + 1]].view(np.int64),
                        "hits": [{"place": p, "hash": x} for p, x in zip(place[low:high].tolist(), h[low:high].tolist())],
                    }], schema=layout)

    layout = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.string()), ("words", pa.list_(pa.int64())),
        ("hits", pa.list_(pa.struct([("place", pa.int64()), ("hash", pa.int64())])))])
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return numbered.mapInArrow(run, schema)


def best_stretch(equal: np.ndarray) -> int:
    """Equal words in the stretch with the largest sum of 1 for an equal and -2 for another word; of ties, the most."""
    if not len(equal) or not equal.any():
        return 0
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    least = np.minimum.accumulate(sums)
    # Where the least sum up to each place stands first.
    begin = np.maximum.accumulate(np.where(np.diff(least, prepend=1) < 0, np.arange(len(sums)), 0))
    gain = sums[1:] - least[:-1]
    ends = np.flatnonzero(gain == gain.max())
    counted = np.concatenate([[0], np.cumsum(equal)])
    return int((counted[ends + 1] - counted[begin[ends]]).max())


def matching(equal: np.ndarray, n: int) -> int:
    """Equal words of an overlap with an item of n words, 0 if it is none."""
    total, stretch = int(equal.sum()), best_stretch(equal)
    return total if total >= SHARE * n else stretch if stretch >= min(MATCHES, SHARE * n) else 0


def verified(places: DataFrame) -> DataFrame:
    """row, doc_id, digest, class, n, matches of the rows whose words are equal enough (`equal` word by word)."""
    kept = ["row", "doc_id", "digest", "class", "n"]

    def run(parts):
        for part in parts:
            column, n = part.column("equal"), part.column("n").to_pylist()
            flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets) - column.offsets[0].as_py()
            matches = np.array([matching(flat[i:j], k) for i, j, k in zip(starts[:-1], starts[1:], n)], np.int64)
            yield pa.record_batch([*[part.column(c) for c in kept], pa.array(matches)], names=[*kept, "matches"])

    return places.select(*kept, "equal").mapInArrow(
        run, "row long, doc_id long, digest string, class long, n long, matches long").where("matches > 0")


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """row, doc_id, digest, class, n, matches: one row per row of `docs` and class of equal items that overlap, the best place."""
    classes = materialise(items.select(F.xxhash64("words").alias("class"), "words").dropDuplicates(["class"]), "items")
    seed_table = materialise(item_seeds(classes), "seeds")
    rows = materialise(suspects(docs, *seed_filter(seed_table)), "suspects")
    hits = rows.select("row", F.inline("hits")).join(seed_table, "hash")
    places = hits.select("row", "class", (F.col("place") - F.col("at")).alias("place")).distinct()
    own = classes.select("class", F.col("words").alias("own"), F.size("words").cast("long").alias("n"))
    # From `lead` on, the item's words have neighbours in the document.
    lead, begin = F.greatest(-F.col("place"), F.lit(0)).cast("int"), F.greatest(F.col("place"), F.lit(0)).cast("int")
    there = places.join(own, "class").join(rows.drop("hits"), "row").withColumn("_lead", lead).withColumn("_begin", begin)
    length = F.least(F.size("own") - F.col("_lead"), F.size("words") - F.col("_begin"))
    equal = F.zip_with(F.slice("own", F.col("_lead") + 1, length), F.slice("words", F.col("_begin") + 1, length), lambda a, b: a == b)
    compared = there.select("row", "doc_id", "digest", "class", "n", equal.alias("equal"))
    enough = F.size(F.filter("equal", lambda e: e)) >= F.least(F.lit(float(MATCHES)), SHARE * F.col("n"))
    return verified(compared.where(enough)).groupBy("row", "doc_id", "digest", "class", "n").agg(F.max("matches").alias("matches"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matches, item_words: one row per document and item that overlap."""
    items = materialise(item_words(benchmark), "benchmark")
    members = items.select("item_id", F.xxhash64("words").alias("class"))
    return found(docs, items).join(members, "class").select("doc_id", "item_id", "matches", F.col("n").alias("item_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that overlap no item, with all their columns. Equal texts share their fate, so texts are what goes.

    Rows whose digest isn't in a filter of the bad ones stay where they are; only the others, few more than the bad
    ones, meet the bad digests in a join.
    """
    items = materialise(item_words(benchmark), "benchmark")
    bad = materialise(found(docs, items).select("digest").distinct(), "contaminated").withColumnRenamed("digest", "_digest")
    size, packed = seed_filter(bad.select(F.xxhash64("_digest").alias("hash")))
    bits = docs.sparkSession.sparkContext.broadcast(packed)  # 2^FILTER bits at most

    @F.pandas_udf("boolean")
    def doubtful(h: pd.Series) -> pd.Series:
        held, hashes, out = bits.value, h.to_numpy(np.int64).view(np.uint64), np.ones(len(h), bool)
        for probe in range(PROBES):
            at = bits_of(hashes, probe, size)
            out &= held[at >> 3] & (np.uint8(128) >> (at & 7).astype(np.uint8)) != 0
        return pd.Series(out)

    digest = F.sha2(docs["text"], 256)
    doubt = doubtful(F.xxhash64(digest))
    checked = docs.where(doubt).join(bad, digest == bad["_digest"], "left_anti")
    return docs.where(~doubt).union(checked)
