"""Stupid-backoff scores of documents under a word-pair model of the whole corpus.

Words are counted by their 64-bit hash, in a Spark table of all words of the
corpus. A pair seen at least `SEEN` times scores count(pair) / count(first word),
another `BACKOFF` * count(second word) / words in the corpus, and the first word
of a text its share of the corpus.

Pairs become rows (document, pair, times), once for each document, and go to the
partition of their pair, where a window adds up their count. Only words that make
up `COMMON` of the corpus or more (there are 1 / `COMMON` at most) are known to
all tasks; they have short numbers in place of their hashes, and their counts are
joined by broadcast. All others stay in the table: a pair with such a rare word
goes to the partition of that word, where it meets the word's count; one of two
rare words goes to both, and either adds what its word decides. A pair that makes up a
thousandth of all pairs or more (there are a thousand of them at most) is
counted beforehand and never moves, so no partition is crowded.

Words are runs of letters and digits, or of other signs, without regard to
case. Null text counts as empty; a text without words has n_words 0, log_score
0 and no score per word. Rows that share an id are summed up as one document,
those without an id, too. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duesight.llm.quality import kth_largest
from duesight.llm.shingles import LETTERS_AND_SIGNS, batches, hashed_words, mix
from duesight.session import materialise

#: Words of the vocabulary: all. A caller may ask for fewer; the others are one unknown word then.
WORDS = None
#: Share of all words from which a word is known to all tasks.
COMMON = 1 / (1 << 20)
#: A pair counted less often is scored as never seen: a document's own pair is no evidence for it.
SEEN = 2
BACKOFF = 0.4
#: Share of all words, or pairs, from which one is frequent.
FREQUENT = 1 / 1000
#: Pairs in a partition, about.
PER_PARTITION = 2_000_000
#: Words that a task gathers before it counts them, and characters before it deals out their pairs.
GATHERED = 4_000_000
NO_ID = -(1 << 63)
#: In place of the word before the first one of a text.
START = -1


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n: for all words of the corpus."""

    def run(parts):
        kept, size = [], 0

        def summed():
            words, at = np.unique(np.concatenate([w for w, _ in kept]), return_inverse=True)
            return words, np.bincount(at, np.concatenate([c for _, c in kept])).astype(np.int64)

        def batch(words, counts):
            return pa.record_batch([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])

        for part in parts:
            texts = part.column("text").to_pylist()
            for a, b in batches(texts):
                kept.append(np.unique(hashed_words(texts[a:b], LETTERS_AND_SIGNS)[0], return_counts=True))
                size += len(kept[-1][0])
                if size > GATHERED:
                    kept = [summed()]
                    if len(kept[0][0]) > GATHERED // 2:
                        yield batch(*kept.pop())
                    size = len(kept[0][0]) if kept else 0
        if kept:
            yield batch(*summed())

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Numbers of words by their hash, counts by number; the last number is that of all other words.

    If it is `open` these are told apart by their hash, else they are one unknown word.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, open: bool = False):
        self.open = open
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.counts = np.append(counts[order], total - int(counts.sum()))
        self.total = total
        self.bits = max(1, int(len(hashes)).bit_length())
        self.begin = np.searchsorted(self.hashes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        self.unknown = len(hashes)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), self.unknown, np.int64)
        left = np.arange(len(words))
        at = self.begin[(words >> np.uint64(64 - self.bits)).astype(np.int64)]
        while len(left):  # a few steps: a stretch of the hashes has about one word
            inside = at < self.unknown
            left, at = left[inside], at[inside]
            here = self.hashes[at]
            same = here == words[left]
            out[left[same]] = at[same]
            on = here < words[left]
            left, at = left[on], at[on] + 1
        return out


def vocabulary(counts: DataFrame, most: int | None = WORDS) -> Vocabulary:
    total = counts.agg(F.sum("n")).first()[0] or 0
    if most is None:
        # At most 1 / COMMON rows of 16 bytes.
        top = counts.where(F.col("n") >= COMMON * total).toPandas()
        return Vocabulary(top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), total, open=True)
    least = kth_largest(counts, "n", most)
    if least is not None:
        ties = counts.where(F.col("n") == least).select("*", F.bitwise_not("word").alias("order"))
        last = kth_largest(ties, "order", most - counts.where(F.col("n") > least).count())
        chosen = F.col("n") > least
        counts = counts.where(chosen if last is None else chosen | (F.col("n") == least) & (F.bitwise_not("word") >= last))
        counts = counts if last is not None else counts.union(ties.select("word", "n"))
    # At most `most` rows of 16 bytes.
    top = counts.toPandas()
    return Vocabulary(top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), total)


def numbered(texts: list[str | None], words: Vocabulary, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, last, numbers of their words, their keys, where each text's words begin) by batches.

    The key of a word is its number, or if it has none its hash below zero.
    """
    for a, b in batches(texts, most):
        hashes, starts = hashed_words(texts[a:b], LETTERS_AND_SIGNS)
        numbers = words.numbers(hashes)
        keys = np.where(numbers == words.unknown, rare_key(hashes), numbers) if words.open else numbers
        yield a, b, numbers, keys, starts


def rare_key(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64) | np.int64(-(1 << 63))


def pairs_of(numbers: np.ndarray, starts: np.ndarray, unknown: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, pair) for all pairs of neighbours; a pair is first * (unknown + 1) + second."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = doc[1:] == doc[:-1]
    return doc[1:][inside], numbers[:-1][inside] * (unknown + 1) + numbers[1:][inside]


def frequent_pairs(docs: DataFrame, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs with their counts: all that make up FREQUENT of the pairs (and so consist of frequent words)."""
    often = np.flatnonzero(words.counts >= FREQUENT * words.total)
    if words.open:
        often = often[often != words.unknown]
    place = np.full(words.unknown + 1, -1)
    place[often] = np.arange(len(often))
    base = words.unknown + 1

    def run(parts):
        table = np.zeros((len(often), len(often)), np.int64)
        for part in parts:
            for _, _, numbers, _, starts in numbered(part.column("text").to_pylist(), words):
                _, pair = pairs_of(place[numbers], starts, len(often))
                first, second = pair // (len(often) + 1), pair % (len(often) + 1)
                # A place of -1 shows as the end of the row before.
                good = (pair >= 0) & (second < len(often))
                table += np.bincount(first[good] * len(often) + second[good], minlength=table.size).reshape(table.shape)
        a, b = np.nonzero(table)
        yield pa.record_batch([pa.array(often[a] * base + often[b]), pa.array(table[a, b])], names=["pair", "n"])

    found = docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(
        F.col("n") >= FREQUENT * words.total).orderBy("pair").toPandas()
    return found["pair"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def pair_scores(pair: np.ndarray, count: np.ndarray, words: Vocabulary) -> np.ndarray:
    first, second = pair // (words.unknown + 1), pair % (words.unknown + 1)
    seen = count >= SEEN
    return np.where(seen, np.log(np.maximum(count, 1)) - np.log(np.maximum(words.counts[first], 1)),
                    np.log(BACKOFF) + np.log(np.maximum(words.counts[second], 1)) - np.log(max(words.total, 1)))


def dealt_out(doc: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each (keys, text) is first found, in order of the keys, and how often; `doc` ascends.

    Rows of one key that follow each other take a third less room in a shuffle.
    """
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in (doc, *keys)], axis=0)
    begin = np.flatnonzero(new)
    return order[begin], np.diff(np.append(begin, len(order)))


def doc_ids(part: pa.RecordBatch) -> np.ndarray:
    return np.array([NO_ID if i is None else i for i in part.column("doc_id").to_pylist()], np.int64)


def common_rows(docs: DataFrame, words: Vocabulary, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, pair, x (times) for each pair of a document whose words have numbers, but for the frequent pairs.

    A pair is second * (unknown + 1) + first. Two rows below zero tell what is known of each document: odd ones a sum,
    even ones the number of words.
    """
    hot, hot_counts = frequent
    hot_scores = pair_scores(hot, hot_counts, words)

    def run(parts):
        for part in parts:
            ids, texts = doc_ids(part), part.column("text").to_pylist()
            for at, end, numbers, keys, starts in numbered(texts, words, GATHERED):
                n, lengths = end - at, np.diff(starts)
                doc, pair = pairs_of(numbers, starts, words.unknown)
                first, second = pair // (words.unknown + 1), pair % (words.unknown + 1)
                mine = (first != words.unknown) & (second != words.unknown) if words.open else np.ones(len(pair), bool)
                known, full = np.zeros(n), lengths > 0
                head = np.full(n, -1)
                head[full] = keys[starts[:-1][full]]
                common = head >= 0
                known[common] = np.log(words.counts[head[common]]) - np.log(words.total)
                if len(hot):
                    place = np.minimum(np.searchsorted(hot, pair), len(hot) - 1)
                    found = hot[place] == pair
                    known += np.bincount(doc[found], hot_scores[place[found]], n)
                    mine &= ~found
                doc, pair = doc[mine], (second * (words.unknown + 1) + first)[mine]
                once, times = dealt_out(doc, pair)
                spread = (mix((ids[at:end] + np.arange(n)).view(np.uint64)) >> np.uint64(3)).view(np.int64)
                columns = (np.concatenate([ids[at:end][doc[once]], ids[at:end], ids[at:end]]),
                           np.concatenate([pair[once], -1 - 2 * spread, -2 - 2 * spread]),
                           np.concatenate([times.astype(float), known, lengths.astype(float)]))
                yield pa.record_batch([pa.array(c) for c in columns], names=["doc_id", "pair", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, pair long, x double")


def rare_rows(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """doc_id, rare, other (keys of words), x: each pair of a document with a rare word, by that word.

    x is how often the pair occurs, below zero where the rare word is the first. A pair of two rare words has a row for
    either. A rare word at the start of a text has START for the other.
    """

    def run(parts):
        for part in parts:
            ids, texts = doc_ids(part), part.column("text").to_pylist()
            for at, end, _, keys, starts in numbered(texts, words, GATHERED):
                doc = np.repeat(np.arange(end - at), np.diff(starts))
                head = starts[:-1][np.diff(starts) > 0]
                inside = doc[1:] == doc[:-1]
                # The word itself, the word beside it, and whether that comes second.
                behind, before = np.flatnonzero(inside & (keys[1:] < 0)) + 1, np.flatnonzero(inside & (keys[:-1] < 0))
                head = head[keys[head] < 0]
                place = np.concatenate([behind, before, head])
                other = np.concatenate([keys[behind - 1], keys[before + 1], np.full(len(head), START)])
                leads = np.concatenate([np.zeros(len(behind), bool), np.ones(len(before), bool), np.zeros(len(head), bool)])
                order = np.argsort(place, kind="stable")
                place, other, leads = place[order], other[order], leads[order]
                rare, doc = keys[place], doc[place]
                once, times = dealt_out(doc, rare, other, leads)
                columns = (ids[at:end][doc[once]], rare[once], other[once], np.where(leads[once], -1.0, 1.0) * times)
                yield pa.record_batch([pa.array(c) for c in columns], names=["doc_id", "rare", "other", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, rare long, other long, x double")


def scored(docs: DataFrame, most: int | None = WORDS, partitions: int | None = None) -> DataFrame:
    """doc_id, n_words, log_score, per_word: one row per document."""
    spark = docs.sparkSession
    counts = materialise(word_counts(docs), "words")
    words = vocabulary(counts, most)
    partitions = partitions or words.total // PER_PARTITION + 1
    frequent, log_total = frequent_pairs(docs, words), float(np.log(max(words.total, 1)))
    # At most 1 / COMMON rows (or as many as the caller asks for).
    common = F.broadcast(spark.createDataFrame(
        pa.table({"key": np.arange(len(words.counts)), "c": np.log(np.maximum(words.counts, 1))})))

    unseen, n, x = float(np.log(BACKOFF)) - log_total, F.col("n"), F.col("x")
    pair, base = F.col("pair"), words.unknown + 1
    is_pair = pair >= 0
    seen = is_pair & (n >= SEEN)
    rows = common_rows(docs, words, frequent).repartition(partitions, "pair")
    rows = rows.withColumn("n", F.sum("x").over(Window.partitionBy("pair"))).select(
        "doc_id", F.when(is_pair, F.when(seen, pair % base).otherwise(F.floor(pair / base))).alias("key"),
        F.when(seen, x * F.log("n")).when(is_pair, x * unseen).when(pair % 2 != 0, x).otherwise(0.0).alias("s"),
        F.when(~is_pair & (pair % 2 == 0), x).otherwise(0.0).alias("n_words"),
        F.when(seen, -x).when(is_pair, x).otherwise(0.0).alias("times"))
    sums = rows.join(common, "key", "left").select(
        "doc_id", "n_words", (F.col("s") + F.col("times") * F.coalesce("c", F.lit(0.0))).alias("s"))
    if words.open:
        # A word has no more rows than its count, and all its rows and its count meet in one partition.
        own = counts.where(n < COMMON * words.total).select(
            F.col("word").bitwiseOR(F.lit(NO_ID)).alias("rare"), F.log("n").alias("own"))
        rows = rare_rows(docs, words).repartition(partitions, "rare").join(own, "rare", "left")
        rows = rows.select("*", (x < 0).alias("leads")).withColumn(
            "n", F.sum(F.abs("x")).over(Window.partitionBy("rare", "other", "leads")))
        rows, times = rows.join(common.withColumnRenamed("key", "other"), "other", "left"), F.abs(x)
        # The count that decides is the first word's for a pair that was seen, else the second's; that word has the row.
        deciding = F.when(F.col("leads") == (n >= SEEN), F.col("own")).otherwise(F.col("c"))
        s = F.when(F.col("other") == START, F.col("own") - log_total).when(
            n >= SEEN, F.log("n") - deciding).otherwise(unseen + deciding)
        sums = sums.union(rows.select("doc_id", F.lit(0.0).alias("n_words"), F.coalesce(times * s, F.lit(0.0)).alias("s")))
    sums = sums.groupBy("doc_id").agg(F.sum("n_words").cast("long").alias("n_words"), F.round(F.sum("s"), 6).alias("log_score"))
    return sums.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_words", "log_score",
                       F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6)).alias("per_word"))
