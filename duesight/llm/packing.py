"""Best-fit packing by linear grouping.

Documents become token pieces of at most `capacity` tokens. How many pieces
have which length is a table of at most `capacity` rows, whatever the corpus;
the plan is made from it alone. Large lengths are rounded up within groups of
equal cardinality, the few sizes left are packed by a linear program over
configurations, actual documents take the places of the rounded ones, and all
that is left goes to the fullest sequence in which it fits. The plan says, for
each length, which ranks go where; a piece finds its place by its rank among
the pieces of its length.

Null text counts as empty, and an empty text is one piece, the end token alone.
Null, repeated ids and further columns of the input do no harm: every row is
packed. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duesight.session import materialise

CAPACITY = 2048
END = 0
#: Sizes after rounding.
GROUPS = 48
#: Lengths above a share of the capacity are grouped; smaller ones fill gaps. The better of these shares counts.
LARGE = (1 / 3, 1 / 2)
#: Words a task remembers.
REMEMBERED = 1_200_000

#: Texts of other characters, or with a special token in them, go through the tokenizer whole.
_ODD = re.compile(r"<\||[^\t\n\r\x20-\x7eÀ-ÿ]")
_PART = re.compile(r"[a-zß-öø-ÿ]+|[^a-zß-öø-ÿ]+")
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")


class WordTokens:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, by a tokenizer whose tokens never cross white space.

    The ids of a text of plain characters are those of its words in turn, so
    each word is encoded once. The last token of a word is marked in the
    vocabulary, which lets many words be encoded in one call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # Words and parts of words; when there are many, only those that occur again stay.
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def recall(self, words: set[str]) -> set[str]:
        """Take up again what was put aside of these words; returns the others. `old` is looked up, never gone through."""
        again = {w: self.old[w] for w in words if w in self.old}
        self.words.update(again)
        return words.difference(again)

    def learn(self, words: set[str], forget: bool = True) -> None:
        if forget and len(self.words) + len(words) > REMEMBERED // 2:
            self.old, self.words = self.words, {}
        words = self.recall(words)
        plain = {}
        for w in words:
            if "'" in w:
                self.words[w] = self.whole(w)
            else:
                plain[w] = _PART.findall(w)
        new = self.recall({p for parts in plain.values() for p in parts}.difference(self.words))
        letters = [p for p in new if _LETTERS.match(p)]
        if letters:
            ids = np.array(self.tokenizer.encode(" ".join(letters), add_special_tokens=False).ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(letters):
                raise ValueError("this tokenizer doesn't mark the ends of words")
            data, begin = ids.tobytes(), 0
            for p, stop in zip(letters, stops.tolist()):
                self.words[p], begin = data[begin:stop], stop
        for p in new:
            if p not in self.words:
                self.words[p] = self.whole(p)
        get = self.words.__getitem__
        for w, parts in plain.items():
            self.words[w] = b"".join(map(get, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if _ODD.search(t) else t.lower().split() for t in texts]
        new = set().union(*filter(None, split)).difference(self.words)
        if new:
            self.learn(new)
        get = self.words.__getitem__
        try:
            return [self.whole(t) if s is None else b"".join(map(get, s)) for t, s in zip(texts, split)]
        except KeyError:  # learning put earlier words aside
            self.learn(set().union(*filter(None, split)).difference(self.words), forget=False)
            return [self.whole(t) if s is None else b"".join(map(get, s)) for t, s in zip(texts, split)]


_tokens: dict[str, WordTokens] = {}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """One row per piece, with its task and its number among the task's pieces of that length; with its ids if asked."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long" + ", ids binary" * ids

    def run(batches):
        tokens = _tokens.setdefault(tokenizer, None) or WordTokens(tokenizer)
        _tokens[tokenizer] = tokens
        task, seen, end = TaskContext.get().partitionId(), Counter(), np.array([END], "<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for a in range(0, len(texts), 256):
                rows = []
                for key, data in zip(keys[a : a + 256], tokens.encode(texts[a : a + 256])):
                    data += end
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        n = len(part) // 4
                        rows.append((key, k, at // 4, n, zlib.crc32(part), task, seen[n], part)[: 7 + ids])
                        seen[n] += 1
                columns = list(zip(*rows))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number", "ids"][: 7 + ids]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


# --- the plan, from the number of pieces of each length


def grouped(counts: dict[int, int], least: float, groups: int = GROUPS) -> list[tuple[int, list[int]]]:
    """Linear grouping: (rounded size, lengths in it), each with about the same number of pieces."""
    large = sorted(n for n in counts if n > least)
    total, seen, found = sum(counts[n] for n in large), 0, defaultdict(list)
    for n in large:
        found[min(groups - 1, seen * groups // total)].append(n)
        seen += counts[n]
    return [(max(lengths), lengths) for _, lengths in sorted(found.items())]


def configurations(sizes: list[int], need: list[int], capacity: int) -> list[tuple[float, list[int]]]:
    """The linear program over configurations, by column generation: how often which numbers of each size share a sequence."""
    k = len(sizes)
    columns = np.diag([capacity // s for s in sizes]).astype(float)
    need, most = np.array(need, float), capacity // min(sizes)
    amount = need / np.diag(columns)
    for _ in range(40 * k):
        prices = np.linalg.solve(columns.T, np.ones(k))
        best = np.zeros(capacity + 1)
        layers, choices = [best], []
        for _ in range(most):
            new, choice = best.copy(), np.full(capacity + 1, -1)
            for g, s in enumerate(sizes):
                value = best[: capacity + 1 - s] + prices[g]
                better = value > new[s:] + 1e-12
                new[s:][better], choice[s:][better] = value[better], g
            choices.append(choice)
            layers.append(best := new)
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for choice in reversed(choices):
            if (g := choice[room]) >= 0:
                column[g] += 1
                room -= sizes[g]
        change = np.linalg.solve(columns, column)
        rates = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        out = int(np.argmin(rates))
        step = rates[out]
        amount = np.maximum(amount - step * change, 0)
        amount[out] = step
        columns[:, out] = column
    return [(a, columns[:, i].astype(int).tolist()) for i, a in enumerate(amount) if a > 0]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    plans = [plan_above(counts, capacity, share * capacity) for share in LARGE]
    return min(plans, key=lambda p: max((first + n for _, _, n, first, _ in p), default=0))


def plan_above(counts: dict[int, int], capacity: int, least: float) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number of ranks, first sequence, offset): rank first + i goes to sequence first + i."""
    left, taken, places, sequences = dict(counts), Counter(), [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> (first sequence, how many)

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        places.append((length, taken[length], n, sequence, offset))
        taken[length] += n
        left[length] -= n

    groups = grouped(counts, least)
    if groups:
        stock = [[n for n in lengths] for _, lengths in groups]
        for amount, column in configurations([s for s, _ in groups], [sum(counts[n] for n in x) for _, x in groups], capacity):
            many = int(amount + 1e-9)
            slots = [g for g, n in enumerate(column) for _ in range(n)]
            while many > 0 and slots:
                for g in slots:
                    while stock[g] and not left[stock[g][-1]]:
                        stock[g].pop()
                chosen = [stock[g][-1] if stock[g] else 0 for g in slots]
                if not all(chosen):
                    break
                n = min(many, *(left[x] // y for x, y in Counter(chosen).items()))
                if not n:  # one piece of that length, several places: one sequence with what there is
                    fill, mine = [], Counter()
                    for g in slots:
                        for x in reversed(stock[g]):
                            if left[x] > mine[x]:
                                mine[x] += 1
                                fill.append(x)
                                break
                    chosen, n = fill, 1
                at = 0
                for x in chosen:
                    put(x, n, sequences, at)
                    at += x
                gaps[capacity - at].append((sequences, n))
                sequences, many = sequences + n, many - n
    rooms = sorted(r for r in gaps if r)
    for length in sorted((n for n in left if left[n]), reverse=True):
        while left[length]:
            room = next((r for r in rooms if r >= length and gaps[r]), None)
            if room is None:
                n = -(-left[length] // (capacity // length))
                first, sequences, room = sequences, sequences + n, capacity
            else:
                first, n = gaps[room].pop()
            use = min(n, left[length])
            put(length, use, first, capacity - room)
            if use < n:
                gaps[room].append((first + use, n - use))
            gaps[room - length].append((first, use))
            rooms = sorted({r for r in (*rooms, room, room - length) if r and gaps[r]})
    return places


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add `sequence_id` and `offset` to pieces that are fixed, such as a written table."""
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = per_task.select(
        "length", "task",
        (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    # At most `capacity` rows.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.createDataFrame(plan(counts, capacity) if counts else [],
                                   "size long, lowest long, many long, sequence long, offset long")
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("number"))
    # The plan's size depends on the capacity, not on the input.
    return ranked.join(
        F.broadcast(places),
        (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("lowest"))
        & (F.col("rank") < F.col("lowest") + F.col("many")),
    ).withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("lowest")).drop(
        "task", "number", "before", "rank", "size", "lowest", "many", "sequence")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): one row per piece."""
    pieces = materialise(token_pieces(docs, tokenizer, capacity, ids), "pieces")
    out = pack(docs.sparkSession, pieces, capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * ids)
