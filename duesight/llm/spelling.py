"""Spelling variants: words one edit apart, found by permuterm rotations.

A word is marked with a terminator and rotated so that the edited place comes last. `x c y` with its character `c`
replaced, deleted or inserted is the rotation `y | x` with another, no, or one more last character, so all words that an
edit at this place connects share the prefix `y | x`. The rotations are sorted by that prefix; a group of it holds the
words `x ? y` and the word `x y` itself, hence never more rows than the alphabet has letters, and one. A scan of the
group gives each row how many neighbours it has there and the most frequent one, without making pairs.

Nulls: a null text is empty, a null id is the empty string in the damaging key. Repeated rows count each time. Words
are compared by code points. Without words the result is empty. Only `doc_id` and `text` are read, other columns are
ignored whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duesight.session import materialise

#: What a word may hold, how short and how rare it may be, and how much more frequent a form is.
LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, RAREST, TIMES = 6, 5, 5
#: Every key that this number divides loses a character.
DAMAGE = 199
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_EMIT = 1 << 17
END = "|"
WHOLE, FIRST_OF_RUN, IN_RUN = 0, 1, 2


def lowered(text: str) -> str:
    return text.translate(_LOWER)


def damaged(doc_id, run: str) -> str:
    """The run as it counts for this document: one in DAMAGE loses a code point."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """word, n: the words of at least `shortest` code points that occur `rarest` times or more in all documents.

    Tasks add up what they see before it moves, and send it on whenever it has grown to a fixed size.
    """
    # A run shorter than that makes no word, and a greedy match takes a longer one whole.
    run = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def count(batches):
        held: Counter = Counter()

        def sent():
            out = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                  names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                for word, n in Counter(map(lowered, run.findall(text))).items():
                    held[damaged(key, word)] += n
                if len(held) > _EMIT:
                    yield sent()
        if held:
            yield sent()

    rows = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return rows.where(F.char_length("word") >= shortest).groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= rarest)


def rotations(words: DataFrame) -> DataFrame:
    """prefix, letter, kind, n: a row for each place of an edit.

    Kind WHOLE is the word `x y` at each of its gaps. The others are words `x c y` with their letter c; only the first
    of equal letters in a row (FIRST_OF_RUN) stands for the deletion, as the others give the same word.
    """
    length = F.char_length("word")
    ends = F.concat("word", F.lit(END))

    def turned(at: Column, skip: int) -> Column:
        return F.concat(F.substring(ends, at + skip, length + 1), F.substring("word", F.lit(1), at - 1))

    gaps = words.select("n", "word", F.explode(F.sequence(F.lit(1), length + 1)).alias("at")).select(
        turned(F.col("at"), 0).alias("prefix"), F.lit("").alias("letter"), F.lit(WHOLE).alias("kind"), "n")
    letter, before = F.substring("word", F.col("at"), F.lit(1)), F.substring("word", F.col("at") - 1, F.lit(1))
    edited = words.select("n", "word", F.explode(F.sequence(F.lit(1), length)).alias("at")).select(
        turned(F.col("at"), 1).alias("prefix"), letter.alias("letter"),
        F.when((F.col("at") > 1) & (letter == before), IN_RUN).otherwise(FIRST_OF_RUN).alias("kind"), "n")
    return gaps.unionByName(edited)


def word_of(prefix: str = "prefix", letter: str = "letter") -> Column:
    """`x c y` from `y | x` and c."""
    return F.concat(F.substring_index(prefix, END, -1), F.col(letter), F.substring_index(prefix, END, 1))


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, near: how many words are one edit away, and the (n, word) of the best of them.

    The best has the largest n, of equals the smallest word.
    """
    edited = F.col("kind") != WHOLE
    group = W.partitionBy("prefix")
    ranked = group.orderBy(F.desc("n"), "word")
    rows = rotations(words).select("prefix", "letter", "kind", "n", word_of().alias("word"))
    up_to, after = ranked.rowsBetween(W.unboundedPreceding, -1), ranked.rowsBetween(1, W.unboundedFollowing)
    whole = group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    me = F.struct("n", "word")

    def best(of: Column) -> Column:
        """The first row before this one, else the first after it, which `of` holds for."""
        pick = F.when(of, me)
        return F.coalesce(F.first(pick, ignorenulls=True).over(up_to), F.first(pick, ignorenulls=True).over(after))

    kind = F.col("kind")
    first = kind == FIRST_OF_RUN
    found = rows.select(
        "word",
        F.when(kind == WHOLE, F.count_if(first).over(whole))
        .when(first, F.count("*").over(whole) - 1)
        .otherwise(F.count_if(edited).over(whole) - 1).alias("here"),
        F.when(kind == WHOLE, best(first)).when(first, best(F.lit(True))).otherwise(best(edited)).alias("near"),
    ).where("here > 0")
    rank = F.struct(F.col("near.n").alias("n"), F.col("near.word").alias("word"))
    return found.groupBy("word").agg(F.sum("here").alias("n_near"), F.min_by(
        "near", F.struct((-rank["n"]).alias("down"), rank["word"].alias("word"))).alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms, by doubling the steps. Chains end, as every form is more frequent."""
    steps = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = materialise(steps.join(further, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "forms")
        steps = now.select("word", "root")
        if now.where("moved").isEmpty():
            return steps


def spelling_variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n, one row per word.

    The form of a word is its most frequent neighbour if that is `times` as frequent; the root ends the chain of forms.
    """
    words = materialise(word_counts(docs), "words")
    near = neighbours(words)
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("near.n") >= times * F.col("n"), F.col("near")).alias("best"))
    rows = materialise(rows.select(
        "word", "n", "n_near", F.col("best.word").alias("form"), F.col("best.n").alias("form_n")), "variants")
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
