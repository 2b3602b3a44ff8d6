"""Document fingerprints by one-permutation MinHash, in built-in functions only.

The hashes of a text's word shingles are sorted once. The upper bits of a hash
name its bin, so the first hash of each bin is the bin's minimum. An empty bin
takes the value of a filled one that a hash of both bins picks (optimal
densification): the choice depends on which bins are filled, not on their
values. The low `LOW` bits of the 256 values are packed into 16 words of 64 bits.
Chance makes two low parts equal once in 2^LOW; likeness takes that out.

Words are split at blanks and control white space, without regard to case. A
text of fewer than five words has one shingle. Null text counts as empty; the
fingerprint of a text without words is '', alike to itself (1) and to nothing
else (0). A text's fingerprint depends on the text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 5
BINS = 256
LOW = 4
#: Bins that an empty one asks before it looks at all.
PROBES = 8
#: Values in a packed word of 64 bits.
PER_WORD = 64 // LOW
#: Neighbouring ids in a group, as a power of two.
NEAR = 10
#: Groups that one task may put in order.
ALONE = 100_000

_BIN_SHIFT = 56
_REST = (1 << _BIN_SHIFT) - 1


def words(text: Column) -> Column:
    plain = F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(plain, " "), "")


def _bin(value: Column) -> Column:
    return F.shiftrightunsigned(value, _BIN_SHIFT)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def packed(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the packed values of `text` as an array of 16 longs, empty for a text without words."""
    w, m, f = f"_{name}_words", f"_{name}_minima", f"_{name}_full"
    # A value larger than all others stands in each bin, so that every bin has a first one.
    ends = F.array(*[F.lit(_signed(b << _BIN_SHIFT | _REST)) for b in range(BINS)])
    # A position past the end is null and leaves the hash alone, so short texts have one shingle.
    hashes = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - WIDTH, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(WIDTH)]))
    out = df.withColumn(w, words(F.col(text)))
    out = out.withColumn(m, F.when(F.size(w) > 0, F.sort_array(F.concat(hashes, ends))))
    out = out.withColumn(m, F.filter(m, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(F.col(m), i - 1)))))
    out = out.withColumn(f, F.filter(m, lambda x: x.bitwiseAND(F.lit(_REST)) != _REST))
    filled = lambda v: v.bitwiseAND(F.lit(_REST)) != _REST

    def chosen(x: Column) -> Column:
        """The bins that hashes of the empty one name, in turn; where none of the first is filled, the least hash of both."""
        named = [F.get(F.col(m), F.pmod(F.xxhash64(_bin(x), F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
        least = F.array_min(F.transform(f, lambda y: F.struct(F.xxhash64(_bin(x), _bin(y)).alias("h"), y.alias("y"))))["y"]
        return F.coalesce(*[F.when(filled(v), v) for v in named], least)

    # Hashed with its new bin: else a wrong match of low bits would repeat in all bins that take the same value.
    dense = F.transform(m, lambda x: F.when(filled(x), x).otherwise(
        F.xxhash64(chosen(x), _bin(x))))
    # The columns that a lambda uses are used twice here: Spark then computes them once, not once an element.
    out = out.withColumn(m, F.when(F.size(f) == BINS, F.col(m)).otherwise(dense))
    word = lambda k: F.aggregate(
        F.slice(m, k * PER_WORD + 1, PER_WORD), F.lit(0).cast("long"),
        lambda acc, x: F.shiftleft(acc, LOW).bitwiseOR(x.bitwiseAND(F.lit((1 << LOW) - 1))))
    return out.withColumn(name, F.when(F.size(w) > 0, F.array(*map(word, range(BINS // PER_WORD)))).otherwise(
        F.array().cast("array<long>"))).drop(w, m, f)


def likeness(a: str, b: str) -> Column:
    """The estimated share of common shingles of two packed fingerprints, 0 to 1."""
    def equal(k: int) -> Column:
        x = F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.lit(PER_WORD) - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    same = sum((equal(k) for k in range(1, BINS // PER_WORD)), equal(0)) / F.lit(float(BINS))
    chance = 1 / (1 << LOW)
    estimate = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return (F.when((F.size(a) == 0) | (F.size(b) == 0), F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(0.0))
            .otherwise(estimate))


def text_of(packed_name: str) -> Column:
    """A fingerprint as hexadecimal digits, one for each bin."""
    return F.array_join(F.transform(packed_name, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def following(groups: DataFrame) -> DataFrame:
    """(g, next_g): for each of some distinct numbers the next larger one, null for the largest."""
    if groups.limit(ALONE + 1).count() <= ALONE:
        return groups.select("g", F.lead("g").over(Window.orderBy("g")).alias("next_g"))
    up = groups.withColumn("up", F.shiftright("g", NEAR))
    inside = up.select("g", "up", F.lead("g").over(Window.partitionBy("up").orderBy("g")).alias("inner_g"))
    first = up.groupBy("up").agg(F.min("g").alias("first_g"))
    beyond = (following(first.select(F.col("up").alias("g")))
              .join(first.select(F.col("up").alias("next_g"), "first_g"), "next_g")
              .select(F.col("g").alias("up"), "first_g"))
    return inside.join(beyond, "up", "left").select("g", F.coalesce("inner_g", "first_g").alias("next_g"))


def with_neighbours(docs: DataFrame) -> tuple[DataFrame, Window]:
    """The documents in groups of neighbouring ids, each group with the first text after it as a row with lent = 1.

    Within the window a row is followed by the next document by id, and the
    last document by the first. Repeated ids follow each other by text; rows
    without an id come first.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("g", F.coalesce(F.shiftright("doc_id", NEAR), F.lit(-(1 << 62))))
    heads = own.groupBy("g").agg(F.min(F.struct("doc_id", "text")).alias("head"))
    groups = own.select("g").distinct()
    lowest = groups.agg(F.min("g")).first()[0]
    after = following(groups).withColumn("next_g", F.coalesce("next_g", F.lit(lowest).cast("long")))
    lent = after.join(heads.select(F.col("g").alias("next_g"), "head"), "next_g").select(
        "g", F.col("head.doc_id").alias("doc_id"), F.col("head.text").alias("text"), F.lit(1).alias("lent"))
    rows = own.select("g", "doc_id", "text", F.lit(0).alias("lent")).unionByName(lent)
    return rows, Window.partitionBy("g").orderBy("lent", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint: one row per document."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return packed(text, "text", "values").select("doc_id", text_of("values").alias("fingerprint"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of the documents and of their edited texts, and how alike they are to these and to the next document.

    The last half of an edited text (rounded down) comes from the start of the next document.
    """
    rows, w = with_neighbours(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.left("text", n - half), F.left(F.coalesce(F.lead("text").over(w), F.lit("")), half)))
    rows = packed(packed(rows, "text", "values"), "edited", "edited_values")
    rows = rows.withColumn("next_values", F.lead("values").over(w)).where("lent = 0")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_of("values").alias("fingerprint"), text_of("edited_values").alias("edited_fingerprint"),
        likeness("values", "edited_values").alias("near_edited"), likeness("values", "next_values").alias("near_next"))
