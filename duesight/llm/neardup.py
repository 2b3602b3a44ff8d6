"""Near duplicates by an LSH forest, with links confirmed on whole shingle sets.

Documents with equal shingle sets are one class. The MinHash signature of a
class is read in several orders (trees). Classes with a long common prefix in a
tree are candidates; how long depends on the region: where a prefix of `SHALLOW`
values has few classes, these are compared by a sketch of their signatures, and
where it has many, the prefix grows up to `DEPTH` values. Classes that still
agree are candidates as a whole.

Candidates form groups of classes that may be linked. Within a group the sets
are compared exactly, by an inverted index of its shingles, and every link
counts. A group too large for one task is cut into blocks: first each block is
compared with itself and with the first one, then all that isn't connected with
most of the group is compared with every block. So no link inside a group is
lost, and no pairs are listed. What can be lost is a link between classes whose
signatures agree in no tree: at the threshold, one in a million where regions
are small, one in ten thousand where they are large.

Words are lowered (A-Z) and parted by blanks and control white space. A text
with fewer words than a shingle is one shingle; null and empty texts have no
shingle and are linked with nothing. Rows that share an id are taken as one
document. A row without an id is linked with nothing and stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duesight.llm.components import components, settled
from duesight.llm.shingles import mix, shingle_sets
from duesight.session import materialise

TREES, SHALLOW, DEPTH = 20, 3, 5
HASHES = TREES * DEPTH
#: Classes in a region that are compared by their sketches.
SMALL = 32
#: How far a sketch of HASHES bytes may be below the threshold: about five standard errors.
SLACK = 0.18
#: Classes in a task that compares sets.
BLOCK = 1024
#: Bytes of a shingle's hash that are compared.
WIDE = 6

_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES numbers of 32 bits for each set; zeros for an empty one."""
    out = np.zeros((len(sets), HASHES), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        joined = np.concatenate([sets[i] for i in full])
        begin = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        lows = np.empty((len(full), HASHES), np.uint64)
        with np.errstate(over="ignore"):
            for k, factor in enumerate(_FACTORS):
                lows[:, k] = np.minimum.reduceat(joined * factor, begin)
        out[full] = mix(lows).astype(np.uint32)
    return out


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (shingles), key (of the set), signature: one row per document."""

    def run(parts):
        for part in parts:
            ids, texts = part.column("doc_id"), part.column("text").to_pylist()
            for a in range(0, len(texts), 500):
                sets = shingle_sets(texts[a : a + 500], width)
                yield pa.record_batch(
                    [ids.slice(a, 500), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                     pa.array([row.tobytes() for row in signatures(sets)], pa.binary())],
                    names=["doc_id", "n", "key", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, key binary, signature binary")


def prefixes(classes: DataFrame) -> DataFrame:
    """id and the hashes of its prefixes of SHALLOW to DEPTH values, one row per tree."""
    names = [f"p{d}" for d in range(SHALLOW, DEPTH + 1)]

    def run(parts):
        for part in parts:
            if not part.num_rows:
                continue
            values = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, TREES, DEPTH)
            state, columns = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), values.shape[:2]), []
            with np.errstate(over="ignore"):
                for d in range(DEPTH):
                    state = mix((state + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ values[:, :, d])
                    if d + 1 >= SHALLOW:
                        columns.append(pa.array(state.ravel().view(np.int64)))
            ids = np.repeat(part.column("id").to_numpy(zero_copy_only=False), TREES)
            yield pa.record_batch([pa.array(ids), *columns], names=["id", *names])

    return classes.select("id", "signature").mapInArrow(run, "id long, " + ", ".join(f"{n} long" for n in names))


def sketch_likeness(a: str, b: str):
    """Share of equal values, from one byte of each."""

    @F.pandas_udf("double")
    def like(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        left, right = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, HASHES) for s in (x, y))
        return pd.Series(((left == right).mean(axis=1) - 1 / 256) / (1 - 1 / 256))

    return like(a, b)


def with_sketch(classes: DataFrame) -> DataFrame:
    def run(parts):
        for part in parts:
            rows = [np.frombuffer(s, np.uint32).astype(np.uint8).tobytes() for s in part.column("signature").to_pylist()]
            yield pa.record_batch([part.column("id"), part.column("n"), pa.array(rows, pa.binary())],
                                  names=["id", "n", "sketch"])

    return classes.select("id", "n", "signature").mapInArrow(run, "id long, n long, sketch binary")


def candidates(classes: DataFrame, per_100: int) -> DataFrame:
    """a, b: pairs that may be linked in small regions, and each class of a large region with its first."""
    rows, found, large = prefixes(classes), [], None
    for depth in range(SHALLOW, DEPTH + 1):
        name = f"p{depth}"
        counts = rows.groupBy(name).agg(F.count("*").alias("c")).where("c > 1")
        rows = settled(rows.join(counts, name), "regions")
        found.append(rows.where(F.col("c") <= SMALL).select("id", F.col(name).alias("region")))
        rows = rows.where(F.col("c") > SMALL)
        large = rows.select("id", F.col(name).alias("region"))
        rows = rows.drop("c")
    small = found[0]
    for f in found[1:]:
        small = small.union(f)
    # At most SMALL rows of a region meet.
    pairs = small.select(F.col("id").alias("a"), "region").join(
        small.select(F.col("id").alias("b"), "region"), "region").where("a < b").select("a", "b").distinct()
    sketches = materialise(with_sketch(classes), "sketches")
    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(
            F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)
    alike = pairs.where(100 * F.least("n_a", "n_b") >= per_100 * F.greatest("n_a", "n_b")).where(
        sketch_likeness("s_a", "s_b") >= per_100 / 100 - SLACK).select("a", "b")
    first = large.groupBy("region").agg(F.min("id").alias("b"))
    return alike.union(large.join(first, "region").select(F.col("id").alias("a"), "b").where("a > b"))


def packed(s: np.ndarray) -> bytes:
    """The low WIDE bytes of the hashes of a set, sorted."""
    low = np.unique(s & np.uint64((1 << 8 * WIDE) - 1))
    return low.view(np.uint8).reshape(-1, 8)[:, :WIDE].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WIDE, 8), np.uint8)
    out[:, :WIDE] = np.frombuffer(data, np.uint8).reshape(-1, WIDE)
    return out.view(np.uint64).ravel()


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id, shingles: the packed sets of the documents with these ids."""

    def run(parts):
        for part in parts:
            texts = part.column("text").to_pylist()
            yield pa.record_batch([part.column("id"), pa.array([packed(s) for s in shingle_sets(texts, width)], pa.binary())],
                                  names=["id", "shingles"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
    return wanted.mapInArrow(run, "id long, shingles binary").dropDuplicates(["id"])


def linked(ids: np.ndarray, sets: list[np.ndarray], asks: np.ndarray, per_100: int) -> list[tuple[int, int]]:
    """What the links of the asking sets with all sets connect: each set with the smallest id of its part."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    joined = np.concatenate(sets)
    order = np.argsort(joined, kind="stable")
    joined, owner = joined[order], owner[order]
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    parent = np.arange(len(sets))  # by rank of the id, so a root has the smallest

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in np.flatnonzero(asks):
        low, high = np.searchsorted(joined, sets[i], "left"), np.searchsorted(joined, sets[i], "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(100 * common >= per_100 * (size + size[i] - common)):
            x, y = root(rank[i]), root(rank[j])
            parent[max(x, y)] = min(x, y)
    roots = [root(i) for i in range(len(ids))]
    return [(int(ids[order[i]]), int(ids[order[r]])) for i, r in enumerate(roots) if i != r]


def compared(tasks: DataFrame, sets: DataFrame, per_100: int) -> DataFrame:
    """a, b, whole from (task, id, asks): in each task the asking classes are compared with all, and each gets the
    smallest id of its part; `whole` says that the task had whole groups, so that the part is a component."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        links = linked(group["id"].to_numpy(), [unpacked(s) for s in group["shingles"]], group["asks"].to_numpy(), per_100)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64").assign(whole=group["task"].iloc[0][0] == "s")

    # A task holds two blocks at most.
    return tasks.join(sets, "id").groupBy("task").applyInPandas(run, "a long, b long, whole boolean")


def connected(docs: DataFrame, classes: DataFrame, width: int, per_100: int) -> DataFrame:
    """node, component: for the classes with links, but the first of each component."""
    groups = components(candidates(classes, per_100))
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    groups = settled(groups.join(sizes, "component").select(
        F.col("node").alias("id"), "component", "size",
        F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK)).alias("block")), "groups")
    sets = materialise(sets_of(docs, groups.select("id"), width), "sets")
    n = groups.count()
    # Small groups share a task; each stays whole. Groups only link within themselves, so sharing adds no work but
    # the look at common shingles.
    small = groups.where(F.col("size") <= BLOCK).select(
        F.concat_ws("-", F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(n // BLOCK + 1))).alias("task"), "id",
        F.lit(True).alias("asks"))
    large = groups.where(F.col("size") > BLOCK)
    name = lambda *parts: F.concat_ws("-", "component", *parts)
    blocks = large.select("component", "block").distinct()
    own = large.select(name("block").alias("task"), "id", F.lit(True).alias("asks"))
    lent = large.where("block = 0").select("component", "id").join(
        blocks.where("block > 0"), "component").select(name("block").alias("task"), "id", F.lit(False).alias("asks"))
    first = settled(compared(small.union(own).union(lent), sets, per_100), "links")
    alone = first.where("whole").select(F.col("a").alias("node"), F.col("b").alias("component"))
    if large.isEmpty():
        return alone
    first = first.where("NOT whole")
    found = components(first).withColumnRenamed("component", "part")
    parts = settled(large.join(found, F.col("id") == F.col("node"), "left").select(
        "component", "id", "block", F.coalesce("part", "id").alias("part")), "parts")
    sizes = parts.groupBy("component", "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("component").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    left = settled(parts.join(main, "component").where("part != main").select("component", "id"), "left")
    per = left.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("cuts"))
    left = left.join(per, "component").select("component", "id", F.pmod(F.xxhash64("id", F.lit(1)), "cuts").alias("cut"))
    cuts = left.select("component", "cut").distinct()
    asks = left.join(blocks, "component").select(name("block", "cut").alias("task"), "id", F.lit(True).alias("asks"))
    told = large.join(cuts, "component").select(name("block", "cut").alias("task"), "id", F.lit(False).alias("asks"))
    both = asks.union(told).groupBy("task", "id").agg(F.max("asks").alias("asks"))
    return alone.union(components(first.union(compared(both, sets, per_100))))


def near_duplicates(docs: DataFrame, width: int = 5, per_100: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document.

    Two documents are linked if 100 times their common shingles are at least `per_100` times their union; the
    component is the smallest id that links reach.
    """
    rows = materialise(signed(docs, width), "signed")
    classes = materialise(
        rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(
            F.min(F.struct("doc_id", "n", "signature")).alias("first")).select(
            "key", F.col("first.doc_id").alias("id"), F.col("first.n").alias("n"), F.col("first.signature").alias("signature")),
        "classes")
    found = connected(docs, classes, width, per_100)
    labels = classes.select("key", "id").join(found, F.col("id") == F.col("node"), "left").select(
        "key", F.coalesce("component", "id").alias("component_id"))
    full = F.col("n") > 0
    return rows.select("doc_id", "n", "key").join(labels, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(full & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, width: int = 5, per_100: int = 80) -> DataFrame:
    """The rows of `docs` that stay, one document of each component, with all their columns."""
    gone = near_duplicates(docs, width, per_100).where(~F.col("kept")).select(F.col("doc_id").alias("doc_id_"))
    gone = materialise(gone.distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["doc_id_"], "left_anti")
