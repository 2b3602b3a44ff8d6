"""Removal of byte strings that stand earlier in the corpus, by distributed prefix doubling.

A byte goes if it lies in a string of THRESHOLD bytes that also starts earlier (a smaller document, or an earlier start).

1. Positions. Every run of WINDOW + SEED - 1 = THRESHOLD bytes has one anchor: its seed of SEED bytes with the smallest
   hash. Equal strings have their anchors at equal places, so strings are ranked by their anchors. Neighbouring starts
   with one anchor travel as one row (a block).
2. Ranks. Spark sorts the pairs (name of the seed, name of the block's whole stretch) by range. A seed that stands
   once is unique, its starts stay. Of blocks with equal pairs all but the first go. Blocks whose seed has other
   stretches, too, are open: the first of each stretch is ranked further.
3. Doubling. The open blocks of a seed come together by a second sort. Their positions get ranks of STEP bytes, then of
   twice as many from the pairs (rank at i, rank at i + length), until the rank is unique or its length is THRESHOLD.
   Equal ranks then are equal strings, of which all but the first go.

A seed of very many blocks spreads over ranges in step 2, as the position is part of the order; what a range can't tell
by itself is about its first and last rows (three rows a range are compared on the driver). In step 3 the starts of a
seed of over CLASS_ROWS open blocks are sorted by Spark once more, in ranges again.

Documents are ordered by id (null first), rows of one id by a hash of the text. Rows with the same id and text are one
document; each of them is returned, with the same figures. A null text is empty. Texts may be of any length; they are
read in slices. An empty table gives an empty result. Other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duesight.llm.shingles import mix
from duesight.session import materialise

THRESHOLD, SEED, STEP = 100, 37, 25
WINDOW = THRESHOLD - SEED + 1
#: Bytes before the anchor that an open block needs; it needs THRESHOLD from there on.
BEFORE = WINDOW - 1
CONTEXT = BEFORE + THRESHOLD
#: Bytes looked at together; with another piece of that length a place takes PLACE_BITS.
SLICE, PLACE_BITS = 1 << 19, 21
#: Open blocks of a seed that a task takes (about 8 KB a row), and those it looks at together.
CLASS_ROWS = 30_000
GROUP_ROWS = 4_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BYTES = np.random.Generator(np.random.PCG64(13)).integers(1, 1 << 63, (2, 256), np.uint64)
_tables: dict[tuple[int, bool], np.ndarray] = {}

DOC = "doc_id long, h long"
BLOCK = f"{DOC}, at long, low int, high int, k1 long, k2 long"
DUP, OPEN, HEAD, TAIL, LAST = range(5)
RANKED = f"part int, verdict int, several boolean, {BLOCK}"
CONTEXTS = f"{DOC}, at long, low int, high int, k1 long, around binary"
RUN = f"{DOC}, first long, last long"


def _powers(which: int, inverse: bool, n: int) -> np.ndarray:
    key = (which, inverse)
    if len(_tables.get(key, ())) < n:
        base = pow(_BASES[which], -1, 1 << 64) if inverse else _BASES[which]
        step = np.full(1 << n.bit_length(), base, np.uint64)
        step[0] = 1
        with np.errstate(over="ignore"):
            _tables[key] = np.multiply.accumulate(step)
    return _tables[key][:n]


class Names:
    """Names (hashes) of any stretches of `data`, from sums over its bytes."""

    def __init__(self, data: np.ndarray, which: int):
        self.which = which
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTES[which][data] * _powers(which, False, len(data)), out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            value = (self.sums[end] - self.sums[begin]) * _powers(self.which, True, len(self.sums))[begin]
            return mix(value + (end - begin).astype(np.uint64))


def blocks(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The blocks of some texts that stand one after the other in `data`, text t from bounds[t] to bounds[t + 1].

    first, last: the starts of a block; at: its anchor; k1, k2: the names of the seed and of the stretch.
    """
    lengths = np.diff(bounds)
    none = {n: np.zeros(0, np.int64) for n in ("text", "first", "last", "at")}
    if not len(lengths) or lengths.max() < THRESHOLD:
        return none | {n: np.zeros(0, np.uint64) for n in ("k1", "k2")}
    names, others = Names(data, 0), Names(data, 1)
    at = np.arange(len(data) - SEED + 1)
    seeds = names.of(at, at + SEED)
    bits = np.uint64(PLACE_BITS)
    # The place in the low bits: of equal seeds the first is the least.
    least = (seeds >> bits << bits) | at.astype(np.uint64)
    span = 1
    while 2 * span <= WINDOW:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < WINDOW:
        least = np.minimum(least[: len(least) - WINDOW + span], least[WINDOW - span :])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    fits = np.zeros(len(data) + 1, np.int32)
    long = lengths >= THRESHOLD
    np.add.at(fits, bounds[:-1][long], 1)
    np.add.at(fits, bounds[1:][long] - THRESHOLD + 1, -1)
    starts = np.flatnonzero(np.cumsum(fits)[: len(anchor)] > 0)
    anchor = anchor[starts]
    cut = np.flatnonzero((np.diff(starts) > 1) | (np.diff(anchor) != 0)) + 1
    first, last = starts[np.concatenate([[0], cut])], starts[np.concatenate([cut, [len(starts)]]) - 1]
    at = anchor[np.concatenate([[0], cut])]
    shape = (((at - first) << 8) | (at - last)).astype(np.uint64)
    with np.errstate(over="ignore"):
        k2 = mix(names.of(first, last + THRESHOLD) + others.of(first, last + THRESHOLD) * np.uint64(3) + mix(shape))
    text = np.searchsorted(bounds, first, "right") - 1
    return {"text": text, "first": first, "last": last, "at": at, "k1": seeds[at], "k2": k2}


def slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, bounds, text numbers, offset of each piece in its text), about SLICE bytes a time."""
    held, size = [], 0

    def joined():
        data = np.frombuffer(b"".join(p for p, _, _ in held), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p, _, _ in held])])
        return data, bounds, np.array([t for _, t, _ in held]), np.array([o for _, _, o in held])

    for t, text in enumerate(texts):
        for begin in range(0, max(len(text) - THRESHOLD + 1, 0), SLICE):
            piece = text[begin : begin + SLICE + THRESHOLD - 1]
            held.append((piece, t, begin))
            size += len(piece)
            if size >= SLICE:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def encoded(texts) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")


def block_rows(docs: DataFrame) -> DataFrame:
    """A row for each block of the keyed documents."""

    def run(batches):
        for batch in batches:
            texts = encoded(batch.column("text").to_pylist())
            for data, bounds, number, offset in slices(texts):
                b = blocks(data, bounds)
                if len(b["at"]):
                    which = pa.array(number[b["text"]])
                    # From places in the slice to places in the text.
                    at = b["at"] - bounds[b["text"]] + offset[b["text"]]
                    yield pa.record_batch(
                        [batch.column("doc_id").take(which), batch.column("h").take(which), pa.array(at),
                         pa.array((b["at"] - b["last"]).astype(np.int32)), pa.array((b["at"] - b["first"]).astype(np.int32)),
                         pa.array(b["k1"].view(np.int64)), pa.array(b["k2"].view(np.int64))],
                        names=["doc_id", "h", "at", "low", "high", "k1", "k2"])

    return docs.mapInArrow(run, BLOCK)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    doc = batch.column("doc_id")
    null = doc.is_null().to_numpy(zero_copy_only=False)
    return (doc.fill_null(0).to_numpy(), null, *(batch.column(c).to_numpy() for c in ("h", "at", "k1", "k2")))


def _judged(batch: pa.RecordBatch, verdict: int, several: bool = False) -> pa.RecordBatch:
    n = batch.num_rows
    part = TaskContext.get().partitionId()
    return pa.record_batch(
        [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, verdict, np.int32)), pa.array([several] * n, pa.bool_()),
         *batch.columns], names=["part", "verdict", "several", *batch.schema.names])


def rank_sorted(batches) -> Iterator[pa.RecordBatch]:
    """Verdicts on rows that come sorted by pair and position; what depends on other ranges as HEAD, TAIL and LAST.

    DUP: a row after the first of its pair. OPEN: the first of a pair whose k1 has other pairs. The first row of the
    range is HEAD, with `several` if its k1 has more pairs here; TAIL is the first row of the last k1, if no second pair
    of it was seen; LAST is the first row of the last pair.
    """
    head = pending = opener = None  # rows: the range's first, the undecided first of a k1, the first of the pair
    several = False
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, null, h, at, k1, k2 = _columns(batch)
        before = _columns(opener) if opener is not None else None
        new1, new2 = np.ones(len(k1), bool), np.ones(len(k1), bool)
        new1[1:] = k1[1:] != k1[:-1]
        new2[1:] = new1[1:] | (k2[1:] != k2[:-1])
        if before is not None:
            new1[0] = k1[0] != before[4][0]
            new2[0] = new1[0] or k2[0] != before[5][0]
        first = np.maximum.accumulate(np.where(new2, np.arange(len(k1)), -1))
        same = np.ones(len(k1), bool)
        for i, c in enumerate((doc, null, h, at)):
            own = c[np.maximum(first, 0)]
            if before is not None:
                own = np.where(first < 0, before[i][0], own)
            same &= c == own
        dup = np.flatnonzero(~new2 & ~same)
        places = np.flatnonzero(new2)
        if len(places) and pending is not None:
            if not new1[places[0]]:  # a second pair of the pending row's k1
                if pending is head:
                    several = True
                else:
                    yield _judged(pending, OPEN)
            pending = None
        begins = new1[places]
        follows = np.concatenate([~begins[1:], [False]])
        opened = places[~begins | follows]
        if head is None:
            head = batch.slice(0, 1)
            several = bool(follows[0])
            opened = opened[opened != 0]
        if len(places):
            opener = batch.slice(places[-1], 1)
            if begins[-1]:
                pending = head if places[-1] == 0 and before is None else opener
        if len(dup):
            yield _judged(batch.take(pa.array(dup)), DUP)
        if len(opened):
            yield _judged(batch.take(pa.array(opened)), OPEN)
    if head is not None:
        yield _judged(head, HEAD, several)
        if pending is not None and pending is not head:
            yield _judged(pending, TAIL)
        yield _judged(opener, LAST)


def settle(edges: list) -> list[tuple]:
    """Verdicts on the rows at the borders of the ranges, from at most three rows a range in order of the ranges."""
    out, pending, pair, opener = [], None, None, None
    by_part: dict[int, dict[int, object]] = {}
    for e in edges:
        by_part.setdefault(e["part"], {})[e["verdict"]] = e

    def key(r):
        return r["doc_id"], r["h"], r["at"]

    for part in sorted(by_part):
        head, tail, last = (by_part[part].get(v) for v in (HEAD, TAIL, LAST))
        goes_on = pair is not None and head["k1"] == pair[0]
        same = goes_on and head["k2"] == pair[1]
        ends = head["k1"] != last["k1"]
        if same and key(head) != opener:
            out.append((DUP, head))
        elif goes_on and not same:
            out.append((OPEN, head))
        if pending is not None and goes_on and (not same or head["several"]):
            out.append((OPEN, pending))
            pending = None
        if not goes_on:
            pending = None
            if head["several"]:
                out.append((OPEN, head))
            elif not ends:
                pending = head
        if ends:
            pending = tail
        if not (same and (last["k1"], last["k2"]) == pair):
            opener = key(last)
        pair = last["k1"], last["k2"]
    return out


def ranked(rows: DataFrame) -> DataFrame:
    """verdict and row: the DUP and OPEN rows of all ranges. Ranges split a pair of very many rows."""
    order = ["k1", "k2", F.asc_nulls_first("doc_id"), "h", "at"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = materialise(dealt.mapInArrow(rank_sorted, RANKED), "ranked")
    edges = found.where(F.col("verdict") > OPEN).collect()  # three rows a range
    names = [c.split()[0] for c in BLOCK.split(", ")]
    more = [(v, *(r[c] for c in names)) for v, r in settle(edges)]
    inner = found.where(F.col("verdict") <= OPEN).select("verdict", *names)
    return inner.unionByName(rows.sparkSession.createDataFrame(more, f"verdict int, {BLOCK}"))


def with_context(open_rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The open blocks with the bytes around their anchors."""
    listed = open_rows.groupBy("doc_id", "h").agg(F.collect_list(F.struct("at", "low", "high", "k1")).alias("open"))
    listed = listed.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "open")
    joined = docs.join(listed, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select(
        "doc_id", "h", "text", "open")

    names = [c.split()[0] for c in CONTEXTS.split(", ")]
    schema = pa.schema(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())))

    def run(batches):
        for batch in batches:
            held = []
            for doc, h, text, found in zip(*(batch.column(c) for c in ("doc_id", "h", "text", "open"))):
                data = b"\0" * BEFORE + encoded([text.as_py()])[0] + b"\0" * THRESHOLD
                for at, low, high, k1 in zip(*(found.values.field(c).to_pylist() for c in names[2:6])):
                    held.append((doc.as_py(), h.as_py(), at, low, high, k1, data[at : at + CONTEXT]))
                    if len(held) == GROUP_ROWS:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], schema)
                        held = []
            if held:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], schema)

    return joined.mapInArrow(run, CONTEXTS)


def pair_ranks(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each pair, that is the first place that has it, and how many places do."""
    order = np.lexsort((right, left))
    new = np.ones(len(order), bool)
    new[1:] = (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1])
    group = np.cumsum(new) - 1
    first = np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order
    rank, count = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    rank[order], count[order] = first[group], np.bincount(group)[group] if len(order) else 0
    return rank, count


def doubled(around: np.ndarray, seed: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """For each start (row, place before the anchor) the first row that has its string of THRESHOLD bytes, in order of rows.

    Ranks of STEP bytes are names; each round ranks the pairs (rank at i, rank at i + length). Starts outside, and
    those whose rank is unique at some length, get -1.
    """
    rows, width, length = len(around), CONTEXT - STEP + 1, STEP
    names = Names(around.ravel(), 0)
    at = (np.arange(rows)[:, None] * CONTEXT + np.arange(width)).ravel()
    with np.errstate(over="ignore"):
        rank = names.of(at, at + STEP) + mix(np.repeat(seed.view(np.uint64), width))
    alive = inside.copy()
    while 2 * length < THRESHOLD:
        rank = rank.reshape(rows, width)
        width -= length
        rank, count = pair_ranks(rank[:, :width].ravel(), rank[:, length : length + width].ravel())
        length *= 2
        alive &= count.reshape(rows, width)[:, :WINDOW] > 1
    rank = rank.reshape(rows, width)
    row, place = np.nonzero(alive)
    last, count = pair_ranks(rank[row, place], rank[row, place + THRESHOLD - length])
    out = np.full((rows, WINDOW), -1)
    out[row, place] = np.where(count > 1, row[last], -1)
    return out


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of True in each row."""
    wide = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    wide[:, 1:-1] = flags
    step = np.diff(wide, axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1] - 1


def _matrix(table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("around").to_pylist()), np.uint8).reshape(-1, CONTEXT)


def _inside(table) -> np.ndarray:
    """Which places before the anchor are starts of the block."""
    d = BEFORE - np.arange(WINDOW)
    low, high = (table.column(c).to_numpy()[:, None] for c in ("low", "high"))
    return (d >= low) & (d <= high)


def _decided(table: pa.Table) -> pa.RecordBatch:
    """The starts that go, as runs, of whole seeds whose rows are in order of position."""
    first = doubled(_matrix(table), table.column("k1").to_numpy(), _inside(table))
    doc = table.column("doc_id").combine_chunks()
    same = np.ones(first.shape, bool)  # a repeated row of the document is not later
    for k in (doc.fill_null(0), doc.is_null(), table.column("h"), table.column("at")):
        k = k.to_numpy(zero_copy_only=False) if isinstance(k, pa.Array) else k.to_numpy()
        same &= k[np.maximum(first, 0)] == k[:, None]
    row, a, b = runs_of((first >= 0) & ~same)
    at, take = table.column("at").to_numpy()[row] - BEFORE, pa.array(row)
    return pa.record_batch([doc.take(take), table.column("h").combine_chunks().take(take), pa.array(at + a), pa.array(at + b)],
                           names=["doc_id", "h", "first", "last"])


def _spread(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each start of the blocks as a row of its own, with two names of its string."""
    around = _matrix(batch)
    row, place = np.nonzero(_inside(batch))
    begin, take = row * CONTEXT + place, pa.array(row)
    k1, k2 = (Names(around.ravel(), which).of(begin, begin + THRESHOLD).view(np.int64) for which in (0, 1))
    at = batch.column("at").to_numpy()[row] - BEFORE + place
    zero = pa.array(np.zeros(len(row), np.int32))
    return pa.record_batch(
        [batch.column("doc_id").take(take), batch.column("h").take(take), pa.array(at), zero, zero, pa.array(k1), pa.array(k2)],
        names=["doc_id", "h", "at", "low", "high", "k1", "k2"])


def open_verdicts(contexts: DataFrame) -> DataFrame:
    """doc_id, h, first, last: the removed starts of the open blocks.

    Seeds come whole to a task; those of more than CLASS_ROWS blocks are told apart by Spark, start by start.
    """
    many = contexts.groupBy("k1").agg(F.count("*").alias("n")).where(F.col("n") > CLASS_ROWS).select("k1")
    many = materialise(many, "many")
    order = ["k1", F.asc_nulls_first("doc_id"), "h", "at"]
    dealt = contexts.join(many, "k1", "left_anti").repartition("k1").sortWithinPartitions(*order)

    def decide(batches):
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            k1 = batch.column("k1").to_numpy()
            begin = 0
            while begin < len(k1):
                # What is held may end where a new seed begins.
                if size >= GROUP_ROWS:
                    new = np.flatnonzero(np.concatenate([[k1[begin] != last], k1[begin + 1 :] != k1[begin:-1]]))
                    stop = begin + int(new[0]) if len(new) else len(k1)
                else:
                    stop = min(len(k1), begin + GROUP_ROWS - size)
                if stop > begin:
                    held.append(batch.slice(begin, stop - begin))
                    size, last = size + stop - begin, k1[stop - 1]
                if size >= GROUP_ROWS and stop < len(k1) and k1[stop] != last:
                    yield _decided(pa.Table.from_batches(held))
                    held, size = [], 0
                begin = stop
        if held:
            yield _decided(pa.Table.from_batches(held))

    def spread(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, GROUP_ROWS):
                yield _spread(batch.slice(begin, GROUP_ROWS))

    single = contexts.join(many, "k1", "left_semi").select(
        "doc_id", "h", "at", "low", "high", "k1", "around").mapInArrow(spread, BLOCK)
    later = ranked(single).where(F.col("verdict") == DUP).select("doc_id", "h", F.col("at").alias("first"), F.col("at").alias("last"))
    return dealt.mapInArrow(decide, RUN).unionByName(later)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, h, first, last: runs of starts whose string of THRESHOLD bytes also starts earlier."""
    blocks_ = ranked(block_rows(docs))
    whole = blocks_.where(F.col("verdict") == DUP).select(
        "doc_id", "h", (F.col("at") - F.col("high")).alias("first"), (F.col("at") - F.col("low")).alias("last"))
    contexts = materialise(with_context(blocks_.where(F.col("verdict") == OPEN), docs), "contexts")
    return whole.unionByName(open_verdicts(contexts))


def removed_spans(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes (end exclusive) that the strings from the given runs of starts cover."""
    out: list[list[int]] = []
    for first, last in sorted(starts):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + THRESHOLD)
        else:
            out.append([first, last + THRESHOLD])
    return [tuple(s) for s in out]


def _with_runs(docs: DataFrame) -> DataFrame:
    rows = keyed(docs)
    runs = repeated_runs(rows).groupBy("doc_id", "h").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    runs = runs.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "runs")
    return rows.join(runs, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", "text", "runs")


def _kept(text: bytes, runs) -> tuple[list[bytes], list[tuple[int, int]]]:
    spans = removed_spans([(r["first"], r["last"]) for r in runs or ()])
    edges = [0, *(x for s in spans for x in s), len(text)]
    return [text[a:b] for a, b in zip(edges[::2], edges[1::2])], spans


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, text, spans: what is left of each text, and what was removed (bytes, end exclusive).

    A cut inside a character leaves the replacement character in the text; `suffix_report` counts and hashes bytes.
    """

    def run(batches):
        for batch in batches:
            cells = [_kept(t, r) for t, r in zip(encoded(batch.column("text").to_pylist()), batch.column("runs").to_pylist())]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([b"".join(p).decode("utf-8", "replace") for p, _ in cells], pa.string()),
                 pa.array([[{"start": a, "stop": b} for a, b in s] for _, s in cells],
                          pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                names=["doc_id", "text", "spans"])

    return _with_runs(docs).mapInArrow(run, "doc_id long, text string, spans array<struct<start:long,stop:long>>")


def suffix_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row per row of `docs`."""

    def run(batches):
        for batch in batches:
            out = []
            for text, runs in zip(encoded(batch.column("text").to_pylist()), batch.column("runs").to_pylist()):
                pieces, spans = _kept(text, runs)
                digest = hashlib.sha256()
                for p in pieces:
                    digest.update(p)
                out.append((len(text), sum(b - a for a, b in spans), len(spans), digest.hexdigest()))
            cells = list(zip(*out)) or [()] * 4
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cells[:3]), pa.array(cells[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_runs(docs).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
