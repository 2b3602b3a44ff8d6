"""Conversation repair as lightest derivations, found by Knuth's agenda.

An item is "the first i rows are dealt with and the repaired roles have led to state q". Rules derive items from items:
keep, rerole or delete the next row, or insert a row. A derivation weighs (cost, audit): costs add, audits (initials of
the edits) are joined. No rule makes a weight smaller, and a smaller premise never gives a larger conclusion (at equal
cost neither audit is a prefix of the other, as it would need fewer insertions), so items can be finalised in the order
in which the agenda pops them.

Long conversations are cut into pieces of PIECE rows of a range of the sorted rows. A piece is solved on its own, from
each state it may be entered in; a rule with two premises, (p to q over one stretch) and (q to r over the next), joins
them. So no task solves a conversation of very many rows, only its edits and its digest, which are one per conversation
by contract, pass through one task as a stream: audits of four states a piece, and no texts, are held.

Nulls: a null role or text is one space; a null id or turn is a space in the damaging key, a null id is a conversation
of its own, null turns come first. Rows of one turn are in order of a hash of role and text after damage; repeated rows
are duplicates. Empty tables give an empty result. Other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duesight.session import materialise

#: What an edit costs, and which states of `(s?(ua)+)?` may end a conversation.
KEEP, REROLE, DELETE, INSERT, TRUNCATED_COST = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
GOALS = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
SPACE = r"\x20\x09-\x0D"
PIECE = 1_024
_BATCH = 4_096


def expected(state: int) -> tuple[str, int]:
    """The role that an inserted or renamed row takes, and the state after it."""
    return ("assistant", ASSISTANT) if state == USER else ("user", USER)


def lightest(rows: list[tuple[str, int]], start: int) -> dict[int, tuple[int, str]]:
    """state: (cost, audit) of the lightest derivation that leads from `start` over all rows (role initial, fault)."""
    agenda = [(0, "", 0, start)]
    done: set[tuple[int, int]] = set()
    goals: dict[int, tuple[int, str]] = {}
    while agenda and len(goals) < 4:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows):
            goals[state] = cost, audit

        def derive(more: int, letter: str, rows_done: int, to: int) -> None:
            if (rows_done, to) not in done:
                heapq.heappush(agenda, (cost + more, audit + letter, rows_done, to))

        _, after = expected(state)
        derive(INSERT, "I", i, after)
        if i < len(rows):
            initial, fault = rows[i]
            derive(DELETE, "D", i + 1, state)
            if fault in (FINE, TRUNCATED):
                more = TRUNCATED_COST if fault == TRUNCATED else 0
                derive(REROLE + more, "R", i + 1, after)
                if (state, initial) in STEPS:
                    derive(KEEP + more, "K", i + 1, STEPS[state, initial])
    return goals


def joined(pieces: Iterable[list[tuple[int, int, int, str]]]) -> tuple[int, list[str]]:
    """Cost and audits, by piece, of the lightest derivation over all pieces, given as (from, to, cost, audit).

    What came before a piece is compared by rank: without the insertions at their ends two audits over the same rows
    are equal or differ before either ends, so the rank and these insertions decide as the whole audits would.
    """
    reached, back = {START: (0, 0, "")}, []
    for entries in pieces:
        found: dict[int, tuple] = {}
        for a, b, cost, audit in entries:
            if a in reached:
                before, rank, tail = reached[a]
                weight = (before + cost, rank, tail + audit)
                if b not in found or weight < found[b][0]:
                    found[b] = weight, a, audit
        bases = {b: (w[1], w[2].rstrip("I")) for b, (w, _, _) in found.items()}
        order = {x: k for k, x in enumerate(sorted(set(bases.values())))}
        reached = {b: (w[0], order[bases[b]], w[2][len(bases[b][1]) :]) for b, (w, _, _) in found.items()}
        back.append({b: (a, audit) for b, (_, a, audit) in found.items()})
    cost, _, _, state = min((*reached[g], g) for g in GOALS if g in reached)
    audits = []
    for choice in reversed(back):
        state, audit = choice[state]
        audits.append(audit)
    return cost, audits[::-1]


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the contract states; `copy` tells repeated rows apart."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    lot = F.crc32(key.cast("binary")) % 20
    copies = F.when(lot == 0, F.array().cast("array<int>")).when(lot == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(lot == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(lot == 1, "").when(lot == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy"))


ROW = "conv_id long, turn long, role string, text string, key string"


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with their place, (part, pos): ranges of the order by conversation and turn, written out."""
    key = F.sha2(F.concat_ws(
        ":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role"), F.concat("role", "text")), 256)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "tie"]
    keyed = rows.select("conv_id", "turn", "role", "text", key.alias("key"), F.xxhash64("role", "text").alias("tie"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie")

    def number(batches):
        seen = 0
        for batch in batches:
            n = batch.num_rows
            part = TaskContext.get().partitionId()
            yield pa.record_batch(
                [pa.array([part] * n, pa.int32()), pa.array(range(seen, seen + n), pa.int64()), *batch.columns],
                names=["part", "pos", *batch.schema.names])
            seen += n

    return materialise(dealt.mapInArrow(number, f"part int, pos long, {ROW}"), "turns")


def faulted(rows: DataFrame) -> DataFrame:
    """conv_id, part, pos, initial, fault of numbered rows; no texts. The least place of a text is found by an
    aggregate, so equal texts in any number don't meet in one task."""
    place = F.struct("part", "pos")
    firsts = rows.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = rows.select("key", "part", "pos").join(firsts, "key").where(place > F.col("first")).select(
        "part", "pos", F.lit(True).alias("again"))
    text = F.col("text")
    blank = ~text.rlike(f"[^{SPACE}]")
    whole = text.rlike(rf"[.!?][{SPACE}]*\z")
    narrow = rows.select("conv_id", "part", "pos", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), whole.alias("whole"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("again"), DUPLICATE).when(~F.col("whole"), TRUNCATED).otherwise(FINE)
    return narrow.join(later, ["part", "pos"], "left").select("conv_id", "part", "pos", "initial", fault.alias("fault"))


ENTRY = "struct<start:int,stop:int,cost:long,audit:string>"
COUNTS = "blank long, duplicate long, truncated long, illegal long"
SOLVED = f"conv_id long, part int, pos long, {COUNTS}, first string, last string, entries array<{ENTRY}>"
_ENTRY = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_SOLVED = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("pos", pa.int64()), *(
    (c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string()), ("entries", _ENTRY)])


def grouped(batches, key) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Streams of the rows with equal keys, of rows in order; a stream is read before the next one begins."""
    rows = (r for batch in batches for piece in range(0, batch.num_rows, _BATCH) for r in batch.slice(piece, _BATCH).to_pylist())
    held = next(rows, None)
    while held is not None:
        now = key(held)

        def stream():
            nonlocal held
            while held is not None and key(held) == now:
                yield held
                held = next(rows, None)

        yield now, stream()


def batched(records: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for r in records:
        held.append(r)
        if len(held) == _BATCH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def solved(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """A row for each piece of a conversation with its counts and lightest derivations."""
    block = F.floor(F.col("pos") / piece).alias("block")
    dealt = rows.select("*", block).repartition("part", "block").sortWithinPartitions("part", "block", "pos")

    def solve(batches):
        def one(rows):
            rows = list(rows)
            first = rows[0]
            items = [(r["initial"], r["fault"]) for r in rows]
            # Within a block the conversation begins here; at its border it may go on from the one before.
            starts = range(4) if first["pos"] % piece == 0 else (START,)
            entries = [{"start": a, "stop": b, "cost": c, "audit": t} for a in starts for b, (c, t) in lightest(items, a).items()]
            pairs = sum(x + y not in LEGAL for (x, _), (y, _) in zip(items, items[1:]))
            n = [sum(f == kind for _, f in items) for kind in (BLANK, DUPLICATE, TRUNCATED)]
            return dict(zip(_SOLVED.names, (first["conv_id"], first["part"], first["pos"], *n, pairs, items[0][0], items[-1][0], entries)))

        key = lambda r: (r["part"], r["block"], r["conv_id"])
        yield from batched((one(stream) for _, stream in grouped(batches, key)), _SOLVED)

    return dealt.mapInArrow(solve, SOLVED)


EDITS = f"conv_id long, part int, pos long, edits string, {COUNTS}, cost long, audit string"
_EDITS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("pos", pa.int64()), ("edits", pa.string()), *(
    (c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])


def edits(pieces: DataFrame) -> DataFrame:
    """The edits of each piece, and a row for each conversation (edits null) with its counts, cost and audit."""
    order = ["conv_id", "part", "pos"]
    dealt = pieces.repartition("conv_id").sortWithinPartitions(*order)

    def join(batches):
        def records():
            for (conv,), stream in grouped(batches, lambda r: (r["conv_id"],)):
                places, counts, last = [], [0] * 4, None

                def entries():
                    nonlocal last
                    for r in stream:
                        places.append((r["part"], r["pos"]))
                        for k, c in enumerate(("blank", "duplicate", "truncated", "illegal")):
                            counts[k] += r[c]
                        counts[3] += last is not None and last + r["first"] not in LEGAL
                        last = r["last"]
                        yield [(e["start"], e["stop"], e["cost"], e["audit"]) for e in r["entries"]]

                cost, audits = joined(entries())
                for (part, pos), audit in zip(places, audits):
                    yield {"conv_id": conv, "part": part, "pos": pos, "edits": audit}
                yield dict(zip(_EDITS.names, (conv, None, None, None, *counts, cost, "".join(audits))))

        yield from batched(records(), _EDITS)

    return dealt.mapInArrow(join, EDITS)


def _applied(stream: Iterator[dict]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each row that stays or is inserted, of one conversation's pieces, each followed by its rows."""
    state, letters, at = START, "", 0
    for r in stream:
        if r["edits"] is not None:
            letters, at = r["edits"], 0
        else:
            letter, (role, after) = letters[at], expected(state)
            at += 1
            if letter == "K":
                role, after = r["role"], STEPS[state, r["role"][:1]]
            if letter != "D":
                yield letter, role, r["text"]
                state = after
        while letters[at : at + 1] == "I":
            role, state = expected(state)
            yield "I", role, ""
            at += 1


def _plan(turns: DataFrame, piece: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered rows, edits, and both in one table: a piece's edits before its rows."""
    rows = numbered(turns)
    found = materialise(edits(solved(faulted(rows), piece)), "edits")
    heads = found.where("edits IS NOT NULL").select("conv_id", "part", "pos", F.lit(0).alias("kind"), "edits",
                                                    F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    bodies = rows.select("conv_id", "part", "pos", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("edits"), "role", "text")
    both = heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos", "kind")
    return rows, found, both


def repaired_turns(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, place (from 0), edit, role, text: the repaired conversations, row by row. `turns` are taken as they are."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))

    def run(batches):
        yield from batched((dict(zip(schema.names, (conv, k, *r))) for (conv,), stream in grouped(
            batches, lambda r: (r["conv_id"],)) for k, r in enumerate(_applied(stream))), schema)

    return _plan(rows, piece)[2].mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def repair_report(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """Counts, cost, audit and digest of each conversation of `turns` after the contract's damage."""
    rows, found, both = _plan(damaged(turns), piece)
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches):
        def records():
            for (conv,), stream in grouped(batches, lambda r: (r["conv_id"],)):
                digest, joint = hashlib.sha256(), ""
                for _, role, text in _applied(stream):
                    digest.update(f"{joint}{role}:{text}".encode("utf-8", "surrogatepass"))
                    joint = "\n"
                yield {"conv_id": conv, "repaired_sha256": digest.hexdigest()}

        yield from batched(records(), schema)

    counts = [c.split()[0] for c in COUNTS.split(", ")]
    kinds = {"gaps": "long", **{c: "long" for c in counts}, "cost": "long", "audit": "string", "repaired_sha256": "string"}
    gaps = rows.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    sides = [turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), gaps,
             found.where("edits IS NULL").select("conv_id", *counts, "cost", "audit"),
             both.mapInArrow(run, "conv_id long, repaired_sha256 string")]
    every = [side.select("conv_id", *((F.col(c) if c in side.columns else F.lit(None).cast(t)).alias(c) for c, t in kinds.items()))
             for side in sides]
    union = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])
    zero = {"long": F.lit(0).cast("long"), "string": F.lit("")}
    return union.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in kinds)).select(
        "conv_id", *(F.coalesce(c, F.lit(hashlib.sha256().hexdigest()) if c == "repaired_sha256" else zero[t]).alias(c)
                     for c, t in kinds.items()))
