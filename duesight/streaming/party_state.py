"""What parties had accumulated at the first of each month, stored, so that a receipt replays only later rows.

Four tables under one folder, each partitioned by the batch that wrote it and by a hash of the party:

* states: PARTY_ID, month and the running values before the month's first row,
* values: PARTY_ID, month, value, n: the histogram of the values that medians are taken of, by month,
* dates: PARTY_ID, CUSTOMER_TRX_ID, TRX_DATE and the dates of the invoice's events,
* replays: PARTY_ID and the month from which a batch wrote the other three anew, missing if from the beginning.

A micro-batch finds the first date at which anything of a party can differ, loads the party's last state at or
before it, and replays the invoices from then on, the undated ones, and the stored events of earlier invoices. Earlier
rows keep the scores that are served. It reads the partitions of the touched parties and writes what it replayed
under its own number; readers leave out what a later replay covers. A repeated batch reads what older ones wrote and replaces its own.

Scores are those of a full run, bit by bit while no party needs the chunked form. Parties without a state start from
nothing. Nulls: invoices without a party are scored alone, those without a date are always replayed, after all others.
Batches whose receipts hit nothing publish nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from duesight.functions.cleaning import plus_days
from duesight.operators.features import pre_due_columns
from duesight.operators.history import (
    EVENT_COUNTS,
    EVENT_DATES,
    INVOICE_ROW,
    SEED,
    dated_rows,
    history_of_stream,
    party_stream,
    prior_measures,
    running_values,
    with_window_lane,
)
from duesight.operators.invoices import clean_invoices
from duesight.operators.ledger import TARGET, receipt_days
from duesight.operators.scoring import SCORE_COLUMNS, Model, score, score_table
from duesight.operators.skew import Skew
from duesight.operators.targets import receipts_of, restrict_to_targets, target_ids
from duesight.plans.features import RawTables, party_skew, snapshot_facts
from duesight.session import CODEC, materialise, shuffles_cleared
from duesight.sinks.publish import RunKey, publish_scores
from duesight.sources.by_party import PartyTables
from duesight.streaming.receipt_trigger import hit_invoices, surviving_memos, touched_invoices

#: The number under which a full run stores its state.
FULL = -1


def schemas() -> dict[str, str]:
    measures = prior_measures()
    kinds = {"sums": "double", "totals": "bigint", "counts": "bigint", "lows": "timestamp"}
    running = [f"{n} {t}" for kind, t in kinds.items() for n in measures[kind]] + [f"{n} bigint" for n in EVENT_COUNTS.values()]
    return {
        "states": ", ".join(["month date", *running]),
        "values": "month date, value bigint, n bigint",
        "dates": ", ".join(["CUSTOMER_TRX_ID bigint, TRX_DATE timestamp", *[f"{n} timestamp" for n in EVENT_DATES.values()]]),
        "replays": "_start date",
    }


@dataclass(frozen=True)
class PartyState:
    """The stored state. `parts` is the number of hash classes of parties; a batch names those it touches in its filters."""

    spark: SparkSession
    path: str
    parts: int = 256

    def part(self) -> Column:
        return F.pmod(F.xxhash64("PARTY_ID"), F.lit(self.parts)).cast("int")

    def write(self, name: str, rows: DataFrame, number: int) -> None:
        columns = StructType.fromDDL(schemas()[name])
        stamped = rows.select("PARTY_ID", *[F.col(f.name).cast(f.dataType) for f in columns],
                              F.lit(number).cast("bigint").alias("_number"), self.part().alias("_part"))
        # A few files for each class, more for a large one.
        with shuffles_cleared(rows.sparkSession):
            stamped.hint("rebalance", "_part").write.partitionBy("_number", "_part").mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").option("compression", CODEC).parquet(f"{self.path}/{name}")

    def _rows(self, name: str, parties: DataFrame, parts: list[int], number: int) -> DataFrame:
        """What batches before `number` wrote of the parties, whose partitions are named."""
        schema = f"PARTY_ID bigint, {schemas()[name]}, _number bigint, _part int"
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        rows = rows.where(F.col("_part").isin(parts) & (F.col("_number") < number))
        return rows.join(parties.select("PARTY_ID"), "PARTY_ID", "left_semi").drop("_part")

    def read(self, name: str, day: str, parties: DataFrame, parts: list[int], number: int) -> DataFrame:
        """The rows of the parties that no later batch has replayed: none that began at or before the row's `day`.

        The replays of a party are as many as its batches since the last full run.
        """
        replays = self._rows("replays", parties, parts, number).groupBy("PARTY_ID").agg(
            F.collect_list(F.struct(F.col("_number").alias("by"), "_start")).alias("_replays"))
        rows = self._rows(name, parties, parts, number).join(replays, "PARTY_ID", "left")

        def newer(r):
            return (r["by"] > F.col("_number")) & (r["_start"].isNull() | (r["_start"] <= F.col(day)))

        return rows.where(F.col("_replays").isNull() | ~F.exists("_replays", newer)).drop("_number", "_replays")

    def store(self, done: DataFrame, number: int, starts: DataFrame | None = None) -> None:
        """Write the state that a stream with the events' dates went through. The replays go last: they make the rest count."""
        known = done.where(F.col("PARTY_ID").isNotNull() & F.col("_at").isNotNull())
        known = known.withColumn("month", F.trunc("_at", "month"))
        names = ["_at", "_kind", "CUSTOMER_TRX_ID", *running_values()]
        # The lane is among the keys because the stream is partitioned by it.
        first = known.groupBy("PARTY_ID", "_lane", "month").agg(F.min(F.struct(*names)).alias("_first"))
        self.write("states", first.select("PARTY_ID", "month", *[f"_first.{n}" for n in running_values()]), number)
        invoices = known.where(F.col("_kind") == INVOICE_ROW)
        paid = invoices.where((F.col("is_paid") == 1) & F.col("actual_dpd").isNotNull())
        values = paid.groupBy("PARTY_ID", "_lane", "month", F.col("actual_dpd").alias("value")).agg(F.count("*").alias("n"))
        self.write("values", values, number)
        self.write("dates", invoices, number)
        none = self.spark.createDataFrame([], "PARTY_ID bigint, _start date")
        self.write("replays", none if starts is None else starts, number)

    def starts(self, since: DataFrame, parts: list[int], number: int) -> DataFrame:
        """PARTY_ID, _start: the last month with a state not after the party's `_since`; missing without one."""
        stored = self.read("states", "month", since, parts, number).select("PARTY_ID", "month")
        early = stored.join(since, "PARTY_ID").where(F.col("month") <= F.coalesce("_since", F.col("month").cast("timestamp")))
        last = early.groupBy("PARTY_ID").agg(F.max("month").alias("_start"))
        return since.select("PARTY_ID").join(last, "PARTY_ID", "left")

    def earlier(self, starts: DataFrame, parts: list[int], number: int) -> DataFrame:
        """What `party_stream` goes on from: the parties' state and histogram at their start, and events still to come."""
        at = starts.where(F.col("_start").isNotNull())
        here, lane = F.col("_start").cast("timestamp").alias("_at"), F.lit(0).cast("bigint").alias("_lane")
        seed = F.lit(SEED).alias("_kind")
        states = self.read("states", "month", at, parts, number).join(at, "PARTY_ID")
        totals = states.where(F.col("month") == F.col("_start")).select(
            "PARTY_ID", lane, seed, here, *[F.col(n).alias(f"_s_{n}") for n in running_values()])
        values = self.read("values", "month", at, parts, number).join(at, "PARTY_ID")
        histogram = values.where(F.col("month") < F.col("_start")).groupBy("PARTY_ID", "_start", "value").agg(
            F.sum("n").alias("_s_freq")).select("PARTY_ID", lane, seed, here, F.col("value").alias("_s_value"), "_s_freq")
        dates = self.read("dates", "TRX_DATE", at, parts, number).join(at, "PARTY_ID")
        events = F.inline(F.array(*[F.struct(F.lit(k).alias("_kind"), F.col(c).alias("_at")) for k, c in EVENT_DATES.items()]))
        coming = dates.where(F.col("TRX_DATE") < F.col("_start")).select("PARTY_ID", lane, "CUSTOMER_TRX_ID", "_start", events)
        coming = coming.where(F.col("_at") >= F.col("_start")).drop("_start")
        return totals.unionByName(histogram, allowMissingColumns=True).unionByName(coming, allowMissingColumns=True)


def first_changes(hit: DataFrame, tables: RawTables, snapshot) -> DataFrame:
    """PARTY_ID, _since: before this moment no row or event of the party depends on the invoices that were hit.

    An invoice's events lie at its receipts or 90 days past due, whatever its own date.
    """
    ids = target_ids(hit)
    rows = clean_invoices(tables.invoice.join(ids, "CUSTOMER_TRX_ID", "left_semi"))
    days = receipt_days(receipts_of(tables.receipt, hit), snapshot)
    paid = days.select(F.col("_receipt_id").alias("CUSTOMER_TRX_ID"), F.get("_days", F.lit(0))["day"].alias("_first_day"))
    # All rows of an id count, as receipts decide which of them is kept.
    by_id = rows.groupBy("CUSTOMER_TRX_ID").agg(
        F.min(F.least("TRX_DATE", plus_days(F.col("DUE_DATE"), 90))).alias("_first_date"))
    since = by_id.join(paid, "CUSTOMER_TRX_ID", "left").select(
        "CUSTOMER_TRX_ID", F.least("_first_date", "_first_day").alias("_since"))
    parties = rows.where(F.col("PARTY_ID").isNotNull()).select("PARTY_ID", "CUSTOMER_TRX_ID").distinct()
    return parties.join(since, "CUSTOMER_TRX_ID").groupBy("PARTY_ID").agg(F.min("_since").alias("_since"))


def replayed_invoices(touched: DataFrame, starts: DataFrame) -> DataFrame:
    """The touched invoices that are not all dated before their party's start, and the memos they are netted with."""
    late = F.col("_start").isNull() | F.col("TRX_DATE").isNull() | (F.col("TRX_DATE") >= F.col("_start"))
    ids = target_ids(touched.where(TARGET).join(starts, "PARTY_ID", "left").where(late)).withColumn("_late", F.lit(True))
    own = ids.withColumnRenamed("_late", "_own")
    original = ids.withColumnsRenamed({"CUSTOMER_TRX_ID": "PREVIOUS_CUSTOMER_TRX_ID", "_late": "_original"})
    found = touched.join(own, "CUSTOMER_TRX_ID", "left").join(original, "PREVIOUS_CUSTOMER_TRX_ID", "left")
    return found.where("_own OR _original").select(*touched.columns)


def _read_facts(facts: DataFrame, model: Model | None) -> list[str]:
    """The facts that the scores are made of. A model of the caller's own may read any."""
    read = {*SCORE_COLUMNS, TARGET, "PARTY_ID", *(c for c in facts.columns if c.endswith("_pre_due"))}
    return [c for c in facts.columns if c != "_lane" and (model is not None or c in read)]


def _stored_stream(facts: DataFrame, snapshot, skew: Skew, keep: list[str], earlier: DataFrame | None = None) -> DataFrame:
    """The party stream of the facts, written out with the columns that the state and the scores are made of."""
    dates = list(EVENT_DATES.values())
    stream = party_stream(dated_rows(facts, snapshot), [*(c for c in facts.columns if c != "_lane"), *dates], skew, earlier)
    names = ["PARTY_ID", "_lane", "_at", "_kind", "CUSTOMER_TRX_ID", *keep, *dates, "is_paid", "actual_dpd",
             *running_values(), *prior_measures()["medians"]]
    return materialise(stream.select(*dict.fromkeys(names)), "stream")


def _scored(done: DataFrame, keep: list[str], model: Model | None) -> DataFrame:
    features = history_of_stream(done, keep).select("*", *pre_due_columns())
    return score_table(restrict_to_targets(score(features, model), None))


def score_and_store(state: PartyState, raw: RawTables, snapshot, model: Model | None = None) -> DataFrame:
    """The scores of a full run; its state is stored."""
    skew = party_skew(raw)
    facts = with_window_lane(snapshot_facts(raw, snapshot, skew), skew)
    keep = _read_facts(facts, model)
    done = _stored_stream(facts, snapshot, skew, keep)
    state.store(done, FULL)
    return _scored(done, keep, model)


def replay_batch(
    source: Callable[[], RawTables | PartyTables], state: PartyState, snapshot: str, scores_path: str, served: RunKey,
    has_memos: bool,
    clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
    model: Model | None = None,
) -> Callable[[DataFrame, int], None]:
    """Handler for foreachBatch, as `rescore_batch`, but for the rows from the first change on.

    Plain tables hold the batch's receipts by then. To tables by party the batch is appended, and only the parts that it
    touches are read.
    `has_memos` says whether the run that stored the state had credit memos that count. If the first such memo arrives
    by a receipt, all amounts may change: the batch fails, and a full run has to come first.
    """

    def handle(batch: DataFrame, number: int) -> None:
        tables = source()
        by_party = isinstance(tables, PartyTables)
        if by_party:
            tables.append(batch, number)
        if not has_memos and surviving_memos(tables.everything() if by_party else tables):
            raise ValueError("the first credit memo that counts arrived: store the state anew by a full run")
        hit = materialise(tables.hit(batch) if by_party else hit_invoices(batch, tables.invoice), "hit")
        if by_party:
            tables = tables.around(hit)
        touched = touched_invoices(batch, tables.invoice, hit)
        touched = materialise(clean_invoices(touched, [TARGET]), "touched")
        since = materialise(first_changes(hit, tables, snapshot), "since")
        parts = [r["p"] for r in since.select(state.part().alias("p")).distinct().collect()]  # a number for each class at most
        starts = materialise(state.starts(since, parts, number), "starts")
        invoices = materialise(replayed_invoices(touched, starts), "replayed")
        # Copies of a receipt stay, as in a run over all dates.
        ids = target_ids(invoices).withColumnRenamed("CUSTOMER_TRX_ID", "_id")
        receipts = tables.receipt.join(ids, F.col("APPLIED_CUSTOMER_TRX_ID") == F.col("_id"), "left_semi")
        raw = RawTables(invoices, receipts, tables.customer, has_memos=has_memos)
        skew = party_skew(raw)
        facts = with_window_lane(snapshot_facts(raw, snapshot, skew), skew)
        late = F.col("_start").isNull() | F.col("TRX_DATE").isNull() | (F.col("TRX_DATE") >= F.col("_start"))
        facts = facts.join(starts, "PARTY_ID", "left").where(late).select(*facts.columns)
        earlier = materialise(state.earlier(starts, parts, number), "earlier")
        keep = _read_facts(facts, model)
        done = _stored_stream(facts, snapshot, skew, keep, earlier)
        # Of one moment's batches the larger number sorts last as text, too.
        run = replace(served, job_id=f"stream-{number:019d}", published_at=clock().isoformat(" "))
        publish_scores(_scored(done, keep, model), scores_path, run, replace=False)
        state.store(done, number, starts)

    return handle
