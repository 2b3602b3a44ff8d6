"""Every operator as a named query over the derived tables, with its SQL twin.

A query states its output columns once, as "name:kind"; both sides are cast by
it: i integer, f double rounded to 4 digits, d date text, t timestamp text,
s text.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duesight.checks import fixtures as fx
from duesight.checks import oracle as o
from duesight.checks import store as st
from duesight.functions import cleaning as cl
from duesight.functions import risk as rk
from duesight.operators import customer_risk as cr
from duesight.operators import customers as cu
from duesight.operators import exclusion as ex
from duesight.operators import features as ft
from duesight.operators import history as hi
from duesight.operators import invoices as iv
from duesight.operators import ledger as lg
from duesight.operators import models as md
from duesight.operators.quality import Quality
from duesight.operators import receipts as rc
from duesight.operators import scoring as sc
from duesight.operators import targets as tg
from duesight.plans import catalogue as ct
from duesight.plans import features as pf
from duesight.plans import jobs as jb
from duesight.plans import reports as rp
from duesight.schemas import CUSTOMER_RISK, SCORES
from duesight.session import materialise, prepare, scratch_path
from duesight.settings import COLD_START, SCORECARD
from duesight.sinks import publish as pb
from duesight.sources import by_party as bp
from duesight.sources import files as sf
from duesight.sources import tables as tb
from duesight.streaming import party_state as ps
from duesight.streaming import receipt_trigger as rt

SNAP = fx.SNAPSHOT


@dataclass(frozen=True)
class Context:
    spark: SparkSession
    sf_dir: str

    @cached_property
    def raw(self) -> pf.RawTables:
        return fx.raw_tables(self.spark, self.sf_dir)

    @cached_property
    def store(self) -> st.Store:
        return st.store(self.spark, self.sf_dir)

    @cached_property
    def core(self) -> DataFrame:
        return lg.invoice_core(self.raw.invoice, self.raw.receipt, SNAP)

    @cached_property
    def pay(self) -> DataFrame:
        return rc.base_payments(self.raw.receipt, SNAP)

    @cached_property
    def base(self) -> DataFrame:
        return cu.base_invoices(self.core, self.raw.customer)

    @cached_property
    def facts(self) -> DataFrame:
        return rc.payment_facts(self.core, self.pay, SNAP, "AS_OF_DATE", "pre_due")

    @cached_property
    def history(self) -> DataFrame:
        rows = lg.ledger(self.raw.invoice, self.raw.receipt, SNAP)
        facts = lg.with_payment_facts(rows, SNAP, "AS_OF_DATE", "pre_due")
        return hi.party_history(facts, SNAP, skew=pf.party_skew(self.raw))

    @cached_property
    def surviving(self) -> DataFrame:
        return iv.drop_unpaid_nonpositive(iv.clean_invoices(self.raw.invoice), self.raw.receipt)

    @cached_property
    def excluded(self) -> DataFrame:
        return sf.excluded_keys(fx.excluded_names(self.spark, self.sf_dir))

    @cached_property
    def runs(self) -> DataFrame:
        return fx.runs(self.spark, self.sf_dir)

    def path(self, name: str) -> str:
        return scratch_path(self.spark, name)


@dataclass(frozen=True)
class Query:
    spark: Callable[[Context], DataFrame]
    columns: str
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def add(name: str, columns: str, run: Callable[[Context], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = Query(run, columns, sql)


def _kinds(columns: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in columns.split()]


def _cast(name: str, kind: str) -> Column:
    col = F.col(name)
    made = {
        "i": lambda: col.cast("bigint"),
        "f": lambda: F.round(col.cast("double"), 4) + F.lit(0.0),
        "d": lambda: F.date_format(col, "yyyy-MM-dd"),
        "t": lambda: F.date_format(col, "yyyy-MM-dd HH:mm:ss"),
        "s": lambda: col.cast("string"),
    }[kind]()
    return made.alias(name)


def _cast_sql(name: str, kind: str) -> str:
    made = {
        "i": f"CAST({name} AS BIGINT)",
        "f": o.r(name),
        "d": f"strftime({name}, '%Y-%m-%d')",
        "t": f"strftime({name}, '%Y-%m-%d %H:%M:%S')",
        "s": f"CAST({name} AS VARCHAR)",
    }[kind]
    return f"{made} AS {name}"


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    query = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = query.spark(Context(prepare(spark), sf_dir))
        return frame.select(*[_cast(n, k) for n, k in _kinds(query.columns)])

    return run


def oracle(name: str) -> str | None:
    query = QUERIES[name]
    if query.sql is None:
        return None
    cells = ", ".join(_cast_sql(n, k) for n, k in _kinds(query.columns))
    return o.sql(f"SELECT {cells} FROM ({query.sql}) AS q")


ID = "CUSTOMER_TRX_ID:i"
INVOICE_COLS = (
    "CUSTOMER_TRX_ID:i TRX_NUMBER:s PARTY_ID:i TRX_DATE:d DUE_DATE:d TRX_AMOUNT:f TRANS_TYPE:s CURRENCY_CODE:s "
    "ORG_ID:i PREVIOUS_CUSTOMER_TRX_ID:i"
)
RECEIPT_COLS = "APPLIED_CUSTOMER_TRX_ID:i APPLY_DATE:d RECEIPT_DATE:d AMOUNT_APPLIED:f RECEIPT_STATUS:s"
CUSTOMER_COLS = "PARTY_ID:i ACCOUNT_NUMBER:s TRX_NUMBER:s CUSTOMER_NAME:s BU_NAME:s"
SCORE_COLS = (
    "ACCOUNT_NUMBER:s CUSTOMER_NAME:s SBU:s CUSTOMER_TRX_ID:i TRX_DATE:d DUE_DATE:d days_to_due:i TRX_AMOUNT_GROSS:f "
    "credit_memo_reduction:f TRX_AMOUNT:f expected_financial_loss:f prob_bad_debt:f risk_level:s recommended_action:s"
)
RISK_COLS = (
    "PARTY_ID:i ACCOUNT_NUMBER:s CUSTOMER_NAME:s cust_score_max:f cust_score_mean:f cust_score_wavg_amount:f "
    "invoice_cnt:i total_amount:f total_amt_paid_pre_due:f paid_ratio_pre_due_total:f paid_ratio_pre_due_mean:f "
    "pct_invoices_gap_gt_90_pre_due:f party_prior_invoice_cnt:i party_prior_gap90_cnt:i party_prior_gap90_rate:f risk_cust:s"
)
PUBLISHED_COLS = SCORE_COLS + " job_id:s published_at:t start_date:d end_date:d model_key:s snapshot_date:d time_range:s"
HISTORY_COLS = (
    "party_missing:i party_prior_invoice_cnt:i party_is_new_customer:i party_prior_bd90_cnt:i "
    "party_prior_late_firstpay90_cnt:i party_prior_gap90_cnt:i customer_maturity_days:i business_scale_proxy:f "
    "historical_avg_dpd:f historical_late_payment_ratio:f unpaid_exposure_ratio:f payment_consistency_variance:f "
    "historical_partial_payment_freq:f hist_avg_payment_completion_ratio:f total_outstanding_at_trx:f "
    "prob_paid_within_30d:f prob_paid_within_60d:f median_payment_delay:f hazard_approx:f TRX_AMOUNT_log1p:f"
)
PRE_DUE_COLS = (
    "n_pay_pre_due:i amt_paid_pre_due:f first_pay_pre_due:d last_pay_pre_due:d max_gap_pre_due:i "
    "count_gaps_gt_90_pre_due:i paid_ratio_pre_due:f days_trx_to_first_pay_pre_due:i days_before_due_last_pay:i "
    "days_to_due:i trx_month:i trx_weekday:i"
)
MON_COLS = (
    "n_pay_mon:i amt_paid_mon:f first_pay_mon:d last_pay_mon:d max_gap_mon:i count_gaps_gt_90_mon:i paid_ratio_mon:f "
    "days_trx_to_first_pay_mon:i days_since_last_pay_mon:i no_payment_by_90_mon:i first_pay_gt_90_mon:i days_to_due:i "
    "trx_month:i trx_weekday:i"
)
BASE_COLS = (
    "CUSTOMER_TRX_ID:i TRX_DATE:d DUE_DATE:d TRX_AMOUNT:f PARTY_ID:i ACCOUNT_NUMBER:s CUSTOMER_NAME:s SBU:s "
    "cust_master_missing:i TRANS_TYPE:s CURRENCY_CODE:s ORG_ID:i TRX_AMOUNT_GROSS:f credit_memo_reduction:f cm_count:i "
    "cm_first_date:d AS_OF_DATE:d"
)

# ---- sources -------------------------------------------------------------
TEXT_ID = """CASE WHEN CUSTOMER_TRX_ID % 89 = 0 THEN 'abc' WHEN CUSTOMER_TRX_ID % 83 = 0 THEN CUSTOMER_TRX_ID || '.0'
 ELSE CAST(CUSTOMER_TRX_ID AS VARCHAR) END"""
TEXT_DATE = """CASE WHEN CUSTOMER_TRX_ID % 97 = 0 THEN 'junk'
 WHEN CUSTOMER_TRX_ID % 97 = 1 THEN ltrim(strftime(TRX_DATE, '%d-%b-%Y'), '0') ELSE strftime(TRX_DATE, '%d-%b-%Y') END"""
o.step("text_invoice", f"SELECT * EXCLUDE (CUSTOMER_TRX_ID, TRX_DATE), {TEXT_ID} AS CUSTOMER_TRX_ID, {TEXT_DATE} AS TRX_DATE FROM ar_invoice")
o.step("typed_invoice", """
SELECT * EXCLUDE (CUSTOMER_TRX_ID, TRX_DATE), CAST(try_cast(CUSTOMER_TRX_ID AS DOUBLE) AS BIGINT) AS CUSTOMER_TRX_ID,
       try_strptime(TRX_DATE, '%d-%b-%Y') AS TRX_DATE FROM text_invoice""")


def _write_csv(ctx: Context, frame: DataFrame, name: str) -> str:
    path = ctx.path(name)
    frame.write.option("header", True).option("escape", '"').csv(path)
    return path


def _scan_invoice_csv(ctx: Context) -> DataFrame:
    path = _write_csv(ctx, fx.text_invoices(ctx.spark, ctx.sf_dir), "invoice-csv")
    return iv.clean_invoices(sf.read_invoices(ctx.spark, path))


def _scan_receipt_csv(ctx: Context) -> DataFrame:
    path = _write_csv(ctx, fx.text_receipts(ctx.spark, ctx.sf_dir), "receipt-csv")
    df = sf.read_receipts(ctx.spark, path)
    return df.select(
        cl.to_id(df, "APPLIED_CUSTOMER_TRX_ID").alias("APPLIED_CUSTOMER_TRX_ID"),
        cl.to_timestamp(df, "APPLY_DATE").alias("APPLY_DATE"),
        cl.to_timestamp(df, "RECEIPT_DATE").alias("RECEIPT_DATE"),
        cl.to_number(df, "AMOUNT_APPLIED").alias("AMOUNT_APPLIED"),
        "RECEIPT_STATUS",
    )


def _array_lines(frames):
    """The lines of a partition as one JSON array, piece by piece."""
    lead = "["
    for frame in frames:
        if len(frame):
            text = frame["value"].copy()
            text.iloc[0] = lead + text.iloc[0]
            text.iloc[1:] = "," + text.iloc[1:]
            lead = ","
            yield text.to_frame()
    yield pd.DataFrame({"value": ["[]" if lead == "[" else "]"]})


def _scan_customer(kind: str) -> Callable[[Context], DataFrame]:
    def run(ctx: Context) -> DataFrame:
        path = f"{ctx.path('customer')}.{kind}"
        rows = ctx.raw.customer
        if kind == "csv":
            rows.write.option("header", True).option("escape", '"').csv(path)
        elif kind == "parquet":
            rows.write.parquet(path)
        elif kind == "jsonl":
            rows.write.json(path)
        else:
            lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
            lines.mapInPandas(_array_lines, "value string").write.text(path)
        return cu.clean_customers(sf.read_customers(ctx.spark, path))

    return run


add("scan_invoice_csv", INVOICE_COLS, _scan_invoice_csv, "SELECT * FROM typed_invoice")
add("scan_receipt_csv", RECEIPT_COLS, _scan_receipt_csv, "SELECT * FROM ar_receipt")
for _kind in ("csv", "parquet", "jsonl", "json"):
    add(f"scan_customer_{_kind}", CUSTOMER_COLS, _scan_customer(_kind), "SELECT * FROM ar_customer")
add("scan_customers", CUSTOMER_COLS, lambda c: tb.customer_columns(c.raw.customer), "SELECT * FROM ar_customer")
add(
    "scan_invoices_window", INVOICE_COLS,
    lambda c: tb.invoices_in_range(c.raw.invoice, "6m", SNAP),
    "SELECT * FROM ar_invoice WHERE TRX_DATE BETWEEN {SNAP} - 180 AND {SNAP}",
)
add(
    "scan_receipts_window", RECEIPT_COLS,
    lambda c: tb.receipts_in_range(c.raw.receipt, "6m", SNAP),
    "SELECT * FROM ar_receipt WHERE APPLY_DATE BETWEEN {SNAP} - 180 AND {SNAP} OR RECEIPT_DATE BETWEEN {SNAP} - 180 AND {SNAP}",
)
add(
    "scan_year_fallback", INVOICE_COLS,
    lambda c: tb.invoices_in_range(c.raw.invoice, "year", year=1999),
    "SELECT * FROM ar_invoice WHERE year(TRX_DATE) = 1999",
)
add(
    "scan_receipts_year", RECEIPT_COLS,
    lambda c: tb.receipts_in_range(c.raw.receipt, "year", year=1999),
    "SELECT * FROM ar_receipt WHERE year(APPLY_DATE) = 1999 OR year(RECEIPT_DATE) = 1999",
)
add(
    "data_date_range", "min_date:s max_date:s", lambda c: tb.date_range(c.raw.invoice),
    "SELECT strftime(min(TRX_DATE), '%Y-%m-%d') AS min_date, strftime(max(TRX_DATE), '%Y-%m-%d') AS max_date FROM ar_invoice",
)
NAME_KEY = "regexp_replace(upper(trim(coalesce({0}, ''))), '[^A-Z0-9]+', '', 'g')"
o.step("excluded_keys_sql", f"""
SELECT DISTINCT k AS name_key FROM (SELECT {NAME_KEY.format('cell')} AS k FROM (SELECT c0 AS cell FROM ar_excluded UNION ALL SELECT c1 FROM ar_excluded))
WHERE k <> '' AND NOT regexp_matches(k, '^[0-9]{{1,2}}$')""")
add("excluded_keys", "name_key:s", lambda c: c.excluded, "SELECT * FROM excluded_keys_sql")

# ---- cleaning ------------------------------------------------------------


def _parse_dates(ctx: Context) -> DataFrame:
    text = fx.text_invoices(ctx.spark, ctx.sf_dir)
    return text.select("TRX_NUMBER", F.col("TRX_DATE").alias("raw"), cl.parse_timestamp(F.col("TRX_DATE")).alias("parsed"))


def _coerce_numeric(ctx: Context) -> DataFrame:
    text = fx.text_invoices(ctx.spark, ctx.sf_dir)
    return text.select(
        "TRX_NUMBER",
        cl.to_id(text, "CUSTOMER_TRX_ID").alias("id"),
        cl.to_number(text, "CUSTOMER_TRX_ID").alias("number"),
        cl.to_number(text, "TRX_AMOUNT").alias("amount"),
    )


add("parse_dates", "TRX_NUMBER:s raw:s parsed:d", _parse_dates,
    "SELECT TRX_NUMBER, TRX_DATE AS raw, try_strptime(TRX_DATE, '%d-%b-%Y') AS parsed FROM text_invoice")
add("coerce_numeric", "TRX_NUMBER:s id:i number:f amount:f", _coerce_numeric, """
SELECT TRX_NUMBER, CAST(try_cast(CUSTOMER_TRX_ID AS DOUBLE) AS BIGINT) AS id, try_cast(CUSTOMER_TRX_ID AS DOUBLE) AS number,
       TRX_AMOUNT AS amount FROM text_invoice""")
add(
    "fix_year_month", "APPLIED_CUSTOMER_TRX_ID:i AMOUNT_APPLIED:f APPLY_DATE:d RECEIPT_DATE:d",
    lambda c: cl.repair_dates(c.raw.receipt, ["APPLY_DATE", "RECEIPT_DATE"], SNAP),
    "SELECT APPLIED_CUSTOMER_TRX_ID, AMOUNT_APPLIED, fixed_apply AS APPLY_DATE, fixed_receipt AS RECEIPT_DATE FROM rc_fixed",
)
add(
    "payment_date_coalesce", "APPLIED_CUSTOMER_TRX_ID:i AMOUNT_APPLIED:f PAYMENT_DATE:d",
    lambda c: c.raw.receipt.withColumn("PAYMENT_DATE", F.coalesce("APPLY_DATE", "RECEIPT_DATE")),
    "SELECT *, coalesce(APPLY_DATE, RECEIPT_DATE) AS PAYMENT_DATE FROM ar_receipt",
)
add(
    "normalize_name", "CUSTOMER_NAME:s TRX_NUMBER:s name_key:s account_key:s",
    lambda c: c.raw.customer.select(
        "CUSTOMER_NAME", "TRX_NUMBER", cl.normalise_name(F.col("CUSTOMER_NAME")).alias("name_key"),
        cl.normalise_name(F.regexp_replace("ACCOUNT_NUMBER", "ACC", "")).alias("account_key"),
    ),
    f"""SELECT CUSTOMER_NAME, TRX_NUMBER, {NAME_KEY.format('CUSTOMER_NAME')} AS name_key,
 CASE WHEN regexp_matches({NAME_KEY.format("replace(ACCOUNT_NUMBER, 'ACC', '')")}, '^[0-9]{{1,2}}$') THEN ''
      ELSE {NAME_KEY.format("replace(ACCOUNT_NUMBER, 'ACC', '')")} END AS account_key FROM ar_customer""",
)
add("classify_risk", "CUSTOMER_TRX_ID:i p:f level:s",
    lambda c: c.raw.invoice.select("CUSTOMER_TRX_ID", _toy_p().alias("p"), rk.risk_level(_toy_p()).alias("level")),
    f"SELECT CUSTOMER_TRX_ID, p, {o.level_sql('p')} AS level FROM (SELECT *, CASE WHEN PARTY_ID IS NOT NULL THEN (CUSTOMER_TRX_ID % 21) / 20.0 END AS p FROM ar_invoice)")
add("recommend_action", "CUSTOMER_TRX_ID:i level:s action:s",
    lambda c: c.raw.invoice.select("CUSTOMER_TRX_ID", _toy_level().alias("level"), rk.action(_toy_level()).alias("action")),
    f"SELECT CUSTOMER_TRX_ID, level, {o.action_sql('level')} AS action FROM (SELECT *, ['HIGH', 'MEDIUM', 'LOW', 'other'][CUSTOMER_TRX_ID % 4 + 1] AS level FROM ar_invoice)")
add("expected_loss", "CUSTOMER_TRX_ID:i loss:f",
    lambda c: c.raw.invoice.select("CUSTOMER_TRX_ID", rk.expected_loss(F.col("TRX_AMOUNT"), _toy_p()).alias("loss")),
    "SELECT CUSTOMER_TRX_ID, abs(coalesce(TRX_AMOUNT, 0)) * CASE WHEN PARTY_ID IS NOT NULL THEN (CUSTOMER_TRX_ID % 21) / 20.0 END AS loss FROM ar_invoice")
add("log1p_features", "CUSTOMER_TRX_ID:i logged:f",
    lambda c: c.raw.invoice.select("CUSTOMER_TRX_ID", cl.log1p_floor0(F.col("TRX_AMOUNT")).alias("logged")),
    "SELECT CUSTOMER_TRX_ID, ln(1 + greatest(coalesce(TRX_AMOUNT, 0.0), 0.0)) AS logged FROM ar_invoice")
add("day_diffs", "CUSTOMER_TRX_ID:i whole:i floored:i",
    lambda c: c.raw.invoice.select(
        "CUSTOMER_TRX_ID", cl.days_between(F.col("DUE_DATE"), F.col("TRX_DATE")).alias("whole"),
        cl.days_between(F.col("TRX_DATE") - F.make_dt_interval(hours=F.lit(6)), F.col("DUE_DATE")).alias("floored"),
    ),
    """SELECT CUSTOMER_TRX_ID, date_diff('day', TRX_DATE, DUE_DATE) AS whole,
 floor((epoch_us(TRX_DATE - INTERVAL 6 HOUR) - epoch_us(DUE_DATE)) / 86400000000.0) AS floored FROM ar_invoice""")
add("calendar_parts", "CUSTOMER_TRX_ID:i trx_month:i trx_weekday:i",
    lambda c: c.raw.invoice.select("CUSTOMER_TRX_ID", *ft.due_calendar()),
    "SELECT CUSTOMER_TRX_ID, month(TRX_DATE) AS trx_month, isodow(TRX_DATE) - 1 AS trx_weekday FROM ar_invoice")
add("safe_ratios", "CUSTOMER_TRX_ID:i percent:f signed:f bounded:f",
    lambda c: c.raw.invoice.select(
        "CUSTOMER_TRX_ID",
        ft.paid_percent(F.lit(50000.0), F.col("TRX_AMOUNT")).alias("percent"),
        ft.paid_fraction_signed(F.lit(50000.0), F.col("TRX_AMOUNT")).alias("signed"),
        ft.paid_fraction(F.lit(50000.0), F.col("TRX_AMOUNT")).alias("bounded"),
    ),
    """SELECT CUSTOMER_TRX_ID,
 CASE WHEN abs(TRX_AMOUNT) > 0 THEN least(5000000.0 / abs(TRX_AMOUNT), 100) ELSE 0 END AS percent,
 CASE WHEN TRX_AMOUNT <> 0 THEN 50000.0 / TRX_AMOUNT ELSE 0 END AS signed,
 CASE WHEN TRX_AMOUNT > 0 THEN least(50000.0 / TRX_AMOUNT, 1) ELSE 0 END AS bounded FROM ar_invoice""")
add("as_of_date", "CUSTOMER_TRX_ID:i AS_OF_DATE:d",
    lambda c: c.raw.invoice.select("CUSTOMER_TRX_ID", cl.as_of(F.col("DUE_DATE"), SNAP).alias("AS_OF_DATE")),
    "SELECT CUSTOMER_TRX_ID, CASE WHEN DUE_DATE > {SNAP} THEN CAST({SNAP} AS TIMESTAMP) ELSE DUE_DATE END AS AS_OF_DATE FROM ar_invoice")


def _toy_p() -> Column:
    return F.when(F.col("PARTY_ID").isNotNull(), F.col("CUSTOMER_TRX_ID") % 21 / 20.0)


def _toy_level() -> Column:
    names = F.array(*[F.lit(x) for x in ("HIGH", "MEDIUM", "LOW", "other")])
    return F.element_at(names, (F.col("CUSTOMER_TRX_ID") % 4 + 1).cast("int"))


def _cold_start(ctx: Context) -> DataFrame:
    lacking = [F.when(F.col("CUSTOMER_TRX_ID") % 3 == 0, F.lit(7)).cast("double").alias(n) for n in COLD_START]
    return ctx.raw.invoice.select("CUSTOMER_TRX_ID", *lacking).fillna(COLD_START)


add("cold_start_fill", "CUSTOMER_TRX_ID:i " + " ".join(f"{n}:f" for n in COLD_START), _cold_start,
    "SELECT CUSTOMER_TRX_ID, " + ", ".join(f"CASE WHEN CUSTOMER_TRX_ID % 3 = 0 THEN 7 ELSE {v} END AS {n}" for n, v in COLD_START.items()) + " FROM ar_invoice")
OUTCOME_COLS = "actual_dpd:i is_paid:i is_late:i is_partial:i paid_ratio:f paid_within_30d:i paid_within_60d:i bad_debt_flag:i"
add("payment_flags", f"{ID} {OUTCOME_COLS}", lambda c: hi.invoice_history(c.facts), "SELECT * FROM outcome")
add(
    "dq_counts", "bad_ids:i bad_dates:i bad_repairs:i null_amounts:i", lambda c: _dq(c),
    """SELECT (SELECT count(*) FROM text_invoice WHERE CUSTOMER_TRX_ID = 'abc') AS bad_ids,
 (SELECT count(*) FROM text_invoice WHERE TRX_DATE = 'junk') AS bad_dates,
 (SELECT count(*) FROM rc_fixed WHERE APPLY_DATE IS NOT NULL AND fixed_apply IS NULL) AS bad_repairs,
 (SELECT count(*) FROM text_invoice WHERE TRX_AMOUNT IS NULL) AS null_amounts""",
)


def _dq(ctx: Context) -> DataFrame:
    """The counters that a pass over the delivered texts gathers on its way."""
    seen = Quality()
    rows = lg.ledger(fx.text_invoices(ctx.spark, ctx.sf_dir), ctx.raw.receipt, SNAP, quality=seen)
    rows.write.format("noop").mode("overwrite").save()
    found = seen.counts()
    return ctx.spark.range(1).select(*[F.lit(n).alias(c) for c, n in found.items()])


# ---- filters -------------------------------------------------------------
add("filter_invoice_range_all", INVOICE_COLS, lambda c: tb.invoices_in_range(c.raw.invoice, "all", SNAP),
    "SELECT * FROM ar_invoice WHERE TRX_DATE <= {SNAP}")
add("filter_invoice_range_custom", INVOICE_COLS,
    lambda c: tb.invoices_in_range(c.raw.invoice, "custom", SNAP, "1999-03-01", "2001-02-15"),
    "SELECT * FROM ar_invoice WHERE TRX_DATE BETWEEN DATE '1999-03-01' AND DATE '2001-02-15'")
add("filter_invoice_range_3m", INVOICE_COLS, lambda c: tb.invoices_in_range(c.raw.invoice, "3m", SNAP),
    "SELECT * FROM ar_invoice WHERE TRX_DATE BETWEEN {SNAP} - 90 AND {SNAP}")
add("filter_invoice_range_latest", INVOICE_COLS, lambda c: tb.invoices_in_range(c.raw.invoice, "1m"),
    "SELECT * FROM ar_invoice WHERE TRX_DATE >= (SELECT max(TRX_DATE) FROM ar_invoice) - to_days(30)")
add("filter_receipt_range", RECEIPT_COLS,
    lambda c: tb.receipts_in_range(c.raw.receipt, "custom", SNAP, "1999-03-01", "1999-09-15"),
    "SELECT * FROM ar_receipt WHERE APPLY_DATE BETWEEN DATE '1999-03-01' AND DATE '1999-09-15' OR RECEIPT_DATE BETWEEN DATE '1999-03-01' AND DATE '1999-09-15'")
add("filter_receipt_range_all", RECEIPT_COLS, lambda c: tb.receipts_in_range(c.raw.receipt, "all", SNAP),
    "SELECT * FROM ar_receipt WHERE APPLY_DATE <= {SNAP} OR RECEIPT_DATE <= {SNAP}")
add("drop_unpaid_nonpositive", INVOICE_COLS, lambda c: c.surviving, "SELECT * FROM surviving")
add("receipt_status_filter", RECEIPT_COLS,
    lambda c: c.raw.receipt.where(rc.status_counts(F.col("RECEIPT_STATUS"))),
    "SELECT * FROM ar_receipt WHERE RECEIPT_STATUS IS NULL OR RECEIPT_STATUS = 'APP'")


def _payments_in_window(ctx: Context) -> DataFrame:
    rows = ctx.pay.join(ctx.core.select("CUSTOMER_TRX_ID", "TRX_DATE", "AS_OF_DATE"),
                        (F.col("INVOICE_ID") == F.col("CUSTOMER_TRX_ID"))
                        & F.col("PAYMENT_DATE").between(F.col("TRX_DATE"), F.col("AS_OF_DATE")))
    return rows


add("payments_in_window", "CUSTOMER_TRX_ID:i PAYMENT_DATE:d AMOUNT_APPLIED:f", _payments_in_window,
    "SELECT id AS CUSTOMER_TRX_ID, pd AS PAYMENT_DATE, pa AS AMOUNT_APPLIED FROM win_pre_due")

# ---- netting, customers, base --------------------------------------------
add("credit_memo_totals", "original_id:i cm_amount:f cm_count:i cm_first_date:d",
    lambda c: iv.credit_memo_totals(c.surviving, SNAP).withColumnRenamed("_original_id", "original_id"), """
SELECT PREVIOUS_CUSTOMER_TRX_ID AS original_id, coalesce(sum(CASE WHEN TRX_DATE <= {SNAP} THEN coalesce(TRX_AMOUNT, 0) END), 0) AS cm_amount,
       count(*) FILTER (WHERE TRX_DATE <= {SNAP}) AS cm_count, min(TRX_DATE) FILTER (WHERE TRX_DATE <= {SNAP}) AS cm_first_date
FROM surviving WHERE PREVIOUS_CUSTOMER_TRX_ID IS NOT NULL GROUP BY 1""")
NET_COLS = f"{ID} TRX_AMOUNT:f TRX_AMOUNT_GROSS:f credit_memo_reduction:f cm_count:i cm_first_date:d"
add("credit_memo_netting", NET_COLS, lambda c: iv.net_credit_memos(c.surviving, c.surviving, SNAP), "SELECT * FROM netted")
add("dedupe_invoices", f"{ID} TRX_NUMBER:s TRX_DATE:d TRX_AMOUNT:f", lambda c: iv.one_per_id(_with_copies(c)), """
SELECT * FROM (SELECT * FROM ar_invoice UNION ALL SELECT * REPLACE (TRX_DATE - to_days(5) AS TRX_DATE, TRX_AMOUNT + 1 AS TRX_AMOUNT) FROM ar_invoice WHERE ORG_ID = 2)
QUALIFY row_number() OVER (PARTITION BY CUSTOMER_TRX_ID ORDER BY TRX_DATE NULLS LAST) = 1""")


def _with_copies(ctx: Context) -> DataFrame:
    inv = ctx.raw.invoice
    copies = inv.where("ORG_ID = 2").withColumns(
        {"TRX_DATE": F.col("TRX_DATE") - F.make_dt_interval(days=F.lit(5)), "TRX_AMOUNT": F.col("TRX_AMOUNT") + 1}
    )
    return inv.unionByName(copies)


add("dedupe_customers", "PARTY_ID:i ACCOUNT_NUMBER:s CUSTOMER_NAME:s BU_NAME:s",
    lambda c: cu.customer_per_party(c.raw.customer), "SELECT * FROM cust_party")
add("dedupe_customer_numbers", "TRX_NUMBER:s PARTY_ID:i ACCOUNT_NUMBER:s",
    lambda c: cu.customer_per_number(c.raw.customer), "SELECT * FROM cust_number")
add("customer_enrich_party", f"{ID} PARTY_ID:i CUSTOMER_NAME:s SBU:s", lambda c: c.base, "SELECT * FROM base")
add("customer_enrich_trx", f"{ID} ACCOUNT_NUMBER:s", lambda c: c.base, "SELECT * FROM base")
add("master_missing_flag", f"{ID} cust_master_missing:i", lambda c: c.base, "SELECT * FROM base")
add("base_invoices", BASE_COLS, lambda c: pf.base_tables(c.raw, SNAP)[0], "SELECT * FROM base")
add("base_payments", "INVOICE_ID:i PAYMENT_DATE:d AMOUNT_APPLIED:f", lambda c: pf.base_tables(c.raw, SNAP)[1], "SELECT * FROM pay")

# ---- payments ------------------------------------------------------------
add("pre_due_agg", f"{ID} n_pay_pre_due:i amt_paid_pre_due:f first_pay_pre_due:d last_pay_pre_due:d",
    lambda c: c.facts, "SELECT * FROM feat")
add("pre_due_gaps", f"{ID} max_gap_pre_due:i count_gaps_gt_90_pre_due:i", lambda c: c.facts, "SELECT * FROM feat")
add("receipt_agg", f"{ID} receipt_count:i first_pay_date:d last_pay_date:d total_paid:f gap_variance:f is_partial:i",
    lambda c: rc.receipt_totals(c.pay), "SELECT * FROM receipt_agg")
add("payment_gaps", "INVOICE_ID:i PAYMENT_DATE:d gap_days:i", lambda c: rc.payment_days(c.pay), """
SELECT INVOICE_ID, PAYMENT_DATE, date_diff('day', lag(PAYMENT_DATE) OVER (PARTITION BY INVOICE_ID ORDER BY PAYMENT_DATE), PAYMENT_DATE) AS gap_days
FROM (SELECT DISTINCT INVOICE_ID, PAYMENT_DATE FROM pay WHERE PAYMENT_DATE IS NOT NULL)""")
add("first_payment", f"{ID} first_pay_known:d",
    lambda c: c.facts.where("first_pay_known IS NOT NULL"),
    "SELECT i.CUSTOMER_TRX_ID, f.first_pay_date AS first_pay_known FROM core i JOIN first_known f ON f.id = i.CUSTOMER_TRX_ID")
add("first_gap90", f"{ID} first_gap90_known:d",
    lambda c: c.facts.where("first_gap90_known IS NOT NULL"),
    "SELECT i.CUSTOMER_TRX_ID, g.gap90_date AS first_gap90_known FROM core i JOIN gap90_known g ON g.id = i.CUSTOMER_TRX_ID")
add("bd90_paid", f"{ID} paid_by_bd90:f",
    lambda c: c.facts.where("PARTY_ID IS NOT NULL").where(F.col("DUE_DATE") <= F.lit(SNAP).cast("timestamp") - F.make_dt_interval(days=F.lit(90))),
    "SELECT CUSTOMER_TRX_ID, paid_by AS paid_by_bd90 FROM bd90")
add("bd90_events", f"{ID} bd90_event_date:d", lambda c: _events(c, "bd90_event_date"),
    "SELECT CUSTOMER_TRX_ID, event_date AS bd90_event_date FROM bd90 WHERE flag = 1")
add("late_firstpay90_events", f"{ID} late_firstpay90_event_date:d", lambda c: _events(c, "late_firstpay90_event_date"),
    "SELECT CUSTOMER_TRX_ID, event_date AS late_firstpay90_event_date FROM late90")
add("gap90_events", f"{ID} gap90_event_date:d", lambda c: _events(c, "gap90_event_date"),
    "SELECT CUSTOMER_TRX_ID, event_date AS gap90_event_date FROM gap90")


def _events(ctx: Context, name: str) -> DataFrame:
    return ctx.facts.select("CUSTOMER_TRX_ID", hi.event_columns(SNAP)[name].alias(name)).where(F.col(name).isNotNull())


add("invoice_payment_facts", f"{ID} receipt_count:i last_pay_date:d total_paid:f first_pay_known:d first_gap90_known:d",
    lambda c: c.facts, """
SELECT i.CUSTOMER_TRX_ID, r.receipt_count, r.last_pay_date, r.total_paid, f.first_pay_date AS first_pay_known, g.gap90_date AS first_gap90_known
FROM core i LEFT JOIN receipt_agg r ON r.CUSTOMER_TRX_ID = i.CUSTOMER_TRX_ID
LEFT JOIN first_known f ON f.id = i.CUSTOMER_TRX_ID LEFT JOIN gap90_known g ON g.id = i.CUSTOMER_TRX_ID""")
add("invoice_history", f"{ID} PARTY_ID:i TRX_AMOUNT:f receipt_count:i total_paid:f gap_variance:f {OUTCOME_COLS}",
    lambda c: hi.invoice_history(c.facts), "SELECT * FROM outcome")
add("pre_due_features", f"{BASE_COLS} {PRE_DUE_COLS}", lambda c: ft.pre_due_features(c.base, c.pay, SNAP), "SELECT * FROM feat")
add("asof_features", f"{ID} TRX_DATE:d DUE_DATE:d TRX_AMOUNT:f AS_OF_DATE_MON:d {MON_COLS}",
    lambda c: ft.asof_features(_aged(c), c.pay, SNAP, "AS_OF_DATE_MON", "mon"), "SELECT * FROM feat_aged")


def _aged(ctx: Context) -> DataFrame:
    aged = cl.plus_days(F.col("TRX_DATE"), 180)
    snap = cl.midnight(SNAP)
    return ctx.core.drop("AS_OF_DATE").withColumn("AS_OF_DATE_MON", F.when(aged > snap, snap).otherwise(aged))


# ---- party history -------------------------------------------------------
for _key, _cols in {
    "prior_invoice_cnt": "party_missing:i party_prior_invoice_cnt:i party_is_new_customer:i",
    "maturity_days": "customer_maturity_days:i",
    "business_scale": "business_scale_proxy:f",
    "hist_avg_dpd": "historical_avg_dpd:f",
    "hist_late_ratio": "historical_late_payment_ratio:f",
    "hist_partial_freq": "historical_partial_payment_freq:f",
    "unpaid_exposure": "unpaid_exposure_ratio:f",
    "hist_consistency": "payment_consistency_variance:f",
    "hist_completion": "hist_avg_payment_completion_ratio:f",
    "total_outstanding": "total_outstanding_at_trx:f",
    "survival_probs": "prob_paid_within_30d:f prob_paid_within_60d:f hazard_approx:f",
    "median_delay": "median_payment_delay:f",
    "party_prior_bd90": "party_prior_bd90_cnt:i",
    "party_prior_late_firstpay90": "party_prior_late_firstpay90_cnt:i",
    "party_prior_gap90": "party_prior_gap90_cnt:i",
    "history_features": HISTORY_COLS,
}.items():
    add(_key, f"{ID} {_cols}", lambda c: c.history, "SELECT * FROM history")
POOLED_COLS = (
    "customer_maturity_days:i business_scale_proxy:f historical_avg_dpd:f historical_late_payment_ratio:f "
    "unpaid_exposure_ratio:f payment_consistency_variance:f historical_partial_payment_freq:f "
    "hist_avg_payment_completion_ratio:f total_outstanding_at_trx:f"
)
POOLED_SQL = {
    "customer_maturity_days": "maturity", "business_scale_proxy": "scale", "historical_avg_dpd": "avg_dpd",
    "historical_late_payment_ratio": "late_ratio", "unpaid_exposure_ratio": "exposure",
    "payment_consistency_variance": "consistency", "historical_partial_payment_freq": "partial_freq",
    "hist_avg_payment_completion_ratio": "completion", "total_outstanding_at_trx": "outstanding",
}
o.step("pooled_named", "SELECT CUSTOMER_TRX_ID, " + ", ".join(f"{v} AS {k}" for k, v in POOLED_SQL.items()) + " FROM pooled")
add("pooled_history_features", f"{ID} {POOLED_COLS}",
    lambda c: hi.pooled_history(hi.invoice_history(c.facts), pf.pooled_skew(c.raw)), "SELECT * FROM pooled_named")
add("snapshot_features", f"{BASE_COLS} {PRE_DUE_COLS} {HISTORY_COLS}", lambda c: pf.snapshot_features(c.raw, SNAP),
    "SELECT * FROM snapshot_feat")
MON_OUT = f"{ID} PARTY_ID:i ACCOUNT_NUMBER:s CUSTOMER_NAME:s cust_master_missing:i TRX_AMOUNT_GROSS:f {MON_COLS} {HISTORY_COLS} mon_observable:i"
for _key, _flag, _feat in (("monitoring_features", True, "feat_mon"), ("monitoring_features_aged", False, "feat_aged")):
    add(_key, MON_OUT, lambda c, flag=_flag: pf.monitoring_features(c.raw, SNAP, asof_to_snapshot=flag),
        f"SELECT f.*, h.* EXCLUDE (CUSTOMER_TRX_ID) FROM {_feat} f JOIN history h ON h.CUSTOMER_TRX_ID = f.CUSTOMER_TRX_ID")
add("new_featured_snapshot", f"{ID} {PRE_DUE_COLS} {HISTORY_COLS} " + " ".join(f"pooled_{x}" for x in POOLED_COLS.split()),
    lambda c: pf.pooled_snapshot_features(c.raw, SNAP),
    "SELECT f.*, " + ", ".join(f"p.{k} AS pooled_{k}" for k in POOLED_SQL)
    + " FROM snapshot_feat f JOIN pooled_named p ON p.CUSTOMER_TRX_ID = f.CUSTOMER_TRX_ID")

# ---- run inputs ----------------------------------------------------------
o.step("targets_6m", "SELECT * FROM ar_invoice WHERE TRX_DATE BETWEEN {SNAP} - 180 AND {SNAP}")
o.step("number_party", "SELECT TRX_NUMBER, max(PARTY_ID) AS p FROM ar_customer GROUP BY 1")
o.step("filled_6m", "SELECT t.* REPLACE (coalesce(t.PARTY_ID, m.p) AS PARTY_ID) FROM targets_6m t LEFT JOIN number_party m ON m.TRX_NUMBER = t.TRX_NUMBER")
o.step("history_6m", "SELECT * FROM ar_invoice WHERE TRX_DATE <= {SNAP} AND PARTY_ID IN (SELECT PARTY_ID FROM filled_6m WHERE PARTY_ID IS NOT NULL)")
o.step("inputs_6m", "SELECT * FROM targets_6m UNION SELECT * FROM history_6m")
o.step("receipts_6m", """
SELECT DISTINCT * FROM ar_receipt WHERE APPLIED_CUSTOMER_TRX_ID IN (SELECT CUSTOMER_TRX_ID FROM inputs_6m)
AND (APPLY_DATE <= {SNAP} OR RECEIPT_DATE <= {SNAP})""")


def _targets(ctx: Context) -> DataFrame:
    return tb.invoices_in_range(ctx.raw.invoice, "6m", SNAP)


def _history(ctx: Context) -> DataFrame:
    return tg.history_of_parties(ctx.raw.invoice, tg.target_parties(_targets(ctx), ctx.raw.customer), SNAP)


def _inputs(ctx: Context, span: str = "6m") -> pf.RawTables:
    return tg.run_inputs(ctx.raw, span, SNAP, skew=pf.party_skew(ctx.raw))


add("target_ids", ID, lambda c: tg.target_ids(_targets(c)), "SELECT DISTINCT CUSTOMER_TRX_ID FROM targets_6m")
add("fill_missing_party", f"{ID} PARTY_ID:i", lambda c: tg.fill_missing_party(_targets(c), c.raw.customer), "SELECT * FROM filled_6m")
add("history_for_targets", INVOICE_COLS, _history, "SELECT * FROM history_6m")
add("union_history", INVOICE_COLS, lambda c: tg.union_history(_targets(c), _history(c)), "SELECT * FROM inputs_6m")
add("receipts_for_history", RECEIPT_COLS, lambda c: tg.receipts_of(c.raw.receipt, _history(c), SNAP), """
SELECT DISTINCT * FROM ar_receipt WHERE APPLIED_CUSTOMER_TRX_ID IN (SELECT CUSTOMER_TRX_ID FROM history_6m)
AND (APPLY_DATE <= {SNAP} OR RECEIPT_DATE <= {SNAP})""")
add("two_pass_inputs_invoices", INVOICE_COLS, lambda c: _inputs(c).invoice, "SELECT * FROM inputs_6m")
add("two_pass_inputs_receipts", RECEIPT_COLS, lambda c: _inputs(c).receipt, "SELECT * FROM receipts_6m")
add("single_pass_inputs_receipts", RECEIPT_COLS, lambda c: _inputs(c, "all").receipt,
    "SELECT * FROM ar_receipt WHERE APPLY_DATE <= {SNAP} OR RECEIPT_DATE <= {SNAP}")

# ---- scores --------------------------------------------------------------
add("score_linear", f"{ID} prob_bad_debt:f", lambda c: st.scored_all(c.spark, c.sf_dir), "SELECT * FROM scored")
add("score_invoices", SCORE_COLS, lambda c: sc.score_table(jb.score_snapshot(c.raw, SNAP)), "SELECT * FROM scored")
add("score_invoices_by_key", f"{ID} prob_bad_debt:f", lambda c: jb.score_snapshot(c.raw, SNAP, jb.model_of("lgbm_hyper_smote")),
    f"SELECT CUSTOMER_TRX_ID, {o.sigmoid_sql(o.linear_sql(sc.PAYMENT_SCORECARD))} AS prob_bad_debt FROM snapshot_feat")
STACK_SQL = o.sigmoid_sql(
    f"{sc.STACK[0]} + {sc.STACK[1]} * {o.sigmoid_sql(o.linear_sql(SCORECARD))} + {sc.STACK[2]} * {o.sigmoid_sql(o.linear_sql(sc.PAYMENT_SCORECARD))}"
)
add("score_stacked_linear", f"{ID} prob_bad_debt:f", lambda c: jb.score_snapshot(c.raw, SNAP, sc.stacked_probability()),
    f"SELECT CUSTOMER_TRX_ID, {STACK_SQL} AS prob_bad_debt FROM snapshot_feat")
add("calibrate_platt", f"{ID} calibrated:f",
    lambda c: c.store.scored.withColumn("calibrated", sc.calibrate_platt(F.col("prob_bad_debt"))),
    f"SELECT CUSTOMER_TRX_ID, {o.sigmoid_sql(f'{sc.PLATT[0]} + {sc.PLATT[1]} * prob_bad_debt')} AS calibrated FROM scored")


def _labelled(ctx: Context) -> DataFrame:
    """The features with the label, written out as a training run would."""
    skew = pf.party_skew(ctx.raw)
    rows = pf.snapshot_features(ctx.raw, SNAP, skew, keep_facts=True)
    labelled = rows.withColumn("label", md.bad_debt_label(SNAP))
    return materialise(md.feature_matrix(labelled, "label", "PARTY_ID"), "training")


def _score_gbt(ctx: Context) -> DataFrame:
    train = _labelled(ctx)
    return md.predict(md.fit_boosted(train), train)


def _score_stacked(ctx: Context) -> DataFrame:
    train = _labelled(ctx)
    return md.predict_stack(md.fit_stack(train, by="PARTY_ID"), train)


def _calibrate_isotonic(ctx: Context) -> DataFrame:
    rows = _labelled(ctx)
    scored = rows.withColumn("prob_bad_debt", sc.scorecard_probability())
    return md.apply_isotonic(md.fit_isotonic(scored), scored)


def _own_model(features: pd.DataFrame) -> pd.Series:
    """Stands for a user's model: any function of the feature columns."""
    ratio = features["historical_late_payment_ratio"].fillna(0) / 100
    return (0.21713 + 0.48377 * ratio + 0.29091 * features["hazard_approx"].fillna(0)).clip(0, 1)


add("score_gbt", f"{ID} prob_bad_debt:f", _score_gbt)
add("score_stacked", f"{ID} prob_bad_debt:f", _score_stacked)
add("calibrate_isotonic", f"{ID} prob_bad_debt:f calibrated:f", _calibrate_isotonic)
add("score_with_own_model", f"{ID} prob_bad_debt:f", lambda c: sc.score_with(c.store.scored.drop("prob_bad_debt"), _own_model), """
SELECT CUSTOMER_TRX_ID, least(greatest(0.21713 + 0.48377 * (historical_late_payment_ratio / 100) + 0.29091 * hazard_approx, 0), 1) AS prob_bad_debt
FROM snapshot_feat""")
KEPT_SQL = f"SELECT * FROM {{0}} WHERE {NAME_KEY.format('CUSTOMER_NAME')} NOT IN (SELECT name_key FROM excluded_keys_sql)"
add("exclude_affiliates", f"{ID} CUSTOMER_NAME:s", lambda c: ex.exclude_affiliates(c.store.scored, c.excluded), KEPT_SQL.format("scored"))
add("restrict_to_targets", f"{ID} prob_bad_debt:f",
    lambda c: tg.restrict_to_targets(c.store.scored, tg.target_ids(_targets(c))),
    "SELECT * FROM scored WHERE CUSTOMER_TRX_ID IN (SELECT CUSTOMER_TRX_ID FROM targets_6m)")

# ---- customer risk and counts --------------------------------------------
add("customer_risk", RISK_COLS, lambda c: cr.customer_risk(st.scored_all(c.spark, c.sf_dir), True), "SELECT * FROM cust_risk")
add("weighted_score", "PARTY_ID:i w:f",
    lambda c: st.scored_all(c.spark, c.sf_dir).groupBy("PARTY_ID").agg(cr.weighted_score(F.col("prob_bad_debt"), F.col("TRX_AMOUNT")).alias("w")), """
SELECT PARTY_ID, CASE WHEN sum(abs(TRX_AMOUNT)) > 0 THEN sum(prob_bad_debt * abs(TRX_AMOUNT)) / sum(abs(TRX_AMOUNT)) ELSE avg(prob_bad_debt) END AS w
FROM scored GROUP BY 1""")
add("customer_invoice_cnt", "PARTY_ID:i ACCOUNT_NUMBER:s CUSTOMER_NAME:s invoice_cnt:i",
    lambda c: cr.customer_risk(c.store.scored), "SELECT * FROM cust_risk")
add("risk_summary", "risk_level:s cnt:i", lambda c: cr.level_counts(c.store.scored, "risk_level"),
    "SELECT risk_level, count(*) AS cnt FROM scored GROUP BY 1")
add("customer_risk_summary", "risk_cust:s cnt:i", lambda c: cr.level_counts(cr.customer_risk(c.store.scored, True), "risk_cust"),
    "SELECT risk_cust, count(*) AS cnt FROM cust_risk GROUP BY 1")
add("early_warning_counts", "processed_invoices:i alerts_count:i high_risk_count:i", lambda c: cr.warning_counts(c.store.scored), """
SELECT count(*) AS processed_invoices, count(*) FILTER (WHERE prob_bad_debt >= 0.3) AS alerts_count,
       count(*) FILTER (WHERE prob_bad_debt >= 0.6) AS high_risk_count FROM scored""")
add("run_summary", "job_id:s total_invoices:i total_customers:i", lambda c: jb.run_summary(c.store.scores), """
SELECT job_id, count(*) AS total_invoices, count(DISTINCT coalesce(ACCOUNT_NUMBER, '') || '/' || coalesce(CUSTOMER_NAME, '')) AS total_customers
FROM pub GROUP BY 1""")

# ---- publishing ----------------------------------------------------------
KEY_3M = pb.RunKey("job-x", "stacked", SNAP, "3m", "2000-07-02 06:00:00")
PUBLISHED_AS = """'{0}' AS job_id, TIMESTAMP '{1}' AS published_at, CAST({2} AS DATE) AS start_date, CAST({3} AS DATE) AS end_date,
 'stacked' AS model_key, {{SNAP}} AS snapshot_date, '{4}' AS time_range"""


def _published_sql(where: str, job: str, at: str, span: str, start: str = "NULL", end: str = "NULL", source: str = "scored") -> str:
    return f"SELECT *, {PUBLISHED_AS.format(job, at, start, end, span)} FROM {source} WHERE {where}"


def _publish_replace(ctx: Context) -> DataFrame:
    """Publish all rows, then publish the run again with fewer: only the second stays."""
    path = ctx.path("replace")
    other = pb.RunKey("job-y", "stacked", SNAP, "6m", "2000-07-02 05:00:00")
    rows = ctx.store.published_rows
    pb.publish_scores(sc.score_table(rows), path, other)
    pb.publish_scores(sc.score_table(rows), path, KEY_3M)
    pb.publish_scores(sc.score_table(rows.where("days_to_due > 30")), path, KEY_3M)
    return pb.read_table(ctx.spark, path, SCORES)


def _publish_append(ctx: Context) -> DataFrame:
    path = ctx.path("append")
    later = pb.RunKey("job-z", "stacked", SNAP, "3m", "2000-07-03 06:00:00")
    pb.publish_scores(sc.score_table(ctx.store.published_rows), path, KEY_3M, replace=False)
    pb.publish_scores(sc.score_table(st.halved(ctx.store.published_rows)), path, later, replace=False)
    return pb.latest_per_invoice(pb.published_scores(ctx.spark, path, "stacked", SNAP))


def _publish_custom(ctx: Context) -> DataFrame:
    """Two custom windows stand side by side; the first is replaced once."""
    path = ctx.path("custom")
    rows = ctx.store.published_rows
    for job, start, end, cut in (
        ("a", "2000-01-01", "2000-03-31", "true"),
        ("b", "2000-02-01", "2000-05-31", "true"),
        ("c", "2000-01-01", "2000-03-31", "days_to_due > 30"),
    ):
        run = pb.RunKey(job, "stacked", SNAP, "custom", "2000-07-02 06:00:00", start, end)
        window = tb.invoices_in_range(rows, "custom", SNAP, start, end).where(cut)
        pb.publish_scores(sc.score_table(window), path, run)
    return pb.read_table(ctx.spark, path, SCORES)


def _publish_risk(ctx: Context) -> DataFrame:
    path = ctx.path("risk")
    pb.publish_customer_risk(cr.customer_risk(ctx.store.published_rows, True), path, KEY_3M)
    return pb.read_table(ctx.spark, path, CUSTOMER_RISK)


def _retain(ctx: Context) -> DataFrame:
    path = ctx.path("retained")
    kept = pb.retain_published(ctx.store.scores, "2000-07-02 07:30:00", 1)
    pb.rewrite(kept, path)
    return pb.read_table(ctx.spark, path, SCORES)


def _retain_in_place(ctx: Context) -> DataFrame:
    path = ctx.path("retained-in-place")
    pb.rewrite(ctx.store.scores, path)
    pb.drop_expired(ctx.spark, path, SCORES, "2000-07-02 07:30:00", 1)
    return pb.read_table(ctx.spark, path, SCORES)


def _page_after(ctx: Context) -> DataFrame:
    """The third page, from the last row of the second."""
    order = rp.sort_order("TRX_AMOUNT", "desc", rp.SCORE_SORT, ["CUSTOMER_TRX_ID"])
    last = rp.page_of(ctx.store.scored, order, 2).collect()[-1].asDict()
    return rp.page_after(ctx.store.scored, last, "TRX_AMOUNT", "desc", rp.SCORE_SORT, ["CUSTOMER_TRX_ID"])


add("page_after", f"{ID} TRX_AMOUNT:f prob_bad_debt:f", _page_after,
    "SELECT * FROM scored ORDER BY TRX_AMOUNT DESC NULLS LAST, CUSTOMER_TRX_ID LIMIT 50 OFFSET 100")


def _cascade(ctx: Context) -> DataFrame:
    """Runs, score rows and risk rows that survive, counted per job."""
    runs = ct_runs(ctx)
    kept = pb.retain_runs(runs, ctx.store.scores, ctx.store.risk, "2000-07-31 07:30:00", 30)
    counts = [
        rows.groupBy("job_id").agg(F.count("*").alias("n")).select("job_id", F.lit(name).alias("tab"), "n")
        for name, rows in zip(("runs", "scores", "risk"), kept)
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def ct_runs(ctx: Context) -> DataFrame:
    return st.catalogue(ctx.store.risk).withColumn("started_at", F.col("completed_at"))


def _export(ctx: Context) -> DataFrame:
    path = ctx.path("export")
    pb.export_csv(sc.score_table(st.scored_all(ctx.spark, ctx.sf_dir)).withColumn("_rn", F.lit(1)), path)
    back = ctx.spark.read.option("header", True).option("escape", '"').csv(path)
    return back.withColumns({d: F.col(d).cast("timestamp") for d in ("TRX_DATE", "DUE_DATE")})


add("published_scores", PUBLISHED_COLS,
    lambda c: pb.latest_per_invoice(tb.scored_in_range(
        pb.published_scores(c.spark, c.store.scores_path, "stacked", SNAP).where("job_id = 'job-3m'"), "1m", SNAP)),
    o.latest_sql("SELECT * FROM stacked_rows WHERE job_id = 'job-3m' AND TRX_DATE >= {SNAP} - 30"))
add("publish_replace_partition", PUBLISHED_COLS, _publish_replace,
    _published_sql("days_to_due > 30", "job-x", "2000-07-02 06:00:00", "3m") + " UNION ALL "
    + _published_sql("true", "job-y", "2000-07-02 05:00:00", "6m"))
o.step("appended", _published_sql("true", "job-x", "2000-07-02 06:00:00", "3m").replace("SELECT *", "SELECT " + o._OUT)
       + " UNION ALL " + _published_sql("true", "job-z", "2000-07-03 06:00:00", "3m", source="rescored").replace("SELECT *", "SELECT " + o._OUT))
add("publish_append_dedupe", PUBLISHED_COLS, _publish_append, o.latest_sql("SELECT * FROM appended"))
_C1, _C2 = ("DATE '2000-01-01'", "DATE '2000-03-31'"), ("DATE '2000-02-01'", "DATE '2000-05-31'")
add("replace_partition_custom", PUBLISHED_COLS, _publish_custom,
    _published_sql(f"days_to_due > 30 AND TRX_DATE BETWEEN {_C1[0]} AND {_C1[1]}", "c", "2000-07-02 06:00:00", "custom", *_C1)
    + " UNION ALL " + _published_sql(f"TRX_DATE BETWEEN {_C2[0]} AND {_C2[1]}", "b", "2000-07-02 06:00:00", "custom", *_C2))
add("publish_customer_risk", RISK_COLS + " job_id:s model_key:s snapshot_date:d time_range:s", _publish_risk,
    _published_sql("true", "job-x", "2000-07-02 06:00:00", "3m", source="cust_risk"))
add("retain_published", PUBLISHED_COLS, _retain, "SELECT * FROM pub WHERE published_at >= TIMESTAMP '2000-07-01 07:30:00'")
add("retain_in_place", PUBLISHED_COLS, _retain_in_place, "SELECT * FROM pub WHERE published_at >= TIMESTAMP '2000-07-01 07:30:00'")
add("retain_runs_cascade", "job_id:s tab:s n:i", _cascade, """
SELECT job_id, 'runs' AS tab, 1 AS n FROM (SELECT DISTINCT job_id FROM pub_risk WHERE published_at >= TIMESTAMP '2000-07-01 07:30:00')
UNION ALL SELECT job_id, 'scores', count(*) FROM pub WHERE job_id IN (SELECT job_id FROM pub_risk WHERE published_at >= TIMESTAMP '2000-07-01 07:30:00') GROUP BY 1
UNION ALL SELECT job_id, 'risk', count(*) FROM pub_risk WHERE published_at >= TIMESTAMP '2000-07-01 07:30:00' GROUP BY 1""")
add("export_scores_csv", SCORE_COLS, _export, "SELECT * FROM scored")
add("records_json", "record:s", lambda c: pb.json_records(c.raw.invoice.select("CUSTOMER_TRX_ID", "TRX_NUMBER", "PARTY_ID")), """
SELECT '{"CUSTOMER_TRX_ID":' || CUSTOMER_TRX_ID || ',"TRX_NUMBER":"' || TRX_NUMBER || '","PARTY_ID":' || coalesce(CAST(PARTY_ID AS VARCHAR), 'null') || '}' AS record
FROM ar_invoice""")
add("latest_per_invoice", PUBLISHED_COLS, lambda c: pb.latest_per_invoice(c.store.scores),
    o.latest_sql("SELECT * FROM pub"))

# ---- run lookup ----------------------------------------------------------
RUN_KINDS = ["1w", "2w", "1m", "3m", "6m", "1y", "all", "custom"]
o.step("runs_sql", """
SELECT 'job-' || k AS job_id,
       CASE WHEN k % 10 = 3 THEN 'failed' WHEN k % 10 = 6 THEN 'running' ELSE 'completed' END AS status,
       CASE WHEN k % 3 = 0 THEN 'lgbm_hyper_smote' ELSE 'stacked' END AS model_key, last_day(d) AS snapshot_date,
       ['1w', '2w', '1m', '3m', '6m', '1y', 'all', 'custom'][k % 8 + 1] AS time_range,
       CASE WHEN k % 8 = 7 THEN CAST(date_trunc('month', d) AS DATE) END AS start_date,
       CASE WHEN k % 8 = 7 THEN CAST(date_trunc('month', d) AS DATE) + CAST(k % 5 * 7 AS INTEGER) END AS end_date,
       k % 1000 AS total_invoices,
       CASE WHEN k % 10 <> 6 THEN d + INTERVAL 6 HOUR + to_minutes(CAST(k % 60 AS BIGINT)) END AS completed_at,
       [7, 14, 30, 90, 180, 365, 99999, 0][k % 8 + 1] AS days
FROM ar_orders""")
RUN_COLS = "job_id:s status:s model_key:s snapshot_date:d time_range:s start_date:d end_date:d total_invoices:i completed_at:t"
MINE = "model_key = 'stacked' AND snapshot_date = DATE '1999-06-30' AND status = 'completed'"
add("latest_run_exact", RUN_COLS, lambda c: ct.latest_run(c.runs, "stacked", "1999-06-30", "3m"),
    f"SELECT * FROM runs_sql WHERE {MINE} AND time_range = '3m' ORDER BY completed_at DESC, job_id LIMIT 1")
add("latest_run_custom", RUN_COLS, lambda c: ct.latest_run(c.runs, "stacked", "1999-06-30", "custom", "1999-06-01", "1999-06-15"),
    f"SELECT * FROM runs_sql WHERE {MINE} AND time_range = 'custom' AND start_date = DATE '1999-06-01' AND end_date = DATE '1999-06-15' ORDER BY completed_at DESC, job_id LIMIT 1")
add("latest_run_covering", RUN_COLS + " effective_time_range:s",
    lambda c: ct.latest_covering_run(c.runs.where("time_range <> '6m'"), "stacked", "1999-06-30", "6m"),
    f"SELECT *, time_range AS effective_time_range FROM runs_sql WHERE {MINE} AND days >= 180 AND time_range <> '6m' ORDER BY completed_at DESC, job_id LIMIT 1")
PUB_COLS = "job_id:s time_range:s snapshot_date:d published_at:t total_invoices:i"
add("published_runs", PUB_COLS, lambda c: ct.published_runs(c.store.scores, "stacked", SNAP), "SELECT * FROM publications")
add("published_run_covering", PUB_COLS, lambda c: ct.covering_publication(c.store.scores, "stacked", SNAP, "1m", index=c.store.index),
    "SELECT * FROM publications WHERE days >= 30 ORDER BY published_at DESC, job_id LIMIT 1")
add("published_run_exact", "job_id:s snapshot_date:d last_published_at:t",
    lambda c: ct.exact_publication(c.store.scores, "stacked", SNAP, "6m"),
    "SELECT job_id, snapshot_date, max(published_at) AS last_published_at FROM publications WHERE time_range = '6m' GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 1")

# ---- reports -------------------------------------------------------------
add("read_range_subset", f"{ID} job_id:s TRX_DATE:d", lambda c: tb.scored_in_range(c.store.scores, "1m", SNAP),
    "SELECT * FROM pub WHERE TRX_DATE >= {SNAP} - 30")
add("filter_risk_level", f"{ID} job_id:s risk_level:s", lambda c: rp.with_level(c.store.scores, "HIGH", "risk_level"),
    "SELECT * FROM pub WHERE risk_level = 'HIGH'")
add("search_customer", f"{ID} job_id:s CUSTOMER_NAME:s", lambda c: rp.with_name(c.store.scores, "cUSTomer#00000_0%5"),
    "SELECT * FROM pub WHERE CUSTOMER_NAME ILIKE '%cUSTomer#00000_0%5%'")
add("alerts_threshold", f"{ID} prob_bad_debt:f", lambda c: rp.alerts(c.store.scored, 0.6), "SELECT * FROM scored WHERE prob_bad_debt >= 0.6")
_ORDER = ["TRX_AMOUNT", "CUSTOMER_TRX_ID"]
add("score_page_sorted", SCORE_COLS,
    lambda c: rp.page_of(c.store.scored, rp.sort_order("CUSTOMER_NAME", "asc", rp.SCORE_SORT, ["CUSTOMER_TRX_ID"]), 4, 200),
    "SELECT * FROM scored ORDER BY CUSTOMER_NAME ASC NULLS FIRST, CUSTOMER_TRX_ID LIMIT 200 OFFSET 600")
add("score_page", SCORE_COLS,
    lambda c: rp.page_of(c.store.scored, rp.sort_order("TRX_AMOUNT", "desc", rp.SCORE_SORT, ["CUSTOMER_TRX_ID"]), 2, 50),
    "SELECT * FROM scored ORDER BY TRX_AMOUNT DESC NULLS LAST, CUSTOMER_TRX_ID LIMIT 50 OFFSET 50")
add("page_totals", "page:i page_size:i total_records:i total_pages:i", lambda c: rp.page_totals(c.store.scored, 2, 50),
    "SELECT 2 AS page, 50 AS page_size, count(*) AS total_records, CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages FROM scored")
add("top_expected_loss", SCORE_COLS, lambda c: rp.top_loss(c.store.scored),
    "SELECT * FROM scored WHERE expected_financial_loss IS NOT NULL ORDER BY expected_financial_loss DESC, CUSTOMER_TRX_ID LIMIT 50")
add("score_preview", SCORE_COLS, lambda c: rp.preview(sc.score_table(c.store.scored)), "SELECT * FROM scored ORDER BY CUSTOMER_TRX_ID LIMIT 20")
REPORT_COLS = SCORE_COLS
ANSWER_3M = o.answering_sql("1m")
add("report_score", REPORT_COLS,
    lambda c: rp.score_report(c.store.scores, "stacked", SNAP, "1m", sort_by="TRX_AMOUNT", level="MEDIUM", search="customer", index=c.store.index)["page"],
    f"SELECT * FROM ({ANSWER_3M}) WHERE risk_level = 'MEDIUM' AND CUSTOMER_NAME ILIKE '%customer%' ORDER BY TRX_AMOUNT DESC NULLS LAST, CUSTOMER_TRX_ID LIMIT 50")
add("report_score_totals", "page:i page_size:i total_records:i total_pages:i",
    lambda c: rp.score_report(c.store.scores, "stacked", SNAP, "6m", level="LOW", index=c.store.index)["totals"],
    f"SELECT 1 AS page, 50 AS page_size, count(*) AS total_records, CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages FROM ({o.answering_sql('6m')}) WHERE risk_level = 'LOW'")
add("report_score_summary", "risk_level:s cnt:i",
    lambda c: rp.score_report(c.store.scores, "stacked", SNAP, "1m", index=c.store.index)["risk_summary"],
    f"SELECT risk_level, count(*) AS cnt FROM ({ANSWER_3M}) GROUP BY 1")
add("report_score_custom", REPORT_COLS,
    lambda c: rp.score_report(c.store.scores, "stacked", SNAP, "custom", "2000-01-01", "2000-03-31", sort_by="TRX_AMOUNT", index=c.store.index)["page"],
    f"SELECT * FROM ({o.answering_sql('custom', '2000-01-01', '2000-03-31')}) ORDER BY TRX_AMOUNT DESC NULLS LAST, CUSTOMER_TRX_ID LIMIT 50")
add("report_alerts", REPORT_COLS,
    lambda c: rp.alerts_report(c.store.scores, "stacked", SNAP, "1y", threshold=0.6, sort_by="TRX_AMOUNT", index=c.store.index)["page"],
    f"SELECT * FROM ({o.answering_sql('1y')}) WHERE prob_bad_debt >= 0.6 ORDER BY TRX_AMOUNT DESC NULLS LAST, CUSTOMER_TRX_ID LIMIT 50")
add("report_early_warning", "processed_invoices:i alerts_count:i high_risk_count:i",
    lambda c: rp.early_warning_report(c.store.scores, "stacked", SNAP, "1m", index=c.store.index)["counts"], f"""
SELECT count(*) AS processed_invoices, count(*) FILTER (WHERE prob_bad_debt >= 0.3) AS alerts_count,
       count(*) FILTER (WHERE prob_bad_debt >= 0.6) AS high_risk_count FROM ({ANSWER_3M})""")
add("report_chart", f"{ID} ACCOUNT_NUMBER:s CUSTOMER_NAME:s SBU:s prob_bad_debt:f expected_financial_loss:f risk_level:s recommended_action:s",
    lambda c: rp.chart_rows(c.store.scores, "stacked", SNAP, "1y", index=c.store.index), f"SELECT * FROM ({o.answering_sql('1y')})")
add("report_customer_risk", RISK_COLS,
    lambda c: rp.customer_risk_report(
        st.catalogue(c.store.risk), c.store.risk, "stacked", SNAP, "1m", sort_by="total_amount", level="MEDIUM")["page"],
    """SELECT * FROM pub_risk WHERE job_id = 'job-6m' AND risk_cust = 'MEDIUM'
 ORDER BY total_amount DESC NULLS LAST, PARTY_ID NULLS FIRST, ACCOUNT_NUMBER NULLS FIRST, CUSTOMER_NAME NULLS FIRST LIMIT 50""")


# ---- jobs ----------------------------------------------------------------
def _score_files(ctx: Context) -> DataFrame:
    """Delivered text files through to scores."""
    invoices = ctx.raw.invoice.select(
        *[F.date_format(c, "dd-MMM-yyyy").alias(c) if c.endswith("_DATE") else F.col(c) for c in ctx.raw.invoice.columns]
    )
    paths = [
        _write_csv(ctx, invoices, "inv"),
        _write_csv(ctx, fx.text_receipts(ctx.spark, ctx.sf_dir), "rcp"),
        f"{ctx.path('cust')}.jsonl",
    ]
    ctx.raw.customer.write.json(paths[2])
    return jb.score_files(ctx.spark, *paths, SNAP)["scores"]


def _run(ctx: Context) -> tuple[DataFrame, str, str]:
    paths, runs = (ctx.path("run-scores"), ctx.path("run-risk")), ctx.path("runs")
    jb.run_snapshot(
        ctx.spark, ctx.raw, SNAP, "6m", *paths, job_id="job-r", published_at="2000-07-04 06:00:00", excluded=ctx.excluded,
        runs_path=runs,
    )
    return jb.stored_runs(ctx.spark, runs), *paths


def _two_runs(ctx: Context) -> tuple[DataFrame, str, str]:
    """A run, and a second one a month later."""
    run, scores, risk = _run(ctx)
    later = run.withColumns({"job_id": F.lit("job-s"), "started_at": F.lit("2000-08-10 06:00:00").cast("timestamp")})
    key = pb.RunKey("job-s", "stacked", SNAP, "3m", "2000-08-10 06:00:00")
    pb.publish_scores(sc.score_table(ctx.store.published_rows), scores, key)
    pb.publish_customer_risk(cr.customer_risk(ctx.store.published_rows, True), risk, key)
    return run.unionByName(later), scores, risk


def _retained(ctx: Context) -> DataFrame:
    """What is kept of two runs."""
    runs, scores, risk = _two_runs(ctx)
    new = ctx.path("kept-scores"), ctx.path("kept-risk")
    kept = jb.retain_results(ctx.spark, runs, scores, risk, "2000-08-10 07:00:00", *new)
    return _kept_by_job(ctx, kept, *new)


def _retained_in_place(ctx: Context) -> DataFrame:
    runs, scores, risk = _two_runs(ctx)
    kept = jb.retain_in_place(ctx.spark, runs, scores, risk, "2000-08-10 07:00:00")
    return _kept_by_job(ctx, kept, scores, risk)


def _kept_by_job(ctx: Context, runs: DataFrame, scores: str, risk: str) -> DataFrame:
    counts = [runs, pb.read_table(ctx.spark, scores, SCORES), pb.read_table(ctx.spark, risk, CUSTOMER_RISK)]
    return counts[0].select("job_id", F.lit("runs").alias("tab")).unionByName(
        counts[1].select("job_id", F.lit("scores").alias("tab"))
    ).unionByName(counts[2].select("job_id", F.lit("risk").alias("tab"))).groupBy("job_id", "tab").agg(F.count("*").alias("n"))


add("score_files", SCORE_COLS, _score_files, "SELECT * FROM scored")
RUN_SCORED = o.over("scored", {"ar_invoice": "inputs_6m", "ar_receipt": "receipts_6m"})
o.step("run_scored", KEPT_SQL.format(RUN_SCORED) + " AND CUSTOMER_TRX_ID IN (SELECT CUSTOMER_TRX_ID FROM targets_6m)")
o.step("run_risk", o.risk_sql("run_scored"))
_RUN_TAIL = "'job-r' AS job_id, TIMESTAMP '2000-07-04 06:00:00' AS published_at, CAST(NULL AS DATE) AS start_date, CAST(NULL AS DATE) AS end_date, 'stacked' AS model_key, {SNAP} AS snapshot_date, '6m' AS time_range"
add("run_snapshot", PUBLISHED_COLS, lambda c: pb.read_table(c.spark, _run(c)[1], SCORES), f"SELECT *, {_RUN_TAIL} FROM run_scored")
add("run_snapshot_risk", RISK_COLS + " job_id:s", lambda c: pb.read_table(c.spark, _run(c)[2], CUSTOMER_RISK),
    f"SELECT *, {_RUN_TAIL} FROM run_risk")
add("run_snapshot_catalogue", "job_id:s status:s model_key:s snapshot_date:d time_range:s total_invoices:i total_customers:i",
    lambda c: _run(c)[0], f"""
SELECT 'completed' AS status, (SELECT count(*) FROM run_scored) AS total_invoices, (SELECT count(*) FROM run_risk) AS total_customers, {_RUN_TAIL}""")
RETAINED_SQL = """
SELECT 'job-s' AS job_id, 'runs' AS tab, 1 AS n UNION ALL SELECT 'job-s', 'scores', count(*) FROM scored
UNION ALL SELECT 'job-s', 'risk', count(*) FROM cust_risk"""
add("retain_results", "job_id:s tab:s n:i", _retained, RETAINED_SQL)
add("retain_results_in_place", "job_id:s tab:s n:i", _retained_in_place, RETAINED_SQL)


def _stream(ctx: Context) -> DataFrame:
    """Three batches of receipts, the last of them months late; the parties of each are scored again."""
    folder, out, checkpoint = ctx.path("stream-in"), ctx.path("stream-out"), ctx.path("stream-cp")
    served = pb.RunKey("job-s", "stacked", SNAP, "all", "2000-07-05 06:00:00")
    handle = rt.rescore_batch(lambda: ctx.raw, SNAP, out, served, lambda: dt.datetime(2000, 7, 5, 7))
    for low, high in (("2000-06-01", "2000-06-14"), ("2000-06-15", "2000-06-30"), ("2000-01-01", "2000-01-31")):
        arrived = ctx.raw.receipt.where(F.col("RECEIPT_DATE").between(F.lit(low), F.lit(high)))
        arrived.write.mode("append").json(folder)
        rt.start_trigger(rt.receipt_stream(ctx.spark, folder), handle, checkpoint).awaitTermination()
    return pb.latest_per_invoice(pb.published_scores(ctx.spark, out, "stacked", SNAP))


add("stream_receipt_trigger", f"{ID} prob_bad_debt:f risk_level:s", _stream, """
WITH hit AS (SELECT * FROM ar_invoice WHERE CUSTOMER_TRX_ID IN (SELECT APPLIED_CUSTOMER_TRX_ID FROM ar_receipt
  WHERE RECEIPT_DATE BETWEEN DATE '2000-06-01' AND DATE '2000-06-14' OR RECEIPT_DATE BETWEEN DATE '2000-06-15' AND DATE '2000-06-30'
     OR RECEIPT_DATE BETWEEN DATE '2000-01-01' AND DATE '2000-01-31')),
 touched AS (SELECT * FROM hit UNION ALL SELECT * FROM ar_invoice WHERE CUSTOMER_TRX_ID IN (SELECT PREVIOUS_CUSTOMER_TRX_ID FROM hit))
SELECT * FROM scored WHERE PARTY_ID IN (SELECT PARTY_ID FROM touched WHERE PARTY_ID IS NOT NULL)
 OR (PARTY_ID IS NULL AND CUSTOMER_TRX_ID IN (SELECT CUSTOMER_TRX_ID FROM touched))""")


def _stream_state(ctx: Context) -> DataFrame:
    """A full run without the receipts of two spans, which then arrive in batches that go on from the stored state."""
    folder, out, checkpoint = ctx.path("state-in"), ctx.path("state-out"), ctx.path("state-cp")
    state, booked = ps.PartyState(ctx.spark, ctx.path("state"), parts=16), F.col("RECEIPT_DATE")
    spans = [("2000-06-01", "2000-06-14"), ("2000-06-15", "2000-06-30"), ("2000-01-01", "2000-01-31")]
    arrived = [booked.between(F.lit(low), F.lit(high)) for low, high in spans]
    late = F.coalesce(reduce(lambda a, b: a | b, arrived), F.lit(False))
    tables = bp.PartyTables(ctx.spark, ctx.path("by-party"), ctx.raw.customer, parts=16)
    tables.write(replace(ctx.raw, receipt=ctx.raw.receipt.where(~late)))
    held = tables.everything()
    served = pb.RunKey("job-s", "stacked", SNAP, "all", "2000-07-05 06:00:00")
    pb.publish_scores(ps.score_and_store(state, held, SNAP), out, served)
    handle = ps.replay_batch(
        lambda: tables, state, SNAP, out, served, rt.surviving_memos(held), lambda: dt.datetime(2000, 7, 5, 7))
    for batch in arrived:
        ctx.raw.receipt.where(batch).write.mode("append").json(folder)
        # Copies count: the tables by party take the receipts from the stream.
        rt.start_trigger(rt.receipt_stream(ctx.spark, folder, repeats_within=None), handle, checkpoint).awaitTermination()
    return pb.latest_per_invoice(pb.published_scores(ctx.spark, out, "stacked", SNAP))


add("stream_receipt_state", f"{ID} prob_bad_debt:f risk_level:s", _stream_state, "SELECT * FROM scored")
