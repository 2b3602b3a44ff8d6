"""The same tables and operators in plain SQL, for comparison.

Each entry of CTES is one named step. `sql(body)` puts the steps that `body`
needs, directly or through other steps, in front of it.
"""

from __future__ import annotations

import re

from duesight.settings import ACTIONS, COVER_DAYS, SCORECARD

SNAP = "DATE '2000-06-30'"
CTES: dict[str, str] = {}


def step(name: str, body: str) -> None:
    CTES[name] = body.replace("{SNAP}", SNAP)


def sql(body: str) -> str:
    body = body.replace("{SNAP}", SNAP)
    needed: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in CTES:
            if name in words and name not in needed:
                needed.add(name)
                todo.append(CTES[name])
    if not needed:
        return body
    steps = ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed)
    return f"WITH {steps}\n{body}"


def over(name: str, tables: dict[str, str]) -> str:
    """A copy of a step, and of all it builds on, that reads other source tables."""
    done = dict(tables)

    def copy(step_name: str) -> str:
        if step_name not in done:
            body = CTES[step_name]
            changed = re.sub(r"\w+", lambda m: copy(m[0]) if m[0] in CTES and m[0] != step_name else m[0], body)
            done[step_name] = step_name if changed == body else f"{step_name}_run"
            if changed != body:
                CTES[done[step_name]] = changed
        return done[step_name]

    return copy(name)


def r(expr: str, digits: int = 4) -> str:
    """Rounded double; adding zero turns minus zero into zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


# ---- source tables -------------------------------------------------------
step("ar_orders", "SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS TIMESTAMP) AS d, o_totalprice AS amt, o_orderpriority AS prio FROM orders")
step("ar_invoice", """
SELECT k AS CUSTOMER_TRX_ID, 'INV-' || k AS TRX_NUMBER, CASE WHEN k % 53 <> 0 THEN c END AS PARTY_ID,
       d AS TRX_DATE,
       d + to_days(CAST(CASE left(prio, 1) WHEN '1' THEN 14 WHEN '2' THEN 30 WHEN '3' THEN 45 WHEN '4' THEN 60 ELSE 90 END AS INTEGER)) AS DUE_DATE,
       CASE WHEN k % 101 = 0 THEN 0.0 WHEN k % 103 = 0 THEN -amt ELSE amt END AS TRX_AMOUNT,
       'INV' AS TRANS_TYPE, 'IDR' AS CURRENCY_CODE, k % 5 AS ORG_ID, CAST(NULL AS BIGINT) AS PREVIOUS_CUSTOMER_TRX_ID
FROM ar_orders
UNION ALL
SELECT k + 1000000000, 'CM-' || k, c, d + to_days(20), NULL, -floor(amt * 10 + 0.5) / 100, 'CM', 'IDR', k % 5, k
FROM ar_orders WHERE k % 6 IN (0, 1)""")
step("ar_line", """
SELECT l.*, o.amt, o.d + to_days(CAST((l_partkey * 11 + l_suppkey * 7 + l_linenumber * 17) % 240 AS INTEGER)) AS pd
FROM lineitem l JOIN ar_orders o ON l.l_orderkey = o.k""")
step("ar_receipt", """
SELECT l_orderkey AS APPLIED_CUSTOMER_TRX_ID,
       CASE WHEN l_suppkey % 19 = 0 THEN NULL WHEN l_partkey % 211 = 0 THEN pd + to_years(200) ELSE pd END AS APPLY_DATE,
       pd + to_days(2) AS RECEIPT_DATE, floor(amt * l_quantity + 0.5) / 100 AS AMOUNT_APPLIED,
       CASE l_returnflag WHEN 'A' THEN 'APP' WHEN 'R' THEN 'REV' END AS RECEIPT_STATUS
FROM ar_line
UNION ALL
SELECT k + 1000000000, d + to_days(20), d + to_days(20), 0.0, 'APP' FROM ar_orders WHERE k % 6 = 0""")
step("ar_customer", """
SELECT c AS PARTY_ID, CASE WHEN c_custkey % 13 <> 0 THEN 'ACC-' || c_custkey END AS ACCOUNT_NUMBER,
       'INV-' || k AS TRX_NUMBER, c_name AS CUSTOMER_NAME, c_mktsegment AS BU_NAME
FROM ar_orders JOIN customer ON c = c_custkey WHERE k % 7 <> 0 AND c % 29 <> 0""")
step("ar_excluded", """
SELECT CASE c_custkey % 3 WHEN 0 THEN lower(c_name) WHEN 1 THEN replace(c_name, '#', ' # ') ELSE c_name || '.' END AS c0,
       CASE WHEN c_custkey % 2 = 0 THEN '0' ELSE '' END AS c1
FROM customer WHERE c_custkey % 41 = 0""")

# ---- invoices ------------------------------------------------------------
step("has_receipt", "SELECT DISTINCT APPLIED_CUSTOMER_TRX_ID AS id FROM ar_receipt WHERE APPLIED_CUSTOMER_TRX_ID IS NOT NULL")
step("surviving", """
SELECT i.* FROM ar_invoice i LEFT JOIN has_receipt h ON h.id = i.CUSTOMER_TRX_ID
WHERE NOT (coalesce(TRX_AMOUNT <= 0, false) AND h.id IS NULL)""")
step("cm_totals", """
SELECT PREVIOUS_CUSTOMER_TRX_ID AS original_id,
       sum(coalesce(TRX_AMOUNT, 0)) AS cm_amount, count(*) AS cm_count, min(TRX_DATE) AS cm_first_date
FROM surviving WHERE PREVIOUS_CUSTOMER_TRX_ID IS NOT NULL AND TRX_DATE <= {SNAP} GROUP BY 1""")
step("netted", """
SELECT s.* EXCLUDE (TRX_AMOUNT), coalesce(TRX_AMOUNT, 0.0) AS TRX_AMOUNT_GROSS,
       greatest(-least(coalesce(cm_amount, 0.0), 0.0), 0.0) AS credit_memo_reduction,
       coalesce(cm_count, 0) AS cm_count, cm_first_date,
       CASE WHEN (SELECT count(PREVIOUS_CUSTOMER_TRX_ID) > 0 FROM surviving)
            THEN greatest(coalesce(TRX_AMOUNT, 0.0) + least(coalesce(cm_amount, 0.0), 0.0), 0.0)
            ELSE coalesce(TRX_AMOUNT, 0.0) END AS TRX_AMOUNT
FROM surviving s LEFT JOIN cm_totals ON original_id = CUSTOMER_TRX_ID""")
step("core", """
SELECT *, CASE WHEN DUE_DATE > {SNAP} THEN CAST({SNAP} AS TIMESTAMP) ELSE DUE_DATE END AS AS_OF_DATE FROM netted
WHERE CUSTOMER_TRX_ID IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY CUSTOMER_TRX_ID ORDER BY TRX_DATE NULLS LAST, TRX_NUMBER) = 1""")
step("cust_party", """
SELECT PARTY_ID, ACCOUNT_NUMBER, CUSTOMER_NAME, BU_NAME FROM ar_customer WHERE PARTY_ID IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY PARTY_ID ORDER BY TRX_NUMBER NULLS LAST, ACCOUNT_NUMBER NULLS LAST, CUSTOMER_NAME NULLS LAST, BU_NAME NULLS LAST) = 1""")
step("cust_number", """
SELECT TRX_NUMBER, PARTY_ID, ACCOUNT_NUMBER FROM ar_customer WHERE TRX_NUMBER IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY TRX_NUMBER ORDER BY PARTY_ID NULLS LAST, ACCOUNT_NUMBER NULLS LAST) = 1""")
step("base", """
SELECT i.*, coalesce(p.ACCOUNT_NUMBER, n.ACCOUNT_NUMBER) AS ACCOUNT_NUMBER, p.CUSTOMER_NAME, p.BU_NAME AS SBU,
       CASE WHEN p.PARTY_ID IS NULL AND n.TRX_NUMBER IS NULL THEN 1 ELSE 0 END AS cust_master_missing
FROM core i LEFT JOIN cust_party p ON p.PARTY_ID = i.PARTY_ID LEFT JOIN cust_number n ON n.TRX_NUMBER = i.TRX_NUMBER""")

# ---- receipts ------------------------------------------------------------
def _repair(col: str) -> str:
    y = f"year({col})"
    y1 = f"(CASE WHEN {y} BETWEEN 2200 AND 2299 THEN {y} - 200 ELSE {y} END)"
    return f"(CASE WHEN {y1} > 2000 AND {y1} <= 2020 THEN {y1} - 10 ELSE {y1} END)"


def _repaired(col: str) -> str:
    y, m, d = f"{col}_y", f"month({col})", f"day({col})"
    return (
        f"CASE WHEN {y} IS NOT NULL AND {d} <= day(last_day(make_date(CAST({y} AS BIGINT), CAST({m} AS BIGINT), CAST(1 AS BIGINT)))) "
        f"THEN make_date(CAST({y} AS BIGINT), CAST({m} AS BIGINT), CAST({d} AS BIGINT)) END"
    )


step("rc_year", f"SELECT *, {_repair('APPLY_DATE')} AS APPLY_DATE_y, {_repair('RECEIPT_DATE')} AS RECEIPT_DATE_y FROM ar_receipt")
step("rc_day", f"SELECT *, {_repaired('APPLY_DATE')} AS a, {_repaired('RECEIPT_DATE')} AS b FROM rc_year")
step("rc_fixed", """
SELECT * EXCLUDE (a, b),
       CASE WHEN a > {SNAP} AND a <= {SNAP} + 45 THEN CAST(a - INTERVAL 1 MONTH AS DATE) ELSE a END AS fixed_apply,
       CASE WHEN b > {SNAP} AND b <= {SNAP} + 45 THEN CAST(b - INTERVAL 1 MONTH AS DATE) ELSE b END AS fixed_receipt
FROM rc_day""")
step("pay", """
SELECT APPLIED_CUSTOMER_TRX_ID AS INVOICE_ID, CAST(coalesce(fixed_apply, fixed_receipt) AS TIMESTAMP) AS PAYMENT_DATE,
       coalesce(AMOUNT_APPLIED, 0.0) AS AMOUNT_APPLIED
FROM rc_fixed WHERE APPLIED_CUSTOMER_TRX_ID IS NOT NULL AND (RECEIPT_STATUS IS NULL OR RECEIPT_STATUS = 'APP')""")
step("pay_gaps", """
SELECT *, date_diff('day', lag(PAYMENT_DATE) OVER (PARTITION BY INVOICE_ID ORDER BY PAYMENT_DATE), PAYMENT_DATE) AS gap_days
FROM pay WHERE PAYMENT_DATE IS NOT NULL""")
step("receipt_agg", """
SELECT INVOICE_ID AS CUSTOMER_TRX_ID, count(*) AS receipt_count, min(PAYMENT_DATE) AS first_pay_date,
       max(PAYMENT_DATE) AS last_pay_date, sum(AMOUNT_APPLIED) AS total_paid, var_samp(gap_days) AS gap_variance,
       CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS is_partial
FROM pay_gaps GROUP BY 1""")


def window_steps(prefix: str, source: str, asof: str) -> None:
    step(f"win_{prefix}", f"""
SELECT i.CUSTOMER_TRX_ID AS id, p.PAYMENT_DATE AS pd, p.AMOUNT_APPLIED AS pa,
       date_diff('day', lag(p.PAYMENT_DATE) OVER (PARTITION BY i.CUSTOMER_TRX_ID ORDER BY p.PAYMENT_DATE), p.PAYMENT_DATE) AS gap
FROM pay p JOIN {source} i ON i.CUSTOMER_TRX_ID = p.INVOICE_ID
WHERE p.PAYMENT_DATE >= i.TRX_DATE AND p.PAYMENT_DATE <= i.{asof}""")
    step(f"agg_{prefix}", f"""
SELECT id, count(*) AS n, sum(pa) AS paid, min(pd) AS first_pd, max(pd) AS last_pd, max(gap) AS max_gap,
       count(*) FILTER (WHERE gap > 90) AS n_gap90 FROM win_{prefix} GROUP BY 1""")


window_steps("pre_due", "base", "AS_OF_DATE")
step("feat", """
SELECT b.*, coalesce(a.n, 0) AS n_pay_pre_due, coalesce(a.paid, 0.0) AS amt_paid_pre_due,
       a.first_pd AS first_pay_pre_due, a.last_pd AS last_pay_pre_due,
       coalesce(a.max_gap, 0) AS max_gap_pre_due, coalesce(a.n_gap90, 0) AS count_gaps_gt_90_pre_due,
       CASE WHEN abs(TRX_AMOUNT) > 0 THEN least(greatest(coalesce(a.paid, 0.0) / abs(TRX_AMOUNT) * 100, 0), 100) ELSE 0.0 END AS paid_ratio_pre_due,
       date_diff('day', TRX_DATE, a.first_pd) AS days_trx_to_first_pay_pre_due,
       date_diff('day', a.last_pd, DUE_DATE) AS days_before_due_last_pay,
       date_diff('day', TRX_DATE, DUE_DATE) AS days_to_due,
       month(TRX_DATE) AS trx_month, isodow(TRX_DATE) - 1 AS trx_weekday
FROM base b LEFT JOIN agg_pre_due a ON a.id = b.CUSTOMER_TRX_ID""")

# ---- history -------------------------------------------------------------
step("known_pay", "SELECT * FROM pay_gaps WHERE PAYMENT_DATE <= {SNAP}")
step("bd90", """
SELECT i.CUSTOMER_TRX_ID, i.PARTY_ID, i.DUE_DATE + to_days(90) AS event_date,
       coalesce(sum(p.AMOUNT_APPLIED), 0.0) AS paid_by, any_value(i.TRX_AMOUNT) AS amount,
       CASE WHEN round(any_value(i.TRX_AMOUNT) - coalesce(sum(p.AMOUNT_APPLIED), 0.0), 6) > 0.01 THEN 1 ELSE 0 END AS flag
FROM base i LEFT JOIN known_pay p ON p.INVOICE_ID = i.CUSTOMER_TRX_ID AND p.PAYMENT_DATE <= i.DUE_DATE + to_days(90)
WHERE i.PARTY_ID IS NOT NULL AND i.TRX_DATE IS NOT NULL AND i.DUE_DATE + to_days(90) <= {SNAP}
GROUP BY 1, 2, 3""")
step("first_known", "SELECT INVOICE_ID AS id, min(PAYMENT_DATE) AS first_pay_date FROM known_pay GROUP BY 1")
step("gap90_known", "SELECT INVOICE_ID AS id, min(PAYMENT_DATE) AS gap90_date FROM known_pay WHERE gap_days > 90 GROUP BY 1")
step("late90", """
SELECT i.CUSTOMER_TRX_ID, i.PARTY_ID, f.first_pay_date AS event_date FROM base i JOIN first_known f ON f.id = i.CUSTOMER_TRX_ID
WHERE i.PARTY_ID IS NOT NULL AND date_diff('day', i.TRX_DATE, f.first_pay_date) > 90""")
step("gap90", """
SELECT i.CUSTOMER_TRX_ID, i.PARTY_ID, g.gap90_date AS event_date FROM base i JOIN gap90_known g ON g.id = i.CUSTOMER_TRX_ID
WHERE i.PARTY_ID IS NOT NULL AND i.TRX_DATE IS NOT NULL""")
step("prior_events", """
SELECT i.CUSTOMER_TRX_ID,
       (SELECT count(*) FROM bd90 e WHERE e.flag = 1 AND e.PARTY_ID = i.PARTY_ID AND e.event_date < i.TRX_DATE) AS party_prior_bd90_cnt,
       (SELECT count(*) FROM late90 e WHERE e.PARTY_ID = i.PARTY_ID AND e.event_date < i.TRX_DATE) AS party_prior_late_firstpay90_cnt,
       (SELECT count(*) FROM gap90 e WHERE e.PARTY_ID = i.PARTY_ID AND e.event_date < i.TRX_DATE) AS party_prior_gap90_cnt
FROM base i""")
step("outcome", """
SELECT *, CASE WHEN actual_dpd > 0 THEN 1 ELSE 0 END AS is_late,
       CASE WHEN is_paid = 1 AND actual_dpd <= 30 THEN 1 ELSE 0 END AS paid_within_30d,
       CASE WHEN is_paid = 1 AND actual_dpd <= 60 THEN 1 ELSE 0 END AS paid_within_60d,
       CASE WHEN is_paid = 0 OR actual_dpd > 90 THEN 1 ELSE 0 END AS bad_debt_flag
FROM (SELECT i.*, r.* EXCLUDE (CUSTOMER_TRX_ID),
             date_diff('day', i.DUE_DATE, r.last_pay_date) AS actual_dpd,
             CASE WHEN r.last_pay_date IS NOT NULL THEN 1 ELSE 0 END AS is_paid,
             CASE WHEN TRX_AMOUNT > 0 THEN least(greatest(coalesce(total_paid, 0.0) / TRX_AMOUNT, 0), 1) ELSE 0.0 END AS paid_ratio
      FROM base i LEFT JOIN receipt_agg r ON r.CUSTOMER_TRX_ID = i.CUSTOMER_TRX_ID)""")


def history_step(name: str, source: str, party: str) -> None:
    step(name, f"""
SELECT CUSTOMER_TRX_ID, row_number() OVER w - 1 AS prior_cnt,
       CASE WHEN row_number() OVER w = 1 THEN 0 ELSE date_diff('day', min(TRX_DATE) OVER (PARTITION BY {party}), TRX_DATE) END AS maturity,
       coalesce(sum(TRX_AMOUNT) OVER p, 0.0) AS scale,
       avg(CASE WHEN is_paid = 1 THEN actual_dpd END) OVER p AS avg_dpd,
       100 * avg(CASE WHEN is_paid = 1 THEN is_late END) OVER p AS late_ratio,
       CASE WHEN coalesce(sum(TRX_AMOUNT) OVER p, 0.0) > 0
            THEN sum(CASE WHEN is_paid = 0 THEN TRX_AMOUNT ELSE 0.0 END) OVER p / (sum(TRX_AMOUNT) OVER p + 1) ELSE 0.0 END AS exposure,
       avg(CASE WHEN is_paid = 1 THEN gap_variance END) OVER p AS consistency,
       100 * avg(CASE WHEN is_paid = 1 THEN is_partial END) OVER p AS partial_freq,
       avg(CASE WHEN is_paid = 1 THEN paid_ratio END) OVER p AS completion,
       coalesce(sum(greatest(TRX_AMOUNT - coalesce(total_paid, 0.0), 0.0)) OVER p, 0.0) AS outstanding,
       avg(paid_within_30d) OVER p AS p30, avg(paid_within_60d) OVER p AS p60,
       median(CASE WHEN is_paid = 1 THEN actual_dpd END) OVER p AS median_dpd,
       avg(bad_debt_flag) OVER p AS hazard
FROM {source}
WINDOW w AS (PARTITION BY {party} ORDER BY TRX_DATE NULLS LAST, CUSTOMER_TRX_ID),
       p AS (PARTITION BY {party} ORDER BY TRX_DATE NULLS LAST, CUSTOMER_TRX_ID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")


step("with_party", "SELECT * FROM outcome WHERE PARTY_ID IS NOT NULL")
history_step("hist", "with_party", "PARTY_ID")
history_step("pooled", "outcome", "coalesce(PARTY_ID, -1)")
step("history", """
SELECT i.CUSTOMER_TRX_ID, CASE WHEN i.PARTY_ID IS NULL THEN 1 ELSE 0 END AS party_missing,
       coalesce(h.prior_cnt, 0) AS party_prior_invoice_cnt,
       CASE WHEN i.PARTY_ID IS NOT NULL AND coalesce(h.prior_cnt, 0) = 0 THEN 1 ELSE 0 END AS party_is_new_customer,
       e.* EXCLUDE (CUSTOMER_TRX_ID),
       coalesce(h.maturity, 0) AS customer_maturity_days, ln(1 + greatest(coalesce(h.scale, 0.0), 0.0)) AS business_scale_proxy,
       coalesce(h.avg_dpd, 0.0) AS historical_avg_dpd, coalesce(h.late_ratio, 0.0) AS historical_late_payment_ratio,
       coalesce(h.exposure, 0.0) AS unpaid_exposure_ratio, coalesce(h.consistency, 0.0) AS payment_consistency_variance,
       coalesce(h.partial_freq, 0.0) AS historical_partial_payment_freq,
       coalesce(h.completion, 0.0) AS hist_avg_payment_completion_ratio, coalesce(h.outstanding, 0.0) AS total_outstanding_at_trx,
       coalesce(h.p30, 0.5) AS prob_paid_within_30d, coalesce(h.p60, 0.5) AS prob_paid_within_60d,
       coalesce(h.median_dpd, 0.0) AS median_payment_delay, coalesce(h.hazard, 0.0) AS hazard_approx,
       ln(1 + greatest(coalesce(i.TRX_AMOUNT, 0.0), 0.0)) AS TRX_AMOUNT_log1p
FROM base i LEFT JOIN hist h ON h.CUSTOMER_TRX_ID = i.CUSTOMER_TRX_ID
LEFT JOIN prior_events e ON e.CUSTOMER_TRX_ID = i.CUSTOMER_TRX_ID""")
step("snapshot_feat", "SELECT f.*, h.* EXCLUDE (CUSTOMER_TRX_ID) FROM feat f JOIN history h ON h.CUSTOMER_TRX_ID = f.CUSTOMER_TRX_ID")

# ---- monitoring ----------------------------------------------------------
step("base_mon", "SELECT * EXCLUDE (AS_OF_DATE), CAST({SNAP} AS TIMESTAMP) AS AS_OF_DATE_MON FROM base")
step("base_aged", "SELECT * EXCLUDE (AS_OF_DATE), least(TRX_DATE + to_days(180), CAST({SNAP} AS TIMESTAMP)) AS AS_OF_DATE_MON FROM base")
for _p, _s in (("mon", "base_mon"), ("aged", "base_aged")):
    window_steps(_p, _s, "AS_OF_DATE_MON")
    step(f"feat_{_p}", f"""
SELECT b.*, coalesce(a.n, 0) AS n_pay_mon, coalesce(a.paid, 0.0) AS amt_paid_mon, a.first_pd AS first_pay_mon, a.last_pd AS last_pay_mon,
       coalesce(a.max_gap, 0) AS max_gap_mon, coalesce(a.n_gap90, 0) AS count_gaps_gt_90_mon,
       CASE WHEN TRX_AMOUNT <> 0 THEN coalesce(a.paid, 0.0) / TRX_AMOUNT ELSE 0.0 END AS paid_ratio_mon,
       date_diff('day', TRX_DATE, a.first_pd) AS days_trx_to_first_pay_mon,
       date_diff('day', coalesce(a.last_pd, TRX_DATE), AS_OF_DATE_MON) AS days_since_last_pay_mon,
       CASE WHEN AS_OF_DATE_MON >= TRX_DATE + to_days(90) AND a.first_pd IS NULL THEN 1 ELSE 0 END AS no_payment_by_90_mon,
       CASE WHEN date_diff('day', TRX_DATE, a.first_pd) > 90 THEN 1 ELSE 0 END AS first_pay_gt_90_mon,
       date_diff('day', TRX_DATE, DUE_DATE) AS days_to_due, month(TRX_DATE) AS trx_month, isodow(TRX_DATE) - 1 AS trx_weekday,
       coalesce(TRX_DATE <= {{SNAP}} - 180, false) AS mon_observable
FROM {_s} b LEFT JOIN agg_{_p} a ON a.id = b.CUSTOMER_TRX_ID""".replace("{{SNAP}}", "{SNAP}"))

# ---- scores and published runs -------------------------------------------
def linear_sql(card) -> str:
    bias, weights = card
    terms = [str(bias)] + [
        f"(coalesce(CAST({n} AS DOUBLE), {c}) - {c}) / {s} * {w}" for n, (c, s, w) in weights.items()
    ]
    return "(" + " + ".join(terms) + ")"


def sigmoid_sql(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def level_sql(p: str) -> str:
    return f"CASE WHEN {p} >= 0.6 THEN 'HIGH' WHEN {p} >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END"


def action_sql(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items()) + " ELSE 'Unknown' END"


def scored_step(name: str, source: str, p: str) -> None:
    step(name, f"""
SELECT *, {level_sql('prob_bad_debt')} AS risk_level, {action_sql(level_sql('prob_bad_debt'))} AS recommended_action,
       abs(coalesce(TRX_AMOUNT, 0.0)) * prob_bad_debt AS expected_financial_loss
FROM (SELECT *, {p} AS prob_bad_debt FROM {source})""")


scored_step("scored", "snapshot_feat", sigmoid_sql(linear_sql(SCORECARD)))
step("rescored_p", "SELECT * EXCLUDE (prob_bad_debt, risk_level, recommended_action, expected_financial_loss), prob_bad_debt / 2 AS half FROM scored WHERE CUSTOMER_TRX_ID % 2 = 0")
scored_step("rescored", "rescored_p", "half")


def range_sql(span: str, start: str | None, end: str | None, day_col: str = "TRX_DATE") -> str:
    if span == "all":
        return f"{day_col} <= {SNAP}"
    if span == "custom":
        return f"{day_col} BETWEEN DATE '{start}' AND DATE '{end}'"
    return f"{day_col} BETWEEN {SNAP} - {COVER_DAYS[span]} AND {SNAP}"


_OUT = (
    "ACCOUNT_NUMBER, CUSTOMER_NAME, SBU, CUSTOMER_TRX_ID, TRX_DATE, DUE_DATE, days_to_due, TRX_AMOUNT_GROSS, "
    "credit_memo_reduction, TRX_AMOUNT, expected_financial_loss, prob_bad_debt, risk_level, recommended_action"
)


def _run_rows(source: str, run, at: str | None = None) -> str:
    job, model, span, start, end, published = run
    dates = [f"CAST({'NULL' if v is None else repr(v)} AS DATE)" for v in (start, end)]
    return (
        f"SELECT {_OUT}, '{job}' AS job_id, TIMESTAMP '{at or published}' AS published_at, {dates[0]} AS start_date, "
        f"{dates[1]} AS end_date, '{model}' AS model_key, {SNAP} AS snapshot_date, '{span}' AS time_range "
        f"FROM {source} WHERE {range_sql(span, start, end)}"
    )


def _published() -> None:
    from duesight.checks.store import AGAIN, RUNS

    again = next(x for x in RUNS if x[0] == AGAIN[0])
    parts = [_run_rows("scored", x) for x in RUNS] + [_run_rows("rescored", again, AGAIN[1])]
    step("pub", "\nUNION ALL ".join(parts))
    risk = []
    for job, model, span, start, end, published in RUNS:
        name = job.replace("-", "_")
        step(f"risk_{name}_rows", f"SELECT * FROM scored WHERE {range_sql(span, start, end)}")
        step(f"risk_{name}", risk_sql(f"risk_{name}_rows"))
        dates = [f"CAST({'NULL' if v is None else repr(v)} AS DATE)" for v in (start, end)]
        risk.append(
            f"SELECT *, '{job}' AS job_id, TIMESTAMP '{published}' AS published_at, {dates[0]} AS start_date, {dates[1]} AS end_date, "
            f"'{model}' AS model_key, {SNAP} AS snapshot_date, '{span}' AS time_range FROM risk_{name}"
        )
    step("pub_risk", "\nUNION ALL ".join(risk))


def risk_sql(source: str) -> str:
    return f"""
SELECT *, {level_sql('cust_score_max')} AS risk_cust FROM (
SELECT PARTY_ID, ACCOUNT_NUMBER, CUSTOMER_NAME, max(prob_bad_debt) AS cust_score_max, avg(prob_bad_debt) AS cust_score_mean,
       CASE WHEN sum(abs(coalesce(TRX_AMOUNT, 0.0))) > 0
            THEN sum(coalesce(prob_bad_debt, 0.0) * abs(coalesce(TRX_AMOUNT, 0.0))) / sum(abs(coalesce(TRX_AMOUNT, 0.0)))
            ELSE avg(coalesce(prob_bad_debt, 0.0)) END AS cust_score_wavg_amount,
       count(DISTINCT CUSTOMER_TRX_ID) AS invoice_cnt, coalesce(sum(TRX_AMOUNT), 0.0) AS total_amount,
       coalesce(sum(amt_paid_pre_due), 0.0) AS total_amt_paid_pre_due,
       CASE WHEN sum(abs(coalesce(TRX_AMOUNT, 0.0))) > 0
            THEN coalesce(sum(amt_paid_pre_due), 0.0) / sum(abs(coalesce(TRX_AMOUNT, 0.0))) * 100 END AS paid_ratio_pre_due_total,
       avg(paid_ratio_pre_due) AS paid_ratio_pre_due_mean,
       avg(CASE WHEN count_gaps_gt_90_pre_due > 0 THEN 1.0 ELSE 0.0 END) * 100 AS pct_invoices_gap_gt_90_pre_due,
       arg_min(party_prior_invoice_cnt, CUSTOMER_TRX_ID) AS party_prior_invoice_cnt,
       arg_min(party_prior_gap90_cnt, CUSTOMER_TRX_ID) AS party_prior_gap90_cnt,
       CAST(NULL AS DOUBLE) AS party_prior_gap90_rate
FROM {source} GROUP BY 1, 2, 3)"""


_published()
step("cust_risk", risk_sql("scored"))
step("stacked_rows", "SELECT * FROM pub WHERE model_key = 'stacked'")
step("publications", """
SELECT job_id, time_range, snapshot_date, published_at, start_date, end_date, count(*) AS total_invoices,
       CASE time_range """ + " ".join(f"WHEN '{k}' THEN {v}" for k, v in COVER_DAYS.items()) + """ ELSE 0 END AS days
FROM stacked_rows GROUP BY 1, 2, 3, 4, 5, 6""")


def latest_sql(rows: str) -> str:
    return (
        f"SELECT * FROM ({rows}) QUALIFY row_number() OVER "
        "(PARTITION BY CUSTOMER_TRX_ID ORDER BY published_at DESC, job_id DESC) = 1"
    )


def answering_sql(span: str, start: str | None = None, end: str | None = None) -> str:
    """Newest rows of the newest covering publication, cut to the range of the request."""
    if span == "custom":
        cover = f"time_range = 'custom' AND start_date = DATE '{start}' AND end_date = DATE '{end}'"
        cut = f"TRX_DATE BETWEEN DATE '{start}' AND DATE '{end}'"
    else:
        cover = f"days >= {COVER_DAYS[span]}"
        cut = "true" if span == "all" else f"TRX_DATE >= {SNAP} - {COVER_DAYS[span]}"
    job = f"(SELECT job_id FROM publications WHERE {cover} ORDER BY published_at DESC, job_id LIMIT 1)"
    return latest_sql(f"SELECT * FROM stacked_rows WHERE job_id = {job} AND {cut}")
