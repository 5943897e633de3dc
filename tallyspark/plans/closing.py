"""Further queries of a close, with their oracle SQL; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import calendar as cal
from tallyspark.functions import money, text
from tallyspark.operators import attribution, audit, blocking, calibration, evaluation, exceptions, forecast, matching, waterfall
from tallyspark.plans import adapters as ad
from tallyspark.plans.catalogue import _CLAIMS, _REQUEST, _SERIES, _SETTLEMENTS, _SINGLE, _exceptions, _payments_due, _settlements, exact_key_match, query

# --- settlements against bank lines -----------------------------------------

#: Gateway settlements and bank lines made of orders: some lines repeat a reference, differ by a paisa, or land late.
_LINES = """, gw AS (SELECT 'setl_' || printf('%012d', key) AS settlement_id, (200000000000 + key - CASE WHEN key % 23 = 1 THEN 1 ELSE 0 END)::VARCHAR AS utr, amount_paise, occurred_on FROM payments),
bank AS (SELECT 'bank_' || key || '_' || c AS line_id, (200000000000 + key)::VARCHAR AS utr, amount_paise + CASE WHEN key % 17 = 0 THEN 1 ELSE 0 END AS amount_paise, occurred_on + (key % 9)::INT AS value_date
  FROM payments, (SELECT unnest([1, 2]) AS c) WHERE c = 1 OR key % 19 = 0)"""


def _lines(spark, d):
    rows = ad.payments(spark, d).select("key", "amount_paise", "occurred_on")
    number = F.lit(200000000000) + F.col("key")
    gateway = rows.select(
        F.format_string("setl_%012d", "key").alias("settlement_id"), F.concat(F.lit("NEFT-HDFC"), (number - (F.col("key") % 23 == 1).cast("int")).cast("string")).alias("reference"), F.col("amount_paise").alias("settled_paise"), "occurred_on"
    )
    bank = rows.withColumn("c", F.explode(F.when(F.col("key") % 19 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    bank = bank.select(
        F.concat_ws("_", F.lit("bank"), F.col("key").cast("string"), F.col("c").cast("string")).alias("line_id"), number.cast("string").alias("utr"),
        (F.col("amount_paise") + (F.col("key") % 17 == 0).cast("int")).alias("amount_paise"), F.expr("date_add(occurred_on, CAST(key % 9 AS INT))").alias("value_date"),
    )
    return gateway, bank


@query(f"""{_LINES}, lone AS (SELECT utr FROM bank GROUP BY utr HAVING count(*) = 1),
ok AS (SELECT g.settlement_id, b.line_id, b.utr, (y.bd_ord - x.bd_ord)::INT AS lag_days FROM gw g JOIN bank b ON b.utr = g.utr JOIN lone l ON l.utr = b.utr JOIN days x ON x.ds = g.occurred_on JOIN days y ON y.ds = b.value_date
  WHERE b.amount_paise = g.amount_paise AND y.bd_ord - x.bd_ord BETWEEN 0 AND 2)
SELECT settlement_id, line_id, utr, lag_days FROM ok QUALIFY row_number() OVER (PARTITION BY utr ORDER BY settlement_id) = 1""")
def settlement_utr_match(spark, d):
    """Settlements and the only bank line of their reference, of the same amount and at most two open days later."""
    gateway, bank = _lines(spark, d)
    days = F.broadcast(ad.days(spark, d).select(F.col("ds").alias("_ds"), F.col("bd_ord").alias("_ord")))
    left = gateway.withColumn("utr", text.normal_reference("reference")).join(days, F.col("occurred_on") == F.col("_ds")).withColumnRenamed("_ord", "_from").drop("_ds")
    right = bank.join(days, F.col("value_date") == F.col("_ds")).withColumnRenamed("_ord", "_to").drop("_ds")
    accept = (F.col("amount_paise") == F.col("settled_paise")) & (F.col("_to") - F.col("_from")).between(0, 2)
    return matching.first_accepted(left, right, "settlement_id", ["utr"], accept).select("settlement_id", "line_id", "utr", (F.col("_to") - F.col("_from")).alias("lag_days"))


@query("""SELECT payment_id, 'win:' || d AS key FROM (SELECT payment_id, unnest(generate_series(win_low, win_high, INTERVAL 1 DAY))::DATE AS d FROM settled WHERE win_low IS NOT NULL AND win_high IS NOT NULL)
UNION ALL SELECT credit_id, 'win:' || (landed_on + n::INT) FROM credits, (SELECT unnest([-2, -1, 0, 1, 3]) AS n)""")
def window_date_keys(spark, d):
    """The dates on which payments and credits may meet, as blocking keys."""
    p = ad.settled(spark, d).select("payment_id", F.col("occurred_on").alias("day"), "win_low", "win_high", F.lit(False).alias("settled"))
    none = F.lit(None).cast("date")
    c = ad.credits(spark, d).select(F.col("credit_id").alias("payment_id"), F.col("landed_on").alias("day"), none.alias("win_low"), none.alias("win_high"), F.lit(True).alias("settled"))
    return p.unionByName(c).select("payment_id", F.explode(blocking.window_keys("day", "win_low", "win_high", "settled")).alias("key"))


@query(f"""{_SINGLE}, members AS (SELECT s.payment_id, g.credit_id, s.settles_on = g.landed_on AS on_time, s.amount_paise, s.net_paise, g.target_paise FROM settled s JOIN single g ON g.landed_on = s.settles_on WHERE g.attributed),
paid AS (SELECT payment_id, invoice_id FROM payments JOIN invoices USING (reference, amount_paise)),
sums AS (SELECT credit_id, count(*) AS member_count, count(*) FILTER (on_time) AS on_time, sum(amount_paise)::BIGINT AS gross_paise, (sum(amount_paise) - any_value(target_paise))::BIGINT AS explained_paise, (sum(amount_paise) - sum(net_paise))::BIGINT AS withheld_paise FROM members GROUP BY credit_id),
inv AS (SELECT credit_id, count(DISTINCT invoice_id) AS invoice_count, min(invoice_id) AS first_invoice, max(invoice_id) AS last_invoice FROM members JOIN paid USING (payment_id) GROUP BY credit_id)
SELECT credit_id, member_count, on_time, gross_paise, coalesce(invoice_count, 0) AS invoice_count, first_invoice, last_invoice,
  round(0.5 + 0.3 * on_time / member_count + 0.17 * greatest(0.0::DOUBLE, 1 - least(abs(explained_paise - withheld_paise), greatest(gross_paise * 6 // 100, 1)) / greatest(gross_paise * 6 // 100, 1)::DOUBLE) + 0.02, 4) AS confidence
FROM sums LEFT JOIN inv USING (credit_id)""")
def match_groups(spark, d):
    """Each settled credit with its members, how many came on time, the invoices that they pay, and its confidence."""
    single = attribution.by_single_credit(_payments_due(spark, d), ad.credits(spark, d)).where("attributed").select(F.col("landed_on").alias("settles_on"), "credit_id", "target_paise", "landed_on")
    members = _payments_due(spark, d).join(single, "settles_on")
    groups = attribution.groups(members, exact_key_match(spark, d))
    return groups.select(
        "credit_id", "member_count", "on_time", "gross_paise", F.size("invoice_ids").cast("long").alias("invoice_count"), F.array_min("invoice_ids").alias("first_invoice"), F.array_max("invoice_ids").alias("last_invoice"), "confidence"
    )


@query(f"""{_SETTLEMENTS}, back AS (SELECT occurred_on + 2 AS settled_on, sum(amount_paise // 10)::BIGINT AS refunds_paise FROM payments WHERE key % 50 = 0 GROUP BY ALL)
SELECT settlement_id, settled_on, coalesce(b.refunds_paise, 0)::BIGINT AS refunds_paise, net_received_paise - (gross_paise - mdr_paise - gst_paise - tds_paise - coalesce(b.refunds_paise, 0)) AS residual_before_naming_paise FROM settlements LEFT JOIN back b USING (settled_on)""")
def refunds_in_settlements(spark, d):
    """Refunds that fall on a settlement's date are taken off what it should bring."""
    single = attribution.by_single_credit(_payments_due(spark, d), ad.credits(spark, d)).where("attributed").select("landed_on", F.col("credit_id").alias("settlement_id"), F.col("target_paise").alias("net_received_paise"))
    members = ad.payments(spark, d).join(ad.settled(spark, d).select("payment_id", "settles_on"), "payment_id").join(single.select(F.col("landed_on").alias("settles_on"), "settlement_id"), "settles_on")
    refunds = ad.payments(spark, d).where("key % 50 = 0").select(F.date_add("occurred_on", 2).alias("landed_on"), F.expr("amount_paise div 10").alias("amount_paise"))
    refunds = waterfall.refunds_by_date(refunds, single.select("landed_on", "settlement_id"), "landed_on")
    fallen = waterfall.settle(waterfall.totals(members, "settlement_id", refunds), single.select("settlement_id", F.col("landed_on").alias("settled_on"), "net_received_paise"), "settlement_id")
    return fallen.select("settlement_id", "settled_on", "refunds_paise", "residual_before_naming_paise")


@query(f"""{_SETTLEMENTS} SELECT settlement_id, mdr_paise AS fee_mdr, gst_paise AS gst_on_fee, tds_paise AS tds_194o, abs(rest) AS remainder FROM settlements""")
def component_sums(spark, d):
    """A settlement's lines back in one row: the absolute sum of each component, those of the remainder together."""
    rows = waterfall.lines(_settlements(spark, d), "settlement_id")
    return waterfall.component_sums(rows, "settlement_id").select("settlement_id", "fee_mdr", "gst_on_fee", "tds_194o", "remainder")


@query(f"""{_SINGLE} SELECT credit_id AS settlement_id, method AS main_method FROM (SELECT g.credit_id, s.method, sum(s.amount_paise) AS gross FROM settled s JOIN single g ON g.landed_on = s.settles_on WHERE g.attributed GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY credit_id ORDER BY gross DESC, method) = 1""")
def main_methods(spark, d):
    return _settlements(spark, d).select("settlement_id", "main_method")


# --- how good the run is ----------------------------------------------------


@query("""SELECT source, count(*) AS n, sum(signed)::BIGINT AS total_paise FROM (SELECT 'gateway' AS source, amount_paise AS signed FROM payments UNION ALL SELECT 'ledger', -amount_paise FROM invoices UNION ALL SELECT 'bank', amount_paise FROM credits) GROUP BY source""")
def source_totals(spark, d):
    """Rows and signed sums by source; what invoices ask for counts against what came in."""
    parts = [ad.payments(spark, d).select(F.lit("gateway").alias("source"), F.col("amount_paise").alias("signed")), ad.invoices(spark, d).select(F.lit("ledger"), -F.col("amount_paise")), ad.credits(spark, d).select(F.lit("bank"), "amount_paise")]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("signed").cast("long").alias("total_paise"))


@query("""SELECT rows, matched, residue, posted, posted_right, claims, round(matched / rows, 6) AS match_rate, round(residue / rows, 6) AS residue_rate, round(posted / claims, 6) AS post_coverage, round(posted_right / posted, 6) AS post_precision FROM (
  SELECT (SELECT count(*) FROM payments) + (SELECT count(*) FROM invoices) AS rows, 2 * m AS matched, (SELECT count(*) FROM payments) + (SELECT count(*) FROM invoices) - 2 * m AS residue, m AS posted, good AS posted_right,
    (SELECT count(*) FROM payments JOIN invoices USING (key)) AS claims FROM (SELECT count(*) AS m, count(*) FILTER (p.key = i.key) AS good FROM payments p JOIN invoices i USING (reference, amount_paise)))""")
def run_metrics(spark, d):
    """Match, residue and posting rates of the exact stage over payments and invoices."""
    p, i = ad.payments(spark, d), ad.invoices(spark, d)
    rows = p.select(F.col("payment_id").alias("row_id")).unionByName(i.select(F.col("invoice_id").alias("row_id")))
    found = exact_key_match(spark, d).toDF("left_id", "right_id")
    matched = found.select(F.col("left_id").alias("row_id")).union(found.select("right_id"))
    truth = p.select("key", F.col("payment_id").alias("left_id")).join(i.select("key", F.col("invoice_id").alias("right_id")), "key").select("left_id", "right_id")
    return evaluation.run_metrics(rows, matched, found, truth, matching.unmatched(rows, matched, "row_id"))


@query("""SELECT key, (200 * greatest(n * 500 + e * 3000 - (m * 3000 + r * 2000), 0) + 45000 + (x * 5 + 50) // 100) // (2 * (45000 + (x * 5 + 50) // 100)) / 100 AS break_even FROM (SELECT key, key % 500 AS n, key % 40 AS e, key % 11 AS r, key % 7 AS m, amount_paise AS x FROM payments)""")
def break_even(spark, d):
    rows = ad.payments(spark, d).selectExpr("key", "key % 500 AS rows", "key % 40 AS exceptions", "key % 11 AS reviews", "key % 7 AS missed", "amount_paise AS exposed_paise")
    return evaluation.break_even(rows).select("key", "break_even")


@query("""SELECT "case", e AS exceptions_per_day, e * m AS minutes_per_day, e * m * h / 60::DOUBLE AS cost_per_day, e * m * h / 60::DOUBLE * d AS cost_per_month, e * m * h / 60::DOUBLE * d * 12 AS cost_per_year FROM (
  SELECT "case", t * p / 100::DOUBLE AS e, m, h, d FROM (VALUES ('low', 200, 2, 2, 400, 22), ('base', 600, 5, 4, 600, 24), ('high', 2000, 10, 8, 1000, 26)) v("case", t, p, m, h, d))""", books=False)
def problem_size(spark, d):
    return evaluation.problem_size(spark)


@query(_CLAIMS.format(alphas=", ".join(map(str, calibration.alpha_grid()))).replace("SELECT alpha, b.c", "SELECT alpha, (b.e * 47500 + (total - b.a) * 2000)::BIGINT AS cost_paise, b.c").replace("FROM t", "FROM t WHERE b IS NOT NULL ORDER BY cost_paise, alpha LIMIT 1"), books=False)
def best_alpha(spark, d):
    """The bound whose threshold costs least, a wrong post and a review priced, the smallest of equals."""
    rows = calibration.calibrate(ad.labelled_claims(spark, d), calibration.alpha_grid())
    return calibration.best_point(rows, 47_500, 2_000)


@query(f"{_SETTLEMENTS} SELECT exception_id, exception_type, severity, amount_paise FROM exceptions WHERE exception_type = 'missing_in_ledger' ORDER BY abs(amount_paise) DESC, exception_id LIMIT 20")
def exception_list(spark, d):
    return exceptions.listed(_exceptions(spark, d), kind="missing_in_ledger", limit=20).select("exception_id", "exception_type", "severity", "amount_paise")


@query(f"{_SETTLEMENTS}, r AS (SELECT exception_id AS row_id, row_number() OVER (ORDER BY exception_id) AS k FROM exceptions) SELECT row_id, CASE WHEN k <= 50 THEN 'model' ELSE 'rule' END AS route FROM r")
def residue_routes(spark, d):
    """The first 50 rows of the residue go to a model, the others are typed by rule."""
    return exceptions.routed(_exceptions(spark, d).select(F.col("exception_id").alias("row_id")))


# --- calendar and cash ------------------------------------------------------


@query("""SELECT ds, least(ds - coalesce(max(CASE WHEN is_open THEN ds END) OVER (ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), (SELECT min(ds) - 1 FROM days)) - 1, 10)::INT AS closed_before,
  (count(*) FILTER (is_open) OVER (PARTITION BY date_trunc('week', ds)))::INT AS open_in_week FROM days""")
def calendar_closures(spark, d):
    return cal.with_closures(ad.days(spark, d)).select("ds", "closed_before", "open_in_week")


@query("""WITH r AS (SELECT unnest(generate_series(DATE '2026-01-05', DATE '2026-01-05' + 90, INTERVAL 1 DAY))::DATE AS d)
SELECT d AS due_on, 9000000 AS amount_paise, 'monthly payroll' AS label FROM r WHERE d = last_day(d) UNION ALL SELECT d, 1800000, 'GST return' FROM r WHERE day(d) = 20 UNION ALL SELECT d, 450000, 'TDS deposit' FROM r WHERE day(d) = 7""", books=False)
def commitments(spark, d):
    return forecast.commitments(spark, "2026-01-05", 90, 9_000_000)


@query(f"""{_SERIES}, p AS (SELECT ds, v, lag(v, 7) OVER (ORDER BY ds) AS point, percent_rank() OVER (ORDER BY ds) <= 0.75 AS fit FROM series), q AS (SELECT * FROM p WHERE point IS NOT NULL),
e AS (SELECT abs(v - point) AS e, row_number() OVER (ORDER BY abs(v - point)) AS k, count(*) OVER () AS n FROM q WHERE fit), w AS (SELECT min(e) AS w FROM e WHERE k >= least(ceil((n + 1) * 0.9), n)),
b AS (SELECT v, point - w AS lower, point + w AS upper FROM q, w WHERE NOT fit), s AS (SELECT count(*) AS n, count(*) FILTER (v BETWEEN lower AND upper) AS held, round(avg(upper - lower), 6) AS mean_width FROM b)
SELECT n, held, mean_width, round(held / n, 6) AS coverage, round(sqrt(held / n * (1 - held / n) / n), 6) AS standard_error FROM s""")
def band_coverage(spark, d):
    """How many days of the last quarter the bands hold that the days before them set."""
    return forecast.coverage(forecast.held_out_bands(forecast.spine(ad.daily_orders(spark, d))))


@query("""SELECT key, CASE key % 4 WHEN 0 THEN occurred_on::TIMESTAMP - INTERVAL '5 hours 30 minutes' WHEN 1 THEN occurred_on::TIMESTAMP + INTERVAL '13 hours' WHEN 2 THEN occurred_on::TIMESTAMP + INTERVAL '13 hours' END AS at,
  occurred_on::TIMESTAMP - INTERVAL '5 hours 30 minutes' AS day_start, occurred_on::TIMESTAMP + INTERVAL '18 hours 30 minutes' AS day_end FROM payments""")
def timestamps_with_zone(spark, d):
    """Times with and without an offset in one column, and the instants between which a date lies."""
    day, k = F.date_format("occurred_on", "yyyy-MM-dd"), F.col("key") % 4
    raw = F.when(k == 0, day).when(k == 1, F.concat(day, F.lit(" 18:30:00"))).when(k == 2, F.concat(day, F.lit("T18:30:00+05:30"))).otherwise("soon")
    bounds = cal.day_bounds("occurred_on")
    rows = ad.payments(spark, d).select("key", cal.zoned_timestamp(raw).alias("at"), bounds["start"].alias("day_start"), bounds["end"].alias("day_end"))
    return rows.select("key", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("at", "day_start", "day_end")))


@query(f"""SELECT row_number() OVER (ORDER BY key) - 1 AS seq, key, 'entry ' || key AS record FROM (SELECT key, {_REQUEST} FROM payments) WHERE currency = 'INR'""")
def log_numbers(spark, d):
    """Records of a log, numbered densely in the order of their keys."""
    rows = ad.payments(spark, d).where("key % 37 != 0").select("key", F.concat(F.lit("entry "), F.col("key").cast("string")).alias("record"))
    return audit.numbered(rows, "key").select("seq", "key", "record")


@query("SELECT ds, is_open::INT AS is_open, " + ", ".join(f"(isodow(ds) = {k + 1})::INT AS weekday_{k}" for k in range(6)) + """, day(ds)::INT AS day_of_month, (day(ds) <= 3)::INT AS month_start, (ds = last_day(ds))::INT AS month_end,
  (day(ds) <= 3 OR (ds = last_day(ds) AND is_open))::INT AS salary_window, (day(ds) BETWEEN 19 AND 21 OR day(ds) = 7)::INT AS gst_window,
  least(ds - coalesce(max(CASE WHEN is_open THEN ds END) OVER (ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), (SELECT min(ds) - 1 FROM days)) - 1, 10)::INT AS closed_before,
  (count(*) FILTER (is_open) OVER (PARTITION BY date_trunc('week', ds)))::INT AS open_in_week FROM days""")
def calendar_all_features(spark, d):
    return cal.all_features(ad.days(spark, d))


@query("""SELECT payment_id, n.next_open, t.ds AS in_five FROM payments p JOIN (SELECT ds, bd_ord + (NOT is_open)::INT + 5 AS o, min(CASE WHEN is_open THEN ds END) OVER (ORDER BY ds ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_open FROM days) n ON n.ds = p.occurred_on
LEFT JOIN days t ON t.is_open AND t.bd_ord = n.o""")
def open_days_ahead(spark, d):
    days = ad.days(spark, d)
    rows = cal.add_open_days(ad.payments(spark, d).select("payment_id", "occurred_on"), days, "occurred_on", 5, "in_five")
    return rows.join(F.broadcast(cal.next_open(days).select(F.col("ds").alias("occurred_on"), "next_open")), "occurred_on").select("payment_id", "next_open", "in_five")


@query("SELECT key, target - (target * 6 // 100 + 100) <= amount_paise AND amount_paise <= target + 100 AS fits, amount_paise - (amount_paise - target) = target AS conserved FROM (SELECT key, amount_paise, amount_paise + (key % 9)::BIGINT * amount_paise // 100 - 50 AS target FROM payments)")
def sums_within_tolerance(spark, d):
    rows = ad.payments(spark, d).selectExpr("key", "amount_paise", "amount_paise + (key % 9) * amount_paise div 100 - 50 AS target")
    a, t = F.col("amount_paise"), F.col("target")
    return rows.select("key", money.within_rate(a, t).alias("fits"), money.conserved(a, a - t, t).alias("conserved"))
