"""The shared tables seen as a merchant's books, as DataFrames and as the same SQL."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.calendar import calendar
from tallyspark.functions.money import GST_PERCENT, MDR_BPS, TDS_BPS, with_fees

#: Days of the calendar before the first payment and after the last one: more than any settlement takes.
MARGIN_DAYS = 31
METHODS = ("upi", "card_credit", "netbanking", "wallet", "card_debit")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar around the dates of all payments."""
    ends = table(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b")).first()
    today = date(2000, 1, 1)
    margin = timedelta(days=MARGIN_DAYS)
    return calendar(spark, str((ends["a"] or today) - margin), str((ends["b"] or today) + margin))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as payments: a date, whole paise, and a method by priority."""
    orders = table(spark, sf_dir, "orders")
    method = F.get(F.array(*map(F.lit, METHODS)), F.try_to_number(F.substring("o_orderpriority", 1, 1), F.lit("9")).cast("int") - 1)
    return orders.select(
        F.col("o_orderkey").alias("key"),
        F.concat(F.lit("pay_"), "o_orderkey").alias("payment_id"),
        F.concat(F.lit("order_"), "o_orderkey").alias("reference"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("counterparty"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_paise"),
        F.col("o_orderdate").cast("date").alias("occurred_on"),
        F.coalesce(method, F.lit("unknown")).alias("method"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as invoices, with rows that are missing, off by a paisa, or without a reference."""
    rows = payments(spark, sf_dir).where("key % 23 != 0")
    return rows.select(
        "key",
        F.concat(F.lit("inv_"), "key").alias("invoice_id"),
        F.when(F.col("key") % 29 != 0, F.col("reference")).alias("reference"),
        F.concat(F.lit("M/S "), F.upper("counterparty"), F.lit(" Pvt. Ltd.")).alias("counterparty"),
        (F.col("amount_paise") + F.when(F.col("key") % 17 == 0, 1).otherwise(0)).alias("amount_paise"),
        "occurred_on",
    )


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments with their fees and the date they settle on."""
    due = F.broadcast(days(spark, sf_dir).select(F.col("ds").alias("occurred_on"), "settles_on", "win_low", "win_high"))
    return with_fees(payments(spark, sf_dir)).join(due, "occurred_on")


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by settlement date."""
    sums = (F.sum(c).cast("long").alias(c) for c in ("amount_paise", "mdr_paise", "gst_paise", "tds_paise", "net_paise"))
    return settled(spark, sf_dir).groupBy("settles_on").agg(F.count(F.lit(1)).alias("member_count"), *sums)


def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the bank shows for each settlement date, with damage by the date's number: late, short, held back, split in two."""
    sums = expected(spark, sf_dir).withColumn("n", F.datediff("settles_on", F.lit("1970-01-01").cast("date")))
    late = days(spark, sf_dir).where("is_open").select(F.col("ds").alias("settles_on"), F.col("bd_ord"))
    after = late.select((F.col("bd_ord") - 1).alias("bd_ord"), F.col("settles_on").alias("next_open"))
    rows = sums.join(F.broadcast(late.join(after, "bd_ord").drop("bd_ord")), "settles_on")
    amount = F.expr("CASE WHEN n % 13 = 1 THEN net_paise - amount_paise div 20 WHEN n % 13 = 2 THEN net_paise - amount_paise div 100 WHEN n % 13 = 3 THEN net_paise - amount_paise div 10 ELSE net_paise END")
    whole = rows.select("settles_on", F.when(F.expr("n % 11 = 0"), F.col("next_open")).otherwise(F.col("settles_on")).alias("landed_on"), amount.cast("long").alias("whole_paise"), F.expr("n % 7 = 0").alias("split"))
    parts = F.when(F.col("split"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    paise = F.expr("CASE WHEN NOT split THEN whole_paise WHEN part = 1 THEN whole_paise div 3 ELSE whole_paise - whole_paise div 3 END")
    out = whole.withColumn("part", F.explode(parts))
    credit = F.concat(F.lit("cr_"), F.date_format("settles_on", "yyyyMMdd"), F.lit("_"), F.col("part").cast("string"))
    return out.select(credit.alias("credit_id"), "settles_on", "landed_on", paise.alias("amount_paise"))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments(spark, sf_dir).groupBy(F.col("occurred_on").alias("ds")).agg(F.sum("amount_paise").alias("v"))


def labelled_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as claims: a confidence in whole hundredths, and whether it was right."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    confidence = (1 - (F.col("n_chars") % 50).cast("decimal(10,2)") / 100).cast("decimal(10,2)")
    return labels.join(docs, "doc_id").select("doc_id", confidence.alias("confidence"), (F.col("quality") == 1).alias("correct"), (F.col("n_chars") * 100).alias("amount_paise"))


_RATES = " ".join(f"WHEN '{m}' THEN {b}" for m, b in MDR_BPS.items())
_METHOD = " ".join(f"WHEN '{k}' THEN '{m}'" for k, m in enumerate(METHODS, 1))
#: The same in DuckDB's SQL: with-clauses that queries' oracles start with.
SQL = f"""
ends0 AS (SELECT min(o_orderdate)::DATE - {MARGIN_DAYS} AS a, max(o_orderdate)::DATE + {MARGIN_DAYS} AS b FROM orders),
days0 AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS ds FROM ends0),
days1 AS (SELECT ds, CASE WHEN isodow(ds) = 7 THEN 'Sunday'
  WHEN isodow(ds) = 6 AND (day(ds) + 6) // 7 IN (2, 4) THEN CASE WHEN (day(ds) + 6) // 7 = 2 THEN '2nd' ELSE '4th' END || ' Saturday (Indian banks closed)'
  WHEN strftime(ds, '%m-%d') IN ('01-26', '04-01', '08-15', '10-02') THEN 'bank holiday' END AS why_closed FROM days0),
days2 AS (SELECT ds, why_closed IS NULL AS is_open, why_closed, sum((why_closed IS NULL)::INT) OVER (ORDER BY ds)::INT AS bd_ord FROM days1),
days AS (SELECT d.ds, d.is_open, d.why_closed, d.bd_ord, s.ds AS settles_on, l.ds AS win_low, h.ds AS win_high FROM days2 d
  LEFT JOIN days2 s ON s.is_open AND s.bd_ord = d.bd_ord + (NOT d.is_open)::INT + 2
  LEFT JOIN days2 l ON l.is_open AND l.bd_ord = d.bd_ord + (NOT d.is_open)::INT + 1
  LEFT JOIN days2 h ON h.is_open AND h.bd_ord = d.bd_ord + (NOT d.is_open)::INT + 3),
payments AS (SELECT o_orderkey AS key, 'pay_' || o_orderkey AS payment_id, 'order_' || o_orderkey AS reference, 'Customer ' || o_custkey AS counterparty,
  round(o_totalprice * 100)::BIGINT AS amount_paise, o_orderdate::DATE AS occurred_on, CASE o_orderpriority[1] {_METHOD} ELSE 'unknown' END AS method FROM orders),
invoices AS (SELECT key, 'inv_' || key AS invoice_id, CASE WHEN key % 29 <> 0 THEN reference END AS reference,
  'M/S ' || upper(counterparty) || ' Pvt. Ltd.' AS counterparty, amount_paise + CASE WHEN key % 17 = 0 THEN 1 ELSE 0 END AS amount_paise, occurred_on FROM payments WHERE key % 23 <> 0),
fees1 AS (SELECT *, (amount_paise * CASE method {_RATES} END + 5000) // 10000 AS mdr_paise, (amount_paise * {TDS_BPS} + 5000) // 10000 AS tds_paise FROM payments),
fees2 AS (SELECT *, (mdr_paise * {GST_PERCENT} + 50) // 100 AS gst_paise FROM fees1),
settled AS (SELECT f.*, amount_paise - mdr_paise - gst_paise - tds_paise AS net_paise, d.settles_on, d.win_low, d.win_high FROM fees2 f JOIN days d ON d.ds = f.occurred_on),
expected AS (SELECT settles_on, count(*) AS member_count, sum(amount_paise)::BIGINT AS amount_paise, sum(mdr_paise)::BIGINT AS mdr_paise, sum(gst_paise)::BIGINT AS gst_paise,
  sum(tds_paise)::BIGINT AS tds_paise, sum(net_paise)::BIGINT AS net_paise FROM settled GROUP BY settles_on),
whole AS (SELECT e.settles_on, CASE WHEN n % 11 = 0 THEN b.ds ELSE e.settles_on END AS landed_on,
  CASE n % 13 WHEN 1 THEN net_paise - amount_paise // 20 WHEN 2 THEN net_paise - amount_paise // 100 WHEN 3 THEN net_paise - amount_paise // 10 ELSE net_paise END AS whole_paise, n % 7 = 0 AS split
  FROM (SELECT *, datediff('day', DATE '1970-01-01', settles_on) AS n FROM expected) e JOIN days a ON a.ds = e.settles_on JOIN days b ON b.is_open AND b.bd_ord = a.bd_ord + 1),
credits AS (SELECT 'cr_' || strftime(settles_on, '%Y%m%d') || '_' || part AS credit_id, settles_on, landed_on,
  CASE WHEN NOT split THEN whole_paise WHEN part = 1 THEN whole_paise // 3 ELSE whole_paise - whole_paise // 3 END AS amount_paise
  FROM whole, (SELECT unnest([1, 2]) AS part) WHERE split OR part = 1)"""
