"""Made-up books with known truth: three sources from hashed row numbers, with late, short, missing and copied rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.calendar import calendar
from tallyspark.functions.money import MDR_BPS, with_fees

METHODS = tuple(m for m in sorted(MDR_BPS) if m not in ("unknown", "bank_transfer"))


def _draw(name: str, below: int, seed: int) -> Column:
    """A number that a row's own id decides."""
    return F.pmod(F.xxhash64(F.lit(name), F.lit(seed), "id"), F.lit(below))


def generate(spark: SparkSession, days: int = 21, per_day: int = 14, first: str = "2026-01-05", seed: int = 20260101) -> dict[str, DataFrame]:
    """payments, invoices, credits and truth (payment_id, invoice_id, credit_id; nulls where a side is missing).

    One invoice in 23 is missing and one in 19 lacks its reference; one payment
    in 24 has a copy; credits, one for each settlement date, are missing, short
    of a reserve of 5 %, or held back by 1 % in turn.
    """
    ids = spark.range(days * per_day)
    payments = ids.select(
        F.concat(F.lit("pay_"), "id").alias("payment_id"),
        F.concat(F.lit("order_"), "id").alias("reference"),
        F.concat(F.lit("Firm "), _draw("firm", 400, seed).cast("string"), F.lit(" Traders")).alias("counterparty"),
        (4_900 + _draw("amount", 2_000_000, seed)).alias("amount_paise"),
        F.date_add(F.lit(first).cast("date"), F.floor(F.col("id") / per_day).cast("int")).alias("occurred_on"),
        F.get(F.array(*map(F.lit, METHODS)), _draw("method", len(METHODS), seed).cast("int")).alias("method"),
        _draw("copy", 24, seed).alias("_copy"),
        _draw("invoice", 23, seed).alias("_gone"),
        _draw("blank", 19, seed).alias("_blank"),
    )
    end = spark.sql(f"SELECT date_add(DATE '{first}', {days + 40}) AS d").first()["d"].isoformat()
    calendar_days = calendar(spark, first, end)
    due = payments.join(F.broadcast(calendar_days.select(F.col("ds").alias("occurred_on"), "settles_on")), "occurred_on")
    sums = with_fees(due).groupBy("settles_on").agg(F.sum("amount_paise").alias("gross"), F.sum("net_paise").alias("net"))
    turn = F.pmod(F.xxhash64("settles_on", F.lit(seed)), F.lit(9))
    amount = F.when(turn == 1, F.expr("net - gross div 20")).when(turn == 2, F.expr("net - gross div 100")).otherwise(F.col("net"))
    credits = sums.where(turn != 0).select(F.concat(F.lit("cr_"), F.date_format("settles_on", "yyyyMMdd")).alias("credit_id"), F.col("settles_on").alias("landed_on"), amount.cast("long").alias("amount_paise"))
    invoices = payments.where("_gone != 0").select(
        F.concat(F.lit("inv_"), F.substring("payment_id", 5, 20)).alias("invoice_id"), F.when(F.col("_blank") != 0, F.col("reference")).alias("reference"),
        F.concat(F.lit("M/S "), F.upper("counterparty"), F.lit(" Pvt Ltd")).alias("counterparty"), "amount_paise", "occurred_on",
    )
    truth = due.select("payment_id", F.when(F.col("_gone") != 0, F.concat(F.lit("inv_"), F.substring("payment_id", 5, 20))).alias("invoice_id"), F.col("settles_on").alias("landed_on"))
    truth = truth.join(credits.select("landed_on", "credit_id"), "landed_on", "left").select("payment_id", "invoice_id", "credit_id")
    columns = ["payment_id", "reference", "counterparty", "amount_paise", "occurred_on", "method"]
    copies = payments.where("_copy = 0").withColumn("payment_id", F.concat("payment_id", F.lit("-dup")))
    return {"payments": payments.select(columns).unionByName(copies.select(columns)), "invoices": invoices, "credits": credits, "truth": truth, "days": calendar_days}
