"""Typed exceptions for all that no stage places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types that explain money, types of missing rows, and severity limits in paise.
EXPLAINABLE = ("fee_mdr", "gst_on_fee", "tds_194o", "refund_offset", "rolling_reserve", "chargeback_hold")
MISSING_ROWS = ("missing_in_bank", "missing_in_ledger")
HIGH_PAISE, MEDIUM_PAISE = 10_000_000, 1_000_000


def severity(kind: str = "exception_type", amount: str = "amount_paise") -> Column:
    size = F.abs(F.col(amount))
    return F.when(F.col(kind).isin(*MISSING_ROWS), "high").when(F.col(kind).isin(*EXPLAINABLE), "info").when(size >= HIGH_PAISE, "high").when(size >= MEDIUM_PAISE, "medium").otherwise("low")


def exception_id(kind: str, source_ids: str, as_of: str, amount: str) -> Column:
    """An id that depends on what the exception is about alone."""
    ids = F.array_join(F.array_sort(F.col(source_ids)), ",")
    return F.concat(F.lit("exc_"), F.substring(F.sha2(F.concat_ws("\u001f", F.col(kind), ids, F.col(as_of).cast("string"), F.col(amount).cast("string")), 256), 1, 32))


def residue_type(kind: str, direction: str, amount: str) -> Column:
    """The rule classifier: what a row that nothing placed most likely is."""
    k = F.col(kind)
    return (
        F.when(k.isin("payment", "refund", "settlement"), "missing_in_bank")
        .when(k == "invoice", "missing_in_gateway")
        .when((k == "bank_line") & (F.col(direction) == "credit"), "missing_in_ledger")
        .when(F.col(amount) == 0, "corrupt")
        .otherwise("unknown")
    )


def consensus(votes: DataFrame, most: int = 3, least_agreement: float = 0.67) -> DataFrame:
    """(row_id, decision, agreement): the most frequent decision of a row's samples, the alphabetically first of equals; too little agreement abstains."""
    counted = votes.groupBy("row_id", "decision").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("o"), "decision"))
    rows = counted.groupBy("row_id").agg(best.alias("b"), F.sum("n").alias("total"))
    agreement = F.round(-F.col("b.o") / F.col("total"), 6)
    decision = F.when(agreement >= least_agreement, F.col("b.decision")).otherwise("abstain")
    return rows.select("row_id", decision.alias("decision"), agreement.alias("agreement"))


def listed(rows: DataFrame, kind: str | None = None, severity: str | None = None, limit: int = 50) -> DataFrame:
    """The largest exceptions of a type and severity, of all where none is named; equal amounts go by id."""
    for column, value in (("exception_type", kind), ("severity", severity)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.abs("amount_paise").desc(), "exception_id").limit(limit)


def review_queue(scored: DataFrame, most: int = 50, *ids: str) -> DataFrame:
    """The pairs of the review band that a person sees, the most likely first."""
    return scored.where("band = 'review'").orderBy(F.col("bits").desc(), *ids).limit(most)


def routed(rows: DataFrame, most: int = 50, order: str = "row_id") -> DataFrame:
    """``rows`` with route: the first ``most`` rows go to a model, the others are typed by rule.

    The first ones are picked by a top-k and joined back, so that no task sorts all rows.
    """
    first = rows.select(order).distinct().orderBy(order).limit(most).withColumn("_m", F.lit(True))
    return rows.join(F.broadcast(first), order, "left").withColumn("route", F.when(F.col("_m"), "model").otherwise("rule")).drop("_m")


def residue(rows: DataFrame, *placed: DataFrame) -> DataFrame:
    """Rows in none of the ``placed`` tables of txn_id."""
    for taken in placed:
        rows = rows.join(taken.select("txn_id"), "txn_id", "left_anti")
    return rows
