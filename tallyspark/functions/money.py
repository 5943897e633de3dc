"""Money as integer paise: parsing, rounding once, fees, shares and display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Merchant discount rates in basis points by method, GST on the fee in percent, TDS in basis points of gross.
MDR_BPS = {
    "upi": 0,
    "rupay_debit": 0,
    "bank_transfer": 0,
    "card_debit": 90,
    "card_credit": 200,
    "netbanking": 175,
    "wallet": 220,
    "emi": 300,
    "international_card": 430,
    "unknown": 200,
}
GST_PERCENT = 18
TDS_BPS = 10


def of_currency(amount: Column, currency: Column | str, allowed: str = "INR") -> Column:
    """The amount, if its currency is the one that is counted in; any other stops the query."""
    code = F.col(currency) if isinstance(currency, str) else currency
    return F.when(F.coalesce(code == allowed, F.lit(False)), amount).otherwise(F.raise_error(F.concat(F.lit("not in " + allowed + ": "), F.coalesce(code, F.lit("no currency")))).cast("long"))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def known_method(method: Column | str) -> Column:
    """The method if it is on the card, else ``unknown``."""
    return F.when(_col(method).isin(*MDR_BPS), _col(method)).otherwise(F.lit("unknown"))


def mdr_bps(method: Column | str) -> Column:
    rates = F.create_map(*(F.lit(x) for pair in MDR_BPS.items() for x in pair))
    return F.element_at(rates, known_method(method))


def exact_share(paise: str, parts: str, whole: int) -> Column:
    """``parts`` out of ``whole`` of an amount by integer division, with one rounding: half away from zero."""
    return F.expr(f"CAST(signum({paise}) AS BIGINT) * ((abs({paise}) * {parts} + {whole // 2}) div {whole})")


def with_fees(df: DataFrame, paise: str = "amount_paise", method: str = "method") -> DataFrame:
    """``df`` with mdr_paise, gst_paise, tds_paise and net_paise: each component rounded once, net exactly what is left."""
    df = df.withColumn("_bps", mdr_bps(method)).withColumn("mdr_paise", exact_share(paise, "_bps", 10_000))
    df = df.withColumns({"gst_paise": exact_share("mdr_paise", str(GST_PERCENT), 100), "tds_paise": exact_share(paise, str(TDS_BPS), 10_000)})
    return df.withColumn("net_paise", F.expr(f"{paise} - mdr_paise - gst_paise - tds_paise")).drop("_bps")


#: Part of a target in percent, and paise, that a sum may fall short of or exceed.
TOLERANCE_PERCENT, TOLERANCE_PAISE = 6, 100


def within_rate(total: Column, target: Column) -> Column:
    """Whether a sum meets a target less at most the tolerated part, and no more than the tolerated paise over it."""
    upper = F.floor(F.abs(target) * TOLERANCE_PERCENT / 100) + TOLERANCE_PAISE
    return total.between(target - upper, target + TOLERANCE_PAISE)


def conserved(gross: Column, explained: Column, net: Column, tolerance: int = 0) -> Column:
    """Whether gross less what is explained is the net, within a tolerance in paise."""
    return F.abs(gross - explained - net) <= tolerance


def deducted_share(df: DataFrame, paise: str = "amount_paise") -> Column:
    """The part of gross that the fees take; null of nothing."""
    return F.try_divide(F.expr(f"CAST({paise} - net_paise AS DOUBLE)"), F.expr(f"CAST({paise} AS DOUBLE)"))


def parse_paise(text: Column | str) -> Column:
    """Paise of a statement's amount: grouping, currency marks, brackets and Cr/Dr are understood; null of anything else."""
    raw = F.trim(_col(text))
    brackets = raw.rlike(r"^\(.*\)$")
    raw = F.when(brackets, F.trim(F.regexp_replace(raw, r"^\(|\)$", ""))).otherwise(raw)
    debit = raw.rlike(r"(?i)dr$")
    raw = F.regexp_replace(raw, r"(?i)(cr|dr)$", "")
    raw = F.regexp_replace(raw, "₹|INR|Rs\\.|Rs|,|[\\x20\\x{A0}]", "")
    minus = raw.startswith("-")
    digits = F.regexp_replace(raw, r"^[+-]", "")
    valid = digits.rlike(r"^[0-9]+(\.[0-9]{0,2})?$|^\.[0-9]{1,2}$")
    sign = F.when(brackets, -1).otherwise(1) * F.when(debit, -1).otherwise(1) * F.when(minus, -1).otherwise(1)
    return F.when(valid, sign * (digits.try_cast("decimal(20,2)") * 100).cast("long"))


def grouped_rupees(paise: Column | str) -> Column:
    """An amount as people write it: rupee mark, groups of lakh and crore, two places."""
    amount = _col(paise)
    whole, rest = F.floor(F.abs(amount) / 100).cast("string"), F.pmod(F.abs(amount), F.lit(100)).cast("string")
    groups = F.regexp_replace(whole, r"(?<=\d)(?=(?:\d\d)*\d{3}$)", ",")
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("₹"), groups, F.lit("."), F.lpad(rest, 2, "0"))


def compact_rupees(paise: Column | str) -> Column:
    """Crore or lakh with two places, half to even; smaller amounts in full."""
    amount = _col(paise)
    size, sign = F.abs(amount).cast("decimal(20,0)"), F.when(amount < 0, "-").otherwise("")
    in_crore, in_lakh = (F.bround(size / F.lit(n).cast("decimal(20,0)"), 2).cast("decimal(20,2)").cast("string") for n in (1_000_000_000, 10_000_000))
    return F.when(size >= 1_000_000_000, F.concat(sign, F.lit("₹"), in_crore, F.lit(" Cr"))).when(size >= 10_000_000, F.concat(sign, F.lit("₹"), in_lakh, F.lit(" L"))).otherwise(grouped_rupees(amount))


def allocate(df: DataFrame, group: list[str], total: str, weight: str, order: str) -> DataFrame:
    """``df`` with share_paise: the group's total split by weight, remainders to the largest fractions, ties to the first by ``order``.

    A group is what shares one total, such as the lines of an order.
    """
    whole = W.partitionBy(*group)
    df = df.withColumn("_w", F.sum(weight).over(whole)).withColumn("_exact", F.expr(f"abs({total}) * {weight}"))
    df = df.withColumns({"_floor": F.expr("_exact div _w"), "_rest": F.expr("_exact % _w")})
    df = df.withColumn("_left", F.abs(F.col(total)) - F.sum("_floor").over(whole))
    rank = F.row_number().over(whole.orderBy(F.col("_rest").desc(), order))
    share = F.signum(F.col(total)).cast("long") * (F.col("_floor") + F.when(rank <= F.col("_left"), 1).otherwise(0))
    return df.withColumn("share_paise", share.cast("long")).drop("_w", "_exact", "_floor", "_rest", "_left")
