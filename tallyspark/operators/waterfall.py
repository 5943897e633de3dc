"""From gross to net: named deductions, what is left over, and rates fitted to many settlements."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.money import GST_PERCENT, MDR_BPS, TDS_BPS, with_fees

#: Fixed value: the largest part of gross that a settlement may withhold and still say something about rates.
MOST_WITHHELD = 0.06
LEAST_SHARE = 0.05


def remainder_class(remainder: str, gross: str) -> Column:
    """What a remainder looks like: a reserve of 5 % of gross, a dispute hold of 0.3 to 2.5 %, or money short or over. Integers only."""
    r, g = F.col(remainder), F.col(gross)
    return (
        F.when(g == 0, "unknown")
        .when(F.expr(f"abs(-{remainder} * 10000 - {gross} * 500) < {gross} * 5"), "rolling_reserve")
        .when(F.expr(f"-{remainder} * 1000 >= {gross} * 3 AND -{remainder} * 1000 <= {gross} * 25"), "chargeback_hold")
        .when(r < 0, "short_pay")
        .otherwise("over_pay")
    )


def totals(payments: DataFrame, by: str, refunds: DataFrame | None = None) -> DataFrame:
    """Sums of the rounded deductions of each settlement's payments, with its main method by gross."""
    rows = with_fees(payments)
    by_method = rows.groupBy(by, "method").agg(*(F.sum(c).alias(c) for c in ("amount_paise", "mdr_paise", "gst_paise", "tds_paise", "net_paise")), F.count(F.lit(1)).alias("member_count"))
    sums = by_method.groupBy(by).agg(
        F.sum("amount_paise").alias("gross_paise"),
        *(F.sum(c).alias(c) for c in ("mdr_paise", "gst_paise", "tds_paise", "member_count")),
        F.min_by("method", F.struct(-F.col("amount_paise"), "method")).alias("main_method"),
    )
    if refunds is None:
        return sums.withColumn("refunds_paise", F.lit(0).cast("long"))
    back = refunds.groupBy(by).agg(F.sum("amount_paise").alias("refunds_paise"))
    return sums.join(back, by, "left").withColumn("refunds_paise", F.coalesce("refunds_paise", F.lit(0)).cast("long"))


def refunds_by_date(refunds: DataFrame, settlements: DataFrame, by: str) -> DataFrame:
    """Refunds with the settlement of their date; ``settlements`` has one row a date. Sums come first, so that a date's refunds meet as one row."""
    return refunds.groupBy(by).agg(F.sum("amount_paise").alias("amount_paise")).join(settlements, by)


def component_sums(rows: DataFrame, by: str) -> DataFrame:
    """The lines of each settlement in one row: absolute sums of the fees by name, and of all else as the remainder."""
    named = F.when(F.col("component").isin("fee_mdr", "gst_on_fee", "tds_194o", "refund_offset"), F.col("component")).otherwise("remainder")
    summed = rows.withColumn("component", named).groupBy(by).pivot("component", ["fee_mdr", "gst_on_fee", "tds_194o", "refund_offset", "remainder"]).agg(F.sum(F.abs("amount_paise")))
    return summed.na.fill(0)


def settle(sums: DataFrame, received: DataFrame, by: str) -> DataFrame:
    """One row a settlement: expected and received net, and the remainder by what it looks like.

    residual_before_naming_paise is what the named fees leave unexplained; the
    remainder's own line then closes the settlement.
    """
    rows = sums.join(received, by).withColumn("_net", F.expr("gross_paise - mdr_paise - gst_paise - tds_paise - refunds_paise"))
    rows = rows.withColumn("residual_before_naming_paise", F.expr("net_received_paise - _net"))
    rows = rows.withColumn("remainder_type", F.when(F.col("residual_before_naming_paise") != 0, remainder_class("residual_before_naming_paise", "gross_paise")))
    held = lambda kind: F.when(F.col("remainder_type") == kind, -F.col("residual_before_naming_paise")).otherwise(0).cast("long")
    rows = rows.withColumns({"chargeback_paise": held("chargeback_hold"), "reserve_paise": held("rolling_reserve")})
    rows = rows.withColumn("net_expected_paise", F.expr("_net - chargeback_paise - reserve_paise"))
    rows = rows.withColumn("residual_paise", F.expr("net_expected_paise - net_received_paise"))
    return rows.withColumn("balanced", F.col("residual_paise") == 0).drop("_net")


def lines(settled: DataFrame, by: str) -> DataFrame:
    """(settlement, component, amount_paise): the waterfall's lines, which add up from gross to what was received."""
    parts = [("fee_mdr", "-mdr_paise"), ("gst_on_fee", "-gst_paise"), ("tds_194o", "-tds_paise"), ("refund_offset", "-refunds_paise")]
    every = [F.struct(F.lit(n).alias("component"), F.expr(e).cast("long").alias("amount_paise")) for n, e in parts]
    last = F.struct(F.coalesce("remainder_type", F.lit("unknown")).alias("component"), F.col("residual_before_naming_paise").cast("long").alias("amount_paise"))
    rows = settled.select(by, F.explode(F.array(*every, last)).alias("l")).select(by, "l.component", "l.amount_paise")
    return rows.where("amount_paise != 0 OR component IN ('fee_mdr', 'gst_on_fee', 'tds_194o')")


def design(payments: DataFrame, received: DataFrame, by: str) -> DataFrame:
    """A row a fee-consistent settlement: gross by method and what was withheld, the rows that rates are fitted to."""
    gross = payments.groupBy(by).pivot("method", sorted(MDR_BPS)).agg(F.sum("amount_paise")).na.fill(0)
    whole = payments.groupBy(by).agg(F.sum("amount_paise").alias("gross_paise"))
    rows = gross.join(whole, by).join(received, by).withColumn("withheld_paise", F.expr("gross_paise - net_received_paise"))
    return rows.where(f"gross_paise > 0 AND withheld_paise >= 0 AND withheld_paise <= {MOST_WITHHELD} * gross_paise")


def nonnegative_least_squares(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> np.ndarray:
    """The non-negative w with the least |xw - y|: an active set that grows by the steepest slope."""
    free, w = np.zeros(x.shape[1], bool), np.zeros(x.shape[1])
    for _ in range(rounds):
        slope = x.T @ (y - x @ w)
        slope[free] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, float(np.abs(y).max(initial=0))):
            return w
        free[best] = True
        while True:
            new = np.zeros_like(w)
            new[free] = np.linalg.lstsq(x[:, free], y, rcond=None)[0]
            if (new[free] > 0).all():
                w = new
                break
            low = free & (new <= 0)
            ratio = np.min(w[low] / np.maximum(w[low] - new[low], 1e-18))
            w = w + ratio * (new - w)
            free &= w > 1e-15
            w[~free] = 0.0
    return w


def fit_rates(rows: list[dict]) -> dict:
    """Effective basis points by method from the rows of ``design``; large misses weigh less (Huber), round by round.

    Rates are identifiable for methods with LEAST_SHARE of gross or more; fewer
    settlements than methods in use give no fit.
    """
    used = [m for m in sorted(MDR_BPS) if any(r[m] for r in rows)]
    if not rows or len(rows) < len(used):
        return {}
    x = np.array([[float(r[m]) for m in used] for r in rows])
    y = np.array([float(r["withheld_paise"]) for r in rows])
    scale, weight = max(float(np.median(np.abs(y))), 1.0), np.ones(len(y))
    for _ in range(12):
        w = nonnegative_least_squares(x / scale * weight[:, None], y / scale * weight)
        miss = np.abs(y - x @ w) / scale
        weight = np.sqrt(np.minimum(1.0, 0.05 / np.maximum(miss, 1e-12)))
    shares = x.sum(axis=0) / x.sum()
    spread = float(((y - y.mean()) ** 2).sum())
    return {
        "rates_bps": {m: float(v * 10_000) for m, v in zip(used, w, strict=True)},
        "shares": {m: float(v) for m, v in zip(used, shares, strict=True)},
        "identifiable": [m for m, v in zip(used, shares, strict=True) if v >= LEAST_SHARE],
        "r2": 1 - float(((y - x @ w) ** 2).sum()) / spread if spread else 1.0,
    }


def _from_products(gram: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A square system (x, y) with the given x'x and x'y, so with the same least squares."""
    values, vectors = np.linalg.eigh(gram)
    root = np.sqrt(np.where(values > 1e-12 * values.max(initial=0), values, 0.0))
    return root[:, None] * vectors.T, np.divide(vectors.T @ product, root, out=np.zeros_like(root), where=root > 0)


def fit_rates_over(rows: DataFrame) -> dict:
    """What ``fit_rates`` gives for all rows of ``design``: each round sums products in Spark, and the driver solves a system as wide as there are methods."""
    methods = sorted(MDR_BPS)
    rows = rows.select(*(F.col(m).cast("double").alias(m) for m in methods), F.col("withheld_paise").cast("double").alias("y")).persist()
    try:
        sums = rows.agg(F.count(F.lit(1)).alias("n"), F.median(F.abs("y")).alias("middle"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy"), *(F.sum(m).alias(m) for m in methods), *(F.max(m).alias(f"{m}_most") for m in methods)).first()
        used = [m for m in methods if sums[f"{m}_most"]]
        if not sums["n"] or sums["n"] < len(used):
            return {}
        scale, w = max(float(sums["middle"]), 1.0), None
        x = [F.col(m) / scale for m in used]
        y = F.col("y") / scale
        pairs = [(i, j) for i in range(len(used)) for j in range(i, len(used))]
        for _ in range(12):
            miss = F.lit(0.0) if w is None else F.abs(y - sum((a * float(b) for a, b in zip(x, w, strict=True)), F.lit(0.0)))
            weight = F.lit(1.0) if w is None else F.least(F.lit(1.0), 0.05 / F.greatest(miss, F.lit(1e-12)))
            weighed = rows.withColumn("_w", weight)
            found = list(weighed.agg(*(F.sum(F.col("_w") * x[i] * x[j]).alias(f"g{i}_{j}") for i, j in pairs), *(F.sum(F.col("_w") * a * y).alias(f"b{i}") for i, a in enumerate(x))).first())
            gram = np.zeros((len(used), len(used)))
            for (i, j), v in zip(pairs, found, strict=False):
                gram[i, j] = gram[j, i] = v
            w = nonnegative_least_squares(*_from_products(gram, np.array(found[len(pairs) :])))
        off = F.col("y") - sum((F.col(m) * float(v) for m, v in zip(used, w, strict=True)), F.lit(0.0))
        lost = rows.agg(F.sum(off * off).alias("v")).first()["v"]
    finally:
        rows.unpersist()
    shares = np.array([sums[m] for m in used]) / sum(sums[m] for m in used)
    spread = sums["yy"] - sums["y"] ** 2 / sums["n"]
    return {
        "rates_bps": {m: float(v * 10_000) for m, v in zip(used, w, strict=True)},
        "shares": {m: float(v) for m, v in zip(used, shares, strict=True)},
        "identifiable": [m for m, v in zip(used, shares, strict=True) if v >= LEAST_SHARE],
        "r2": 1 - lost / spread if spread else 1.0,
    }


def fitted_card(fit: dict) -> list[tuple[str, int, float | None, float, int, bool]]:
    """(method, contract_bps, effective_bps, share, card_bps, fitted) for every method of the contract.

    A rate is taken from the fit where its method is identifiable, and stays the
    contract's elsewhere. Fitted rates are of all that is withheld; the fee is
    what is left without TDS, which is the same for all, and without GST.
    """
    rates, shares, sure = (fit.get(k, {}) for k in ("rates_bps", "shares", "identifiable"))
    fee = lambda m: max(0, round((rates[m] - TDS_BPS) * 100 / (100 + GST_PERCENT)))
    return [(m, bps, rates.get(m), shares.get(m, 0.0), fee(m) if m in sure else bps, m in sure) for m, bps in sorted(MDR_BPS.items())]
