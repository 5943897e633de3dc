"""Distribution-free thresholds: how confident a claim must be for a bounded share of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Fixed value: the fewest labelled claims a bound may rest on.
LEAST_CLAIMS = 30
#: The bounds that a coverage table shows.
TABLE_ALPHAS = (0.01, 0.02, 0.05, 0.1, 0.2)
#: The alpha grid starts here, grows by this factor, and ends at half.
GRID_START, GRID_FACTOR, GRID_END = 0.002, 1.35, 0.5


def alpha_grid() -> list[float]:
    out = []
    while (alpha := GRID_START * GRID_FACTOR ** len(out)) <= GRID_END:
        out.append(round(alpha, 6))
    return out


def by_confidence(claims: DataFrame, *groups: str) -> DataFrame:
    """(groups, confidence, n, wrong): claims of each confidence, all that a sweep needs."""
    return claims.groupBy(*groups, "confidence").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("correct"), 0).otherwise(1)).alias("wrong"))


def sweep(counts: DataFrame, *groups: str) -> DataFrame:
    """For each confidence as a threshold: the claims it admits, and those of them that are wrong.

    Confidences have few digits, so the running sums go over few rows a group, however many claims there are.
    """
    up_to = W.partitionBy(*groups).orderBy(F.col("confidence").desc())
    whole = W.partitionBy(*groups)
    return counts.select(*groups, "confidence", F.sum("n").over(up_to).alias("admitted"), F.sum("wrong").over(up_to).alias("errors"), F.sum("n").over(whole).alias("total"))


def calibrate(claims: DataFrame, alphas: list[float], *groups: str) -> DataFrame:
    """(groups, alpha, threshold, admitted, errors, total): the threshold that admits most within alpha less its correction.

    The correction is (1 - alpha) / n; where it leaves nothing, or fewer than
    LEAST_CLAIMS claims are there, no threshold is available and the row has
    nulls. The lowest passing threshold counts, even if a higher one fails.
    """
    swept = sweep(by_confidence(claims, *groups), *groups)
    rows = swept.withColumn("alpha", F.explode(F.array(*(F.lit(a) for a in alphas))))
    budget = F.col("alpha") - (1 - F.col("alpha")) / F.col("total")
    passes = (F.col("total") >= LEAST_CLAIMS) & (budget > 0) & (F.col("errors") <= budget * F.col("admitted"))
    best = F.max(F.when(passes, F.struct("admitted", "confidence", "errors")))
    out = rows.groupBy(*groups, "alpha").agg(best.alias("b"), F.max("total").alias("total"))
    return out.select(*groups, "alpha", F.col("b.confidence").alias("threshold"), F.col("b.admitted").alias("admitted"), F.col("b.errors").alias("errors"), "total")


def best_point(points: DataFrame, wrong_paise: int, review_paise: int) -> DataFrame:
    """The available bound that costs least, a wrong post and a review priced; the smallest of equals."""
    cost = (F.col("errors") * wrong_paise + (F.col("total") - F.col("admitted")) * review_paise).cast("long")
    return points.where("threshold is not null").withColumn("cost_paise", cost).orderBy("cost_paise", "alpha").limit(1)


def in_calibration_half(claim_id: str, seed: Column | int) -> Column:
    """A claim's half, by a hash of the seed and its id."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    digest = F.sha2(F.concat(seed.cast("string"), F.lit(":"), F.col(claim_id).cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < F.lit(1 << 31)


def evaluate(claims: DataFrame, thresholds: DataFrame, *groups: str) -> DataFrame:
    """(groups, alpha, threshold, held_out, admitted, errors): what the thresholds do to claims they have not seen."""
    found = thresholds.select(*groups, "alpha", "threshold")
    rows = by_confidence(claims, *groups)
    joined = rows.join(F.broadcast(found), list(groups)) if groups else rows.crossJoin(F.broadcast(found))
    admitted = F.coalesce(F.col("confidence") >= F.col("threshold"), F.lit(False))
    return joined.groupBy(*groups, "alpha", "threshold").agg(
        F.sum("n").alias("held_out"), F.sum(F.when(admitted, F.col("n")).otherwise(0)).alias("admitted"), F.sum(F.when(admitted, F.col("wrong")).otherwise(0)).alias("errors")
    )


def validate(claims: DataFrame, claim_id: str, alpha: float, splits: int = 40, seed: int = 20260101, step: int = 7919) -> DataFrame:
    """(split, threshold, held_out, admitted, errors) over many random halves: all of them in one plan, a group a split."""
    seeds = F.explode(F.transform(F.sequence(F.lit(0), F.lit(splits - 1)), lambda t: F.struct(t.alias("split"), (F.lit(seed) + step * t).alias("seed"))))
    rows = claims.select(claim_id, "confidence", "correct", seeds.alias("s")).select(claim_id, "confidence", "correct", "s.split", "s.seed")
    rows = rows.withColumn("_half", in_calibration_half(claim_id, F.col("seed")))
    found = calibrate(rows.where("_half"), [alpha], "split")
    return evaluate(rows.where("NOT _half"), found, "split").select("split", "threshold", "held_out", "admitted", "errors")


def coverage_table(claims: DataFrame, claim_id: str, alphas: tuple[float, ...] = TABLE_ALPHAS, seed: int = 20260101) -> DataFrame:
    """(alpha, threshold, held_out, posted, wrong, reviewed, realised, coverage, holds): each bound calibrated on one half of the claims and measured on the other.

    Realised is the wrong share of what is posted, 0 where nothing is; holds is
    null where no threshold is available, as nothing is promised there.
    """
    rows = claims.withColumn("_half", in_calibration_half(claim_id, seed))
    seen = evaluate(rows.where("NOT _half"), calibrate(rows.where("_half"), list(alphas)))
    realised = F.coalesce(F.try_divide("errors", "admitted"), F.lit(0.0))
    return seen.select(
        "alpha", "threshold", "held_out", F.col("admitted").alias("posted"), F.col("errors").alias("wrong"), (F.col("held_out") - F.col("admitted")).alias("reviewed"), F.round(realised, 6).alias("realised"),
        F.round(F.try_divide("admitted", "held_out"), 6).alias("coverage"), F.when(F.col("threshold").isNotNull(), realised <= F.col("alpha")).alias("holds"),
    )
