"""How good a run is, and what it costs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from math import lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def confusion(predicted: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """One row: true and false positives, false negatives, precision, recall and F1; a ratio without a denominator is 0."""
    p, t = predicted.select(*on).distinct().withColumn("_p", F.lit(1)), truth.select(*on).distinct().withColumn("_t", F.lit(1))
    both = p.join(t, on, "full_outer")
    counts = both.agg(
        F.count(F.when(F.col("_p").isNotNull() & F.col("_t").isNotNull(), 1)).alias("tp"),
        F.count(F.when(F.col("_t").isNull(), 1)).alias("fp"),
        F.count(F.when(F.col("_p").isNull(), 1)).alias("fn"),
    )
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.expr(a), F.expr(b)), F.lit(0.0)), 6)
    return counts.withColumns({"precision": ratio("tp", "tp + fp"), "recall": ratio("tp", "tp + fn"), "f1": ratio("2 * tp", "2 * tp + fp + fn")})


def proportion_interval(hits: int, n: int, level: float = 0.95, resamples: int = 2000, seed: int = 20260101) -> tuple[float, float]:
    """A percentile bootstrap interval of a share; resampled shares of 0/1 values are binomial."""
    if n == 0:
        return 0.0, 0.0
    drawn = np.random.Generator(np.random.PCG64(seed)).binomial(n, hits / n, resamples) / n
    return float(np.quantile(drawn, (1 - level) / 2)), float(np.quantile(drawn, (1 + level) / 2))


#: Tasks that draw weights, rows that a task draws for at once, and the largest count whose weights come from a table.
DRAWING_TASKS, DRAWN_ROWS, TABLED = 192, 128, 1000


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64 bits of each whole number (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=64)
def _poisson_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distribution function, the Poisson number of mean n for each 16 leading bits of a uniform one); -1 where 16 bits do not tell."""
    k = np.arange(n + int(12 * n**0.5) + 30)
    cdf = np.cumsum(np.exp([x * log(n) - n - lgamma(x + 1) for x in k.tolist()]))
    ends = np.searchsorted(cdf, np.arange(65537) / 65536, "right")
    return cdf, np.where(ends[:-1] == ends[1:], ends[:-1], -1).astype(np.float64)


def poisson_weights(keys: np.ndarray, n: int, resamples: int, seed: int) -> np.ndarray:
    """A row for each key: Poisson numbers of mean ``n``, which hang on key and seed alone."""
    if n > TABLED:
        return np.array([np.random.Generator(np.random.PCG64([seed, int(key)])).poisson(n, resamples) for key in keys], np.float64)
    cdf, table = _poisson_table(n)
    start = _mixed(keys ^ _mixed(np.array([seed], np.uint64)))[:, None]
    step = np.uint64(0x9E3779B97F4A7C15)
    bits = _mixed(start + np.arange(1, -(-resamples // 4) + 1, dtype=np.uint64) * step).view(np.uint16)[:, :resamples]
    out = table[bits]
    row, at = np.nonzero(out < 0)
    more = _mixed(_mixed(start[row, 0]) + (at.astype(np.uint64) + np.uint64(1)) * step) >> np.uint64(16)
    out[row, at] = np.searchsorted(cdf, (bits[row, at] + more / 2.0**48) / 65536, "right")
    return out


def ratio_interval(rows: DataFrame, part: str, whole: str, level: float = 0.95, resamples: int = 2000, seed: int = 20260101) -> tuple[float, float] | None:
    """A bootstrap interval of sum(part) / sum(whole) over rows of any kind; None without rows.

    In place of drawing rows, every row gets a Poisson weight in each resample,
    so that all resamples are sums of one pass. Equal rows are counted first,
    and the weight of n of them is one draw, seeded by their values: the result
    hangs neither on partitions nor on their order. A mean has 1 as whole.
    """
    counts = rows.groupBy(F.col(part).cast("double").alias("a"), F.col(whole).cast("double").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    seeded = counts.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b", "n", F.xxhash64("a", "b").alias("key"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, resamples))
        for batch in batches:
            for n, own in batch.groupby("n"):
                values, keys = own[["a", "b"]].to_numpy().T, own["key"].to_numpy().view(np.uint64)
                for at in range(0, len(keys), DRAWN_ROWS):
                    total += values[:, at : at + DRAWN_ROWS] @ poisson_weights(keys[at : at + DRAWN_ROWS], int(n), resamples, seed)
        yield pd.DataFrame({"slot": np.arange(resamples), "a": total[0], "b": total[1]})

    # Few bytes and much work: dealt out by number, as by size few tasks would draw.
    sums = seeded.repartition(DRAWING_TASKS, "key").mapInPandas(draw, "slot int, a double, b double").groupBy("slot").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    drawn = np.array([r["a"] / r["b"] for r in sums.where("b != 0").collect()])
    if not len(drawn):
        return None
    return float(np.quantile(drawn, (1 - level) / 2)), float(np.quantile(drawn, (1 + level) / 2))


#: Minutes of work, what an hour costs in paise, and the part of a wrongly matched amount that is lost, in percent.
HOUR_PAISE = 60_000
MINUTES_FALSE_MATCH, MINUTES_TRIAGE, MINUTES_REVIEW, MINUTES_MANUAL_ROW = 45.0, 3.0, 2.0, 0.5
LOST_PERCENT = 5


def work_paise(minutes: str) -> str:
    """SQL text: what minutes of work cost, rounded half up to the paise."""
    return f"CAST(floor(({minutes}) * {HOUR_PAISE} / 60 + 0.5) AS BIGINT)"


def price(outcomes: DataFrame) -> DataFrame:
    """``outcomes`` with the cost of being wrong and the manual baseline.

    Columns: rows, false_matches, exposed_paise, false_non_matches and reviews.
    A correct post costs nothing.
    """
    out = outcomes.withColumns(
        {
            "false_match_paise": F.expr(f"IF(false_matches > 0, false_matches * {work_paise(str(MINUTES_FALSE_MATCH))} + (exposed_paise * {LOST_PERCENT} + 50) div 100, 0)"),
            "triage_paise": F.expr(f"false_non_matches * {work_paise(str(MINUTES_TRIAGE))}"),
            "review_paise": F.expr(f"reviews * {work_paise(str(MINUTES_REVIEW))}"),
            "manual_paise": F.expr(f"rows * {work_paise(str(MINUTES_MANUAL_ROW))}"),
        }
    )
    return out.withColumn("total_paise", F.expr("false_match_paise + triage_paise + review_paise"))


def break_even(outcomes: DataFrame) -> DataFrame:
    """``outcomes`` with break_even: how many false matches may happen before automation costs more than it saves.

    Columns: rows, exceptions, reviews, missed and exposed_paise, the mean
    amount of a wrong match. The manual baseline is reading all rows and
    triaging all exceptions; without a budget no false match may happen. The
    quotient is rounded once, half up, in whole hundredths.
    """
    manual = f"rows * {work_paise(str(MINUTES_MANUAL_ROW))} + exceptions * {work_paise(str(MINUTES_TRIAGE))}"
    spent = f"missed * {work_paise(str(MINUTES_TRIAGE))} + reviews * {work_paise(str(MINUTES_REVIEW))}"
    each = f"{work_paise(str(MINUTES_FALSE_MATCH))} + (abs(exposed_paise) * {LOST_PERCENT} + 50) div 100"
    budget = f"greatest({manual} - ({spent}), 0)"
    return outcomes.withColumn("break_even", F.expr(f"(200 * {budget} + ({each})) div (2 * ({each}))") / 100)


#: The low, base and high case of what a close costs by hand.
PROBLEM_SIZE = {
    "transactions_per_day": (200, 600, 2000),
    "percent_unmatched": (2, 5, 10),
    "minutes_per_exception": (2, 4, 8),
    "rupees_per_hour": (400, 600, 1000),
    "days_per_month": (22, 24, 26),
}


def problem_size(spark: SparkSession) -> DataFrame:
    """A row for each case: exceptions and minutes a day, and rupees a day, month and year."""
    cases = ", ".join(f"('{case}', {', '.join(str(v[k]) for v in PROBLEM_SIZE.values())})" for k, case in enumerate(("low", "base", "high")))
    rows = spark.sql(f"SELECT * FROM VALUES {cases} t(case, {', '.join(PROBLEM_SIZE)})")
    rows = rows.withColumn("exceptions_per_day", F.expr("transactions_per_day * percent_unmatched / 100D")).withColumn("minutes_per_day", F.expr("exceptions_per_day * minutes_per_exception"))
    rows = rows.withColumn("cost_per_day", F.expr("minutes_per_day * rupees_per_hour / 60D"))
    return rows.withColumns({"cost_per_month": F.expr("cost_per_day * days_per_month"), "cost_per_year": F.expr("cost_per_day * days_per_month * 12")}).drop(*PROBLEM_SIZE)


def run_metrics(rows: DataFrame, matched: DataFrame, posted: DataFrame, truth: DataFrame, residue: DataFrame) -> DataFrame:
    """One row: match rate, coverage and precision of what was posted, and the rate of rows that nothing placed.

    ``rows``, ``matched`` and ``residue`` have row_id; ``posted`` and ``truth``
    have left_id and right_id. A rate without a denominator is 0.
    """
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = n(rows.select("row_id").distinct(), "rows").crossJoin(n(matched.select("row_id").distinct(), "matched")).crossJoin(n(residue.select("row_id").distinct(), "residue"))
    right = posted.select("left_id", "right_id").distinct()
    out = out.crossJoin(n(right, "posted")).crossJoin(n(right.join(truth.select("left_id", "right_id").distinct(), ["left_id", "right_id"], "left_semi"), "posted_right")).crossJoin(n(truth.distinct(), "claims"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return out.withColumns({"match_rate": rate("matched", "rows"), "residue_rate": rate("residue", "rows"), "post_coverage": rate("posted", "claims"), "post_precision": rate("posted_right", "posted")})


def metrics_text(metrics: dict[str, float | int]) -> str:
    """Metrics in one canonical form: sorted keys, six places, nothing of the time of the run."""
    return json.dumps({k: round(v, 6) if isinstance(v, float) else v for k, v in metrics.items()}, sort_keys=True, indent=2) + "\n"
