"""Daily cash: a gapless series, features, a ladder of models, back-tests, bands and alerts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Back-test folds, days between them, days ahead, the least history and the season.
FOLDS, STEP, HORIZON, LEAST_TRAIN, SEASON = 6, 7, 14, 60, 7
LAGS = (1, 2, 3, 7, 14, 28)


def spine(daily: DataFrame, day: str = "ds", value: str = "v") -> DataFrame:
    """(ds, v) for every date from the first to the last; days without rows have 0."""
    ends = daily.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null")
    dates = ends.select(F.explode(F.sequence("a", "b")).alias("ds"))
    sums = daily.groupBy(F.col(day).alias("ds")).agg(F.sum(value).alias("v"))
    return dates.join(sums, "ds", "left").select("ds", F.coalesce("v", F.lit(0)).cast("long").alias("v"))


def lag_features(series: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Lags and means of the days before; the day itself is left out. A series has one row a day, so its window is small."""
    order = W.partitionBy(*(by or [])).orderBy("ds")
    before = lambda n: order.rowsBetween(-n, -1)
    out = series.withColumns({f"lag_{n}": F.lag("v", n).over(order) for n in LAGS})
    return out.withColumns({f"mean_{n}": F.round(F.avg("v").over(before(n)), 6) for n in (7, 28)})


def seasonal_naive_errors(series: DataFrame) -> DataFrame:
    """One row: the mean absolute error of last week's value, and its pinball loss at 50 %."""
    rows = series.withColumn("p", F.lag("v", SEASON).over(W.orderBy("ds"))).where("p is not null")
    error = F.col("v") - F.col("p")
    return rows.agg(F.round(F.avg(F.abs(error)), 6).alias("mae"), F.round(F.avg(F.greatest(0.5 * error, -0.5 * error)), 6).alias("pinball_50"), F.count(F.lit(1)).alias("n"))


def cumulative_alerts(forecast: DataFrame, due: DataFrame, opening: int) -> DataFrame:
    """(due_on, amount_paise, label, expected_paise, confident_paise, severity): cash by each due date against what is due by then.

    ``forecast`` has ds, point and lower; ``due`` has due_on, amount_paise and label.
    """
    cash = forecast.select("ds", F.sum("point").over(W.orderBy("ds")).alias("_e"), F.sum("lower").over(W.orderBy("ds")).alias("_c"))
    owed = due.withColumn("due_paise", F.sum("amount_paise").over(W.orderBy("due_on").rangeBetween(W.unboundedPreceding, 0)))
    met = owed.join(cash, F.col("ds") <= F.col("due_on"), "left").groupBy("due_on", "amount_paise", "label", "due_paise")
    rows = met.agg((F.lit(opening) + F.coalesce(F.max_by("_e", "ds"), F.lit(0))).cast("long").alias("expected_paise"), (F.lit(opening) + F.coalesce(F.max_by("_c", "ds"), F.lit(0))).cast("long").alias("confident_paise"))
    return rows.withColumn(
        "severity",
        F.when(F.col("expected_paise") < F.col("due_paise"), "critical").when(F.col("confident_paise") < F.col("due_paise"), "warn").when(F.col("confident_paise") < 1.15 * F.col("due_paise"), "watch").otherwise("ok"),
    )


#: What falls due each month: label, day (0 is the last) and the part of the payroll, as a divisor.
COMMITMENTS = (("monthly payroll", 0, 1), ("GST return", 20, 5), ("TDS deposit", 7, 20))


def commitments(spark: SparkSession, first: str, days: int, payroll_paise: int) -> DataFrame:
    """(due_on, amount_paise, label) of all that falls due from ``first`` to ``days`` days later."""
    dates = spark.sql(f"SELECT explode(sequence(DATE '{first}', date_add(DATE '{first}', {days}))) AS due_on")
    due = [F.when(F.col("due_on") == (F.last_day("due_on") if not day else F.date_add(F.trunc("due_on", "month"), day - 1)), F.struct(F.lit(payroll_paise // part).cast("long").alias("amount_paise"), F.lit(label).alias("label"))) for label, day, part in COMMITMENTS]
    return dates.select("due_on", F.explode(F.array_compact(F.array(*due))).alias("c")).select("due_on", "c.amount_paise", "c.label")


def coverage(bands: DataFrame) -> DataFrame:
    """One row: how many values their bands hold, the mean width, and the standard error of the share.

    ``bands`` has v, lower and upper.
    """
    held = F.col("v").between(F.col("lower"), F.col("upper")).cast("int")
    rows = bands.agg(F.count(F.lit(1)).alias("n"), F.sum(held).alias("held"), F.round(F.avg(F.col("upper") - F.col("lower")), 6).alias("mean_width"))
    share = F.coalesce(F.try_divide("held", "n"), F.lit(0.0))
    return rows.withColumns({"coverage": F.round(share, 6), "standard_error": F.round(F.coalesce(F.sqrt(F.try_divide(share * (1 - share), F.col("n"))), F.lit(0.0)), 6)})


def held_out_bands(series: DataFrame, nominal: float = 0.90) -> DataFrame:
    """(ds, v, lower, upper) of the last quarter of a daily series: last week's value, widened by a quantile of the errors of the three quarters before.

    The quantile is the smallest error that a share ``nominal`` of n errors,
    counted as n + 1, does not exceed, so that the bands hold for new days.
    """
    order = W.orderBy("ds")
    rows = series.select("ds", "v", F.lag("v", SEASON).over(order).alias("point"), (F.percent_rank().over(order) <= 0.75).alias("fit")).where("point is not null")
    errors = rows.where("fit").select(F.abs(F.col("v") - F.col("point")).alias("e"))
    ranked = errors.select("e", F.row_number().over(W.orderBy("e")).alias("k"), F.count(F.lit(1)).over(W.partitionBy()).alias("n"))
    width = ranked.where(F.col("k") >= F.least(F.ceil((F.col("n") + 1) * nominal), F.col("n"))).agg(F.min("e").alias("width"))
    return rows.where("NOT fit").crossJoin(F.broadcast(width)).select("ds", "v", (F.col("point") - F.col("width")).alias("lower"), (F.col("point") + F.col("width")).alias("upper"))


def _naive(v: np.ndarray, h: int) -> np.ndarray:
    return np.resize(v[-SEASON:], h)


def _drift(v: np.ndarray, h: int) -> np.ndarray:
    slope = (v[-SEASON:].mean() - v[-2 * SEASON : -SEASON].mean()) / SEASON
    return _naive(v, h) + slope * np.arange(1, h + 1)


def _seasonal_shares(v: np.ndarray) -> np.ndarray:
    whole = v[len(v) % SEASON :].reshape(-1, SEASON)
    means = whole.mean(axis=1, keepdims=True)
    return (whole / np.where(means > 0, means, 1)).mean(axis=0)


def _theta(v: np.ndarray, h: int) -> np.ndarray:
    shares = _seasonal_shares(v)
    phase = (np.arange(len(v)) - len(v) % SEASON) % SEASON
    flat = v / np.where(shares[phase] > 0, shares[phase], 1)
    slope = np.polyfit(np.arange(len(flat)), flat, 1)[0]
    level = flat[0]
    for x in flat[1:]:
        level = 0.3 * x + 0.7 * level
    ahead = (np.arange(len(v), len(v) + h) - len(v) % SEASON) % SEASON
    return (level + 0.5 * slope * np.arange(1, h + 1)) * shares[ahead]


def _smooth(v: np.ndarray, alpha: float, gamma: float) -> tuple[float, float, np.ndarray]:
    season = v[:SEASON] - v[:SEASON].mean()
    level, loss = v[:SEASON].mean(), 0.0
    for k in range(SEASON, len(v)):
        s = season[k % SEASON]
        loss += abs(v[k] - level - s)
        new = alpha * (v[k] - s) + (1 - alpha) * level
        season[k % SEASON] = gamma * (v[k] - new) + (1 - gamma) * s
        level = new
    return loss, level, season


def _ets(v: np.ndarray, h: int) -> np.ndarray:
    if len(v) < 3 * SEASON:
        return _theta(v, h)
    _, level, season = min((_smooth(v.copy(), a, g) for a in (0.02, 0.05, 0.1, 0.2, 0.4) for g in (0.02, 0.05, 0.1, 0.3)), key=lambda x: x[0])
    return level + season[np.arange(len(v), len(v) + h) % SEASON]


def _boosted(v: np.ndarray, h: int) -> np.ndarray:
    """Stumps on absolute error over lags and the day of the week, straight to each day ahead."""
    out, start = np.zeros(h), max(LAGS)
    for step in range(1, h + 1):
        rows = np.arange(start, len(v) - step + 1)
        make = lambda at: np.column_stack([*(v[at - n] for n in LAGS), v[at[:, None] - np.arange(1, 8)].mean(axis=1), (at + step - 1) % SEASON])
        x, y, now = make(rows), v[rows + step - 1], make(np.array([len(v)]))
        fit, ahead = np.full(len(y), np.median(y)), float(np.median(y))
        for _ in range(40):
            sign, best = np.sign(y - fit), None
            for j in range(x.shape[1]):
                for cut in np.unique(np.quantile(x[:, j], np.linspace(0.1, 0.9, 9))):
                    low = x[:, j] <= cut
                    if 8 <= low.sum() <= len(y) - 8:
                        gain = abs(sign[low].sum()) + abs(sign[~low].sum())
                        if best is None or gain > best[0]:
                            best = (gain, j, cut, low)
            if best is None:
                break
            _, j, cut, low = best
            move = [0.1 * float(np.median((y - fit)[side])) for side in (low, ~low)]
            fit += np.where(low, *move)
            ahead += move[0] if now[0, j] <= cut else move[1]
        out[step - 1] = ahead
    return out


MODELS = {"seasonal_naive": _naive, "drift": _drift, "theta": _theta, "ets": _ets, "boosted": _boosted}


def backtest(series: DataFrame, models: tuple[str, ...] = tuple(MODELS)) -> DataFrame:
    """(model, fold, step, actual, predicted) of rolling origins, each fold and model a task of its own.

    A task gets its fold's training days, which are as many as the days of the series.
    """
    numbered = series.withColumn("_k", F.row_number().over(W.orderBy("ds")) - 1).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy()))
    folds = F.explode(F.transform(F.sequence(F.lit(0), F.lit(FOLDS - 1)), lambda f: f))
    rows = numbered.withColumn("fold", folds).withColumn("_cut", F.col("_n") - HORIZON - STEP * F.col("fold")).where(f"_cut >= {LEAST_TRAIN} AND _k < _cut + {HORIZON}")
    rows = rows.withColumn("model", F.explode(F.array(*map(F.lit, models))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        v, cut = pdf["v"].to_numpy(float), int(pdf["_cut"].iloc[0])
        ahead = np.maximum(MODELS[pdf["model"].iloc[0]](v[:cut], HORIZON), 0.0)
        return pd.DataFrame({"model": pdf["model"].iloc[0], "fold": pdf["fold"].iloc[0], "step": np.arange(1, HORIZON + 1), "actual": v[cut : cut + HORIZON], "predicted": ahead})

    return rows.groupBy("model", "fold").applyInPandas(run, "model string, fold int, step int, actual double, predicted double")


def ladder(tested: DataFrame, scale: DataFrame) -> DataFrame:
    """(model, mase, pinball_50): errors over the mean absolute weekly change; the best model has the least."""
    error = F.col("actual") - F.col("predicted")
    rows = tested.groupBy("model").agg(F.avg(F.abs(error)).alias("_mae"), F.round(F.avg(F.greatest(0.5 * error, -0.5 * error)), 4).alias("pinball_50"))
    return rows.crossJoin(scale.select(F.col("mae").alias("_scale"))).select("model", F.round(F.col("_mae") / F.col("_scale"), 6).alias("mase"), "pinball_50")


def conformal_bands(tested: DataFrame, alpha: float = 0.10) -> DataFrame:
    """(model, step, half_width): the finite-sample quantile of the held-out errors of each day ahead; the largest where they are few."""
    errors = tested.groupBy("model", "step").agg(F.array_sort(F.collect_list(F.abs(F.col("actual") - F.col("predicted")))).alias("e"))
    n = F.size("e")
    rank = F.ceil((n + 1) * (1 - alpha)).cast("int")
    return errors.select("model", "step", F.round(F.element_at("e", F.least(n, rank)), 6).alias("half_width"))
