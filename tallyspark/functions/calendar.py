"""The bank calendar as one small dimension: opening, settlement dates and windows become joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Holidays by month and day.
HOLIDAYS = ("01-26", "04-01", "08-15", "10-02")


def nth_weekday(day: Column | str) -> Column:
    """Which one of its weekday in its month a date is, from 1."""
    return F.expr(f"(day({day}) + 6) div 7") if isinstance(day, str) else F.floor((F.dayofmonth(day) + 6) / 7)


def why_closed(day: str = "ds") -> Column:
    """Why banks are closed on a date; null where they are open."""
    saturday = (F.weekday(day) == 5) & nth_weekday(day).isin(2, 4)
    ordinal = F.when(nth_weekday(day) == 2, "2nd").otherwise("4th")
    holiday = F.date_format(day, "MM-dd").isin(*HOLIDAYS)
    return (
        F.when(F.weekday(day) == 6, F.lit("Sunday"))
        .when(saturday, F.concat(ordinal, F.lit(" Saturday (Indian banks closed)")))
        .when(holiday | F.coalesce(F.col("extra_holiday"), F.lit(False)), F.lit("bank holiday"))
    )


def calendar(spark: SparkSession, first: str, last: str, extra: DataFrame | None = None, cycle: int = 2, slack: int = 1) -> DataFrame:
    """A row for each date: open, why_closed, bd_ord, settles_on, win_low and win_high.

    bd_ord counts the open days up to the date; settles_on is ``cycle`` open
    days later, from the next open day where the date is closed; the window
    reaches ``slack`` open days to both sides of that. Dates near the end whose
    settlement lies beyond ``last`` have nulls. The dimension has a few hundred
    rows a year, whatever the data; windows over it run in one small task.
    ``extra`` has further holidays in a column ds.
    """
    days = spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS ds")
    if extra is None:
        days = days.withColumn("extra_holiday", F.lit(False))
    else:
        days = days.join(F.broadcast(extra.select("ds").distinct().withColumn("extra_holiday", F.lit(True))), "ds", "left")
    days = days.withColumn("why_closed", why_closed()).withColumn("is_open", F.col("why_closed").isNull()).drop("extra_holiday")
    order = W.orderBy("ds")
    days = days.withColumn("bd_ord", F.sum(F.col("is_open").cast("int")).over(order).cast("int"))
    days = days.withColumn("_start", F.col("bd_ord") + F.when(F.col("is_open"), 0).otherwise(1))
    ordinals = days.where("is_open").select(F.col("bd_ord").alias("_ord"), F.col("ds").alias("_ds"))
    for name, shift in (("settles_on", cycle), ("win_low", cycle - slack), ("win_high", cycle + slack)):
        target = ordinals.select((F.col("_ord") - shift).alias("_start"), F.col("_ds").alias(name))
        days = days.join(target, "_start", "left")
    return days.select("ds", "is_open", "why_closed", "bd_ord", "settles_on", "win_low", "win_high")


def business_days_between(df: DataFrame, days: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """``df`` with the open days after ``start`` up to ``end``; negative backwards."""
    one = days.select(F.col("ds").alias("_d1"), F.col("bd_ord").alias("_o1"))
    other = days.select(F.col("ds").alias("_d2"), F.col("bd_ord").alias("_o2"))
    out = df.join(F.broadcast(one), F.col(start) == F.col("_d1"), "left").join(F.broadcast(other), F.col(end) == F.col("_d2"), "left")
    return out.withColumn(name, F.col("_o2") - F.col("_o1")).drop("_d1", "_d2", "_o1", "_o2")


def with_closures(days: DataFrame, most: int = 10) -> DataFrame:
    """``days`` with closed_before, the closed dates that end the day before (``most`` at most), and open_in_week, the open ones of its ISO week."""
    last_open = F.max(F.when(F.col("is_open"), F.col("ds"))).over(W.orderBy("ds").rowsBetween(W.unboundedPreceding, -1))
    out = days.withColumn("_last", F.coalesce(last_open, F.date_sub(F.min("ds").over(W.partitionBy()), 1)))
    week = W.partitionBy(F.date_trunc("week", "ds"))
    return out.withColumns({"closed_before": F.least(F.datediff("ds", "_last") - 1, F.lit(most)), "open_in_week": F.count_if("is_open").over(week).cast("int")}).drop("_last")


def all_features(days: DataFrame) -> DataFrame:
    """(ds and fourteen features): all that a date knows about itself: opening, weekdays as shares of one, place in the month and the tax dates."""
    rows = with_closures(days)
    last = F.dayofmonth(F.last_day("ds")) == F.dayofmonth("ds")
    return rows.select(
        "ds",
        F.col("is_open").cast("int").alias("is_open"),
        *((F.weekday("ds") == k).cast("int").alias(f"weekday_{k}") for k in range(6)),
        F.dayofmonth("ds").alias("day_of_month"),
        (F.dayofmonth("ds") <= 3).cast("int").alias("month_start"),
        last.cast("int").alias("month_end"),
        ((F.dayofmonth("ds") <= 3) | (last & F.col("is_open"))).cast("int").alias("salary_window"),
        (F.dayofmonth("ds").between(19, 21) | (F.dayofmonth("ds") == 7)).cast("int").alias("gst_window"),
        F.col("closed_before").alias("closed_before"),
        "open_in_week",
    )


def next_open(days: DataFrame) -> DataFrame:
    """``days`` with next_open, the first open date after each."""
    later = W.orderBy("ds").rowsBetween(1, W.unboundedFollowing)
    return days.withColumn("next_open", F.min(F.when(F.col("is_open"), F.col("ds"))).over(later))


def add_open_days(df: DataFrame, days: DataFrame, start: str, n: int, name: str) -> DataFrame:
    """``df`` with the date ``n`` open days after ``start``, which counts from the next open date where it is closed; 0 is that date itself."""
    if n < 0:
        raise ValueError("n is negative")
    own = days.select(F.col("ds").alias("_d"), (F.col("bd_ord") + F.when(F.col("is_open"), 0).otherwise(1) + n).alias("_o"))
    target = days.where("is_open").select(F.col("bd_ord").alias("_o"), F.col("ds").alias(name))
    return df.join(F.broadcast(own.join(target, "_o", "left").drop("_o")), F.col(start) == F.col("_d"), "left").drop("_d")


def value_date(settled: str = "settled_on", occurred: str = "occurred_on") -> Column:
    """The date on which money counts: when it settled, or else when it came about."""
    return F.coalesce(F.col(settled), F.col(occurred))


def day_bounds(day: Column | str, zone: str = "Asia/Kolkata") -> Column:
    """The half-open interval of instants that a date covers in a zone."""
    at = F.to_date(F.col(day) if isinstance(day, str) else day)
    start = lambda d: F.to_utc_timestamp(d.cast("timestamp"), zone)
    return F.struct(start(at).alias("start"), start(F.date_add(at, 1)).alias("end"))


def zoned_timestamp(text: Column | str, zone: str = "Asia/Kolkata") -> Column:
    """The instant that an ISO date or time names; one without an offset is local to ``zone``; null of none. The session's zone is UTC."""
    raw = F.trim(F.col(text) if isinstance(text, str) else text)
    stated = raw.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$") & (F.length(raw) > 10)
    parsed = F.try_to_timestamp(raw)
    return F.when(stated, parsed).otherwise(F.to_utc_timestamp(parsed, zone))


#: Date formats of statements, tried in this order: day first before month first.
STATEMENT_FORMATS = ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "d-MMM-yyyy", "d MMM yyyy", "d/M/yy", "M/d/yyyy")


def statement_date(text: Column | str) -> Column:
    """The date a statement writes; null of none, and of dates that do not exist."""
    raw = F.trim(F.col(text) if isinstance(text, str) else text)
    return F.coalesce(*(F.try_to_date(raw, f) for f in STATEMENT_FORMATS))


def features(day: str = "ds") -> dict[str, Column]:
    """Features of a row of the calendar that need no other row."""
    last = F.dayofmonth(F.last_day(day))
    return {
        "dow": F.weekday(day).cast("int"),
        "dom": F.dayofmonth(day),
        "month": F.month(day),
        "is_month_end": F.dayofmonth(day) == last,
        "is_salary_window": (F.dayofmonth(day) <= 3) | ((F.dayofmonth(day) == last) & F.col("is_open")),
        "is_gst_window": F.dayofmonth(day).between(19, 21) | (F.dayofmonth(day) == 7),
    }
