"""Many payments to one credit: windows, hints, the single-credit rule and a bounded solver for the rest."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.operators import subsets
from tallyspark.session import cut

#: Rounding that a settlement may add for each payment, in paise, and for itself.
SLACK_EACH, SLACK = 4, 200
#: Payments up to which ``subset_reaching`` tries all choices, in two halves, for the one with most items.
EXACT_ITEMS = 34


def window_candidates(payments: DataFrame, credits: DataFrame, days: DataFrame) -> DataFrame:
    """Payments with every credit that lands in their settlement window: the window's dates are joined, not compared.

    ``payments`` has occurred_on, ``credits`` has landed_on; a window has at most a week or so of dates.
    """
    windows = days.where("win_low is not null and win_high is not null").select(F.col("ds").alias("occurred_on"), "settles_on", F.explode(F.sequence("win_low", "win_high")).alias("landed_on"))
    return payments.join(F.broadcast(windows), "occurred_on").join(credits, "landed_on")


def nearest_credit(candidates: DataFrame) -> DataFrame:
    """(payment_id, credit_id, drift_days): the candidate that lands closest to the expected date, the first of equals."""
    drift = F.abs(F.datediff("landed_on", "settles_on"))
    best = F.min(F.struct(drift.alias("drift_days"), "landed_on", "credit_id"))
    return candidates.groupBy("payment_id").agg(best.alias("b")).select("payment_id", "b.credit_id", "b.drift_days")


def by_single_credit(payments: DataFrame, credits: DataFrame) -> DataFrame:
    """Dates with one credit: all their payments belong to it if they reach it but for rounding, and none otherwise.

    ``payments`` has settles_on and net_paise; ``credits`` has landed_on and amount_paise.
    """
    alone = credits.groupBy("landed_on").agg(F.count(F.lit(1)).alias("n"), F.min("credit_id").alias("credit_id"), F.sum("amount_paise").alias("target_paise")).where("n = 1")
    sums = payments.groupBy(F.col("settles_on").alias("landed_on")).agg(F.count(F.lit(1)).alias("members"), F.sum("amount_paise").alias("gross_paise"), F.sum("net_paise").alias("expected_paise"))
    met = alone.join(sums, "landed_on")
    attributed = F.col("expected_paise") >= F.col("target_paise") - (SLACK_EACH * F.col("members") + SLACK)
    return met.select("landed_on", "credit_id", "target_paise", "members", "gross_paise", "expected_paise", attributed.alias("attributed"))


def confidence(on_time: str, members: str, explained: str, expected: str, gross: str, optimal: str) -> str:
    """SQL text of a group's confidence: dates on time, withholding as expected, and an exact solution."""
    slack = f"greatest(CAST({gross} AS DECIMAL(20,0)) * 6 div 100, 1)"
    fit = f"greatest(0.0, 1.0 - least(abs({explained} - {expected}), {slack}) / CAST({slack} AS DOUBLE))"
    return f"round(0.50 + 0.30 * {on_time} / {members} + 0.17 * {fit} + IF({optimal}, 0.02, 0.0), 4)"


def groups(members: DataFrame, paid: DataFrame) -> DataFrame:
    """One row a credit: members, those on time, sums, the invoices that the members pay, and the confidence.

    ``members`` has credit_id, payment_id, settles_on, landed_on, amount_paise,
    net_paise and target_paise; ``paid`` has payment_id and invoice_id.
    """
    sums = members.groupBy("credit_id").agg(
        F.count(F.lit(1)).alias("member_count"), F.count_if(F.col("settles_on") == F.col("landed_on")).alias("on_time"), F.sum("amount_paise").alias("gross_paise"),
        (F.sum("amount_paise") - F.max("target_paise")).alias("explained_paise"), (F.sum("amount_paise") - F.sum("net_paise")).alias("withheld_paise"),
    )
    invoices = members.select("credit_id", "payment_id").join(paid, "payment_id").groupBy("credit_id").agg(F.array_sort(F.collect_set("invoice_id")).alias("invoice_ids"))
    rows = sums.join(invoices, "credit_id", "left").withColumn("invoice_ids", F.coalesce("invoice_ids", F.array().cast("array<string>")))
    return rows.withColumn("confidence", F.expr(confidence("on_time", "member_count", "explained_paise", "withheld_paise", "gross_paise", "true")).cast("double"))


def subset_reaching(amounts: np.ndarray, low: int, high: int) -> list[int] | None:
    """Indices of a subset whose sum lies in [low, high], the one with most items; meets in the middle, for up to EXACT_ITEMS items."""
    if len(amounts) > EXACT_ITEMS:
        raise ValueError(f"more than {EXACT_ITEMS} items")
    if low <= int(amounts.sum()) <= high:
        return list(range(len(amounts)))
    half = len(amounts) // 2

    def sums(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total, count = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for x in part:
            total, count = np.concatenate([total, total + x]), np.concatenate([count, count + 1])
        return total, count

    (left, n_left), (right, n_right) = sums(amounts[:half]), sums(amounts[half:])
    order = np.lexsort((-n_right, right))
    right_sorted, best = right[order], None
    first, last = np.searchsorted(right_sorted, low - left), np.searchsorted(right_sorted, high - left, "right")
    for i in np.flatnonzero(first < last):
        inside = order[first[i] : last[i]]
        j = inside[np.argmax(n_right[inside])]
        if best is None or n_left[i] + n_right[j] > best[0]:
            best = (n_left[i] + n_right[j], i, j)
    if best is None:
        return None
    _, i, j = best
    return [k for k in range(half) if i >> k & 1] + [half + k for k in range(len(amounts) - half) if j >> k & 1]


def assign_one_to_one(weights: np.ndarray, abstain: float) -> list[tuple[int, int]]:
    """Pairs (row, column) of the largest total weight, each row and column once; a row stays free where that costs less than ``abstain``.

    Shortest augmenting paths over the rows' costs, with a column of its own
    for each row to stay free in. NaN forbids a pair.
    """
    rows, columns = weights.shape
    cost = np.full((rows, columns + rows), np.inf)
    cost[:, :columns] = np.where(np.isnan(weights), np.inf, -weights)
    cost[np.arange(rows), columns + np.arange(rows)] = -abstain
    size = columns + rows
    by_row, by_column = np.zeros(rows), np.zeros(size)
    owner = np.full(size, -1)
    for row in range(rows):
        least, previous, done = np.full(size, np.inf), np.full(size, -1), np.zeros(size, bool)
        at, column = row, -1
        while True:
            reduced = cost[at] - by_row[at] - by_column
            better = ~done & (reduced < least)
            least[better], previous[better] = reduced[better], column
            open_ = np.where(done, np.inf, least)
            column = int(np.argmin(open_))
            step = open_[column]
            by_row[row] += step
            for c in np.flatnonzero(done):
                by_row[owner[c]] += step
                by_column[c] -= step
            least[~done] -= step
            done[column] = True
            if owner[column] < 0:
                break
            at = owner[column]
        while column >= 0:
            before = previous[column]
            owner[column] = owner[before] if before >= 0 else row
            column = before
    return sorted((int(owner[c]), c) for c in range(columns) if owner[c] >= 0)


#: Open days with credits that are searched together where payments reach over several days; an even number of such windows never shares a payment with the next even one.
WINDOW_DATES = 10
#: Parts into which the payments of one amount are dealt when they are numbered.
SALTS = 64

#: Tasks among which the groups of a search are dealt.
SEARCH_TASKS = 96
EPOCH = date(1970, 1, 1)

TAKES = "array<struct<low: date, high: date, net_paise: long, credit_id: string, first: long, n: long>>"


def _placed(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """``rows`` with place, from 0 within ``key``: counted by parts, so that a key with very many rows is numbered in many tasks."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(SALTS)).cast("int"))
    before = F.sum("_n").over(W.partitionBy(*key).orderBy("_salt")) - F.col("_n")
    counts = rows.groupBy(*key, "_salt").agg(F.count(F.lit(1)).alias("_n")).select(*key, "_salt", before.alias("_before"))
    place = F.row_number().over(W.partitionBy(*key, "_salt").orderBy(order)) - 1 + F.col("_before")
    return rows.join(counts, [*key, "_salt"]).withColumn("place", place).drop("_salt", "_before")


def _taken(payments: DataFrame, solved: DataFrame, low: str, high: str) -> DataFrame:
    """(payment_id, credit_id, exact): the payments of the counts that credits take; equal payments go in the order of their ids."""
    key = ["low", "high", "net_paise"]
    takes = solved.select(F.explode("takes").alias("t"), (F.col("method") != "greedy").alias("exact")).select("t.*", "exact")
    totals = payments.select(F.col(low).alias("low"), F.col(high).alias("high"), "net_paise", "payment_id")
    met = totals.join(takes.select(*key).distinct(), key, "left_semi")
    return _placed(met, key, "payment_id").join(takes, key).where("place >= first AND place < first + n").select("payment_id", "credit_id", "exact")


def _searched(groups: DataFrame) -> DataFrame:
    """What a search finds in each group: group, takes, method, status, tried and space, a row for each window of credits.

    ``groups`` has group, own (array of low, high, net_paise and n), credits
    (array of credit_id, amount_paise, landed_on and room, in order), reaching
    (whether payments are limited to the credits from low to high) and slack.
    Room is how much of the credit the group's payments stand for. Amounts of
    zero or less are left out of the search. Amounts stay in columns, some
    dozen bytes each, so that a group may have millions of them.
    """
    item = pa.struct([("low", pa.date32()), ("high", pa.date32()), ("net_paise", pa.int64()), ("credit_id", pa.string()), ("first", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                group, reaching, slack = (batch.column(c)[at].as_py() for c in ("group", "reaching", "slack"))
                credits = batch.column("credits")[at].as_py()
                own = batch.column("own")[at].values
                values, counts = (own.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("net_paise", "n"))
                lows, highs = (own.field(c).cast(pa.int32()).to_numpy(zero_copy_only=False) for c in ("low", "high"))
                values, counts, lows, highs = (x[values > 0] for x in (values, counts, lows, highs))
                landed = [(c["landed_on"] - EPOCH).days for c in credits]
                allowed = [(lows <= day) & (day <= highs) for day in landed] if reaching else None
                first = np.zeros(len(values), np.int64)
                for begin, parts, method, status, tried in subsets.attribute_in_windows(values, counts, [int(c["room"]) for c in credits], int(slack), allowed):
                    takes = []
                    for k, part in enumerate(parts):
                        used = np.flatnonzero(part) if part is not None else np.zeros(0, np.int64)
                        name = credits[begin + k]["credit_id"]
                        columns = [pa.array(lows[used], pa.int32()).cast(pa.date32()), pa.array(highs[used], pa.int32()).cast(pa.date32()), pa.array(values[used]), pa.array([name] * len(used), pa.string()), pa.array(first[used]), pa.array(part[used] if len(used) else used)]
                        takes.append(pa.StructArray.from_arrays(columns, fields=list(item)))
                        if len(used):
                            first[used] += part[used]
                    met = [credits[begin + k]["credit_id"] for k, part in enumerate(parts) if part is not None]
                    taken = pa.concat_arrays(takes) if takes else pa.array([], item)
                    columns = [pa.array([group]), pa.ListArray.from_arrays(pa.array([0, len(taken)], pa.int32()), taken), pa.array([met], pa.list_(pa.string())), pa.array([len(parts)], pa.int32()), pa.array([method]), pa.array([status]), pa.array([tried], pa.int64()), pa.array([subsets.space(counts)], pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["group", "takes", "met", "asked", "method", "status", "tried", "space"])

    # Groups are few bytes and much work, so they are dealt out by number: by size they would all go to one task.
    dealt = groups.select("group", "own", "credits", "reaching", "slack").repartition(SEARCH_TASKS, "group")
    return dealt.mapInArrow(run, f"group string, takes {TAKES}, met array<string>, asked int, method string, status string, tried long, space double")


def solve_dates(payments: DataFrame, credits: DataFrame) -> DataFrame:
    """The search on each date with several credits, over its amounts with their counts; see ``by_several_credits``.

    A date is one search however many amounts it has: what it finds does not
    hang on their number.
    """
    item = F.struct("credit_id", "amount_paise", "landed_on", F.col("amount_paise").alias("room"))
    # A row for each date, which is asked for twice and is made from all payments or all of a bank's lines.
    plan = cut(credits.groupBy("landed_on").agg(F.array_sort(F.collect_list(item)).alias("credits")).where(F.size("credits") > 1))
    own = payments.select(F.col("settles_on").alias("landed_on"), "net_paise").join(plan.select("landed_on"), "landed_on", "left_semi")
    amounts = own.groupBy("landed_on", "net_paise").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("net_paise", F.col("landed_on").alias("low"), F.col("landed_on").alias("high"), "n")))
    gathered = amounts.groupBy("landed_on").agg(listed.alias("own"), (SLACK_EACH * F.sum("n") + SLACK).alias("slack")).join(plan, "landed_on")
    return _searched(gathered.select(F.col("landed_on").cast("string").alias("group"), "own", "credits", F.lit(False).alias("reaching"), "slack"))


def by_several_credits(payments: DataFrame, credits: DataFrame) -> DataFrame:
    """(payment_id, credit_id, exact) for dates with several credits.

    Each credit takes payments that add up to it but for rounding, and one of
    them, the last if that can be, all others, if they reach it. Where no such
    split exists, the credits that payments add up to at all are met, and where
    this fails too, each credit takes the largest payments that fit, if they
    come close to it. Only the last kind is not ``exact``. Payments of equal
    amounts stand for each other, so a search sees amounts and counts; see
    ``solve_dates`` for what it saw, by date.
    """
    return _taken(payments, cut(solve_dates(payments, credits)), "settles_on", "settles_on")


def by_whole_dates(payments: DataFrame, credits: DataFrame) -> DataFrame:
    """(credit_id, settles_on, landed_on, drift_days, members): credits that a whole settlement date's payments add up to, but for rounding.

    The credit may land on any date of the payments' window, so a late one finds
    the payments of the day before. A date and a credit belong together if each
    is the other's nearest by days, then by paise, then by their order.
    """
    blocks = payments.groupBy("settles_on", "win_low", "win_high").agg(F.sum("net_paise").alias("sum"), F.count(F.lit(1)).alias("members"))
    blocks = blocks.groupBy("settles_on").agg(F.sum("sum").alias("sum"), F.sum("members").alias("members"), F.max("win_low").alias("low"), F.min("win_high").alias("high"))
    near = blocks.select("*", F.explode(F.sequence("low", "high")).alias("landed_on")).join(credits.select("landed_on", "credit_id", "amount_paise"), "landed_on")
    gap = F.abs(F.col("sum") - F.col("amount_paise"))
    pairs = near.where(gap <= SLACK_EACH * F.col("members") + SLACK).withColumns({"drift_days": F.datediff("landed_on", "settles_on"), "gap": gap})
    pairs = pairs.select("settles_on", "credit_id", "landed_on", "drift_days", "members", F.struct(F.abs("drift_days").alias("days"), "gap").alias("far"))
    for own, other in (("settles_on", "credit_id"), ("credit_id", "settles_on")):
        best = pairs.groupBy(own).agg(F.min(F.struct("far", other)).alias(f"best_{other}"))
        pairs = pairs.join(best, own)
    kept = pairs.where((F.col("best_credit_id.credit_id") == F.col("credit_id")) & (F.col("best_settles_on.settles_on") == F.col("settles_on")))
    return kept.select("credit_id", "settles_on", "landed_on", "drift_days", "members")


def solve_windows(payments: DataFrame, credits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((payment_id, credit_id, exact), what was searched) where payments may reach credits of several days.

    Credits hang together over the payments whose windows hold both, and as a
    window is a few days, that is a matter of neighbouring dates: dates with
    credits fall apart where no payment reaches from one to the next, which a
    running sum over one row a date finds. Longer stretches are cut into windows
    of WINDOW_DATES dates. Two rounds search them, every second one first, as
    those share no payment; the others choose from what is left.
    """
    spans = payments.groupBy("win_low", "win_high").agg(F.count(F.lit(1)).alias("n"))
    dates = credits.select("landed_on").distinct()
    touched = spans.select("win_low", "win_high", F.explode(F.sequence("win_low", "win_high")).alias("landed_on")).join(dates, "landed_on")
    # The last credit date that a payment which reaches this date reaches too.
    ends = touched.groupBy("win_low", "win_high").agg(F.max("landed_on").alias("end"))
    reach = touched.join(ends, ["win_low", "win_high"]).groupBy("landed_on").agg(F.max("end").alias("reach"))
    order = W.orderBy("landed_on")
    begun = F.coalesce((F.max("reach").over(order.rowsBetween(W.unboundedPreceding, -1)) < F.col("landed_on")).cast("int"), F.lit(1))
    islands = reach.withColumn("island", F.sum(begun).over(order))
    windows = islands.withColumn("window", ((F.row_number().over(W.partitionBy("island").orderBy("landed_on")) - 1) / WINDOW_DATES).cast("int"))
    windows = cut(windows.select("landed_on", "island", "window"))
    placed = credits.join(windows, "landed_on").withColumn("group", F.concat_ws(" ", F.col("island").cast("string"), F.col("window").cast("string")))
    taken, seen = None, None
    for turn in (0, 1):
        own = placed.where(F.col("window") % 2 == turn)
        item = F.struct("landed_on", "credit_id", "amount_paise", F.col("amount_paise").alias("room"))
        asked = own.groupBy("group").agg(F.array_sort(F.collect_list(item)).alias("credits"))
        reached = own.select("group", "landed_on").distinct().join(touched, "landed_on").select("group", "win_low", "win_high").distinct()
        left = payments if taken is None else payments.join(taken.select("payment_id"), "payment_id", "left_anti")
        amounts = left.groupBy("win_low", "win_high", "net_paise").agg(F.count(F.lit(1)).alias("n")).join(reached, ["win_low", "win_high"])
        gathered = amounts.groupBy("group").agg(
            F.array_sort(F.collect_list(F.struct("net_paise", F.col("win_low").alias("low"), F.col("win_high").alias("high"), "n"))).alias("own"), (SLACK_EACH * F.sum("n") + SLACK).alias("slack")
        )
        solved = cut(_searched(gathered.join(asked, "group").withColumn("reaching", F.lit(True))))
        some = cut(_taken(left, solved, "win_low", "win_high"))
        taken = some if taken is None else taken.unionByName(some)
        seen = solved if seen is None else seen.unionByName(solved)
    return taken, seen


def search_report(solved: DataFrame) -> DataFrame:
    """(method, status, searches, asked, met, tried, largest_space): what searches there were, how many credits they asked for and met, and the largest number of choices, as a power of two."""
    return solved.groupBy("method", "status").agg(
        F.count(F.lit(1)).alias("searches"), F.sum("asked").alias("asked"), F.sum(F.size("met")).cast("long").alias("met"), F.sum("tried").alias("tried"), F.max("space").alias("largest_space")
    )


def attribute(payments: DataFrame, credits: DataFrame) -> DataFrame:
    """(payment_id, credit_id, stage, exact): payments and the credits that they settle into, by stages that take what the earlier ones left.

    Whole dates, on time or late; dates with one open credit, which takes all
    payments of the date that it is reached by; dates with several; and what is
    left within windows over several dates. ``payments`` has settles_on,
    win_low, win_high and net_paise. A payment belongs to one credit at most.
    """
    columns = ["payment_id", "credit_id", "stage", "exact"]
    credits = cut(credits.select("credit_id", "landed_on", "amount_paise"))
    whole = by_whole_dates(payments, credits)
    taken = cut(payments.join(whole.select("settles_on", "credit_id"), "settles_on").select("payment_id", "credit_id", F.lit("whole_date").alias("stage"), F.lit(True).alias("exact")))

    def left() -> tuple[DataFrame, DataFrame]:
        return payments.join(taken.select("payment_id"), "payment_id", "left_anti"), credits.join(taken.select("credit_id").distinct(), "credit_id", "left_anti")

    open_payments, open_credits = left()
    alone = by_single_credit(open_payments, open_credits).where("attributed").select(F.col("landed_on").alias("settles_on"), "credit_id")
    single = open_payments.join(alone, "settles_on").select("payment_id", "credit_id", F.lit("single").alias("stage"), F.lit(True).alias("exact"))
    taken = cut(taken.unionByName(single))
    several = by_several_credits(*left()).withColumn("stage", F.lit("several"))
    taken = cut(taken.unionByName(several.select(*columns)))
    late, _ = solve_windows(*left())
    return taken.unionByName(late.withColumn("stage", F.lit("window")).select(*columns))
