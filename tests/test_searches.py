"""Searches for payments that add up, at sizes where a copy of the work for each payment, or one task for all groups, would show."""

from datetime import date

import numpy as np
from pyspark.sql import functions as F

from tallyspark.operators import attribution, subsets


def test_many_copies_of_each_amount_are_split():
    """Pools of copies of one amount reach few sums; those of all amounts alike find the split."""
    values = np.random.default_rng(7).integers(500_000, 45_000_000, 47)
    counts, slack = np.full(47, 60), 11_480
    total = int((values * counts).sum())
    done = subsets.split(values, counts, [total // 3, total - total // 3 - 40_000_000], slack)
    assert done.status == "found"
    taken = [int((values * p).sum()) for p in done.parts]
    assert abs(taken[0] - total // 3) <= slack and abs(taken[1] - (total - total // 3 - 40_000_000)) <= slack
    assert (sum(done.parts) <= counts).all()


def test_what_needs_leave_must_be_a_choice_too():
    """No choice sums up to the 7 that both needs would leave: all is seen at once, though either need is met by very many."""
    values = np.random.default_rng(3).integers(1_000_000, 50_000_000, 60) * 10
    total, counts = int(values.sum()), np.ones(60, np.int64)
    done = subsets.split(values, counts, [total // 3, total - total // 3 - 7], 1)
    assert (done.status, done.tried) == ("none", 0)


def test_sums_are_kept_once_in_order():
    assert subsets._with(np.array([0, 3, 5]), 2).tolist() == [0, 2, 3, 5, 7]
    assert subsets._with(np.zeros(0, np.int64), 2).tolist() == []


def test_unreachable_agrees_with_all_choices():
    rng = np.random.default_rng(11)
    for _ in range(200):
        values, counts = rng.integers(1, 30, 5), rng.integers(0, 3, 5)
        low = int(rng.integers(0, 120))
        sums = {0}
        for v, c in zip(values.tolist(), counts.tolist(), strict=True):
            sums = {s + k * v for s in sums for k in range(c + 1)}
        assert subsets.unreachable(values, counts, low, low + 2) == (not sums & {low, low + 1, low + 2})


def test_searches_are_dealt_out(spark):
    """Groups are small in bytes, so that by size all went to one task."""
    d = date(2024, 1, 1)
    own = [{"low": d, "high": d, "net_paise": 100 * k + 7, "n": 1} for k in range(1, 4)]
    credits = [{"credit_id": f"c{k}", "amount_paise": 100 * k + 7, "landed_on": d, "room": 100 * k + 7} for k in range(1, 4)]
    item = "struct<low: date, high: date, net_paise: long, n: long>"
    credit = "struct<credit_id: string, amount_paise: long, landed_on: date, room: long>"
    groups = spark.createDataFrame([(f"g{k}", own, credits, False, 0) for k in range(40)], f"group string, own array<{item}>, credits array<{credit}>, reaching boolean, slack long").repartition("group")
    found = attribution._searched(groups)
    assert found.where("method = 'all' AND status = 'found'").count() == 40
    assert found.selectExpr("spark_partition_id() AS task").distinct().count() > 10


def test_a_date_is_one_search_however_many_amounts_it_has(spark):
    """60,000 different amounts: more than were searched together, when buckets of amounts were laid end to end over the credits."""
    rows = spark.range(60_000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("payment_id"), F.lit(date(2024, 1, 1)).alias("settles_on"), (F.col("id") * 7 + 1_000_003).alias("net_paise"))
    total = sum(k * 7 + 1_000_003 for k in range(60_000))
    credits = spark.createDataFrame([("c1", date(2024, 1, 1), total // 3), ("c2", date(2024, 1, 1), total // 5), ("c3", date(2024, 1, 1), total - total // 3 - total // 5)], "credit_id string, landed_on date, amount_paise long")
    found = attribution.solve_dates(rows, credits).collect()
    assert [(r.group, r.method, r.status, r.asked, sorted(r.met)) for r in found] == [("2024-01-01", "all", "found", 3, ["c1", "c2", "c3"])]
    taken = {c: sum(t.net_paise * t.n for t in found[0].takes if t.credit_id == c) for c in ("c1", "c2", "c3")}
    assert sum(t.n for t in found[0].takes) == 60_000 and sum(taken.values()) == total
    assert abs(taken["c1"] - total // 3) <= 4 * 60_000 + 200 and abs(taken["c2"] - total // 5) <= 4 * 60_000 + 200
