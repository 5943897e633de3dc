import datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import calendar
from tallyspark.operators import evaluation
from tallyspark.plans import reconcile
from tallyspark.sources import generator


@pytest.fixture(scope="module")
def books(spark):
    made = {k: v.cache() for k, v in generator.generate(spark).items()}
    closed = {k: v.cache() for k, v in reconcile.close(made["payments"], made["invoices"], made["credits"], made["days"], truth=made["truth"]).items()}
    return made, closed


def test_links_are_right(books):
    made, closed = books
    truth = made["truth"].where("invoice_id IS NOT NULL").select("payment_id", "invoice_id")
    score = evaluation.confusion(closed["links"], truth, ["payment_id", "invoice_id"]).first()
    assert score.precision >= 0.98 and score.recall >= 0.95
    exact = evaluation.confusion(closed["links"].where("stage = 'exact'"), truth, ["payment_id", "invoice_id"]).first()
    assert exact.precision == 1.0 and 0.5 < exact.recall < 1.0


def test_attribution_is_right(books):
    made, closed = books
    truth = made["truth"].where("credit_id IS NOT NULL").select("payment_id", "credit_id")
    score = evaluation.confusion(closed["attributed"], truth, ["payment_id", "credit_id"]).first()
    assert score.precision >= 0.98 and score.recall >= 0.83
    assert not [r for r in closed["attributed"].groupBy("payment_id").count().collect() if r["count"] > 1]
    assert closed["attributed"].count() == closed["attributed"].select("payment_id").distinct().count()


def test_every_row_ends_in_one_place(books):
    made, closed = books
    places = closed["duplicates"].select("payment_id").unionByName(closed["attributed"].select("payment_id"))
    lost = closed["exceptions"].where("exception_type = 'missing_in_bank'").select(F.element_at("source_ids", 1).alias("payment_id"))
    placed = places.unionByName(lost)
    assert placed.count() == placed.distinct().count() == made["payments"].count()
    assert closed["settlements"].where("residual_before_naming_paise = 0").count() > 0 and closed["exceptions"].select("exception_id").distinct().count() == closed["exceptions"].count()
    assert {r.part for r in reconcile.report(closed).collect()} == set(closed)


def test_generator_is_deterministic(spark):
    one, two = (sorted(map(tuple, generator.generate(spark, days=4)["payments"].repartition(n).collect())) for n in (1, 5))
    assert one == two


def test_groups_residue_and_metrics(books):
    made, closed = books
    groups = {r.credit_id: r for r in closed["groups"].collect()}
    assert sum(g.member_count for g in groups.values()) == closed["attributed"].count() and all(0.5 <= g.confidence <= 0.99 for g in groups.values())
    kinds = {(r.kind, r.exception_type) for r in closed["residue"].collect()}
    assert kinds <= {("payment", "missing_in_bank"), ("bank_line", "missing_in_ledger"), ("invoice", "missing_in_gateway")} and kinds
    row = closed["metrics"].first()
    assert row.post_precision >= 0.98 and row.match_rate > 0.9 and row.posted == closed["links"].count()
    assert {r.stage for r in closed["attributed"].select("stage").distinct().collect()} <= {"whole_date", "single", "several", "window"}


def test_settlements_meet_their_bank_line_by_reference(spark):
    days = reconcile_days(spark)
    day = lambda k: datetime.date(2026, 3, k)
    settled = spark.createDataFrame([("s1", "NEFT-HDFC940235305794", 100, day(2)), ("s2", "UTR2000000001", 50, day(2)), ("s3", "UTR2000000002", 70, day(2)), ("s4", "", 1, day(2))], "settlement_id string, reference string, amount_paise long, occurred_on date")
    credits = spark.createDataFrame([("c1", "HDFC940235305794", 100, day(3)), ("c2", "UTR2000000001", 51, day(3)), ("c3", "UTR2000000002", 70, day(20)), ("c4", None, 1, day(2))], "credit_id string, reference string, amount_paise long, landed_on date")
    assert [tuple(r) for r in reconcile.utr_stage(settled, credits, days).collect()] == [("s1", "c1")]


def reconcile_days(spark):
    return calendar.calendar(spark, "2026-02-20", "2026-03-31")


def test_a_later_stage_only_adds(spark):
    columns = "match_id string, relation string, payment_id string, invoice_id string, credit_id string, confidence double"
    first = reconcile.add_stage(None, "one", spark.createDataFrame([("a", "pays_invoice", "p1", "i1", None, 1.0), ("b", "pays_invoice", "p1", "i2", None, 0.9), ("c", "pays_invoice", "p2", "i2", None, 0.8)], columns))
    assert {r.match_id for r in first.collect()} == {"a", "c"}
    then = reconcile.add_stage(first, "two", spark.createDataFrame([("d", "pays_invoice", "p3", "i2", None, 1.0), ("e", "settles_into", "p1", None, "c1", 1.0), ("f", "settles_into", "p1", None, "c2", 1.0), ("g", "pays_invoice", "p3", "i3", None, 0.1)], columns))
    assert {(r.match_id, r.stage) for r in then.collect()} == {("a", "one"), ("c", "one"), ("e", "two"), ("g", "two")}
