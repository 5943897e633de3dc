import pytest

from tallyspark.operators import forecast
from tallyspark.plans import adapters as ad
from tallyspark.plans import catalogue, closing, reports, rounds  # noqa: F401
from tests.oracle import SF_DIR, compare


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_oracle(spark, name):
    rows, off = compare(spark, catalogue.QUERIES[name], catalogue.ORACLES[name])
    assert not off
    assert rows or name in ("qa_settlement_detail", "qa_settlement_on_date")


def test_multi_credit_attribution_keeps_its_invariants(spark):
    found = catalogue.QUERIES["attribution_multi"](spark, SF_DIR).collect()
    assert found and len({r.payment_id for r in found}) == len(found)


def test_scores_separate_true_pairs(spark):
    scored = catalogue.QUERIES["linkage_scores"](spark, SF_DIR)
    true = scored.where("substring(payment_id, 5) = substring(invoice_id, 5)")
    assert true.where("band = 'link'").count() > 0.95 * true.count()
    assert scored.where("substring(payment_id, 5) <> substring(invoice_id, 5) AND band = 'link'").count() < 0.05 * true.count()


def test_money_is_never_a_double(spark):
    for name in ("settlement_expected_by_date", "waterfall_settlements", "waterfall_lines", "typed_exceptions", "cost_of_outcomes", "allocate_largest_remainder"):
        kinds = dict(catalogue.QUERIES[name](spark, SF_DIR).dtypes)
        assert all(kind == "bigint" for column, kind in kinds.items() if column.endswith("_paise"))


def test_partitions_do_not_change_results(spark):
    def rows(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(tuple, catalogue.QUERIES["waterfall_lines"](spark, SF_DIR).collect()))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert rows("1") == rows("13")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_waterfall_closes(spark):
    lines = catalogue.QUERIES["waterfall_lines"](spark, SF_DIR).groupBy("settlement_id").sum("amount_paise")
    ends = catalogue.QUERIES["waterfall_settlements"](spark, SF_DIR)
    assert ends.join(lines, "settlement_id").where("gross_paise + `sum(amount_paise)` != net_received_paise").count() == 0
    assert ends.where("balanced").count() > 0


def test_the_ladder_covers_the_whole_series(spark):
    series = forecast.spine(ad.daily_orders(spark, SF_DIR))
    assert series.count() > 200
    want = forecast.ladder(forecast.backtest(series, ("drift",)), forecast.seasonal_naive_errors(series)).first()
    got = {r.model: r for r in catalogue.QUERIES["forecast_ladder"](spark, SF_DIR).collect()}
    assert len(got) == len(forecast.MODELS) and got["drift"] == want
