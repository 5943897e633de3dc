"""What rows carry to their blocks, and that names taken apart there are what they are in columns."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import blocking, linkage

NAMES = [
    "M/S Bose Exports Pvt. Ltd.", "m/s. customer 17 pvt. ltd.", "Customer 1002", "MESSRS Rao & Sons", "Shri Dr. A. K. Pillai and Co", "Zübeyde Ltd", "Straße Inc", "  ", "", "Ltd", "Co Ltd Corp",
    "Phoenix Khan Ghee", "A", "aeiou", "x\ty  z", "Dr", "M/S", "M/S  ", "İstanbul Çelik LLP", "ΣΑΣ", "店 123 😀", "P LTD and sons", "under_score 12", "Bhatt-Vaz (P) Limited", "sons of Rao", "0011 2233",
]


def test_names_are_taken_apart_alike(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", text.normal_name("n").alias("normal"), text.name_key("n").alias("key"), text.gram_buckets("n").alias("grams")).collect()
    for r in rows:
        normal = text.normal_name_of(r.n)
        assert (r.n, normal) == (r.n, r.normal)
        assert (r.n, " ".join(map(text.word_key_of, normal.split(" "))) if normal else "") == (r.n, r.key)
        counts = linkage._gram_counts([r.n], {})
        assert [int(c) for c in counts[0]] == [r.grams.count(b) for b in range(256)] and not counts[1].any()


def test_rows_carry_no_more_than_is_compared(spark):
    """No table of names is joined to the rows, and there are three shuffles: of ids to be counted, of the rows, and of the rows to their blocks; counts of patterns have one more."""
    columns = "row_id string, source string, reference string, amount_paise long, occurred_on date, counterparty string"
    rows = spark.createDataFrame([("p", "a", "r", 1, None, "N"), ("i", "b", "r", 1, None, "N")], columns)
    keys = {"reference": F.array("reference"), "name": F.array("counterparty")}
    for found, shuffles in ((linkage.compared_candidates(rows, keys, "left_id", "right_id"), 3), (linkage.counted_candidates(rows, keys), 4)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "collect_list" not in plan and "collect_set" not in plan
        assert plan.count("Exchange hashpartitioning") == shuffles
        assert found.count() == 1


def test_pairs_of_rows_with_many_keys(spark):
    """Of 150 keys all but the last are in too many rows: the pair is met in the block of that one."""
    shared = [f"k{n:03}" for n in range(150)]
    rows = [(f"p{n}", "a", shared) for n in range(3)] + [(f"i{n}", "b", [*shared[:149], f"only {n}"]) for n in range(3)] + [("i9", "b", shared[149:])]
    rows = spark.createDataFrame(rows, "row_id string, source string, keys array<string>")
    found = {(r.left_id, r.right_id) for r in blocking.candidates(rows, {"s": F.col("keys")}, 4).collect()}
    assert found == {(f"p{n}", "i9") for n in range(3)}
    with pytest.raises(Exception, match="too many keys"):
        blocking.candidates(rows.withColumn("keys", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: k.cast("string"))), {"s": F.col("keys")}).collect()


def _books(spark):
    columns = "row_id string, source string, reference string, amount_paise long, occurred_on date, counterparty string"
    rows = [(f"{s}{k:02}", s, f"ref {k % 20}", 100 * (k % 7), None, f"Customer {k % 4}") for k in range(40) for s in ("a", "b")]
    return spark.createDataFrame(rows, columns), {"reference": F.array("reference"), "amount": F.array(F.col("amount_paise").cast("string")), "name": F.array("counterparty")}


def test_a_fit_shares_the_shuffles_of_what_it_scores(spark):
    rows, keys = _books(spark)
    levels, counts = linkage.compared_candidates(rows, keys, "left_id", "right_id"), linkage.counted_candidates(rows, keys)
    model = linkage.fit([(tuple(r[f] for f in linkage.FIELDS), r["n"]) for r in counts.collect()])
    found = linkage.scored(levels, linkage.fitted(counts))
    got = sorted(map(tuple, found.drop("because").collect()))
    assert got == sorted(map(tuple, linkage.scored(levels, model).drop("because").collect())) and len(got) > 100
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
    none = linkage.fitted(counts.where("n < 0")).first()
    assert none.prior == linkage.fit([]).prior_bits and len(none.table) == len(linkage.FIELDS)


def test_what_leads_is_chosen_in_the_block(spark):
    rows, keys = _books(spark)
    model = linkage.Model([list(linkage.SEED_M)] * 5, [list(linkage.SEED_U)] * 5, linkage.SEED_SHARE)
    want = linkage.leading(linkage.scored(linkage.compared_candidates(rows, keys, "left_id", "right_id"), model), "left_id", "right_id")
    found = linkage.leading_candidates(rows, keys, model, "left_id", "right_id")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_only_open_rows_leave_as_pairs(spark):
    rows, keys = _books(spark)
    rows = rows.withColumn("open", F.col("row_id").isin("a01", "a02", "b01"))
    every = linkage.compared_candidates(rows, keys, "left_id", "right_id")
    found = linkage.compared_candidates(rows, keys, "left_id", "right_id", only="open")
    want = every.where("left_id IN ('a01', 'a02') AND right_id = 'b01'")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count()
    assert linkage.counted_candidates(rows, keys, only="open").agg(F.sum("n")).first()[0] == every.count()
