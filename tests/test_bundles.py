"""Merging inside bundles gives what merging in rounds gives."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import matching


@pytest.mark.parametrize("folded", [100, 10])
def test_bundles_merge_as_rounds_do(spark, monkeypatch, folded):
    monkeypatch.setattr(matching, "FOLDED", folded)
    rows = spark.range(400).selectExpr("concat('g', id) AS match_id", "CASE WHEN id % 40 < 25 THEN id % 3 WHEN id % 40 < 39 THEN id div 6 + 10 END AS bundle", "(id * 7919) % 23 AS price")
    name = F.coalesce(F.col("bundle").cast("string"), F.lit("none"))
    one = F.struct(F.concat(F.lit("x"), name).alias("relation"), F.when(F.col("price") != 5, F.pmod(F.hash("match_id"), F.lit(4)).cast("string")).alias("row_id"))
    two = F.struct(F.concat(F.lit("y"), name).alias("relation"), F.pmod(F.hash(F.reverse("match_id")), F.lit(5)).cast("string").alias("row_id"))
    rows = rows.withColumn("claims", F.when(F.col("price") == 7, F.array().cast("array<struct<relation: string, row_id: string>>")).otherwise(F.array(one, two)))
    claimed = rows.select("match_id", F.explode("claims").alias("c")).select("match_id", "c.*")
    want = sorted(map(tuple, matching.merged(rows, claimed, [-F.col("price")]).collect()))
    rounds = []
    inner = matching.merged
    monkeypatch.setattr(matching, "merged", lambda *a: rounds.append(1) or inner(*a))
    assert sorted(map(tuple, matching.merged_within(rows, "bundle", "claims", [-F.col("price")]).collect())) == want
    assert len(want) == 400 and len(rounds) == (folded == 10)
