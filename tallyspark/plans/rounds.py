"""Queries over what takes several rounds or a search: attribution by stages, assignment, merging, proofs and budgets; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import assignment, attribution, audit, evaluation, linkage, matching
from tallyspark.plans import adapters as ad
from tallyspark.plans import reconcile
from tallyspark.plans.catalogue import _TREE, FIXED_WEIGHTS, _levels, query


def _due(spark, d):
    return ad.settled(spark, d).where("settles_on IS NOT NULL AND win_low IS NOT NULL AND win_high IS NOT NULL").select("payment_id", "settles_on", "win_low", "win_high", "amount_paise", "net_paise")


@query("""SELECT credit_id, settles_on, landed_on, drift_days, members FROM (
  SELECT *, row_number() OVER (PARTITION BY settles_on ORDER BY abs(drift_days), gap, credit_id) AS of_date, row_number() OVER (PARTITION BY credit_id ORDER BY abs(drift_days), gap, settles_on) AS of_credit FROM (
  SELECT c.credit_id, b.settles_on, c.landed_on, datediff('day', b.settles_on, c.landed_on)::INT AS drift_days, b.members, abs(b.total - c.amount_paise) AS gap FROM (
  SELECT settles_on, max(win_low) AS low, min(win_high) AS high, sum(net_paise)::BIGINT AS total, count(*) AS members FROM settled WHERE settles_on IS NOT NULL AND win_low IS NOT NULL AND win_high IS NOT NULL GROUP BY settles_on) b
  JOIN credits c ON c.landed_on BETWEEN b.low AND b.high WHERE abs(b.total - c.amount_paise) <= 4 * b.members + 200)) WHERE of_date = 1 AND of_credit = 1""")
def whole_date_credits(spark, d):
    """Credits that a whole settlement date adds up to; late ones win the payments of the day before."""
    return attribution.by_whole_dates(_due(spark, d), ad.credits(spark, d))


@query()
def attribution_stages(spark, d):
    """Every payment that some credit explains, with the stage that found it."""
    return attribution.attribute(_due(spark, d), ad.credits(spark, d))


@query()
def attribution_searches(spark, d):
    """What the search on dates with several credits came to, by method."""
    return attribution.search_report(attribution.solve_dates(_due(spark, d), ad.credits(spark, d)))


@query()
def one_to_one_links(spark, d):
    """Payments and invoices paired so that the bits of all pairs together are most; a pair below zero bits is none."""
    scored = linkage.scored(_levels(spark, d), FIXED_WEIGHTS)
    pairs = scored.select(F.col("payment_id").alias("left_id"), F.col("invoice_id").alias("right_id"), F.col("bits").alias("weight"))
    return assignment.one_to_one(pairs).select(F.col("left_id").alias("payment_id"), F.col("right_id").alias("invoice_id"), F.col("weight").alias("bits"))


@query(f"""WITH l0 AS (SELECT o_orderkey - (SELECT min(o_orderkey) FROM orders) AS seq, sha256(unhex('00') || encode(o_orderkey || '|' || o_orderstatus)) AS h FROM orders), {_TREE},
n AS (SELECT count(*) AS n FROM l0)
SELECT seq, len([l FOR l IN range(0, 34) IF xor(seq >> l, 1) < (n.n + (1::BIGINT << l) - 1) >> l])::INT AS steps, (SELECT h FROM l34) AS root FROM l0, n""", books=False)
def merkle_proofs(spark, d):
    """For every record of a log how many steps prove it, and the root that they lead to."""
    records = ad.table(spark, d, "orders").select("o_orderkey", F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("record"))
    least = records.agg(F.min("o_orderkey").alias("_m"), F.count(F.lit(1)).alias("_n")).first()
    leaves = audit.leaves(records.withColumn("seq", F.col("o_orderkey") - F.lit(least["_m"] or 0)), "seq", "record")
    return audit.proven(audit.new_nodes(leaves, 0, least["_n"]), leaves, least["_n"])


@query("""WITH RECURSIVE n AS (SELECT l_orderkey, l_orderkey || '-' || l_linenumber AS match_id, 'as ' || min(l_returnflag) AS m, 'at ' || min(l_tax) AS t, max(l_extendedprice) AS price FROM lineitem GROUP BY l_orderkey, l_linenumber),
g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY price DESC, match_id) AS k FROM n),
f AS (SELECT DISTINCT l_orderkey, 0::BIGINT AS k, []::VARCHAR[] AS held, NULL::VARCHAR AS match_id, NULL::BOOLEAN AS accepted FROM g
  UNION ALL SELECT g.l_orderkey, g.k, CASE WHEN list_has_any(held, [m, t]) THEN held ELSE held || [m, t] END, g.match_id, NOT list_has_any(held, [m, t]) FROM f JOIN g ON g.l_orderkey = f.l_orderkey AND g.k = f.k + 1)
SELECT match_id, accepted FROM f WHERE match_id IS NOT NULL""", books=False)
def stage_merge(spark, d):
    """Lines of an order as groups of one stage that claim one of the order's flags and taxes: the dearest first, each claim once."""
    lines = ad.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_tax").cast("string").alias("tax"), F.max("l_extendedprice").alias("price"))
    lines = lines.withColumn("match_id", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    claim = lambda prefix, c: F.struct(F.lit(prefix).alias("relation"), F.col(c).alias("row_id"))
    lines = lines.withColumn("claims", F.array(claim("as", "flag"), claim("at", "tax")))
    return matching.merged_within(lines, "l_orderkey", "claims", [-F.col("price")])


@query()
def returned_share_interval(spark, d):
    """A bootstrap interval of the returned lines' share of all lines' value."""
    lines = ad.table(spark, d, "lineitem").select((F.col("l_extendedprice") * (F.col("l_returnflag") == "R").cast("int")).alias("returned"), F.col("l_extendedprice").alias("value"))
    low, high = evaluation.ratio_interval(lines, "returned", "value") or (None, None)
    return spark.createDataFrame([(low, high)], "low double, high double")


@query()
def close_report(spark, d):
    """A whole close over the books: how much each part of it holds."""
    p, i = ad.payments(spark, d), ad.invoices(spark, d)
    truth = p.select("key", "payment_id").join(i.select("key", "invoice_id"), "key").select("payment_id", "invoice_id")
    refunds = p.where("key % 50 = 0").select(F.date_add("occurred_on", 2).alias("landed_on"), F.expr("amount_paise div 10").alias("amount_paise"))
    return reconcile.report(reconcile.close(p, i, ad.credits(spark, d), ad.days(spark, d), refunds=refunds, truth=truth))
