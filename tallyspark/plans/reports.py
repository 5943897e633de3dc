"""Queries behind reports: bounds on held-out claims, a fitted card, candidates by relation and by row, canonical records; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import blocking, calibration, linkage, waterfall
from tallyspark.plans import adapters as ad
from tallyspark.plans.catalogue import _BITS, _LEVELS, FIXED_WEIGHTS, _strategies, query


@query(f"""WITH c AS (SELECT l.doc_id, (1 - (n_chars % 50) / 100)::DECIMAL(10, 2) AS confidence, quality = 1 AS correct, ('0x' || sha256('20260101:' || l.doc_id)[1:8])::BIGINT < 2147483648 AS half FROM labels l JOIN documents USING (doc_id)),
a AS (SELECT unnest({list(calibration.TABLE_ALPHAS)}::DOUBLE[]) AS alpha),
s AS (SELECT DISTINCT confidence, count(*) OVER w AS admitted, count(*) FILTER (NOT correct) OVER w AS errors, count(*) OVER () AS total FROM c WHERE half WINDOW w AS (ORDER BY confidence DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT alpha, max({{'a': admitted, 'c': confidence, 'e': errors}}) FILTER (total >= 30 AND alpha - (1 - alpha) / total > 0 AND errors <= (alpha - (1 - alpha) / total) * admitted).c AS threshold FROM s, a GROUP BY alpha),
h AS (SELECT alpha, threshold, count(*) AS held_out, count(*) FILTER (confidence >= threshold) AS posted, count(*) FILTER (confidence >= threshold AND NOT correct) AS wrong FROM t, c WHERE NOT half GROUP BY alpha, threshold)
SELECT alpha, threshold, held_out, posted, wrong, held_out - posted AS reviewed, round(coalesce(wrong / nullif(posted, 0), 0), 6) AS realised, round(posted / held_out, 6) AS coverage, CASE WHEN threshold IS NOT NULL THEN coalesce(wrong / nullif(posted, 0), 0) <= alpha END AS holds FROM h""", books=False)
def coverage_table(spark, d):
    """What five bounds promise on one half of the claims and keep on the other."""
    return calibration.coverage_table(ad.labelled_claims(spark, d), "doc_id")


@query()
def fitted_card(spark, d):
    """The contract's rates with those in their place that the settlements bear out."""
    members = ad.settled(spark, d).where("settles_on IS NOT NULL").select("settles_on", "method", "amount_paise")
    received = ad.credits(spark, d).groupBy(F.col("landed_on").alias("settles_on")).agg(F.sum("amount_paise").alias("net_received_paise"))
    fit = waterfall.fit_rates_over(waterfall.design(members, received, "settles_on"))
    rows = [(m, contract, None if rate is None else round(rate, 2), round(share, 6), bps, sure) for m, contract, rate, share, bps, sure in waterfall.fitted_card(fit)]
    return spark.createDataFrame(rows, "method string, contract_bps int, effective_bps double, share double, card_bps int, fitted boolean")


@query(""", r AS (SELECT payment_id AS row_id, 'gateway' AS source, reference, settles_on AS due FROM settled UNION ALL SELECT invoice_id, 'ledger', reference, occurred_on FROM invoices UNION ALL SELECT credit_id, 'bank', NULL, landed_on FROM credits),
k AS (SELECT 'reference' AS strategy, row_id, source, reference AS key FROM r WHERE reference IS NOT NULL UNION ALL SELECT 'due', row_id, source, due::VARCHAR FROM r WHERE due IS NOT NULL),
z AS (SELECT strategy, key FROM k GROUP BY ALL HAVING count(*) BETWEEN 2 AND 400),
p AS (SELECT DISTINCT a.strategy, a.row_id AS left_id, b.row_id AS right_id FROM z JOIN k a USING (strategy, key) JOIN k b USING (strategy, key) WHERE (strategy = 'reference' AND a.source = 'gateway' AND b.source = 'ledger') OR (strategy = 'due' AND a.source = 'bank' AND b.source = 'gateway'))
SELECT left_id, right_id, array_to_string(list_sort(list(strategy)), ',') AS why FROM p GROUP BY left_id, right_id""")
def blocking_by_relation(spark, d):
    """Candidates among three sources: references between gateway and ledger only, due dates between bank and gateway only."""
    none = F.lit(None).cast("string")
    p = ad.settled(spark, d).select(F.col("payment_id").alias("row_id"), F.lit("gateway").alias("source"), "reference", F.col("settles_on").alias("due"))
    i = ad.invoices(spark, d).select(F.col("invoice_id").alias("row_id"), F.lit("ledger").alias("source"), "reference", F.col("occurred_on").alias("due"))
    c = ad.credits(spark, d).select(F.col("credit_id").alias("row_id"), F.lit("bank").alias("source"), none.alias("reference"), F.col("landed_on").alias("due"))
    keys = {"reference": F.array("reference"), "due": F.array(F.col("due").cast("string"))}
    found = blocking.candidates(p.unionByName(i).unionByName(c), keys, between={"reference": [("gateway", "ledger")], "due": [("gateway", "bank")]})
    return found.select("left_id", "right_id", F.array_join("why", ",").alias("why"))


@query("""SELECT g.settles_on, g.members, c.credit_id, CASE WHEN c.landed_on = g.settles_on THEN 3 WHEN c.landed_on BETWEEN g.win_low AND g.win_high THEN 2 WHEN abs(c.landed_on - g.settles_on) <= 7 THEN 1 ELSE 0 END AS date
FROM (SELECT settles_on, win_low, win_high, count(*) AS members FROM settled WHERE settles_on IS NOT NULL AND win_low IS NOT NULL AND win_high IS NOT NULL GROUP BY ALL) g JOIN credits c ON c.landed_on BETWEEN g.settles_on - 9 AND g.settles_on + 9""")
def settlement_date_levels(spark, d):
    """How well the dates of payments and of credits near them agree, through the bank calendar; payments of a window go together."""
    due = ["settles_on", "win_low", "win_high"]
    groups = ad.settled(spark, d).where(" AND ".join(f"{c} IS NOT NULL" for c in due)).groupBy(*due).agg(F.count(F.lit(1)).alias("members"))
    near = groups.withColumn("_on", F.explode(F.sequence(F.date_sub("settles_on", 9), F.date_add("settles_on", 9))))
    pairs = near.join(ad.credits(spark, d).select("credit_id", F.col("landed_on").alias("d2")), F.col("_on") == F.col("d2"))
    sides = pairs.select("settles_on", "members", "credit_id", F.lit(False).alias("at_bank1"), F.lit(True).alias("at_bank2"), F.lit(None).cast("date").alias("d1"), "d2", *(F.col(c).alias(f"{c}1") for c in due), *(F.lit(None).cast("date").alias(f"{c}2") for c in due))
    return sides.select("settles_on", "members", "credit_id", linkage.related_date_level(1, 2).alias("date"))


@query(f"""{_LEVELS}, b AS (SELECT payment_id, invoice_id, round(({_BITS})::DOUBLE, 6) AS bits FROM levels), k AS (SELECT *, row_number() OVER (PARTITION BY payment_id ORDER BY bits DESC, invoice_id) AS place FROM b)
SELECT payment_id, string_agg(invoice_id, ',' ORDER BY place) AS invoices, max(bits) AS most_bits, count(*)::INT AS shown FROM k WHERE place <= 6 GROUP BY payment_id""")
def leading_candidates(spark, d):
    """The six invoices that speak most for each payment, as a report on an open payment shows them."""
    found = linkage.leading_candidates(*_strategies(spark, d), FIXED_WEIGHTS, "payment_id", "invoice_id")
    return found.select("payment_id", F.array_join(F.transform("leading", lambda c: c["invoice_id"]), ",").alias("invoices"), F.get("leading", F.lit(0))["bits"].alias("most_bits"), F.size("leading").alias("shown"))


@query("""SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","o_orderkey":' || o_orderkey || ',"o_orderstatus":' || coalesce('"' || o_orderstatus || '"', 'null') || '}') AS content FROM orders""", books=False)
def canonical_digests(spark, d):
    """A digest of each order's canonical text."""
    orders = ad.table(spark, d, "orders")
    return orders.select("o_orderkey", text.content_hash(orders, ["o_orderkey", "o_orderstatus", "o_custkey", "o_orderdate"]).alias("content"))
