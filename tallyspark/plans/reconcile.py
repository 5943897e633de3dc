"""A whole close: duplicates, exact keys, blocking, linkage, attribution, waterfall and what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.functions.money import with_fees
from tallyspark.operators import attribution, blocking, evaluation, exceptions, linkage, matching, waterfall
from tallyspark.session import cut


def _strategies() -> dict[str, Column]:
    """Rows that share a reference, an amount or a name are candidates."""
    return {
        "reference": F.array(F.concat(F.lit("ref:"), text.normal_reference("reference"))),
        "amount": F.array(F.concat(F.lit("amt:"), F.abs("amount_paise").cast("string"))),
        "counterparty": F.array(F.concat(F.lit("cp:"), F.array_join(F.array_sort(text.name_tokens("counterparty")), " ")), F.concat(F.lit("ph:"), text.name_key("counterparty"))),
    }


def _rows(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    side = lambda df, own, source: df.select(F.col(own).alias("row_id"), F.lit(source).alias("source"), *linkage.COMPARED, *(c for c in ("open",) if c in df.columns))
    return side(payments, "payment_id", "gateway").unionByName(side(invoices, "invoice_id", "ledger"))


def candidates(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """(payment_id, invoice_id, why): pairs that share a reference, an amount or a name."""
    return blocking.candidates(_rows(payments, invoices), _strategies()).select(F.col("left_id").alias("payment_id"), F.col("right_id").alias("invoice_id"), "why")


def _open_scored(payments: DataFrame, invoices: DataFrame, made: DataFrame) -> DataFrame:
    """(payment_id, invoice_id, bits, probability, band) of the candidates, neither of them linked by ``made``, that link or are to be reviewed; the fit sees all pairs.

    Pairs are compared and counted where they are met; those of linked rows and
    those that are rejected, nearly all, leave no task. Dates that are compared
    through the bank calendar need the pairs themselves.
    """
    if all(c in df.columns for df in (payments, invoices) for c in linkage.DUE):
        compared = cut(linkage.compared(candidates(payments, invoices), payments, invoices, "payment_id", "invoice_id"))
        model = linkage.fitted(linkage.pattern_counts(compared))
        compared = compared.join(made.select("payment_id"), "payment_id", "left_anti").join(made.select("invoice_id"), "invoice_id", "left_anti")
    else:
        marked = lambda df, own: df.join(made.select(own, F.lit(False).alias("_linked")), own, "left").withColumn("open", F.col("_linked").isNull())
        # Only what is compared: written once, for the counts of the blocks, the blocks and the fit.
        rows = cut(_rows(marked(payments, "payment_id"), marked(invoices, "invoice_id")))
        compared = linkage.compared_candidates(rows, _strategies(), "payment_id", "invoice_id", only="open")
        model = linkage.fitted(linkage.counted_candidates(rows, _strategies(), only="open"))
    return cut(linkage.scored(compared, model).where("band != 'reject'").select("payment_id", "invoice_id", "bits", "probability", "band"))


def utr_stage(settlements: DataFrame, credits: DataFrame, days: DataFrame, most_days: int = 2) -> DataFrame:
    """(settlement_id, credit_id): a gateway's settlements and the only credit of their reference, of the same amount and at most some open days later.

    ``settlements`` has settlement_id, reference, amount_paise and occurred_on;
    ``credits`` credit_id, reference, amount_paise and landed_on.
    """
    dated = lambda df, on, name: df.join(F.broadcast(days.select(F.col("ds").alias("_ds"), F.col("bd_ord").alias(name))), F.col(on) == F.col("_ds")).drop("_ds")
    left = dated(settlements.select("settlement_id", text.normal_reference("reference").alias("utr"), F.col("amount_paise").alias("settled_paise"), "occurred_on"), "occurred_on", "_from").where("utr != ''")
    right = dated(credits.select("credit_id", text.normal_reference("reference").alias("utr"), "amount_paise", "landed_on"), "landed_on", "_to")
    accept = (F.col("amount_paise") == F.col("settled_paise")) & (F.col("_to") - F.col("_from")).between(0, most_days)
    return matching.first_accepted(left, right, "settlement_id", ["utr"], accept).select("settlement_id", "credit_id")


def _claims(groups: DataFrame) -> DataFrame:
    """(match_id, relation, row_id): what the groups of a stage claim: an invoice's and a payment's only link, and a payment's only settlement."""
    links = groups.where("relation = 'pays_invoice'").select("match_id", "relation", F.explode(F.array(F.concat(F.lit("p:"), "payment_id"), F.concat(F.lit("i:"), "invoice_id"))).alias("row_id"))
    return links.unionByName(groups.where("relation = 'settles_into'").select("match_id", "relation", F.col("payment_id").alias("row_id")))


def add_stage(made: DataFrame | None, stage: str, found: DataFrame) -> DataFrame:
    """``made`` with what a stage adds to it: nothing that it claims already, and of the stage's own groups the first on each claim.

    Groups have match_id, relation, payment_id, invoice_id, credit_id and
    confidence; the stage's groups go by confidence, then by id.
    """
    found = cut(found.withColumn("stage", F.lit(stage)))
    if made is not None:
        taken = _claims(made).select("relation", "row_id").distinct()
        found = found.join(_claims(found).join(taken, ["relation", "row_id"], "left_semi").select("match_id").distinct(), "match_id", "left_anti")
    kept = matching.merged(found, _claims(found), [-F.col("confidence")]).where("accepted").select("match_id")
    found = cut(found.join(kept, "match_id"))
    return found if made is None else made.unionByName(found)


def close(payments: DataFrame, invoices: DataFrame, credits: DataFrame, days: DataFrame, refunds: DataFrame | None = None, settlements: DataFrame | None = None, truth: DataFrame | None = None) -> dict[str, DataFrame]:
    """All that a close finds, a table for each part of it.

    duplicates; links (payment to invoice); review; utr (a gateway's settlements
    and their bank lines, where ``settlements`` is given and credits have a
    reference); attributed (payment to credit, by stages); groups (a credit's
    members with its confidence); settlements (with ``refunds``: amount_paise and
    landed_on, which the first credit of their date bears); residue (what nothing placed, with its type); exceptions; and
    metrics, where ``truth`` (payment_id, invoice_id) is given.

    Each stage takes what the earlier ones left open and may only add, and every
    input row ends in exactly one place. The fit sees all candidate pairs, as
    counts of at most 5**5 patterns; the driver sees nothing else.
    """
    marked = cut(matching.mark_duplicates(payments, ["reference", "amount_paise", "occurred_on"], "payment_id"))
    duplicates = marked.where("is_duplicate").select("payment_id", "survivor", "amount_paise", "occurred_on")
    live = marked.where("NOT is_duplicate").drop("survivor", "is_duplicate")

    link = lambda df, probability: df.select(
        F.concat_ws(" ", "payment_id", "invoice_id").alias("match_id"), F.lit("pays_invoice").alias("relation"), "payment_id", "invoice_id", F.lit(None).cast("string").alias("credit_id"), probability.cast("double").alias("confidence")
    )
    exact = matching.unique_matches(live.select("payment_id", "reference", "amount_paise"), invoices.select("invoice_id", "reference", "amount_paise"), "payment_id", "invoice_id", ["reference", "amount_paise"])
    made = add_stage(None, "exact", link(exact, F.lit(1.0)))

    open_pairs = _open_scored(live, invoices, made)
    linked = matching.mutual_best(open_pairs.where("band = 'link'"), "payment_id", "invoice_id", "bits")
    made = add_stage(made, "linkage", link(linked, F.col("probability")))
    review = open_pairs.where("band = 'review'").select("payment_id", "invoice_id", "bits", "probability")

    fees = with_fees(live).join(F.broadcast(days.select(F.col("ds").alias("occurred_on"), "settles_on", "win_low", "win_high")), "occurred_on")
    due = cut(fees.where("settles_on IS NOT NULL AND win_low IS NOT NULL AND win_high IS NOT NULL"))
    found = attribution.attribute(due, credits.select("credit_id", "landed_on", "amount_paise"))
    settles = found.select(
        F.concat_ws(" ", "payment_id", "credit_id").alias("match_id"), F.lit("settles_into").alias("relation"), "payment_id", F.lit(None).cast("string").alias("invoice_id"), "credit_id",
        F.when(F.col("exact"), 1.0).otherwise(0.5).alias("confidence"), F.col("stage").alias("how"), "exact",
    )
    made = add_stage(made, "attribution", settles.drop("how", "exact"))
    links = made.where("relation = 'pays_invoice'").select("payment_id", "invoice_id", "stage", F.col("confidence").alias("probability"))
    attributed = cut(made.where("relation = 'settles_into'").select("match_id").join(settles, "match_id").select("payment_id", "credit_id", "exact", F.col("how").alias("stage")))

    received = credits.select("credit_id", F.col("landed_on").alias("settled_on"), F.col("amount_paise").alias("net_received_paise"))
    members = due.join(attributed.select("payment_id", "credit_id"), "payment_id").join(received, "credit_id").withColumnsRenamed({"settled_on": "landed_on", "net_received_paise": "target_paise"})
    groups = attribution.groups(members, links)
    taken = None if refunds is None else waterfall.refunds_by_date(refunds, received.groupBy(F.col("settled_on").alias("landed_on")).agg(F.min("credit_id").alias("credit_id")), "landed_on")
    fallen = waterfall.settle(waterfall.totals(members, "credit_id", taken), received, "credit_id")

    residue = matching.unmatched(live, attributed, "payment_id").select(F.col("payment_id").alias("row_id"), F.lit("payment").alias("kind"), F.lit("credit").alias("direction"), "amount_paise", F.col("occurred_on").alias("as_of"))
    for df, placed, on, kind, day in ((credits, attributed, "credit_id", "bank_line", "landed_on"), (invoices, links, "invoice_id", "invoice", "occurred_on")):
        residue = residue.unionByName(matching.unmatched(df, placed, on).select(F.col(on).alias("row_id"), F.lit(kind).alias("kind"), F.lit("credit").alias("direction"), "amount_paise", F.col(day).alias("as_of")))
    residue = cut(residue.withColumn("exception_type", exceptions.residue_type("kind", "direction", "amount_paise")))

    raised = [
        duplicates.select(F.array("payment_id", "survivor").alias("source_ids"), F.lit("duplicate").alias("exception_type"), "amount_paise", F.col("occurred_on").alias("as_of")),
        residue.select(F.array("row_id"), "exception_type", "amount_paise", "as_of"),
        fallen.where("remainder_type IS NOT NULL").select(F.array("credit_id"), "remainder_type", -F.col("residual_before_naming_paise"), "settled_on"),
    ]
    every = raised[0]
    for rows in raised[1:]:
        every = every.union(rows)
    every = every.withColumn("severity", exceptions.severity()).withColumn("exception_id", exceptions.exception_id("exception_type", "source_ids", "as_of", "amount_paise"))
    out = {"duplicates": duplicates, "links": links, "review": review, "attributed": attributed, "groups": groups, "settlements": fallen, "residue": residue, "exceptions": every}
    if settlements is not None and "reference" in credits.columns:
        out["utr"] = utr_stage(settlements, credits, days)
    if truth is not None:
        rows = live.select(F.col("payment_id").alias("row_id")).unionByName(invoices.select(F.col("invoice_id").alias("row_id")))
        matched = links.select(F.col("payment_id").alias("row_id")).unionByName(links.select(F.col("invoice_id").alias("row_id")))
        posted, right = links.toDF("left_id", "right_id", "stage", "probability").select("left_id", "right_id"), truth.where("payment_id IS NOT NULL AND invoice_id IS NOT NULL").select(F.col("payment_id").alias("left_id"), F.col("invoice_id").alias("right_id"))
        out["metrics"] = evaluation.run_metrics(rows, matched, posted, right, matching.unmatched(rows, matched, "row_id"))
    return out


def report(closed: dict[str, DataFrame]) -> DataFrame:
    """(part, rows): how much each part of a close holds."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows") for name, df in closed.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
