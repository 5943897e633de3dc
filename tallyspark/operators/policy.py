"""What may be posted without a person: blocking rules, gates, and a run's budget."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.session import cut


@dataclass(frozen=True)
class Policy:
    """Limits in paise; the defaults are fixed values."""

    kill_switch: bool = False
    materiality_paise: int = 2_500_000
    action_cap_paise: int = 20_000_000
    run_cap_paise: int = 500_000_000
    run_cap_count: int = 5_000
    min_confidence: float = 0.90
    min_evidence: int = 1
    currencies: tuple[str, ...] = ("INR",)


BLOCKING = ("kill_switch", "no_money_movement", "currency_allowed", "reason_present", "per_action_cap")
GATES = ("materiality", "confidence", "evidence_present")


def rules(requests: DataFrame, policy: Policy) -> DataFrame:
    """``requests`` with ``failed``, the rules each one breaks, and its verdict by all rules but the run's budget.

    Columns: action_class, amount_paise, currency, confidence, reason,
    evidence_count and human_approved. A blocking rule denies; a gate asks for a
    person unless one has approved.
    """
    allowed = F.coalesce(F.col("currency").isin(*policy.currencies), F.lit(False))
    size = F.abs("amount_paise")
    passed = {
        "kill_switch": F.lit(not policy.kill_switch),
        "no_money_movement": F.col("action_class") != "move_money",
        "currency_allowed": allowed,
        "reason_present": F.trim(F.coalesce("reason", F.lit(""))) != "",
        "per_action_cap": allowed & (size <= policy.action_cap_paise),
        "materiality": allowed & (size <= policy.materiality_paise),
        "confidence": F.col("confidence") >= policy.min_confidence,
        "evidence_present": F.col("evidence_count") >= policy.min_evidence,
    }
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(passed[r], F.lit(False)), F.lit(r)) for r in (*BLOCKING, *GATES))))
    out = requests.withColumn("failed", failed)
    blocked = F.arrays_overlap("failed", F.array(*map(F.lit, BLOCKING)))
    gated = F.arrays_overlap("failed", F.array(*map(F.lit, GATES)))
    verdict = F.when(blocked, "denied").when(gated & ~F.col("human_approved"), "needs_human").when(F.col("human_approved"), "approved_by_human").otherwise("auto_approved")
    return out.withColumn("verdict", verdict)


#: Width of the stretches of ``order`` whose sums are added up before their rows' own.
STRETCH = 100_000
#: Requests of a run that are decided one after the other in one task; of more, running sums decide first.
FOLDED = 100_000
#: Rounds of running sums before what is left is decided one after the other, however much it is.
ROUNDS = 40


def _running(rows: DataFrame, run: str, order: str) -> DataFrame:
    """``rows`` (run, order, size) with ``upto`` and ``place``, the running sum and count of the run: by stretches first, so that one run is many tasks."""
    rows = rows.withColumn("_at", F.floor(F.col(order) / STRETCH))
    before = W.partitionBy(run).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(run, "_at").agg(F.sum("size").alias("_s"), F.count(F.lit(1)).alias("_n"))
    sums = sums.select(run, "_at", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_sum"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_count"))
    inside = W.partitionBy(run, "_at").orderBy(order)
    rows = rows.join(sums, [run, "_at"])
    return rows.select(run, order, "size", (F.col("_sum") + F.sum("size").over(inside)).alias("upto"), (F.col("_count") + F.row_number().over(inside)).alias("place"))


def within_budget(decided: DataFrame, policy: Policy, run: str = "run_id", order: str = "seq") -> DataFrame:
    """(run, order, posted): which approved requests a run's caps let through, in their order.

    ``order`` is a whole number, distinct within a run. A request that is refused
    uses nothing of the budget, so later, smaller ones may still pass. In a
    round, running sums post all requests up to the first that does not fit;
    this one and all later ones that are larger than what is left are refused;
    the others go into the next round. A run with no more than FOLDED requests
    left is decided one after the other, in one task, as are those that still
    have some after ROUNDS rounds: the result is the same either way.
    """
    kinds = dict(decided.dtypes)
    size = F.abs("amount_paise").alias("size")
    fits = F.col("verdict").isin("auto_approved", "approved_by_human")
    left = decided.where(fits).select(run, order, size)
    spent = left.select(run).distinct().select(run, F.lit(0).cast("long").alias("spent"), F.lit(0).cast("long").alias("count"))
    posted = None
    for _ in range(ROUNDS):
        # One row a run: how many requests it has left.
        most = left.groupBy(run).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
        if most <= FOLDED:
            break
        rows = cut(_running(left, run, order).join(spent, run))
        passes = (F.col("spent") + F.col("upto") <= policy.run_cap_paise) & (F.col("count") + F.col("place") <= policy.run_cap_count)
        stops = rows.where(~passes).groupBy(run).agg(F.min(order).alias("_stop"))
        rows = rows.join(stops, run, "left")
        taken = rows.where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop")))
        some = cut(taken.select(run, order, "size"))
        posted = some if posted is None else posted.unionByName(some)
        gained = some.groupBy(run).agg(F.sum("size").alias("_s"), F.count(F.lit(1)).alias("_n"))
        spent = spent.join(gained, run, "left").select(run, (F.col("spent") + F.coalesce("_s", F.lit(0))).alias("spent"), (F.col("count") + F.coalesce("_n", F.lit(0))).alias("count"))
        spent = cut(spent)
        later = rows.where(F.col(order) > F.col("_stop")).select(run, order, "size").join(spent, run)
        room = (F.col("spent") + F.col("size") <= policy.run_cap_paise) & (F.col("count") < policy.run_cap_count)
        left = cut(later.where(room).select(run, order, "size"))
    kept = _folded(left.join(spent, run), policy, run, order, kinds)
    posted = kept if posted is None else posted.select(run, order).unionByName(kept)
    every = decided.select(run, order)
    return every.join(posted.withColumn("_p", F.lit(True)), [run, order], "left").select(run, order, F.coalesce("_p", F.lit(False)).alias("posted"))


def _folded(rows: DataFrame, policy: Policy, run: str, order: str, kinds: dict[str, str]) -> DataFrame:
    """(run, order) of the requests that pass one after the other; rows come sorted, in batches, and only a run's two totals are kept."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, total, count = None, 0, 0
        for batch in batches:
            passed = []
            for key, size, spent, n in zip(batch[run], batch["size"], batch["spent"], batch["count"], strict=True):
                if key != current:
                    current, total, count = key, spent, n
                ok = total + size <= policy.run_cap_paise and count < policy.run_cap_count
                passed.append(ok)
                total, count = (total + size, count + 1) if ok else (total, count)
            yield batch.loc[passed, [run, order]]

    dealt = rows.repartition(run).sortWithinPartitions(run, order)
    return dealt.mapInPandas(fold, f"{run} {kinds[run]}, {order} {kinds[order]}")


def verdicts(requests: DataFrame, policy: Policy, run: str = "run_id", order: str = "seq") -> DataFrame:
    """``requests`` with ``failed`` and ``verdict`` by all rules, the caps of the run among them.

    A request that the run's caps refuse breaks run_caps, which denies; a
    request that another rule stops uses nothing of them and is not held
    against them.
    """
    decided = rules(requests, policy)
    posted = within_budget(decided, policy, run, order)
    capped = F.col("verdict").isin("auto_approved", "approved_by_human") & ~F.col("posted")
    rows = decided.join(posted, [run, order]).withColumn("_capped", capped)
    return rows.withColumns({"failed": F.when(F.col("_capped"), F.concat("failed", F.array(F.lit("run_caps")))).otherwise(F.col("failed")), "verdict": F.when(F.col("_capped"), "denied").otherwise(F.col("verdict"))}).drop("_capped", "posted")
