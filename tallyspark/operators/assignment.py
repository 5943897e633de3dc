"""One-to-one assignment of the largest total weight over a table of scored pairs, by rounds of joins and aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.operators import attribution
from tallyspark.session import cut

#: Weights are compared in steps of this size, unless a caller names another.
QUANTUM = 1e-6
#: Rounds that settle certain pairs before the auction takes what is left; that changes no total.
CERTAIN_ROUNDS = 12
#: Pairs of a component that one task solves; larger components are auctioned. Which of the two solves it changes no total.
SMALL_PAIRS = 2_000
#: An auction's step shrinks by this factor from one phase to the next, down to one.
STEP_FACTOR = 10


def _two_best(rows: DataFrame, key: str, value: str, other: str, *keep: str) -> DataFrame:
    """(key, best, second): the best row of each key, equals by the greater ``other``, and the next row's value or null.

    Tasks keep two rows a key before the shuffle, so a key with very many rows does not gather.
    """
    place = F.row_number().over(W.partitionBy(key).orderBy(F.col(value).desc(), F.col(other).desc()))
    first = rows.withColumn("_place", place).where("_place <= 2")
    return first.groupBy(key).agg(F.max_by(F.struct(value, other, *keep), F.when(F.col("_place") == 1, 1)).alias("best"), F.max(F.when(F.col("_place") == 2, F.col(value))).alias("second"))


def certain(edges: DataFrame) -> DataFrame:
    """(left_id, right_id) of pairs that an assignment of the largest total may hold whatever else it holds.

    A pair that is best for both sides and gains as much as the next best of
    both together: any assignment without it loses nothing by giving those up
    for it. Such pairs never share an id, so all of them are taken at once.
    """
    of_left = _two_best(edges, "left_id", "gain", "right_id").select("left_id", F.col("best.right_id").alias("right_id"), F.col("best.gain").alias("gain"), F.coalesce("second", F.lit(0)).alias("_a"))
    of_right = _two_best(edges, "right_id", "gain", "left_id").select("right_id", F.col("best.left_id").alias("left_id"), F.coalesce("second", F.lit(0)).alias("_b"))
    return of_left.join(of_right, ["left_id", "right_id"]).where("gain >= _a + _b").select("left_id", "right_id")


def auction(edges: DataFrame) -> DataFrame:
    """(left_id, right_id) of an assignment of the largest total gain; gains are whole and positive.

    Both sides bid, each for the other's ids and for staying free at no gain,
    so that a complete assignment exists and holds the answer twice, once from
    each side. In a round each bidder without an id bids for its best one what
    sets it level with the next best, and a step more; an id goes to its
    highest bid. Prices are a table, and stay from phase to phase while steps
    shrink. Gains are multiplied by more than there are bidders, so that a step
    of one leaves no better assignment. Numbers beyond a long raise an error.
    """
    left, right = F.concat(F.lit("l"), "left_id"), F.concat(F.lit("r"), "right_id")
    offer = lambda bidder, item, value: F.struct(bidder.alias("bidder"), item.alias("item"), value.alias("value"))
    zero = F.lit(0).cast("long")
    both = edges.select(F.explode(F.array(offer(left, right, F.col("gain")), offer(right, left, F.col("gain")), offer(left, left, zero), offer(right, right, zero))).alias("o")).select("o.*").distinct()
    offers = cut(both)
    size = offers.agg(F.count_distinct("bidder").alias("n"), F.max("value").alias("most")).first()
    scale = size["n"] + 1
    offers = offers.withColumn("value", F.col("value") * scale)
    state = cut(offers.select("item").distinct().select("item", zero.alias("price"), F.lit(None).cast("string").alias("owner")))
    step = max(size["most"] * scale // STEP_FACTOR, 1)
    while True:
        state = state.withColumn("owner", F.lit(None).cast("string"))
        while True:
            state = cut(_bid(offers, state, step))
            if not state.where("owner IS NULL").limit(1).count():
                break
        if step == 1:
            break
        step = max(step // STEP_FACTOR, 1)
    held = state.where("startswith(owner, 'l') AND startswith(item, 'r')")
    return held.select(F.expr("substr(owner, 2)").alias("left_id"), F.expr("substr(item, 2)").alias("right_id"))


def _bid(offers: DataFrame, state: DataFrame, step: int) -> DataFrame:
    """The state (item, price, owner) after one round of bids by all who hold nothing."""
    busy = state.where("owner IS NOT NULL").select(F.col("owner").alias("bidder"))
    open_ = offers.join(busy, "bidder", "left_anti").join(state.select("item", "price"), "item").withColumn("profit", F.col("value") - F.col("price"))
    two = _two_best(open_, "bidder", "profit", "item", "price")
    bids = two.select("bidder", F.col("best.item").alias("item"), (F.col("best.price") + F.col("best.profit") - F.col("second") + F.lit(step)).alias("bid"))
    won = bids.groupBy("item").agg(F.max(F.struct("bid", "bidder")).alias("w"))
    return state.join(won, "item", "left").select("item", F.coalesce("w.bid", "price").alias("price"), F.coalesce("w.bidder", "owner").alias("owner"))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` with component, the least name of an id in it: each id takes the least name that its pairs know, and then what that one has taken."""
    left, right = F.concat(F.lit("l"), "left_id"), F.concat(F.lit("r"), "right_id")
    both = cut(edges.select(F.explode(F.array(F.struct(left.alias("a"), right.alias("b")), F.struct(right.alias("a"), left.alias("b")))).alias("e")).select("e.*"))
    labels = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("_other")), "b").groupBy("a").agg(F.min("_other").alias("_near"))
        met = labels.join(near, "a").select("a", "label", F.least("label", "_near").alias("_to"))
        ahead = labels.select(F.col("a").alias("_to"), F.col("label").alias("_ahead"))
        moved = cut(met.join(ahead, "_to").select("a", F.least("_to", "_ahead").alias("label"), (F.least("_to", "_ahead") < F.col("label")).alias("_moved")))
        labels = moved.drop("_moved")
        if not moved.where("_moved").limit(1).count():
            break
    return edges.join(labels.select(F.expr("substr(a, 2)").alias("left_id"), "label", F.expr("startswith(a, 'l')").alias("_l")).where("_l").select("left_id", F.col("label").alias("component")), "left_id")


def _solved(edges: DataFrame) -> DataFrame:
    """(left_id, right_id) of the best assignment of each component of at most SMALL_PAIRS pairs."""

    def solve(pairs: pd.DataFrame) -> pd.DataFrame:
        lefts, a = np.unique(pairs["left_id"].to_numpy(str), return_inverse=True)
        rights, b = np.unique(pairs["right_id"].to_numpy(str), return_inverse=True)
        weights = np.full((len(lefts), len(rights)), np.nan)
        weights[a, b] = pairs["gain"]
        found = attribution.assign_one_to_one(weights, 0.0)
        return pd.DataFrame([(str(lefts[i]), str(rights[j])) for i, j in found], columns=["left_id", "right_id"])

    return edges.groupBy("component").applyInPandas(solve, "left_id string, right_id string")


def one_to_one(pairs: DataFrame, abstain: float | Column = 0.0, quantum: float = QUANTUM, small: int = SMALL_PAIRS) -> DataFrame:
    """(left_id, right_id, weight): pairs of the largest total weight, each id once; a left id stays free where no pair is worth more than ``abstain``.

    ``pairs`` has left_id, right_id and weight; ids come back as text. Null ids,
    null, NaN and infinite weights forbid a pair, of a pair's rows the largest
    weight counts, and an empty table gives none. Of equal totals one is taken,
    the same on every run. Certain pairs go first, round by round. Of what is
    left, components of at most ``small`` pairs are solved side by side, each
    in a task, and larger ones are auctioned.
    """
    price = F.lit(abstain) if isinstance(abstain, float | int) else abstain
    sound = pairs.where("left_id IS NOT NULL AND right_id IS NOT NULL AND weight IS NOT NULL AND abs(weight) < double('infinity')")
    ids = [F.col(c).cast("string").alias(c) for c in ("left_id", "right_id")]
    own = sound.select(*ids, F.col("weight").cast("double").alias("weight"), F.round((F.col("weight") - price) / quantum).cast("long").alias("gain")).where("gain > 0")
    edges = cut(own.groupBy("left_id", "right_id").agg(F.max("weight").alias("weight"), F.max("gain").alias("gain")))
    left, found = edges, None
    for _ in range(CERTAIN_ROUNDS):
        taken = cut(certain(left))
        if not taken.limit(1).count():
            break
        found = taken if found is None else found.unionByName(taken)
        left = cut(left.join(taken.select("left_id"), "left_id", "left_anti").join(taken.select("right_id"), "right_id", "left_anti"))
    if left.limit(1).count():
        parts = components(left)
        sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
        parts = cut(parts.join(sizes, "component"))
        few, many = parts.where(F.col("_n") <= small), parts.where(F.col("_n") > small)
        rest = cut(_solved(few))
        found = rest if found is None else found.unionByName(rest)
        if many.limit(1).count():
            found = found.unionByName(auction(many.select("left_id", "right_id", "gain")))
    if found is None:
        return edges.select("left_id", "right_id", "weight")
    return edges.join(found, ["left_id", "right_id"]).select("left_id", "right_id", "weight")
