"""Exact stages: duplicates, key joins that abstain on doubt, mutual best links and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.session import cut


def mark_duplicates(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """``df`` with survivor, the first ``order`` of the rows that share the key, and is_duplicate.

    The survivors are one pre-aggregated row a key, joined back, so that a key
    with very many rows is a skewed join and not one task's group.
    """
    survivors = df.groupBy(*key).agg(F.min(order).alias("survivor"))
    renamed = survivors.select(*(F.col(k).alias(f"_{k}") for k in key), "survivor")
    same = F.lit(True)
    for k in key:
        same = same & df[k].eqNullSafe(renamed[f"_{k}"])
    return df.join(renamed, same).drop(*(f"_{k}" for k in key)).withColumn("is_duplicate", F.col(order) != F.col("survivor"))


def unique_matches(left: DataFrame, right: DataFrame, left_id: str, right_id: str, on: list[str], accept: Column | None = None) -> DataFrame:
    """Pairs of rows that are each other's only candidates on a key; of those, the ones that ``accept`` holds for.

    Uniqueness is judged on the key alone, before ``accept``: a row with two
    candidates matches none of them. Keys with several rows on one side are
    counted and dropped before the join, so no key multiplies rows.
    """
    for side in ("left", "right"):
        df = left if side == "left" else right
        single = df.where(" AND ".join(f"{k} IS NOT NULL" for k in on)).groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
        if side == "left":
            left = left.join(single, on, "left_semi")
        else:
            right = right.join(single, on, "left_semi")
    pairs = left.join(right, on)
    return pairs if accept is None else pairs.where(accept)


def first_accepted(left: DataFrame, right: DataFrame, left_id: str, on: list[str], accept: Column) -> DataFrame:
    """Pairs of a left row and the only right row of its key, if ``accept`` holds; of several such left rows the first takes it.

    A key with several right rows matches nothing, whatever ``accept`` would
    say; a left row that is refused leaves the right row to the next one.
    """
    single = right.where(" AND ".join(f"{k} IS NOT NULL" for k in on)).groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    pairs = left.join(right.join(single, on, "left_semi"), on).where(accept)
    first = pairs.groupBy(*on).agg(F.min(left_id).alias("_first"))
    return pairs.join(first, on).where(F.col(left_id) == F.col("_first")).drop("_first")


def mutual_best(pairs: DataFrame, left: str, right: str, weight: str) -> DataFrame:
    """Pairs that are the heaviest of both their rows; equal weights go to the smaller ids."""
    best = lambda own, other: F.min_by(other, F.struct(-F.col(weight), other))
    of_left = pairs.groupBy(left).agg(best(left, right).alias("_r"))
    of_right = pairs.groupBy(right).agg(best(right, left).alias("_l"))
    kept = pairs.join(of_left, left).where(F.col(right) == F.col("_r")).drop("_r")
    return kept.join(of_right, right).where(F.col(left) == F.col("_l")).drop("_l")


def unmatched(df: DataFrame, taken: DataFrame, on: str) -> DataFrame:
    return df.join(taken.select(on), on, "left_anti")


def claims(groups: DataFrame) -> DataFrame:
    """(match_id, relation, row_id) of match groups: ledger rows claim a payment of their invoice, gateway and ledger rows a settlement."""
    pays = groups.where("relation = 'pays_invoice'").select("match_id", "relation", F.explode("ledger_ids").alias("row_id"))
    settles = groups.where("relation = 'settles_into'").select("match_id", "relation", F.explode(F.concat("gateway_ids", "ledger_ids")).alias("row_id"))
    return pays.unionByName(settles)


def double_claims(claimed: DataFrame) -> DataFrame:
    return claimed.groupBy("relation", "row_id").agg(F.count_distinct("match_id").alias("n_groups")).where("n_groups > 1")


def refuse_claimed(groups: DataFrame, earlier: DataFrame) -> DataFrame:
    """The groups of a stage none of whose claims an earlier stage has made."""
    taken = claims(groups).join(earlier.select("relation", "row_id").distinct(), ["relation", "row_id"]).select("match_id").distinct()
    return groups.join(taken, "match_id", "left_anti")


def merged(groups: DataFrame, claimed: DataFrame, order: list[Column]) -> DataFrame:
    """(match_id, accepted): which groups of a stage stay if they are taken in ``order`` and one whose claims are made already is refused.

    ``claimed`` has match_id, relation and row_id; ``order`` are columns of
    ``groups``, and equals go by match_id. In a round every group that is the
    first on all its claims is accepted, and all that share a claim with it are
    refused, until none is undecided: the same as one after the other, as a
    group is only decided when all before it that it meets are. A claim that
    very many groups make is one minimum. Groups without claims are accepted, null claims are none,
    and of rows that share a match_id the first counts.
    """
    place = F.struct(*(c.alias(f"_{k}") for k, c in enumerate(order)), "match_id").alias("place")
    own = claimed.where("relation IS NOT NULL AND row_id IS NOT NULL").select("match_id", "relation", "row_id").distinct()
    placed = groups.select("match_id", place).groupBy("match_id").agg(F.min("place").alias("place"))
    left = cut(placed.join(own, "match_id"))
    accepted, refused = placed.select("match_id").join(own, "match_id", "left_anti"), None
    while left.limit(1).count():
        first = left.groupBy("relation", "row_id").agg(F.min("place").alias("_first"))
        held = left.join(first, ["relation", "row_id"])
        won = held.groupBy("match_id").agg(F.bool_and(F.col("place") == F.col("_first")).alias("_all")).where("_all").select("match_id")
        won = cut(won)
        taken = left.join(won, "match_id", "left_semi").select("relation", "row_id").distinct()
        lost = cut(left.join(won, "match_id", "left_anti").join(taken, ["relation", "row_id"], "left_semi").select("match_id").distinct())
        accepted = accepted.unionByName(won)
        refused = lost if refused is None else refused.unionByName(lost)
        left = cut(left.join(won.unionByName(lost), "match_id", "left_anti"))
    out = accepted.select("match_id", F.lit(True).alias("accepted"))
    return out if refused is None else out.unionByName(refused.select("match_id", F.lit(False).alias("accepted")))


#: Groups of one bundle that are decided in one array.
FOLDED = 100


def merged_within(groups: DataFrame, within: str, claims: str, order: list[Column]) -> DataFrame:
    """``merged`` where groups can only share a claim inside a bundle, the value of ``within``: one shuffle and no rounds.

    ``groups`` has a distinct match_id and ``claims``, an array of structs of
    relation and row_id. A bundle's groups are taken in order over what is
    claimed so far. Bundles of more than FOLDED groups go through the rounds.
    """
    own = F.filter(F.coalesce(F.col(claims), F.array().cast(dict(groups.dtypes)[claims])), lambda c: c["relation"].isNotNull() & c["row_id"].isNotNull())
    groups = cut(groups.select("match_id", F.col(within).alias("_w"), own.alias("_c"), *(c.alias(f"_{k}") for k, c in enumerate(order))))
    places = [f"_{k}" for k in range(len(order))]
    large = cut(groups.groupBy("_w").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FOLDED).select("_w"))
    some = large.limit(1).count()
    same = groups["_w"].eqNullSafe(large["_w"])
    small = groups.join(large, same, "left_anti") if some else groups
    kind = dict(groups.dtypes)
    begun = F.struct(F.array().cast(kind["_c"]).alias("held"), F.array().cast(f"array<struct<match_id: {kind['match_id']}, accepted: boolean>>").alias("out"))

    def step(state: Column, g: Column) -> Column:
        free = ~F.arrays_overlap(state["held"], g["_c"])
        held = F.when(free, F.concat(state["held"], g["_c"])).otherwise(state["held"])
        return F.struct(held.alias("held"), F.concat(state["out"], F.array(F.struct(g["match_id"].alias("match_id"), free.alias("accepted")))).alias("out"))

    bundles = small.groupBy("_w").agg(F.array_sort(F.collect_list(F.struct(*places, "match_id", "_c"))).alias("own"))
    out = bundles.select(F.explode(F.aggregate("own", begun, step)["out"]).alias("o")).select("o.*")
    if not some:
        return out
    rest = cut(groups.join(large, same, "left_semi"))
    claimed = rest.select("match_id", F.explode("_c").alias("c")).select("match_id", "c.*")
    return out.unionByName(merged(rest.select("match_id", *places), claimed, [F.col(c) for c in places]))


def claimed_pairs(groups: DataFrame) -> DataFrame:
    """(left_id, right_id) that groups claim: their links, and each member with its credit."""
    links = groups.select(F.explode("links").alias("l")).select(F.col("l.gateway_id").alias("a"), F.col("l.ledger_id").alias("b"))
    members = groups.select(F.explode("bank_ids").alias("a"), F.concat("gateway_ids", "ledger_ids").alias("_m")).select("a", F.explode("_m").alias("b"))
    both = links.unionByName(members)
    return both.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id")).distinct()
