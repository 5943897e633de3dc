"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.llm.common import cut, packed, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
#: Times a document is taken at most, and so its source's size at most.
REPEATS = 2
SHARDS = 16
SEED = 20260101
#: A document's place in its source is 60 bits of a hash; each level of ranges splits by ten of them.
PLACE_BITS, LEVEL_BITS = 60, 10
#: Sources whose rows of a plan are broadcast at most; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
BLOCKS = 1 << LEVEL_BITS


def word_count(text: Column | str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def placed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with ``_size``, its words, and ``_place``, its place in a permutation of its source."""
    digest = F.md5(F.concat_ws("\u001f", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    return docs.withColumns({"_size": word_count(), "_place": F.conv(F.substring(digest, 1, PLACE_BITS // 4), 16, 10).cast("long")})


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, source_size, target) of (source, source_size): words to take of each source.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes; a target stops at REPEATS times its source's size,
    and the excess goes to the others by weight. In the order of size over
    weight the sources that stop come first, so one running sum finds the level
    at which the others stand. Rows are sources, not documents.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("_w", turn).withColumn("_most", REPEATS * F.col("source_size").cast("double"))
    first = W.orderBy(F.col("_most") / F.col("_w"), F.col("source").asc_nulls_last())
    up_to, whole = first.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("_most").over(up_to), F.lit(0.0))
    weight = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(up_to), F.lit(0.0))
    rows = rows.withColumn("_level", left / weight)
    level = F.min(F.when(F.col("_most") > F.col("_level") * F.col("_w"), F.struct(F.col("_most") / F.col("_w"), "_level"))).over(whole)["_level"]
    target = F.least("_most", F.coalesce(level * F.col("_w"), F.col("_most")))
    return rows.select("source", "source_size", target.alias("target"))


def passes(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """What to take of each source: ``full`` times all, once more the places up to ``mark``, and once more the place ``extra``.

    ``keyed`` has (_key, _place, _size), a row for each place; ``wanted`` has
    (_key, source_size, target). Ranges of places are summed level by level, so
    that no task orders more than 1,024 ranges of a source, or the places of one
    range in 2**20. The place ``extra`` is the one that best fills the gap left.
    """
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = wanted.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    state = cut(state.withColumns({"taken": F.lit(0).cast("long"), "mark": F.lit(-1).cast("long"), "next": F.lit(None).cast("long")}))
    rows = keyed
    for shift in (PLACE_BITS - LEVEL_BITS, PLACE_BITS - 2 * LEVEL_BITS, 0):
        ranges = rows.groupBy("_key", F.shiftright("_place", shift).alias("_range")).agg(F.sum("_size").alias("_size"))
        ranges = ranges.join(state.select("_key", "rest", "taken"), "_key")
        up_to = F.col("taken") + F.sum("_size").over(W.partitionBy("_key").orderBy("_range"))
        ranges = ranges.select("_key", "_range", "rest", up_to.alias("_sum"))
        fits = F.col("_sum") <= F.col("rest")
        found = ranges.groupBy("_key").agg(F.max(F.when(fits, F.col("_sum"))).alias("_last"), F.min(F.when(~fits, F.col("_range"))).alias("_next"), F.lit(True).alias("_seen"))
        mark = F.when(F.col("_seen").isNull(), F.col("mark")).when(F.col("_next").isNull(), F.lit(1 << PLACE_BITS)).otherwise(F.shiftleft("_next", shift) - 1)
        state = cut(
            state.join(found, "_key", "left").select(
                "_key", "source_size", "target", "full", "rest", F.coalesce("_last", "taken").alias("taken"), mark.alias("mark"), F.col("_next").alias("next")
            )
        )
        ends = state.where("next is not null").select("_key", F.col("next").alias("_range"))
        rows = rows.withColumn("_range", F.shiftright("_place", shift)).join(ends, ["_key", "_range"]).drop("_range")
    gap = F.col("rest") - F.col("taken")
    off = F.abs(F.col("_size") - gap)
    extra = keyed.join(_few(state).select("_key", "rest", "taken", "mark"), "_key").where((F.col("_place") > F.col("mark")) & (off < gap))
    extra = extra.groupBy("_key").agg(F.min(F.struct(off.alias("off"), F.col("_place").alias("place")))["place"].alias("extra"))
    return state.join(extra, "_key", "left").select("_key", "source_size", "target", "full", "rest", "mark", "extra")


def _few(plan: DataFrame) -> DataFrame:
    """A plan's rows, one a source, marked for broadcast if they are as few as sources mostly are; a hot source then stays where it is."""
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def leaf_quotas(counts: np.ndarray, shards: int, leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The draws that the splitting tree gives one shard, by source, and those that go to the shards before it.

    Each node halves its shards and deals its sources' draws to the halves by a
    multivariate hypergeometric draw, seeded by the node, so that every shard
    gets as many draws as any other, to one, and all quotas add up exactly.
    """
    total = int(counts.sum())
    upto = lambda shard: total * shard // shards
    low, high, before, counts = 0, shards, np.zeros_like(counts), counts.copy()
    while high - low > 1:
        middle = (low + high) // 2
        draw = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(counts, upto(middle) - upto(low), method="marginals")
        if leaf < middle:
            high, counts = middle, draw
        else:
            low, before, counts = middle, before + draw, counts - draw
    return counts, before


def shard_ends(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """(_key, _ends) of (_key, _draws): for each source, at which of its permuted draws each shard ends.

    Each shard's path through the tree is worked out in a task of its own. The
    driver sees one number a source.
    """
    known = sorted((r["_key"], int(r["_draws"])) for r in draws.collect())
    names, counts = [k for k, _ in known], np.array([n for _, n in known], np.int64)

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                own, before = leaf_quotas(counts, shards, int(shard), seed)
                yield pd.DataFrame({"_key": pd.Series(names, dtype=object), "shard": np.full(len(names), shard, np.int32), "end": own + before})

    spark = draws.sparkSession
    rows = spark.range(shards).mapInPandas(leaves, "_key string, shard int, end long")
    return rows.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("_ends"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with their part in the mix: size, source_size, target, taken and ``places``.

    ``places`` holds a struct (shard, position) for each time the document is
    taken; sorting a shard by position shuffles it. A source's places are cut
    into 1,024 blocks; each pass over a block is a draw, the splitting tree
    shares all draws among the shards, and an affine permutation decides which
    of a source's draws each shard gets. Sources are compared by code point; a
    null source is one of its own. Null texts and texts without words have size
    0. Rows with equal doc_id and text are taken alike. Reruns, and runs over
    other partitions, agree. Columns of ``docs`` that are called like the new
    ones are replaced; an empty table gives no rows.
    """
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    own = packed(docs, "size", "source_size", "target", "taken", "places")
    rows = placed(docs.select("doc_id", "text", key.alias("_key"), own), seed).select("row", "_key", "_size", "_place")
    keyed = cut(rows.groupBy("_key", "_place").agg(F.sum("_size").alias("_size")))
    sizes = keyed.groupBy("_key").agg(F.sum("_size").alias("source_size"))
    named = sizes.select(F.when(F.col("_key") != "", F.substring("_key", 2, 1 << 30)).alias("source"), "source_size")
    wanted = targets(named, weights, share).select(key.alias("_key"), "source_size", "target")
    plan = passes(keyed, wanted)
    shift = PLACE_BITS - LEVEL_BITS
    partial = F.shiftright(F.greatest(F.least("mark", F.lit((1 << PLACE_BITS) - 1)), F.lit(0)), shift)
    once_more = F.when(F.col("rest") > 0, partial + 1).otherwise(0)
    plan = cut(plan.withColumns({"_partial": partial, "_draws": (F.col("full") * BLOCKS + once_more).cast("long")}))
    ends = shard_ends(plan.select("_key", "_draws"), shards, seed)
    step = _steps(seed)
    plan = plan.join(ends, "_key").withColumn("_step", step("_draws")).withColumn("_shift", F.pmod(F.xxhash64("_key", F.lit(seed)), F.greatest("_draws", F.lit(1))))
    out = rows.join(_few(plan), "_key")
    block = F.shiftright("_place", shift)
    again = (F.col("rest") > 0) & ((F.col("_place") <= F.col("mark")) | (F.col("_place") == F.coalesce("extra", F.lit(-1))))
    drawn = F.concat(
        F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("full") - 1), lambda k: k * BLOCKS + block)).otherwise(F.array().cast("array<bigint>")),
        F.when(again, F.array(F.col("full") * BLOCKS + F.least(block, F.col("_partial")))).otherwise(F.array().cast("array<bigint>")),
    )
    at = lambda d: F.pmod(d * F.col("_step") + F.col("_shift"), F.greatest("_draws", F.lit(1)))
    shard = lambda d: F.size(F.filter("_ends", lambda end: end <= at(d)))
    position = lambda d, k: F.xxhash64(F.lit(seed), "_key", "_place", d, k)
    places = F.transform(drawn, lambda d, k: F.struct(shard(d).alias("shard"), position(d, k).alias("position")))
    out = out.withColumn("places", places)
    taken = (F.col("_size") * F.size("places")).alias("taken")
    return out.select("row.*", F.col("_size").alias("size"), "source_size", "target", taken, "places")


def _steps(seed: int):
    """A column expression for a multiplier that is prime to the number of draws, so that multiplying permutes them."""
    primes = [p for p in range(1009, 1200) if all(p % q for q in range(2, 35))]
    turn = seed % len(primes)
    primes = primes[turn:] + primes[:turn]

    def step(draws: str) -> Column:
        return F.coalesce(*(F.when(F.col(draws) % p != 0, F.lit(p)) for p in primes[:8]))

    return step


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for each time it is taken, with its shard and its position in the shard."""
    columns = [F.col(c) for c in docs.columns if c not in ("shard", "position")]
    return mix(docs, **options).select(*columns, F.inline("places"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixture.select("doc_id", "size", "source_size", "target", "taken", F.transform("places", lambda p: p["shard"]).alias("shards"))


QUERIES = {"op6_mixing": op6_mixing}
