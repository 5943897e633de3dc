"""Pieces that several corpus operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, *dropped: str) -> Column:
    """All columns of ``df`` but the dropped ones in one struct, ``row``: beside it an operator's own names clash with none, and ``row.*`` brings them back."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in dropped)).alias("row")


#: Rows that Arrow hands to a Python worker at once.
BATCH_ROWS = 256


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches held to BATCH_ROWS rows, so that a batch of very long texts or large groups fits a worker."""
    name, session = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession
    if not 0 < int(session.conf.get(name)) <= BATCH_ROWS:
        session.conf.set(name, str(BATCH_ROWS))
    return df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: lineage ends and a lost executor costs nothing done before.

    The folder is the cluster's ``spark.checkpoint.dir``. A temporary folder is
    set only where that is unset, as in local tests.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tallyspark-"))
    return df.checkpoint(eager=True)


def in_blocks(rows: DataFrame, key: list[str], item: list[str], split_by: str, block: int) -> DataFrame:
    """Gather the rows of each key for pairwise comparison, with no group above about ``2 * block`` rows.

    A key with more than ``block`` rows is cut into blocks by a hash of
    ``split_by``, and each pair of blocks becomes a group of its own, so a hot
    key spreads over many tasks and none of its pairs is lost. Keys with one row
    are dropped. Returns ``key``, ``lo``, ``hi`` and ``items``: an array of
    structs of ``side`` (the row's block) and the ``item`` columns.
    """
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / block).cast("int")
    rows = rows.join(counts, key).withColumn("_blocks", blocks)
    rows = rows.withColumn("_side", F.pmod(F.xxhash64(F.col(split_by), F.lit(7)), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return (
        rows.groupBy(*key, F.least("_side", "_other").alias("lo"), F.greatest("_side", "_other").alias("hi"))
        .agg(F.collect_list(F.struct(F.col("_side").alias("side"), *item)).alias("items"))
        .where(F.size("items") > 1)
    )


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Components of an undirected graph: a row (node, component) for each node with an edge, where component is the smallest node reachable.

    Alternating large-star and small-star rounds: each joins the edges with one
    minimum a node, which is pre-aggregated, so that a node with very many
    edges is only a skewed join key. Nothing is gathered in a task or the driver.
    Null ends and loops are ignored; no edges give no rows.
    """
    u, v = F.col("u"), F.col("v")
    edges = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    edges = cut(edges.where(u > v).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v > m").select(v.alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())
        before, state = state, edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == state:
            break
    members = edges.select(u.alias("node"), v.alias("component"))
    return members.unionByName(edges.select(v.alias("node"), v.alias("component")).distinct())
