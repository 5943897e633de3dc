"""Embedding near-duplicates by collision-counting projections."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import connected_components, cut, small_batches, table
from tallyspark.llm.simhash import smallest_linked

COSINE = 0.95
#: One-dimensional projections in a family, whose cells bring rows together, and families.
DEPTH, FAMILIES = 6, 24
#: Projections on which collisions are counted.
COUNTED = 32
#: Widths, in standard deviations of the difference that a pair at the least cosine has on a projection: of a cell and of half a window.
CELL, REACH = 4.0, 2.0
#: Part of the pairs at the least cosine that the collision count lets through.
RECALL = 0.9995
SEED = 10
BLOCK = 512


def spread(dimension: int, cosine: float = COSINE) -> float:
    """Standard deviation, on a random projection, of the difference of two unit vectors at this cosine."""
    return sqrt((2 - 2 * cosine) / dimension)


def least_count(counted: int = COUNTED, reach: float = REACH, recall: float = RECALL) -> int:
    """The largest number of window collisions that pairs at the least cosine reach with probability ``recall``."""
    hit, below = erf(reach / sqrt(2)), 0.0
    for k in range(counted + 1):
        below += comb(counted, k) * hit**k * (1 - hit) ** (counted - k)
        if below > 1 - recall:
            return k
    return counted


@lru_cache(maxsize=8)
def directions(dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions of the families, their cells' offsets, and directions for counting; a direction's entries have variance 1 over the dimension."""
    draw = np.random.default_rng([SEED, dimension])
    scale = 1 / sqrt(dimension)
    return draw.normal(0, scale, (dimension, FAMILIES * DEPTH)), draw.random(FAMILIES * DEPTH), draw.normal(0, scale, (dimension, COUNTED))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows over their norms; the largest component is divided out first, so that neither overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with ``cells``, the number of their cell in each family; rows of a batch are grouped by dimension."""
    for batch in batches:
        vectors = batch.column("embedding")
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            own = batch.filter(pa.array(sizes == size))
            rows = unit(own.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size))
            ways, offsets, _ = directions(int(size))
            at = np.floor(rows @ ways / (CELL * spread(int(size))) + offsets).astype(np.int64).reshape(len(rows), FAMILIES, DEPTH)
            code = np.full(at.shape[:2], size, np.uint64)
            for k in range(DEPTH):
                code = (code ^ at[:, :, k].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(29)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * FAMILIES), pa.array((code.ravel() >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([*own.columns, cells], names=[*own.schema.names, "cells"])


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group: for each of its vectors the links found, and a vector of its linked class in the group."""
    need = least_count()
    for batch in batches:
        nodes, found, towards = [], [], []
        family, lo, hi = (batch.column(c).to_numpy() for c in ("family", "lo", "hi"))
        for g, items in enumerate(batch.column("items")):
            flat = items.values
            node, copies, side = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("node", "copies", "side"))
            cells = flat.field("cells").flatten().to_numpy(zero_copy_only=False).reshape(len(node), FAMILIES)
            lists = flat.field("embedding")
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            if (dims != dims[0]).any():
                # Vectors of other dimensions share a cell by a clash of hashes only.
                groups = [np.flatnonzero(dims == d) for d in np.unique(dims)]
            else:
                groups = [np.arange(len(node))]
            ends = np.concatenate([[0], np.cumsum(dims)])
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            for own in groups:
                if len(own) < 2:
                    continue
                rows = unit(np.stack([values[ends[k] : ends[k + 1]] for k in own]))
                if lo[g] == hi[g]:
                    left = right = np.arange(len(own))
                else:
                    left, right = np.flatnonzero(side[own] == lo[g]), np.flatnonzero(side[own] == hi[g])
                size = rows.shape[1]
                reach = REACH * spread(size)
                on = rows @ directions(size)[2]
                # Each projection is sorted; a collision is a rank inside the window around the query.
                order = np.argsort(on[right], axis=0, kind="stable")
                line = np.take_along_axis(on[right], order, axis=0).T
                rank = np.empty((COUNTED, len(right)), np.uint16)
                np.put_along_axis(rank, order.T, np.arange(len(right), dtype=np.uint16)[None, :], axis=1)
                i_all, j_all = [], []
                for begin in range(0, len(left), 256):
                    some = left[begin : begin + 256]
                    count = np.zeros((len(some), len(right)), np.uint8)
                    for k in range(COUNTED):
                        first, last = (np.searchsorted(line[k], on[some, k] + r, way).astype(np.uint16) for r, way in ((-reach, "left"), (reach, "right")))
                        count += (rank[k] >= first[:, None]) & (rank[k] < last[:, None])
                    i, j = np.nonzero(count >= need)
                    i, j = some[i], right[j]
                    if lo[g] == hi[g]:
                        i, j = i[i < j], j[i < j]
                    i_all.append(i)
                    j_all.append(j)
                i, j = np.concatenate(i_all), np.concatenate(j_all)
                # A pair is taken in the first family whose cell it shares, so that it counts once.
                before = cells[own][:, : family[g]]
                keep = ~(before[i] == before[j]).any(axis=1)
                i, j = i[keep], j[keep]
                near = (rows[i] * rows[j]).sum(axis=1) >= COSINE
                i, j = i[near], j[near]
                linked = np.zeros(len(own), np.int64)
                np.add.at(linked, i, copies[own][j])
                np.add.at(linked, j, copies[own][i])
                label = smallest_linked(len(own), i, j)
                some = np.flatnonzero(linked)
                nodes.append(node[own][some])
                found.append(linked[some])
                towards.append(node[own][label[some]])
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, found, towards)], names=["node", "links", "towards"])


def usable(vector: str = "embedding") -> Column:
    """Whether a vector has components, all finite and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Equal vectors stand for each other: they are compared once, and count with
    their copies. Rows meet where all DEPTH projections of one of FAMILIES
    families put them in one cell; there the windows around each row on COUNTED
    sorted projections are counted, and pairs with enough collisions are
    verified by their cosine in double precision. Pairs at the least cosine
    share a cell of some family with a probability over 0.99.

    Null, empty, zero or non-finite vectors link with nothing and keep
    themselves. Rows count one by one, whatever their vec_id; one without a
    vec_id links, is not kept, and has its class's smallest id. Vectors of
    different dimensions do not link. Further columns are ignored, and an empty
    table gives no rows.
    """
    rows = vectors.select("vec_id", "embedding", usable().alias("_usable"))
    rows = rows.withColumn("node", F.when(F.col("_usable"), F.xxhash64("embedding")))
    distinct = rows.where("_usable").groupBy("embedding").agg(F.first("node").alias("node"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    kind = vectors.schema["embedding"].dataType.simpleString()
    coded = cut(small_batches(distinct).mapInArrow(_cells, f"embedding {kind}, node long, least {vectors.schema['vec_id'].dataType.simpleString()}, copies long, cells array<int>"))
    spots = coded.select("node", F.posexplode("cells").alias("family", "cell"))
    groups = _groups(coded, spots)
    found = cut(groups.mapInArrow(_matches, "node long, links long, towards long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    members = connected_components(found, "node", "towards").withColumnRenamed("node", "_node")
    nodes = coded.select("node", "least", "copies").join(links, "node", "left")
    nodes = nodes.join(members, nodes["node"] == members["_node"], "left").withColumn("class", F.coalesce("component", "node"))
    smallest = nodes.groupBy("class").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(smallest, "class").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(nodes, "node", "left")
    component = F.when(F.col("_usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _groups(coded: DataFrame, spots: DataFrame) -> DataFrame:
    """The rows of each cell with others in it, in pairs of blocks, with their vectors; cells with one row are left out before vectors move."""
    counts = spots.groupBy("family", "cell").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = spots.join(counts, ["family", "cell"]).withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int"))
    met = met.withColumn("side", F.pmod(F.xxhash64("node", F.lit(7)), F.col("_blocks")).cast("int"))
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.select("node", "family", "cell", "side", F.least("side", "_other").alias("lo"), F.greatest("side", "_other").alias("hi"))
    rows = met.join(coded.select("node", "embedding", "copies", "cells"), "node")
    item = F.struct("side", "node", "copies", "embedding", "cells")
    return rows.groupBy("family", "cell", "lo", "hi").agg(F.collect_list(item).alias("items")).where(F.size("items") > 1).select("family", "lo", "hi", "items")


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op10_vectors": op10_vectors}
