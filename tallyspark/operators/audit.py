"""A log that shows tampering: hashed leaves, a Merkle root by levels, proofs and signed heads."""

from __future__ import annotations

import hashlib
import hmac
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.session import cut

EMPTY_ROOT = hashlib.sha256(b"").hexdigest()


def leaf_hash(record: str) -> Column:
    """sha256 of a zero byte and the record."""
    return F.sha2(F.concat(F.unhex(F.lit("00")), F.encode(F.col(record), "utf-8")), 256)


def _node(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


def leaves(records: DataFrame, seq: str, record: str) -> DataFrame:
    """(seq, leaf_hash) for records numbered densely from 0."""
    return records.select(F.col(seq).cast("long").alias("seq"), leaf_hash(record).alias("leaf_hash"))


#: Levels of the tree that one aggregation climbs.
CLIMB = 10


def _level(nodes: Column) -> Column:
    """The next level over an array of nodes: neighbours hashed together; an odd last node is carried up."""
    pair = lambda i: F.when(2 * i + 1 < F.size(nodes), _node(F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1))).otherwise(F.get(nodes, 2 * i))
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(nodes) / 2).cast("int") - 1), pair)


def subtree_roots(nodes: DataFrame) -> DataFrame:
    """(seq, leaf_hash) of the subtrees over 2**CLIMB neighbouring nodes each, in one aggregation."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("seq", "leaf_hash"))), lambda x: x["leaf_hash"])
    gathered = nodes.groupBy(F.expr(f"seq div {1 << CLIMB}").alias("seq")).agg(own.alias("_nodes"))
    climbed = F.aggregate(F.sequence(F.lit(1), F.lit(CLIMB)), F.col("_nodes"), lambda nodes, _: _level(nodes))
    return gathered.select("seq", F.get(climbed, F.lit(0)).alias("leaf_hash"))


def root(nodes: DataFrame, count: int) -> DataFrame:
    """One row with the root over ``count`` leaves: one narrow aggregation for each CLIMB levels."""
    if count == 0:
        return nodes.sparkSession.createDataFrame([(EMPTY_ROOT,)], "root string")
    while count > 1:
        nodes, count = subtree_roots(nodes), (count + (1 << CLIMB) - 1) >> CLIMB
    return nodes.select(F.col("leaf_hash").alias("root"))


def first_tampered(log: DataFrame, record: str) -> DataFrame:
    """One row: the first number whose record does not give its leaf, or which is missing; null of a sound log."""
    wrong = log.where(leaf_hash(record) != F.col("leaf_hash")).agg(F.min("seq").alias("bad"))
    gaps = log.agg(F.count_distinct("seq").alias("n"), F.max("seq").alias("top")).where("n != top + 1")
    present = log.select((F.col("seq") + 1).alias("seq")).distinct()
    missing = present.join(log.select("seq").distinct(), "seq", "left_anti").agg(F.min("seq").alias("gap"))
    return wrong.crossJoin(missing).crossJoin(gaps.agg(F.count(F.lit(1)).alias("has_gap"))).select(F.least("bad", F.when(F.col("has_gap") > 0, F.col("gap"))).alias("first_tampered"))


def _hash_pair(a: bytes, b: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + a + b).digest()


def verify_inclusion(leaf: bytes, path: list[tuple[str, bytes]], expected: bytes) -> bool:
    for side, other in path:
        leaf = _hash_pair(other, leaf) if side == "left" else _hash_pair(leaf, other)
    return hmac.compare_digest(leaf, expected)


def sign_head(size: int, root_hex: str, at: str, key: bytes) -> str:
    """A keyed signature of a head; keys stay with the caller."""
    return hmac.new(key, f"{size}|{root_hex}|{at}".encode(), hashlib.sha256).hexdigest()


def verify_head(size: int, root_hex: str, at: str, key: bytes, signature: str) -> bool:
    return hmac.compare_digest(sign_head(size, root_hex, at, key), signature)


def _peaks(first: int, last: int) -> list[tuple[int, int]]:
    """Begins and sizes of the largest whole subtrees that cover the leaves from first up to last."""
    out = []
    while first < last:
        size = first & -first if first else 1 << (last.bit_length() - 1)
        while first + size > last:
            size //= 2
        out.append((first, size))
        first += size
    return out


def _bagged(peaks: list[bytes]) -> bytes:
    out = peaks[-1]
    for left in reversed(peaks[:-1]):
        out = _hash_pair(left, out)
    return out


def verify_consistency(old: int, old_root: bytes, size: int, new_root: bytes, path: tuple[list[bytes], list[bytes]]) -> bool:
    """Whether the path gives both roots: the old subtrees alone, and with the later ones, neighbours of one size joined."""
    if not 0 <= old <= size:
        return False
    begun, later = path
    places = _peaks(0, old), _peaks(old, size)
    if (len(begun), len(later)) != tuple(map(len, places)):
        return False
    if old and not hmac.compare_digest(_bagged(begun), old_root):
        return False
    if not old and old_root != bytes.fromhex(EMPTY_ROOT):
        return False
    stack: list[tuple[int, bytes]] = []
    for (_, n), node in zip([*places[0], *places[1]], [*begun, *later], strict=True):
        while stack and stack[-1][0] == n:
            n, node = 2 * n, _hash_pair(stack.pop()[1], node)
        stack.append((n, node))
    return hmac.compare_digest(_bagged([node for _, node in stack]) if stack else bytes.fromhex(EMPTY_ROOT), new_root)


#: Numbers of ``order`` that are counted together when records are numbered.
NUMBERED_AT_ONCE = 100_000


def numbered(records: DataFrame, order: str, first: int = 0) -> DataFrame:
    """``records`` with seq, dense from ``first`` in the order of a distinct whole number.

    Stretches of ``order`` are counted, and a row's place is its place in its
    stretch after all rows of the earlier ones; only the counts, one for each
    stretch, are summed in one task.
    """
    rows = records.withColumn("_at", F.floor(F.col(order) / NUMBERED_AT_ONCE))
    counts = rows.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_at", (F.sum("_n").over(W.orderBy("_at")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_at").orderBy(order)) - 1 + F.col("_before") + first
    return rows.join(offsets, "_at").withColumn("seq", place.cast("long")).drop("_at", "_before")


# --- a stored tree ----------------------------------------------------------
#
# A node (level, index) stands for the leaves from index * 2**level up to the
# next node's. It is stored once all of these are in the log and never changes
# then; what the last leaves hang on is put together from the whole subtrees.

NODES = "level int, index long, hash string"


def _complete(nodes: Column) -> Column:
    """The next level over an array of nodes, of whole pairs only."""
    pair = lambda i: _node(F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1))
    return F.when(F.size(nodes) > 1, F.transform(F.sequence(F.lit(0), F.floor(F.size(nodes) / 2).cast("int") - 1), pair)).otherwise(F.array().cast("array<string>"))


def _numbered_nodes(level: int, nodes: str, begin: Column) -> Column:
    return F.transform(nodes, lambda h, i: F.struct(F.lit(level).alias("level"), (begin + i).alias("index"), h.alias("hash")))


def new_nodes(leaves: DataFrame, first: int, size: int, stored: DataFrame | None = None) -> DataFrame:
    """(level, index, hash): the nodes that the leaves from ``first`` up to ``size`` complete.

    ``leaves`` has seq and leaf_hash; ``stored`` the nodes of the leaves before,
    of which no more than 2**CLIMB neighbours at the right edge are read for each
    CLIMB levels. So the work grows with the new leaves, not with the log.
    """
    base, level, out = leaves.select(F.col("seq").alias("index"), F.col("leaf_hash").alias("hash")), 0, []
    while True:
        begun, done = first >> level, size >> level
        edge = begun >> CLIMB << CLIMB
        if level == 0:
            out.append(base.select(F.lit(0).alias("level"), "index", "hash"))
        if done <= 1 or begun == done:
            break
        if stored is not None and edge < begun:
            base = base.unionByName(stored.where((F.col("level") == level) & (F.col("index") >= edge) & (F.col("index") < begun)).select("index", "hash"))
        own = F.transform(F.array_sort(F.collect_list(F.struct("index", "hash"))), lambda x: x["hash"])
        groups = base.groupBy(F.expr(f"index div {1 << CLIMB}").alias("group")).agg(own.alias("l0"))
        for k in range(1, CLIMB + 1):
            groups = groups.withColumn(f"l{k}", _complete(F.col(f"l{k - 1}")))
        each = [_numbered_nodes(level + k, f"l{k}", F.col("group") * (1 << (CLIMB - k))) for k in range(1, CLIMB + 1)]
        climbed = groups.select(F.explode(F.concat(*each)).alias("n")).select("n.*")
        # Nodes of old leaves only come out of the edge again.
        climbed = cut(climbed.where(F.expr(f"(index + 1) * shiftleft(1L, level) > {first}")))
        out.append(climbed)
        level += CLIMB
        base = climbed.where(F.col("level") == level).select("index", "hash")
    return reduce(DataFrame.unionByName, out).select(F.col("level").cast("int").alias("level"), F.col("index").cast("long").alias("index"), "hash")


def nodes_at(tree: DataFrame, wanted: set[tuple[int, int]]) -> dict[tuple[int, int], bytes]:
    """Some nodes by (level, index): a read that the files' statistics prune to where they lie."""
    if not wanted:
        return {}
    levels: dict[int, list[int]] = {}
    for level, index in sorted(wanted):
        levels.setdefault(level, []).append(index)
    held = reduce(or_, ((F.col("level") == level) & F.col("index").isin(*found) for level, found in levels.items()))
    got = {(r["level"], r["index"]): bytes.fromhex(r["hash"]) for r in tree.where(held).collect()}
    if missing := wanted - got.keys():
        raise ValueError(f"the tree lacks nodes: {sorted(missing)[:5]}")
    return got


def _peak_nodes(first: int, last: int) -> list[tuple[int, int]]:
    return [(n.bit_length() - 1, at >> (n.bit_length() - 1)) for at, n in _peaks(first, last)]


def root_of(tree: DataFrame, size: int) -> str:
    """The root over the first ``size`` leaves, from at most log2(size) nodes."""
    places = _peak_nodes(0, size)
    got = nodes_at(tree, set(places))
    return _bagged([got[p] for p in places]).hex() if places else EMPTY_ROOT


#: A path: on which side the other node stands, and its hash.
PATH = "array<struct<side: string, hash: string>>"


def _tails(tree: DataFrame, size: int) -> Column:
    """By its level, what follows a whole subtree's root on the way to the root over ``size`` leaves: the subtrees to the right as one, then those to the left."""
    places = _peak_nodes(0, size)
    got = nodes_at(tree, set(places))
    hashes, tails = [got[p] for p in places], {}
    for k, (level, _) in enumerate(places):
        right = [("right", _bagged(hashes[k + 1 :]).hex())] if k + 1 < len(places) else []
        tails[level] = right + [("left", h.hex()) for h in reversed(hashes[:k])]
    step = lambda side, h: F.struct(F.lit(side).alias("side"), F.lit(h).alias("hash"))
    return F.array(*(F.array(*(step(*s) for s in tails.get(level, []))).cast(PATH) for level in range(size.bit_length())))


def _met(tree: DataFrame, wanted: DataFrame, size: int, tails: Column, level: int = 0, gather=F.collect_list) -> DataFrame:
    """(block, found, above, root_hash): what is ``wanted`` (index, and whatever else) of each 2**CLIMB neighbours on a level, with its path inside.

    A node meets the tree as one of its block, whose nodes of CLIMB levels are
    one row, so that the tree and what is wanted are shuffled once and no row is
    made for a step. ``found`` has the node's own hash, the path to the block's
    root, and ``top``, the level of the root of its whole subtree: where that is
    inside the block, its tail follows, else ``above``, the path of the block's
    root (``root_hash``), which is one for the block.
    """
    end = level + CLIMB
    top = F.length(F.bin(F.shiftleft(F.col("index").cast("long"), level).bitwiseXOR(F.lit(size).cast("long")))) - 1
    inside = (F.col("index") >= 0) & (F.col("index") < size >> level)
    wanted = wanted.where(inside).withColumn("top", top)
    blocks = wanted.groupBy(F.shiftright("index", CLIMB).alias("block")).agg(gather(F.struct(*wanted.columns)).alias("_wanted"))
    nodes = tree.where((F.col("level") >= level) & (F.col("level") < end)).select(F.expr(f"shiftright(index, {end} - level)").alias("block"), F.col("level").cast("int").alias("level"), "index", "hash")
    # The nodes of a level are there from the block's first on, so that a place in the array is a place in the block.
    held = [F.transform(F.sort_array(F.collect_list(F.when(F.col("level") == level + k, F.struct("index", "hash")))), lambda x: x["hash"]).alias(f"l{k}") for k in range(CLIMB)]
    blocks = blocks.join(nodes.groupBy("block").agg(*held), "block", "left")

    if size >> end:
        above = _met(tree, wanted.select(F.shiftright("index", CLIMB).alias("index")).distinct(), size, tails, end)
        blocks = blocks.join(_whole(above, tails, end).select(F.col("index").alias("block"), F.col("path").alias("above"), F.col("hash").alias("root_hash")), "block", "left")
    else:
        blocks = blocks.withColumn("above", F.lit(None).cast(PATH)).withColumn("root_hash", F.lit(None).cast("string"))

    def found(w: Column) -> Column:
        at = w["index"].bitwiseAND(F.lit((1 << CLIMB) - 1)).cast("int")
        steps = (F.struct(F.when(F.shiftright(at, k).bitwiseAND(F.lit(1)) == 1, "left").otherwise("right").alias("side"), F.get(F.col(f"l{k}"), F.shiftright(at, k).bitwiseXOR(F.lit(1))).alias("hash")) for k in range(CLIMB))
        return F.struct(*(w[c].alias(c) for c in wanted.columns), F.get(F.col("l0"), at).alias("hash"), F.slice(F.array(*steps), F.lit(1), F.least(w["top"] - level, F.lit(CLIMB))).alias("path"))

    return blocks.select("block", F.transform("_wanted", found).alias("found"), "above", "root_hash")


def _rest(top: Column, tails: Column, level: int = 0) -> Column:
    return F.when(top < level + CLIMB, F.get(tails, top)).otherwise(F.col("above"))


def _whole(met: DataFrame, tails: Column, level: int = 0) -> DataFrame:
    """(index, hash, path): each node's path to the root."""
    rows = met.select(F.explode("found").alias("f"), "above")
    return rows.select("f.index", "f.hash", F.concat("f.path", _rest(F.col("f.top"), tails, level)).alias("path"))


def inclusion_proofs(tree: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(seq, path) for the leaves ``wanted`` (seq): the siblings up to the root over ``size`` leaves, structs of side and hash.

    Up to the root of its whole subtree, a leaf's siblings are stored nodes; then
    come the other whole subtrees, those to the right as one. Nothing is gathered
    but the nodes of a block (see ``_met``); a sibling that the tree lacks has no hash.
    """
    tails = _tails(tree, size)
    met = _met(tree, wanted.select(F.col("seq").alias("index")), size, tails, gather=F.collect_set)
    return _whole(met, tails).select(F.col("index").alias("seq"), "path")


def proven(tree: DataFrame, leaves: DataFrame, size: int) -> DataFrame:
    """(seq, steps, root) for ``leaves`` (seq, leaf_hash): the length of each one's path, and the root that the path gives.

    A path goes through the root of the leaf's block. Where it gives the hash
    that the tree has there, the rest is what that hash gives, which is worked
    out once for a block; where it gives another one, the rest is gone for it alone.
    """
    tails = _tails(tree, size)
    met = _met(tree, leaves.select(F.col("seq").alias("index"), "leaf_hash"), size, tails)
    inner = F.transform("found", lambda f: F.struct(f["index"].alias("seq"), f["top"].alias("top"), F.size(f["path"]).alias("steps"), _proven(f["leaf_hash"], f["path"]).alias("inner")))
    # Beside explode, the block's root would be worked out for every leaf.
    met = met.withColumn("above_root", proven_root("root_hash", "above")).select(F.explode(inner).alias("f"), "above", "root_hash", "above_root")
    rest = _rest(F.col("f.top"), tails)
    known = (F.col("f.top") >= CLIMB) & (F.col("f.inner") == F.col("root_hash"))
    return met.select("f.seq", (F.col("f.steps") + F.size(rest)).alias("steps"), F.when(known, F.col("above_root")).otherwise(_proven(F.col("f.inner"), rest)).alias("root"))


def _proven(leaf: Column, path: Column) -> Column:
    step = lambda h, s: F.when(s["side"] == "right", _node(h, s["hash"])).otherwise(_node(s["hash"], h))
    return F.aggregate(path, leaf, step)


def proven_root(leaf: str, path: str) -> Column:
    """The root that a leaf and its path give."""
    return _proven(F.col(leaf), F.col(path))


def consistency_proof(tree: DataFrame, old: int, size: int) -> tuple[list[bytes], list[bytes]]:
    """What shows that a log of ``old`` leaves begins that of ``size``: the roots of its whole subtrees, and of those that the later leaves make."""
    places = _peak_nodes(0, old), _peak_nodes(old, size)
    got = nodes_at(tree, {p for own in places for p in own})
    return tuple([got[p] for p in own] for own in places)


# --- the log in a folder ----------------------------------------------------

HEADS = "size long, root string, at string, signature string, run string"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What is stored at a path; no rows if there is nothing yet."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, f"{folder}/log", "seq long, record string, leaf_hash string, at string, run string")


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, f"{folder}/tree", f"{NODES}, run string")


def read_heads(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, f"{folder}/heads", HEADS)


def log_size(spark: SparkSession, folder: str) -> int:
    return read_heads(spark, folder).agg(F.max("size").alias("n")).first()["n"] or 0


def append(spark: SparkSession, folder: str, records: DataFrame, order: str, run: str, at: str, key: bytes) -> int:
    """Append a run's records (``order`` and record) to the log in a folder, with its nodes and a signed head; the log's size then.

    A run is one folder of Parquet, and is refused if it is there; nothing that
    was written is touched again. First the records are written, then the nodes
    that they complete, then the head. What a crash in between has left without
    a head gets its nodes and its head before a further run begins. Of the log
    only the new run is read, of the tree its right edge.
    """
    size = repair(spark, folder, at, key)
    new = numbered(records.select(order, "record"), order, size).select("seq", "record", leaf_hash("record").alias("leaf_hash"), F.lit(at).alias("at"))
    new.write.mode("error").parquet(f"{folder}/log/run={run}")
    return _seal(spark, folder, run, size, at, key)


def repair(spark: SparkSession, folder: str, at: str, key: bytes) -> int:
    """Give runs of the log that have no head their nodes and their head; the log's size then."""
    heads = read_heads(spark, folder).select("run", "size").collect()
    size = max((h["size"] for h in heads), default=0)
    # The runs are folders, so that those with a head are not read.
    left = read_log(spark, folder).where(~F.col("run").isin([h["run"] for h in heads])).groupBy("run").agg(F.min("seq").alias("first")).orderBy("first").collect()
    for r in left:
        size = _seal(spark, folder, r["run"], size, at, key)
    return size


def _seal(spark: SparkSession, folder: str, run: str, first: int, at: str, key: bytes) -> int:
    leaves = read_log(spark, folder).where(F.col("run") == run).select("seq", "leaf_hash")
    held = leaves.agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count(F.lit(1)).alias("n")).first()
    size = first + held["n"]
    if held["n"]:
        if (held["low"], held["high"]) != (first, size - 1):
            raise ValueError(f"run {run} is not whole: {held['n']} records from {held['low']} to {held['high']}, after {first}")
        nodes = new_nodes(leaves, first, size, read_tree(spark, folder).where(F.col("run") != run))
        nodes.repartitionByRange("level", "index").sortWithinPartitions("level", "index").write.mode("overwrite").parquet(f"{folder}/tree/run={run}")
    top = root_of(read_tree(spark, folder), size)
    spark.createDataFrame([(size, top, at, sign_head(size, top, at, key), run)], HEADS).coalesce(1).write.mode("append").parquet(f"{folder}/heads")
    return size


def page(log: DataFrame, run: str, after: int = -1, size: int = 100) -> DataFrame:
    """The next records of a run after a number, in order."""
    return log.where((F.col("run") == run) & (F.col("seq") > after)).orderBy("seq").limit(size)


def verify(spark: SparkSession, folder: str, key: bytes, trusted: tuple[int, str] | None = None) -> dict:
    """What holds of a log: records against leaves, numbers without gaps, nodes against leaves, and each head's signature and root.

    ``trusted`` is the size and root of a head that was verified before: then
    only the runs after it are read, and the tree must still give that root.
    """
    begun, known = trusted or (0, EMPTY_ROOT)
    heads = read_heads(spark, folder).where(F.col("size") >= begun).orderBy("size", "at").collect()
    later = [h for h in heads if h["size"] > begun]
    runs = [h["run"] for h in later]
    log = read_log(spark, folder).where(F.col("run").isin(runs))
    tree = read_tree(spark, folder)
    size = max((h["size"] for h in heads), default=0)
    bad = first_tampered(log.withColumn("seq", F.col("seq") - begun), "record").first()["first_tampered"]
    whole = bool(heads) and log.count() == size - begun and (trusted is not None or begun == 0)
    signed = all(verify_head(h["size"], h["root"], h["at"], key, h["signature"]) for h in heads)
    rooted = nodes = True
    try:
        rooted = root_of(tree, begun) == known and all(root_of(tree, h["size"]) == h["root"] for h in later)
        made = new_nodes(log.select("seq", "leaf_hash"), begun, size, tree.where(~F.col("run").isin(runs)))
        stored = tree.where(F.col("run").isin(runs)).select("level", "index", F.col("hash").alias("stored"))
        nodes = not made.join(stored, ["level", "index"], "full_outer").where(~F.col("hash").eqNullSafe(F.col("stored"))).limit(1).count()
    except ValueError:
        rooted = False
    bad = bad if bad is None else bad + begun
    return {"sound": bad is None and signed and rooted and nodes and whole, "first_tampered": bad, "signatures": signed, "roots": rooted, "nodes": nodes, "whole": whole}
