"""Proofs by blocks of neighbours: what a path leads to, and that no row is made for a step."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import audit


def fold(leaf, path):
    for s in path:
        leaf = audit._hash_pair(bytes.fromhex(s.hash), leaf) if s.side == "left" else audit._hash_pair(leaf, bytes.fromhex(s.hash))
    return leaf


def made(spark, n):
    leaves = audit.leaves(spark.range(0, n, 1, 3).select("id", F.concat(F.lit("r"), "id").alias("record")), "id", "record").cache()
    return leaves, audit.new_nodes(leaves, 0, n).cache()


@pytest.mark.parametrize(("n", "size"), [(0, 0), (1, 1), (1500, 1024), (2600, 2600)])
def test_a_path_leads_where_its_steps_lead(spark, n, size):
    """Of the log's leaves and of forged ones, which leave the path that a block has in common; also under an earlier head."""
    leaves, tree = made(spark, n)
    paths = {r.seq: r.path for r in audit.inclusion_proofs(tree, leaves.unionByName(leaves), size).collect()}
    assert sorted(paths) == list(range(size))
    forged = leaves.withColumn("leaf_hash", F.when(F.col("seq") % 700 == 5, F.sha2(F.col("seq").cast("string"), 256)).otherwise(F.col("leaf_hash")))
    head, hashes = audit.root_of(tree, size), {r.seq: r.leaf_hash for r in forged.collect()}
    got = {r.seq: r for r in audit.proven(tree, forged, size).collect()}
    assert sorted(got) == sorted(paths)
    for k, r in got.items():
        assert r.steps == len(paths[k]) and r.root == fold(bytes.fromhex(hashes[k]), paths[k]).hex()
        assert (r.root == head) == (k % 700 != 5)


def test_no_row_is_made_for_a_step(spark):
    """Each step of each path was a row that met the tree, n log n in all, shuffled where the tree is too large to broadcast."""
    n = 4000
    leaves, tree = made(spark, n)
    assert tree.count() < 2 * n
    context = spark.sparkContext
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    context.setJobGroup("proofs", "proofs")
    try:
        assert len(audit.inclusion_proofs(tree, leaves, n).collect()) == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("proofs") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)}
    assert 0 < sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) <= 3 * n
