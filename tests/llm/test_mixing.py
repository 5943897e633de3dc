import random

import numpy as np
import pytest

from tallyspark.llm import mixing

SCHEMA = "doc_id long, text string, source string, target string, shard int"


def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        stop = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not stop:
            return out | {s: level * w[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in stop}
        left -= sum(2.0 * sizes[s] for s in stop)
        free -= stop
    return out


def docs(n=900, seed=2):
    pick = random.Random(seed)
    rows = [(k, " ".join(["w"] * pick.choice([0, 1, 5, 20, 80])), pick.choice(["src0"] * 5 + ["a", "b", "zebra", "é", None]), "t", 1) for k in range(n)]
    return rows + [(None, "one two", "a", None, None), (7, None, "only null", None, None), rows[0], rows[0]]


def test_mix(spark):
    rows = docs()
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = plain_targets(sizes)
    taken = {}
    for r in got:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.size * len(r.places) and len(r.places) <= 2
        assert all(0 <= p.shard < mixing.SHARDS for p in r.places)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 45, s
    again = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(7, "text")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    rows_out = mixing.mixed(spark.createDataFrame(rows, SCHEMA))
    assert rows_out.columns == ["doc_id", "text", "source", "target", "shard", "position"]
    assert rows_out.count() == sum(len(r.places) for r in got)


def test_tree_deals_out_every_draw():
    counts = np.array([0, 3, 700, 2049, 41])
    own, before = zip(*(mixing.leaf_quotas(counts, 7, k, 5) for k in range(7)))
    assert (np.sum(own, axis=0) == counts).all()
    assert (np.cumsum([np.zeros(5, int), *own[:-1]], axis=0) == np.array(before)).all()
    assert max(map(sum, own)) - min(map(sum, own)) <= 1


def test_one_document_and_none(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    (r,) = mixing.mix(spark.createDataFrame([(1, "a b c d", "s", None, None)], SCHEMA)).collect()
    assert r.target == 6.0 and r.taken in (4, 8)


def test_many_sources_without_broadcast(spark, monkeypatch):
    rows = docs(200)
    few = sorted(map(repr, mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(repr, mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect())) == few
