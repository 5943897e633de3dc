import random

import numpy as np
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tallyspark.llm import simhash
from tallyspark.llm.common import connected_components

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "")) if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints):
    label = {k: k for k in range(len(ids))}
    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    least = {}
    for k, v in label.items():
        if ids[k] is not None:
            least[v] = min(least.get(v, ids[k]), ids[k])
    return [least.get(label[k]) for k in range(len(ids))]


def rows(seed=1):
    pick = random.Random(seed)
    base = [" ".join(pick.choice(["red", "Blue", "grün", "tea", "of", "x"]) + str(pick.randrange(30)) for _ in range(n)) for n in (1, 2, 3, 30, 60, 200)]
    texts = base + base + [None, "", " \t\n", "ÀB c", "àb c"]
    for b in base[3:]:
        for _ in range(8):
            w = b.split(" ")
            w[pick.randrange(len(w))] = "new"
            texts.append(" ".join(w))
    return [(k if k % 11 else None, t, "clash") for k, t in enumerate(texts, 1)]


def test_classes_match_brute_force(spark):
    data = rows()
    out = simhash.near_duplicates(spark.createDataFrame(data, DOCS)).collect()
    prints = [plain_fingerprint(t) for _, t, _ in data]
    want = sorted((i, p, c) for i, p, c in zip([d[0] for d in data], prints, plain_components([d[0] for d in data], prints)) if i is not None)
    assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in out if r.doc_id is not None) == want
    assert len(out) == len(data)


def test_hot_bucket_is_split_without_loss(spark, monkeypatch):
    pick = np.random.default_rng(3)
    base = int(pick.integers(1 << 62))
    prints = list({base ^ sum(1 << int(b) for b in pick.choice(24, k, replace=False)) for k in pick.integers(0, 5, 400)})
    monkeypatch.setattr(simhash, "BLOCK", 50)
    monkeypatch.setattr(simhash, "SMALL", 8)
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    reach = {p: p for p in prints}

    def root(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for e in edges:
        assert bin((e.a ^ e.b) % 2**64).count("1") <= 64
        reach[root(max(e.a, e.b))] = root(min(e.a, e.b)) if root(e.a) != root(e.b) else reach[root(max(e.a, e.b))]
    got = {frozenset(q for q in prints if root(q) == root(p)) for p in prints}
    want = plain_components(list(range(len(prints))), prints)
    assert got == {frozenset(q for q, w in zip(prints, want) if w == x) for x in set(want)}


def test_bit_sliced_distances():
    pick = np.random.default_rng(5)
    a = pick.integers(0, 2**63, 300, dtype=np.uint64)
    b = a[pick.integers(0, 300, 500)] ^ np.array([sum(1 << int(x) for x in pick.choice(64, k, replace=False)) for k in pick.integers(0, 7, 500)], np.uint64)
    near = np.array([[bin(int(x) ^ int(y)).count("1") <= 3 for y in b] for x in a])
    i, j = simhash.near_pairs(a, b)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(near))))
    assert (simhash.near_listed(a, b[:300]) == near[np.arange(300), np.arange(300)]).all()


def test_keep_one_and_empty(spark):
    kept = simhash.keep_one(spark.createDataFrame([(3, "a b c d", "z"), (2, "a b c d", "y"), (2, "a b c d", "y"), (9, "other words in here", "x")], DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9] and kept.columns == DOCS.names
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_keep_one_judges_each_row_by_its_own_text(spark):
    one, two, three, four, five = ("words of the %s kind that only this one has" % " ".join(f"{n}{k}" for k in range(20)) for n in "abcde")
    data = [(None, one, "x"), (None, two, "x"), (None, two, "x"), (None, three, "x"), (7, three, "x"), (1, four, "x"), (2, four, "x"), (2, five, "x"), (None, None, "x")]
    kept = simhash.keep_one(spark.createDataFrame(data, DOCS)).collect()
    assert sorted(((r.doc_id or 0, r.text or "") for r in kept)) == sorted([(0, one), (0, two), (7, three), (1, four), (2, five), (0, "")])
