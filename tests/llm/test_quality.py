import random

import numpy as np
import pytest

from tallyspark.llm import quality as q

SCHEMA = "doc_id long, text string, lang string, quality_score string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def sample(n, seed, first=0):
    """Every fourth document is bad, by its letters and marks."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("etaoinshr") for _ in range(pick.randrange(2, 9)))
    rows = []
    for k in range(n):
        body = [word() for _ in range(pick.choice([10, 50, 200]))]
        if k % 4 == 0:
            body = [w.upper() + "!!" for w in body] if k % 8 else [w + pick.choice(["###", "%%%"]) for w in body]
        text = " ".join(body)
        rows.append((first + k, text, pick.choice(["en", "de", None]), "x", f"s{k % 3}", len(text)))
    return rows


def label(rows):
    return [(r[0], int(r[0] % 4 != 0), None) for r in rows]


def trained(spark, known, other=()):
    docs = spark.createDataFrame([*known, *other], SCHEMA)
    return q.co_train(docs, spark.createDataFrame(label(known), LABELS))


def right(spark, model, rows):
    got = {r.doc_id: r.quality_score >= q.KEEP for r in q.score(spark.createDataFrame(rows, SCHEMA), model).collect()}
    return np.mean([got[r[0]] == (r[0] % 4 != 0) for r in rows])


def test_held_out_accuracy(spark):
    model = trained(spark, sample(400, 1), sample(200, 2, 1000))
    assert right(spark, model, sample(200, 3, 2000)) > 0.97


def test_few_labels_gain_from_exchange(spark):
    model = trained(spark, sample(60, 1), sample(600, 2, 1000))
    assert right(spark, model, sample(200, 3, 2000)) > 0.95


def test_the_views_complete_each_other(spark):
    """Half of the bad documents show it in their letters only, half in their source only: neither view alone finds all."""
    pick = random.Random(4)

    def rows(n, first):
        out = []
        for k in range(n):
            bad, kind = k % 4 == 0, k % 8
            letters = "qxzjk" if bad and kind == 0 else "etaoinshr"
            text = " ".join("".join(pick.choice(letters) for _ in range(5)) for _ in range(60))
            out.append((first + k, text, "en", "x", "spam" if bad and kind else "paper", len(text)))
        return out

    model = trained(spark, rows(400, 0), rows(400, 1000))
    test = rows(200, 2000)
    assert right(spark, model, test) > 0.97
    raws = [r[1].encode() for r in test]
    steps = model.space.steps(np.stack([q.content_view(x) for x in raws]), np.stack([q.metadata_view(x, r[2], r[4], r[5]) for x, r in zip(raws, test)]))
    y = np.array([r[0] % 4 != 0 for r in test])
    for view, x in zip(model.views, steps):
        assert ((view.odds(x) > 0)[~y]).mean() > 0.3


def test_exchanged_sums_equal_brute_force(spark):
    rows = sample(300, 7)
    known, other = rows[:100], rows[100:]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(label(known), LABELS)
    model = q.co_train(docs, labels)
    got = q._exchanged(q._pool(docs, labels, model.space).repartition(7), model.views)
    raws = [r[1].encode() for r in other]
    steps = model.space.steps(np.stack([q.content_view(x) for x in raws]), np.stack([q.metadata_view(x, r[2], r[4], r[5]) for x, r in zip(raws, other)]))
    for k in (0, 1):
        p = 1 / (1 + np.exp(-model.views[1 - k].odds(steps[1 - k].astype(float))))
        for y, sure in enumerate((p <= 1 - q.SURE, p >= q.SURE)):
            want = q.Sums.of(steps[k][sure])
            assert want.n == got[k][y].n and (want.x == got[k][y].x).all() and (want.xx == got[k][y].xx).all()


def test_reruns_and_partitions_give_the_same_scores(spark):
    rows = sample(200, 9)
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(label(rows[:80]), LABELS)
    one = q.score(docs, q.co_train(docs.repartition(1), labels)).select("doc_id", "quality_score").collect()
    other = q.score(docs, q.co_train(docs.repartition(9), labels.repartition(5))).select("doc_id", "quality_score").collect()
    assert sorted(one) == sorted(other)


def test_rows(spark):
    model = trained(spark, sample(200, 1))
    good, bad = sample(8, 5)[1][1], sample(8, 5)[4][1]
    rows = [(1, good, "en", "x", None, 9), (None, good, "en", "x", None, 9), (2, None, None, "x", None, None), (3, "", "??", "x", "", -1)]
    rows += [(1, good, "en", "x", None, 9), (4, bad, "en", "x", "s1", 9), (5, (good + "\n") * 3000, "en", "x", "s1", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = q.score(df, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "quality_score"] and dict(out.dtypes)["quality_score"] == "double"
    got = {r.doc_id: r.quality_score for r in out.collect()}
    assert got[1] > 0.5 > got[4] and got[None] == got[1] and all(0 <= v <= 1 for v in got.values())
    assert q.score(df.limit(0), model).count() == 0
    assert q.score(df.select("doc_id", "text"), model).columns == ["doc_id", "text", "quality_score"]


def test_accepted_keeps_columns_and_survives_missing_labels(spark):
    rows = sample(80, 1)
    docs = spark.createDataFrame([*rows, rows[0], (None, rows[1][1], "en", "x", "s", 1)], SCHEMA)
    labels = spark.createDataFrame([*label(rows[:60]), (None, 1, 1), (3, None, 0), (5, 1, 1)], LABELS)
    kept = q.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k in range(80) if k % 4} | {None}
    assert q.accepted(docs, labels.limit(0)).count() == 82
    assert q.accepted(docs.limit(0), labels).count() == 0
