import random
from itertools import combinations

from tallyspark.llm import decontamination as dc
from tests.oracle import compare

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"


def test_seeds_meet_every_tolerated_window():
    off = int(dc.WINDOW - dc.SIMILARITY * dc.WINDOW)
    for gone in combinations(range(dc.WINDOW), off):
        assert any(all(s + k not in gone for k in mask) for mask in dc.MASKS for s in range(dc.WINDOW - mask[-1]))


def test_planted_passages(spark):
    pick = random.Random(8)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (10, 13, 30, 60, 4)]
    docs, want = [], set()
    for k in range(120):
        kind, item = k % 6, k % 4
        body = [word() for _ in range(pick.choice([0, 3, 50]))]
        passage = list(items[item])
        if kind == 1:
            for at in range(3, len(passage), 6):
                passage[at] = word()
        if kind == 2:
            passage = [w.upper() + "," for w in passage]
        if kind == 3:
            passage = passage[-13:]
        if kind == 4:
            passage = passage[:6] + [word() for _ in passage[6:]]
        if kind == 5:
            passage = []
        docs.append((k, " ".join(body) + "\n" + " ".join(passage) + " " + " ".join(body[:9]), "x"))
        if kind in (0, 1, 2, 3):
            want.add((k, item))
    docs += [(900, None, None), (901, "", None), (None, " ".join(items[3]), None), (0, docs[0][1], "again")]
    rows = [(k, " ".join(w), "x") for k, w in enumerate(items)] + [(8, None, None), (9, "", None)]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(rows, ITEMS)
    assert {(r.doc_id, r.item_id) for r in dc.overlaps(d, b).collect()} == want | {(None, 3)}
    kept = dc.clean(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {x[0] for x in docs} - {k for k, _ in want} - {None}
    assert dc.overlaps(d.limit(0), b).count() == dc.overlaps(d, b.limit(0)).count() == 0


def test_short_items_against_brute_force(spark):
    """Items of 1 to 12 words with every number of substitutions, among chance repeats of a few words."""
    pick = random.Random(11)
    word = lambda: "".join(pick.choice("ab") for _ in range(4))
    items = {n: [word() for _ in range(n)] for n in range(1, 13)}
    docs = {}
    for n, item in items.items():
        for gone in range(4):
            for _ in range(6):
                body = list(item)
                for at in pick.sample(range(n), min(gone, n)):
                    body[at] = "new" + word()
                docs[len(docs)] = [word() for _ in range(pick.randrange(4))] + body + [word() for _ in range(pick.randrange(4))]
    want = set()
    for d, w in docs.items():
        for n, item in items.items():
            equal = max((sum(0 <= s + k < len(w) and w[s + k] == item[k] for k in range(n)) for s in range(-n, len(w))), default=0)
            if equal >= dc.SIMILARITY * n:
                want.add((d, n, equal))
    d = spark.createDataFrame([(k, " ".join(w), "") for k, w in docs.items()], DOCS)
    b = spark.createDataFrame([(n, " ".join(w), "") for n, w in items.items()], ITEMS)
    assert {(r.doc_id, r.item_id, r.n_equal) for r in dc.overlaps(d, b).collect()} == want


def test_a_very_long_text_is_read_to_its_end(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    d = spark.createDataFrame([(1, "x " * 200_000 + passage, ""), (2, "x " * 200_000, "")], DOCS)
    b = spark.createDataFrame([(5, passage, ""), (6, "w1 w2 w3", "")], ITEMS)
    assert {(r.doc_id, r.item_id) for r in dc.overlaps(d, b).collect()} == {(1, 5), (1, 6)}


def test_without_broadcast(spark, monkeypatch):
    d, b = spark.createDataFrame([(1, "a b c d e f g h i j k l m", "")], DOCS), spark.createDataFrame([(5, "a b c d e f g h i j k l m", "")], ITEMS)
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    assert [tuple(r) for r in dc.overlaps(d, b).collect()] == [(1, 5, 13, 13)]


def test_oracle(spark):
    rows, off = compare(spark, dc.QUERIES["op9_decontamination"], dc.ORACLES["op9_decontamination"])
    assert rows and not off
