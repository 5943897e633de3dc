import math
import random
import zlib

import numpy as np
import zstandard

from tallyspark.llm import toxicity as tx


def sample(n, seed):
    pick = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
    rows = []
    for k in range(n):
        label = k % 5 == 0
        body = ["".join(pick.choice(parts) for _ in range(pick.randrange(1, 4))) for _ in range(pick.choice([20, 60, 300]))]
        if label:
            for _ in range(2 + len(body) // 15):
                body[pick.randrange(len(body))] = pick.choice(["scoundrel", "Villain", "rascal", "wretch", "knave"])
        rows.append((" ".join(body), int(label)))
    return rows


def test_held_out_accuracy():
    model = tx.train(sample(500, 1))
    gains = model.gains()
    test = sample(300, 2)
    found = model.score(np.array([tx.evidence(gains(tx.words(t)), len(tx.words(t)), model.least_gain, model.power) for t, _ in test]))
    label = np.array([y for _, y in test]) == 1
    assert ((found >= tx.THRESHOLD) == label).mean() > 0.95


def test_rows(spark):
    model = tx.train(sample(300, 1))
    toxic = next(t for t, y in sample(20, 3) if y)
    rows = [(1, toxic, "x"), (None, toxic, "x"), (2, None, "x"), (3, "", "x"), (1, toxic, "x"), (4, "12 34 !!", "x"), (5, ("er on an " * 40000) + toxic, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted(tx.score(df, model).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.score >= tx.THRESHOLD for r in got][:5] == [True, True, False, False, False] and got[-1].score == got[0].score
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got[2:5]}) == 1
    assert got[5].n_windows > 120000 and tx.score(df.limit(0), model).count() == 0


def test_training_sees_no_held_out_rows(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, None, k % 2) for k in range(0, 60, 3)] + [(61, 1, None), (None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = {t for t, _ in tx.training_rows(docs, labels)}
    assert got == {f"text {k}" for k in range(0, 60, 3) if zlib.crc32(str(k).encode()) % 3 != 1}
    assert len(tx.training_rows(docs, labels, most=2)) == 4


def test_one_class_finds_nothing():
    model = tx.train([("some text here", 0)] * 30)
    assert model.score(np.array([0.0, 50.0])).max() < tx.THRESHOLD
    assert tx.train([]).score(np.array([1.0])).max() < tx.THRESHOLD


def test_every_window_is_compressed():
    gains = tx.train(sample(500, 1)).gains()
    found = gains([b"xscoundrel", b"archvillain", b"scoundrel", b"th", b"xscoundrel"])
    assert len(found) == 5 and (found[[0, 1, 2, 4]] > 0).all() and found[3] <= 0


def test_scores_equal_brute_force(spark):
    """Each letter run of a text compressed by itself, with new compressors and without what tasks remember or prepare."""
    model = tx.train(sample(300, 1))
    texts = [t for t, _ in sample(40, 7)] + ["", None, "xscoundrel! VILLAIN\nknave", "ünter Wretch 99 wretch", "th"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    settings = zstandard.ZstdCompressionParameters.from_level(tx.LEVEL, window_log=20, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)

    def size(window, dictionary):
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), compression_params=settings).compress(window))

    def by_hand(text):
        runs, run = [], ""
        for letter in (text or "").lower() + " ":
            if letter.isascii() and not letter.isalpha():
                runs, run = runs + [run] * bool(run), ""
            else:
                run += letter
        marked = 0
        for run in runs:
            window = b"\n" + b"".join(bytes([b, b]) for b in run.encode()) + b"\n" + b"~" * 9
            marked += size(window, model.ordinary) - size(window, model.toxic) >= model.least_gain
        found = marked / len(runs) ** model.power if runs else 0.0
        return len(runs), marked, 1 / (1 + math.exp(-model.slope * (found - model.middle)))

    got = {r.doc_id: r for r in tx.score(rows, model).collect()}
    assert len(got) == len(texts)
    for k in [*range(0, 40, 3), *range(40, len(texts))]:
        windows, toxic, score = by_hand(texts[k])
        assert (got[k].n_windows, got[k].n_toxic) == (windows, toxic) and abs(got[k].score - score) < 1e-9
    assert {got[k].score >= tx.THRESHOLD for k in range(40)} == {True, False}
