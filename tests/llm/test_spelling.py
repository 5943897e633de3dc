import random
import re
import zlib
from collections import Counter

from tallyspark.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, _next string"


def plain_words(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def neighbours(word, letters):
    cut = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cut if b} | {a + c + b for a, b in cut for c in letters} | {a + c + b[1:] for a, b in cut if b for c in letters}
    return out - {word}


def plain(rows):
    count = plain_words(rows)
    letters = set("".join(count))
    near = {w: [x for x in neighbours(w, letters) if x in count] for w in count}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 10 * count[w] else None
    out = set()
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), count.get(form[w])))
    return out


def shown(spark, rows, schema="doc_id long, text string"):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(spark.createDataFrame(rows, schema)).collect()}


def rows():
    pick = random.Random(3)
    base = ["".join(pick.choice("abcé") for _ in range(pick.randrange(6, 10))) for _ in range(60)] + ["straßeÀÿ×÷", "abcabca", "Abcabca"]
    out = [(k if k % 7 else None, " ".join(pick.choices(base, [2.0**-(j % 12) for j in range(len(base))], k=pick.randrange(80)))) for k in range(500)]
    # Chains of forms, ties between forms, and words that edits at either end bring near.
    chain = [("grünlich", 2500), ("grünlih", 230), ("grünlihx", 20), ("ünlihxx", 2), ("tiebase", 2), ("tiebasea", 30), ("tiebaseb", 30), ("xtiebase", 30), ("lonesome", 4)]
    out += [(900 + k, f"{w}-" * n) for k, (w, n) in enumerate(chain)]
    return out + [(1, None), (2, ""), (3, "1234 ,.;"), (4, "ſhortish Ā" * 3), (5, "qwertyui" * 60 + " "), (5, "qwertyui" * 60)]


def test_variants_match_plain_search(spark):
    data = rows()
    want = plain(data)
    assert shown(spark, [(*r, "clash", "clash", "clash") for r in data], SCHEMA) == want
    assert sum(r[1] is not None and r[1] != r[2] for r in want) and sum(r[4] == 0 for r in want) and max(r[4] for r in want) > 2


def test_many_small_shards_and_rounds_give_the_same(spark, monkeypatch):
    data = rows()
    monkeypatch.setattr(spelling, "SHARD_WORDS", 40)
    monkeypatch.setattr(spelling, "BROADCAST_BYTES", 6000)
    assert shown(spark, data) == plain(data)


def test_tries_pack_and_walk():
    pick = random.Random(8)
    words = sorted({"".join(pick.choice("abÿ") for _ in range(pick.randrange(1, 7))) for _ in range(600)})
    place = {w: k + 1 for k, w in enumerate(words)}
    tries = [spelling.Trie.unpack(spelling.Trie.pack([(w, place[w]) for w in words if len(w) == n])[1]) for n in range(1, 7)]
    assert [t.length for t in tries] == [1, 2, 3, 4, 5, 6]
    for word in [*words[:300], "aaaaaaaaaa", "zz", "", "bÿz", "aabbaa"]:
        got = sorted(x for t in tries for x in t.near(word))
        assert got == sorted((x, place[x]) for x in neighbours(word, "abÿ") if x in place), word


def test_very_long_runs(spark):
    long = "qwertyui" * 12_500
    ids = [k for k in range(200) if zlib.crc32(f"{k}:{long}".encode()) % 31 and zlib.crc32(f"{k}:{long[1:]}".encode()) % 31]
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(spark.createDataFrame([(k, long) for k in ids[:20]] + [(k, long[1:]) for k in ids[:2]], "doc_id long, text string")).collect()}
    assert got == {(long, None, long, 20, 1, None), (long[1:], long, long, 2, 1, 20)}


def test_empty_tables(spark):
    assert shown(spark, []) == set() and shown(spark, [(1, "once upon"), (None, None)]) == set()


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.op12_spelling(spark, sf_dir).collect()}
    assert got == plain(data)
