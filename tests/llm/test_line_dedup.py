import random

import pyarrow as pa
import pytest

from tallyspark.llm import line_dedup as ld

SCHEMA = "doc_id long, text string, words_removed string, hits string"


def word(pick):
    return "".join(pick.choice("abcdefghij") for _ in range(pick.randrange(2, 9)))


def prose(pick, n, line=None):
    out = []
    for k in range(n):
        out.append(word(pick) + ("\n" if line and k % line == line - 1 else " "))
    return "".join(out).rstrip()


@pytest.mark.parametrize("wrap", [None, 9])
def test_passages_go_but_for_the_first(spark, wrap):
    pick = random.Random(3)
    passages = [prose(pick, n, wrap) for n in (52, 60, 75, 120, 400)]
    rows, plain = [], {}
    for k in range(80):
        parts = [prose(pick, pick.randrange(5, 60), wrap) for _ in range(3)]
        if k % 2:
            parts.insert(pick.randrange(1, 3), passages[(k // 2) % 5])
        plain[k] = [p for p in parts if p not in passages]
        rows.append((k, "\n".join(parts), "x", "y"))
    got = {r.doc_id: r for r in ld.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    left = {p: sum(p in r.text for r in got.values()) for p in passages}
    assert all(n >= 1 for n in left.values())
    holders = {p: [k for k, t, *_ in rows if p in t] for p in passages}
    caught = 0
    for p, ks in holders.items():
        assert p in got[min(ks)].text
        caught += sum(got[k].words_removed >= 0.95 * len(p.split()) for k in ks if k != min(ks))
    assert caught >= 0.95 * sum(len(ks) - 1 for ks in holders.values())
    for k, parts in plain.items():
        kept = set(got[k].text.split())
        assert sum(w in kept for p in parts for w in p.split()) >= sum(len(p.split()) for p in parts) - 4
        if k % 2 == 0:
            assert got[k].text == rows[k][1] and got[k].words_removed == 0


def test_rows(spark):
    pick = random.Random(5)
    text = prose(pick, 200, 7)
    rows = [(4, text, "a", "b"), (2, text, "a", "b"), (2, text, "a", "b"), (None, None, "a", "b"), (5, "", None, None), (6, "one two", "a", "b"), (7, text + "\n" + text, "a", "b"), (9, "w " * 150000, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = ld.dedup(df)
    assert out.columns == ["doc_id", "text", "hits", "words_removed"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.text, r.words_removed))
    assert got[2] == [(text, 0)] * 2 and got[4] == [("", 200)] and got[None] == [(None, 0)] and got[5] == [("", 0)] and got[6] == [("one two", 0)]
    assert got[7] == [("", 400)] and got[9] == [(rows[-1][1], 0)]
    assert ld.dedup(df.limit(0)).count() == 0


def test_against_brute_force_on_word_sequences(spark):
    """Passages of 30 words and more that occur twice are found by comparing all word sequences; nearly all go whole, and no other word does."""
    pick = random.Random(12)
    passages = [prose(pick, pick.randrange(30, 90)) for _ in range(600)]
    rows = [(k, f"{prose(pick, 40)} {p} {prose(pick, 40)}", "", "") for k, p in enumerate(passages)]
    rows += [(1000 + k, f"{prose(pick, 23)}\n{p} {prose(pick, 30)}", "", "") for k, p in enumerate(passages)]
    seen: dict[tuple, int] = {}
    want = {}
    for k, text, *_ in rows:
        w = text.split()
        spans = [at for at in range(len(w) - 29) if tuple(w[at : at + 30]) in seen]
        want[k] = max(spans) + 30 - min(spans) if spans else 0
        for at in range(len(w) - 29):
            seen.setdefault(tuple(w[at : at + 30]), k)
    got = {r.doc_id: r for r in ld.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k].words_removed in (0, n) for k, n in want.items())
    repeated = [k for k, n in want.items() if n]
    assert len(repeated) == 600 and sum(got[k].words_removed == want[k] for k in repeated) > 0.99 * 600
    for k, text, *_ in rows:
        left, w = got[k].text.split(), text.split()
        assert len(left) == len(w) - got[k].words_removed and left[:20] == w[:20] and left[-20:] == w[-20:]


def clashing(batches):
    """The chunks' hashes, of which only five values are left."""
    for batch in ld._hashes(batches):
        yield batch.set_column(4, "chunk", pa.array(batch.column("chunk").to_numpy() % 5))


def test_bytes_decide_where_hashes_clash(spark):
    pick = random.Random(13)
    same = prose(pick, 60)
    rows = [(k, prose(pick, 80) if k % 3 else same, "", "") for k in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.text, r.words_removed) for r in ld.dedup(df, clashing).collect()}
    assert all(got[k] in ((rows[k][1], 0), ("", 60) if k in (3, 6) else None) for k in got)


def test_null_ids_and_rows_that_share_one(spark):
    pick = random.Random(14)
    one, other = prose(pick, 60), prose(pick, 60)
    rows = [(None, one, "", ""), (None, other, "", ""), (5, one, "", ""), (5, other, "", ""), (6, other + " " + one, "", ""), (7, None, "", "")]
    got = sorted((r.doc_id or 0, r.text, r.words_removed) for r in ld.dedup(spark.createDataFrame(rows, SCHEMA)).collect() if r.text is not None)
    assert got == sorted([(0, one, 0), (0, other, 0), (5, "", 60), (5, "", 60), (6, "", 120)])


def test_only_copies_go(spark):
    pick = random.Random(6)
    same, rows = prose(pick, 80), []
    for k in range(6):
        rows.append((k, prose(pick, 80) if k % 2 else same, "", ""))
    got = {r.doc_id: r.words_removed for r in ld.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: 0, 1: 0, 2: 80, 3: 0, 4: 80, 5: 0}


def test_spans_are_compared_and_grown():
    words = " ".join(f"w{k}" for k in range(60)).encode()
    at = words.index(b"w20")
    body, before, after = ld.around(words, at, words.index(b"w30") - 1)
    assert ld.without(b"new " + words, [(at + 4, body, before, after)]) == (b"new ", 60)
    assert ld.without(b"new " + words, [(at + 3, body, before, after)])[1] == 0
    assert ld.without(words[at:], [(0, body, before, b" other words")])[1] == 0
    assert len(ld.chunks(b"")[0]) == len(ld.chunks(b"x")[0]) == 0


def test_a_run_grows_over_any_gap_to_the_first_unequal_word(spark):
    pick = random.Random(8)
    long = lambda n: " ".join("".join(pick.choice("abcdefghij") for _ in range(pick.randrange(4, 13))) for _ in range(n))
    passages = [long(n) for n in (60, 80, 120) for _ in range(40)]
    rows = [(k, f"{long(40)} {p} {long(40)}", "", "") for k, p in enumerate(passages)]
    rows += [(1000 + k, f"{long(40)} {p} {long(40)}", "", "") for k, p in enumerate(passages)]
    # A stretch without chunks that is far longer than any context, and gaps of other white space.
    own = long(60)
    rows += [(k, f"{long(40)} {own} {'x ' * 3000}{long(40)}", "", "") for k in (2000, 2001)]
    rows += [(3000, f"{long(40)} {passages[99]} {long(40)}".replace(" ", "\t\r\n"), "", "")]
    got = {r.doc_id: r.words_removed for r in ld.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k] == 0 for k in range(len(passages)))
    whole = [got[1000 + k] == len(p.split()) for k, p in enumerate(passages)]
    assert all(n in (0, len(p.split())) for n, p in zip((got[1000 + k] for k in range(len(passages))), passages)) and sum(whole) == 120
    assert got[2001] == 3060 and got[3000] == 120
