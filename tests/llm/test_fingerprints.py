import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, likeness string, _text string"


def text(pick, size):
    return "".join(pick.choice(["a", "b ", "cd. ", "\n", "é", "😀 ", "word ", "other ", "x" * 40 + " ", "!"]) for _ in range(size))


def plain_likeness(a, b):
    one, two = Counter(fp.paragraphs(a)), Counter(fp.paragraphs(b))
    shared = sum(len(p) * min(n, two[p]) for p, n in one.items())
    return 2 * shared / (len(a) + len(b)) if a or b else 1.0


def rows():
    pick = random.Random(5)
    out = [(3 * k, text(pick, pick.choice([0, 1, 3, 10, 60, 400]))) for k in range(120)]
    out += [(500, ""), (501, None), (502, "x" * 300_000), (503, "one line. " * 20_000), (504, text(pick, 60_000)), (505, "\n" * 1000), (506, "tail")]
    return out


def test_paragraphs_join_to_the_text_and_edits_stay_local():
    pick = random.Random(1)
    for _, t in rows():
        assert "".join(fp.paragraphs(t or "")) == (t or "")
    long = " ".join(pick.choice("abcdefgh") * pick.randrange(1, 9) for _ in range(4000))
    edited = long[:9000] + "zzz" + long[9003:]
    lost = Counter(fp.paragraphs(long)) - Counter(fp.paragraphs(edited))
    assert 1 <= sum(lost.values()) <= 3 and len(fp.paragraphs(long)) > 100


@pytest.mark.parametrize("a, b", [(0, 0), (0, 3), (1, 1), (5, 4), (300, 2), (40, 5000)])
def test_peeling_gives_what_differs(a, b):
    pick = random.Random(a + b)
    common = [f"c{k}.\n" for k in range(50)] + ["twice.\n"] * 2
    left = common + [f"l{pick.getrandbits(60)}.\n" for _ in range(a)] + ["twice.\n"]
    right = common + [f"r{pick.getrandbits(60)}.\n" for _ in range(b)]
    digests = fp.Digests(["".join(left), "".join(right)])
    pair, key, size, sign, cells = fp.differences(digests, np.array([0]), np.array([1]))
    assert (sign == 1).sum() == a + 1 and (sign == -1).sum() == b and len(set(key.tolist())) == a + b + 1
    assert size[sign == 1].sum() == sum(map(len, left)) - sum(map(len, common)) and size[sign == -1].sum() == sum(map(len, right)) - sum(map(len, common))
    assert cells[0] >= fp.CELLS and (cells[0] == fp.CELLS or a + b > 2) and (cells[0] > fp.CELLS or a + b < 12)


def plain_versions(data):
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0))
    for k, (i, t) in enumerate(order):
        t, then = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + then[: len(t) // 2]
        yield i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(plain_likeness(t, edited), 9), round(plain_likeness(t, then), 9)


def test_versions_match_plain_search(spark):
    data = rows()
    random.Random(2).shuffle(data)
    got = fp.versions(spark.createDataFrame([(*r, "clash", "clash") for r in data], SCHEMA).repartition(5)).collect()
    want = list(plain_versions(data))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)
    prints = {}
    for r in got:
        prints.setdefault(r.fingerprint, set()).add(dict(data)[r.doc_id] or "")
    assert all(len(x) == 1 for x in prints.values()) and len(prints) == len({t or "" for _, t in data})
    texts = {i: t or "" for i, t in data}
    order = sorted(texts)
    edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[order[(k + 1) % len(order)]][: len(texts[i]) // 2] for k, i in enumerate(order)]
    assert dict(zip(order, fp.fingerprint_texts(edited), strict=True)) == {r.doc_id: r.edited_fingerprint for r in got}


def test_ties_null_ids_few_rows_and_empty_tables(spark):
    def shown(data):
        return sorted(((r.doc_id, r.n_chars, r.near_next) for r in fp.versions(spark.createDataFrame([(*r, "", "") for r in data], SCHEMA)).collect()), key=repr)

    assert shown([]) == []
    assert shown([(1, "abc.")]) == [(1, 4, 1.0)]
    assert shown([(None, None)]) == [(None, 0, 1.0)]
    assert shown([(7, "same.")] * 40 + [(8, "end")]) == sorted([(7, 5, 1.0)] * 39 + [(7, 5, 0.0), (8, 3, 0.0)], key=repr)
    assert shown([(None, "a."), (2, "a."), (3, "b.")]) == sorted([(None, 2, 1.0), (2, 2, 0.0), (3, 2, 0.0)], key=repr)


def test_compare_lists_what_differs(spark):
    pairs = spark.createDataFrame([(1, "a.\nb.\nc.\n", "a.\nx.\nc.\n", "kept"), (2, None, "", "kept"), (3, "q.\nq.\n", "q.\n", "kept")], "id long, was string, now string, cells string")
    got = {r.id: r for r in fp.compare(pairs, "was", "now").collect()}
    assert got[1].likeness == pytest.approx(2 / 3) and len(got[1].removed) == len(got[1].added) == 1 and got[1].was == "a.\nb.\nc.\n"
    assert (got[2].likeness, got[2].removed, got[2].added) == (1.0, [], [])
    assert got[3].likeness == pytest.approx(2 / 3) and len(got[3].removed) == 1 and got[3].added == []
    assert fp.compare(pairs.limit(0), "was", "now").count() == 0


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = fp.op11_fingerprints(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(plain_versions(data))
    prints = {r.doc_id: r.fingerprint for r in fp.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert prints == {r.doc_id: r.fingerprint for r in got}
