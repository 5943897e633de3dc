import hashlib
import random
import re

import pytest

from tallyspark.llm import secrets
from tests.oracle import compare

SCHEMA = "doc_id long, text string, spans string"
BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 0, 20),
    "hex": ("[0-9a-f]+", 0, 0, 24),
}


def plain(text):
    found = []
    for rank, (kind, (pattern, flags, group, least)) in enumerate(BASE.items()):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "", flags) if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def texts():
    pick = random.Random(4)
    parts = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "AKIA", "AKIAAKIA", "ABCDEFGHIJ0123456789", "deadbeef" * 4, "0a" * 11, "=", ":", ' "', "'", "  ", "\n", "é", "😀", "abc-_/", "tokens", "ſecret", "ghp_" + "a1" * 18, "xoxb-0123456789", "-----BEGIN RSA PRIVATE KEY-----"]
    out = ["".join(pick.choice(parts) for _ in range(pick.randrange(1, 14))) for _ in range(400)]
    return out + ["", None, "token=token:abcdefgh", "token=secret=abcdefgh", "x" * 300000 + "token: abcdef" + "0" * 30]


def test_base_spans_match_plain_search(spark):
    data = [(k if k % 9 else None, t, "clash") for k, t in enumerate(texts(), 1)]
    data += [data[0], (1, "password=abcdefg", "x")]
    got = secrets.scan(spark.createDataFrame(data, SCHEMA)).collect()
    kinds = [r.kind for r in secrets.RULES]
    have = sorted((r.text or "", ",".join(f"{kinds[s['rank']]}:{s['start']}:{s['stop']}" for s in r.spans if s["rank"] < 3)) for r in got)
    assert have == sorted((t or "", plain(t)) for _, t, _ in data)
    assert secrets.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_full_index_holds_every_trigram(spark):
    rows = spark.createDataFrame([(1, "ABCde", ""), (2, "ab", ""), (3, None, ""), (4, "a\nbé😀", "")], SCHEMA)
    got = {(r.doc_id, r.trigram) for r in secrets.postings(rows).collect()}
    assert got == {(1, "abc"), (1, "bcd"), (1, "cde"), (4, "a\nb"), (4, "\nbé"), (4, "bé😀")}
    assert {(r.doc_id, r.trigram) for r in secrets.postings(rows, ["bcd", "zzz"]).collect()} == {(1, "bcd")}


@pytest.mark.parametrize("pattern, match", [("ab?cde", "acde"), ("(foo|ba[rz]x)+y", "fooy"), ("[a-z]+", "q"), ("x{3}yz", "xxxyz"), ("(abc)*d", "d"), ("abc|", ""), ("a.cdef", "aXcdef")])
def test_queries_are_mandatory(pattern, match):
    assert re.fullmatch(pattern, match)
    assert any(all(t in match for t in clause) for clause in secrets.trigram_query(pattern))


def test_oracle(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows, off = compare(spark, secrets.QUERIES["op2_secrets"], secrets.ORACLES["op2_secrets"], sf_dir)
    assert rows == 1000 and not off
    found = secrets.QUERIES["op2_secrets"](spark, sf_dir).collect()
    assert hashlib.sha256(b"").hexdigest() in {r.base_sha256 for r in found}
    assert all(r.spans.count(f"{k}:") == r[f"n_{k}"] for r in found for k in ("assign", "access", "hex")) and sum(r.n_assign for r in found)
