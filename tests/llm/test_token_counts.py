import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import token_counts as tc

PATH = public_tokenizers.path(tc.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(library):
    pick = random.Random(7)
    letters = "aaaaabcdeéèüßΣσς İıſK<|>' \t\n \u0085\x1c\x1f1²½٣日本語😀👍🏽é‍.,!?$"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randrange(60))) for _ in range(3000)]
    texts += ["", " ", "a" * 5000, "abab" * 700, "don't we'll I'M they'RE", "<|endoftext|>", "x<|endoftext|>y <|startoftext|><|endoftext|>", "<|EndOfText|>", "ΑΣ ΟΔΟΣ"]
    texts += [chr(c) * k for c in range(0x20, 0x3000, 7) for k in (1, 3)]
    assert tc.counter(PATH)(texts) == want(library, texts)


def test_long_unbroken_words(library):
    pick = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(pick.choice(some) for _ in range(n)) for n in (126, 127, 128, 129, 300, 5000) for some in (letters, "ab", "a", letters + "é日")]
    texts.append("".join(pick.choice(letters + letters.upper()) for _ in range(200_000)))
    began = time.monotonic()
    got = tc.counter(PATH)(texts)
    assert time.monotonic() - began < 30
    assert got == want(library, texts)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 3)
    monkeypatch.setattr(tc, "AT_ONCE", 40)
    texts = ["the quick brown fox", "jumped over the lazy dog", "the quick brown fox"]
    count = tc.counter(PATH)
    assert [count([t])[0] for t in texts] == want(library, texts)


def test_rows(spark, library):
    rows = [(1, "Hello wörld", "a"), (None, "x y", "b"), (3, None, "c"), (1, "Hello wörld", "a"), (4, "", None), (5, "long " * 60000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in tc.token_counts(df, PATH).collect())
    assert got == sorted((i or 0, len((t or "").encode()), want(library, [t or ""])[0]) for i, t, _ in rows)
    assert tc.token_counts(df.limit(0), PATH).count() == 0
