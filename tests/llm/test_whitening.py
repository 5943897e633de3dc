import math

import numpy as np
import pytest

from tallyspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, at string"


def plain(rows, most=16):
    usable = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(most, int((values > 1e-10 * values[0]).sum()))
    out = {}
    for i, x in usable:
        row = np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)])
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for k in range(kept):
            out.setdefault((i, k + 1), []).append((n, deviation, row @ vectors[:, k] / math.sqrt(values[k]), values[k] / values.sum()))
    return out


def check(got, want, tolerance=1e-9):
    rows = {}
    for r in got:
        rows.setdefault((r.vec_id, r.component), []).append(r)
    assert {k: len(v) for k, v in rows.items()} == {k: len(v) for k, v in want.items()}
    signs = {}
    for (i, k), own in sorted(rows.items(), key=repr):
        for r, (n, deviation, whitened, explained) in zip(sorted(own, key=lambda r: r.deviation), sorted(want[i, k]), strict=True):
            assert (r.n, r.deviation) == (n, deviation) and abs(r.explained - explained) <= 1e-9 * explained and r.identity_error <= 1e-9
            sign = signs.setdefault(k, 1 if r.whitened * whitened >= 0 else -1)
            assert abs(r.whitened - sign * whitened) <= tolerance * max(1, abs(whitened)), (i, k)


def vectors(count, dims, decay, seed):
    pick = np.random.default_rng(seed)
    base = pick.standard_normal((count, dims)) * np.exp(-decay * np.arange(dims)) * 3 + pick.standard_normal(dims)
    return [(k, [float(np.float32(c)) for c in row]) for k, row in enumerate(base @ np.linalg.qr(pick.standard_normal((dims, dims)))[0])]


@pytest.mark.parametrize("dims, decay", [(48, 0.45), (40, 0.0), (5, 0.1)])
def test_components_match_plain_eigenvectors(spark, dims, decay):
    rows = vectors(300, dims, decay, dims)
    rows += rows[:40] + [(900 + k, rows[7][1]) for k in range(100)] + [(1000, None), (1001, [None] * dims), (1002, [math.nan] + [0.0] * (dims - 1)), (1003, [math.inf] * dims), (1004, [1.0]), (1005, []), (None, [0.5] * dims)]
    kept = [r for r in rows if r[1] is None or len(r[1]) == dims]
    got = whitening.whiten(spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)).collect()
    check(got, plain(kept), 1e-7)


def test_range_finder_is_accepted_on_falling_spectra_and_widened_on_flat_ones(spark):
    fits = []
    few = [(k, [1000.0 * c for c in v[:16]] + v[:16] + v[:16]) for k, v in vectors(400, 16, 0.1, 1)]
    for rows in (few, vectors(400, 48, 0.0, 1)):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        fits.append(whitening.fit_whitening(df.select(whitening.whole_numbers("embedding").alias("x")).distinct()))
    assert fits[0].directions == 26 and fits[0].passes <= whitening.PASSES
    assert fits[1].directions == 48 and fits[1].passes == whitening.PASSES + 1


def test_little_or_no_variation(spark):
    def shown(rows):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()

    assert shown([]) == shown([(1, None)]) == shown([(1, [])]) == shown([(1, [1.0, 2.0])] * 3) == []
    got = shown([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0])])
    assert [(r.component, r.n, r.deviation) for r in got] == [(1, 2, 2 * 64 * 64)] * 3 and {round(abs(r.whitened), 9) for r in got} == {1.0}
    far = shown([(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 0.0])])
    assert [r.deviation for r in far if r.vec_id < 3] == [None, None] and [r.deviation for r in far if r.vec_id == 3] == [0]


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(whitening.op13_whitening(spark, sf_dir).collect(), plain(rows), 1e-6)
