import numpy as np

from tallyspark.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, n_links string"


def brute(rows):
    ids, links, label = [r[0] for r in rows], [], list(range(len(rows)))
    good = [k for k, r in enumerate(rows) if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    by = {}
    for d in {len(rows[k][1]) for k in good}:
        own = [k for k in good if len(rows[k][1]) == d]
        x = np.array([rows[k][1] for k in own], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= 0.95
        for a, k in enumerate(own):
            by[k] = [own[b] for b in np.flatnonzero(near[a]) if own[b] != k]
    changed = True
    while changed:
        changed = False
        for k, others in by.items():
            low = min([label[k], *(label[o] for o in others)])
            if low < label[k]:
                label[k], changed = low, True
    out = []
    for k, i in enumerate(ids):
        own = [ids[j] for j in range(len(ids)) if label[j] == label[k] and ids[j] is not None]
        component = min(own, default=None) if k in by else i
        out.append((i, len(by.get(k, [])), component, i is not None and i == component))
    return sorted(out, key=repr)


def data(n, seed=1, dims=64):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(n, dims))
    rows = [base]
    for k in range(0, n, 5):
        d = draw.choice([0.05, 0.15, 0.25, 0.3])
        noise = draw.normal(size=(3, dims))
        rows.append(base[k] / np.linalg.norm(base[k]) + d * noise / np.linalg.norm(noise, axis=1, keepdims=True))
    return np.concatenate(rows).astype(np.float32)


def test_links_and_components(spark):
    rows = [(int(k), [float(v) for v in x], "clash") for k, x in enumerate(data(150))]
    rows += [(500 + k, rows[7][1], "copy") for k in range(40)] + [rows[3], (3, [float(2 * v) for v in rows[3][1]], "twice")]
    rows += [(900, None, ""), (901, [], ""), (902, [0.0] * 64, ""), (903, [float("nan")] * 64, ""), (904, [None] * 64, ""), (905, [float("inf")] + [1.0] * 63, "")]
    rows += [(None, rows[9][1], ""), (910, [1.0, 2.0, 3.0], ""), (911, [1.0, 2.0, 3.01], ""), (912, [1e30] * 64, ""), (913, [1e-30] * 64, "")]
    got = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_cell_is_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 20)
    draw = np.random.default_rng(2)
    centre = draw.normal(size=64)
    near = centre / np.linalg.norm(centre) + 0.01 * draw.normal(size=(120, 64))
    rows = [(int(k), [float(v) for v in x], "") for k, x in enumerate(near.astype(np.float32))]
    got = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_recall_at_the_least_cosine():
    """Pairs at cosine 0.95 exactly: how many share a cell and pass the count."""
    draw = np.random.default_rng(6)
    a = vectors.unit(draw.normal(size=(20000, 64)))
    side = draw.normal(size=a.shape)
    side = vectors.unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * side
    ways, offsets, counted = vectors.directions(64)
    cell = lambda x: np.floor(x @ ways / (vectors.CELL * vectors.spread(64)) + offsets).reshape(len(x), vectors.FAMILIES, vectors.DEPTH)
    met = (cell(a) == cell(b)).all(axis=2).any(axis=1)
    passed = (np.abs((a - b) @ counted) <= vectors.REACH * vectors.spread(64)).sum(axis=1) >= vectors.least_count()
    assert (met & passed).mean() > 0.985
