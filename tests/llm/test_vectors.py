import math

import numpy as np

from quire.llm import vectors as module
from quire.llm.vectors import near_vectors
from tests.llm.helpers import roots


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def check(spark, rows, threshold=0.98):
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(docs, threshold).collect())
    pairs = []
    for x, (i, v, k) in enumerate(rows):
        for y, (j, w, m) in enumerate(rows):
            if x != y and k is not None and k == m and good(v) and good(w) and len(v) == len(w):
                a, b = np.array(v), np.array(w)
                a, b = a / abs(a).max(), b / abs(b).max()
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    pairs.append((x, y))
    label = roots(range(len(rows)), pairs)
    low = {}
    for x, (i, _, _) in enumerate(rows):
        low[label[x]] = min(low.get(label[x], i), i)
    want = sorted((i, sum(p[0] == x for p in pairs), low[label[x]], i == low[label[x]]) for x, (i, _, _) in enumerate(rows))
    assert got == want


def test_links(spark, monkeypatch):
    monkeypatch.setattr(module, "TILE", 16)
    monkeypatch.setattr(module, "BAND_BYTES", 40 * 24 * 8)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 24))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(base)]
    for i in range(200):
        k = int(rng.integers(60))
        rows.append((100 + i, (base[k] + rng.normal(size=24) * rng.choice([0, 0.05, 0.19, 0.21])).tolist(), k % 3))
    rows += [(400 + i, (base[7] * (i + 1)).tolist(), 1) for i in range(50)] + [(500 + i, base[7].tolist(), 1) for i in range(90)]
    check(spark, rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, nan], 1), (5, [1.0, inf], 1), (6, [1.0, None], 1), (7, [1.0, 2.0], None),
            (8, [1.0, 2.0], 1), (9, [1e200, 2e200], 1), (10, [1e-300, 2e-300], 1), (11, [1.0, 2.0, 0.0], 1), (12, [1.0, 2.0], 2), (8, [1.0, 2.0], 1), (13, [-1.0, -2.0], 1)]
    check(spark, rows)
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
