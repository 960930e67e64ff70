"""Hard negatives and whitening against brute force, and their edge cases."""

import math
from fractions import Fraction

import numpy as np
import pytest

from sensorloom.llm import hard_negatives as hn
from sensorloom.llm import whitening as wh

SCHEMA = "vec_id bigint, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")
ODD = [(100, [1.0, NAN], 1), (200, None, 1), (300, [1.0, None], 1), (400, [1.0, INF], 1), (500, [1.0, 2.0], None), (None, None, None)]


def table(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "vector", "n", "component", "score", "file", "row", "_place", "rank"):  # clashing names
        df = df.withColumn(name, F.lit("x"))
    return df


def brute_negatives(rows):
    own = [(i, [math.floor(256 * float(np.float32(x))) for x in v], (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in rows if v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(own):
        if i is None or i % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), j is None, j or 0, z == y, b != a) for b, (j, w, z) in enumerate(own))
        for s, none, j, *_ in [x for x in scored if x[3] and x[4]][:5]:
            near = [x for x in scored if not x[3] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(i, None if none else j, r + 1, None if x[1] else x[2], -s, -x[0]) for r, x in enumerate(near)]
    return sorted(out, key=str)


def random_rows(seed, n, d, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in rng.normal(0.2, spread, d).astype(np.float32)], int(rng.integers(0, 3))) for i in rng.integers(0, 900, n)]


@pytest.mark.parametrize("seed,d,spread", [(1, 2, 1.0), (2, 19, 1.0), (3, 5, 3e5), (4, 3, 0.01)])
def test_hard_negatives_are_brute_forces(spark, monkeypatch, seed, d, spread):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 37)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 3)
    monkeypatch.setattr(hn, "HELD", 2)
    rows = random_rows(seed, 400, d, spread) + [(100 * i, [0.5] * d, i % 3) for i in range(5)]
    rows += rows[:40] + [(None, [0.4] * d, 1), (None, [0.4] * d, 2), (700, [0.0] * d, 1)]
    got = [tuple(r) for r in hn.hard_negatives(table(spark, rows + (ODD if d == 2 else []))).collect()]
    assert len(got) > 50
    assert sorted(got, key=str) == brute_negatives(rows)


def test_scan_drops_candidates_before_the_last_column():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 100, (64, 3000)) * (0.9 ** np.arange(64))[:, None])
    block, read = {"x": x, "low": x.min(1), "high": x.max(1)}, []
    anchor, k = x[:, 7].copy(), 5
    original = hn.best
    try:
        hn.best = lambda k, s: read.append(len(s)) or original(k, s)
        at, score = hn.scan(anchor, block, np.ones(3000, bool), [(None, None, None)], k)
    finally:
        hn.best = original
    want = np.sort(anchor @ x)[::-1][:k]
    assert (np.sort(score)[::-1][:k] == want).all() and read[-1] < 300 < read[0]


def test_hard_negatives_edges(spark):
    assert hn.hard_negatives(table(spark, ODD)).count() == 0
    assert hn.hard_negatives(table(spark, ODD).limit(0)).count() == 0
    lonely = [(100, [1.0, 1.0], 1), (3, [], 1), (5, [1.0], 2), (6, [0.5, 0.5], 2)]
    assert hn.hard_negatives(table(spark, lonely)).count() == 0
    few = [(100, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (6, [0.5, 0.5], 2)]
    assert [tuple(r) for r in hn.hard_negatives(table(spark, few)).collect()] == [(100, 1, 1, 6, 2 * 256 * 256, 256 * 256)]


def characteristic(a):
    """By the trace recurrence, in fractions."""
    d, m, c = len(a), np.array([[Fraction(0)] * len(a)] * len(a), object), [Fraction(1)]
    eye = np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], object)
    for k in range(1, d + 1):
        m = a.dot(m) + c[-1] * eye
        c.append(-sum((a.dot(m))[i, i] for i in range(d)) / k)
    return [int(x) for x in c[::-1]]


def test_characteristic_polynomial_is_exact(spark):
    for seed, d, rank in ((1, 1, 1), (2, 7, 7), (3, 8, 4)):
        b = np.random.default_rng(seed).integers(-(10**6), 10**6, (d, rank)).astype(object)
        a = b.dot(b.T)
        poly = wh.characteristic_polynomial(spark, a, together=3)
        assert poly == characteristic(a)
        assert next(i for i, x in enumerate(poly) if x) == d - rank


def test_roots_of_a_known_polynomial():
    roots = [1, 4, 4, 4, 10**9, 10**9 + 1]
    poly = [1]
    for r in roots:
        poly = [(poly[i - 1] if i else 0) - r * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    got = [wh.root(poly, k, 3 * 10**9) for k in range(1, 7)]
    for (m, bits), want in zip(got, sorted(roots, reverse=True), strict=True):
        assert m < want << bits <= m + 1 and m.bit_length() >= wh.ROOT_BITS
    assert [wh.roots_above(poly, x, 0) for x in (0, 1, 3, 4, 10**9)] == [6, 5, 5, 2, 1]


def check_whitened(got, x, most=32):
    """Rows of one result against dense matrices."""
    n, d = x.shape
    k = min(most, d)
    y = (x - 1_000_000).astype(object)
    s = y.sum(0)
    exact = sorted(sum(int(v) ** 2 for v in n * row - s) for row in y)
    assert {r.deviation for r in got} == {x if x < 1 << 63 else None for x in exact} and len(got) == n * k
    values, vectors = np.linalg.eigh(np.cov(y.astype(float).T, bias=True).reshape(d, d))
    want = ((y - s / n).astype(float) @ vectors[:, ::-1] / np.sqrt(values[::-1]))[:, :k]
    mine = np.array([[r.whitened for r in got if r.component == c] for c in range(1, k + 1)]).T
    assert np.allclose(np.sort(np.abs(mine), axis=0), np.sort(np.abs(want), axis=0), atol=1e-6)
    assert np.allclose([next(r.explained for r in got if r.component == c) for c in range(1, k + 1)], values[::-1][:k] / values.sum(), rtol=1e-9)
    assert max(r.identity_error for r in got) < 1e-9 and {r.n for r in got} == {n}


@pytest.mark.parametrize("seed,d,spread", [(1, 1, 1.0), (2, 5, 1.0), (3, 40, 0.5), (4, 4, 1e5)])
def test_whitening_is_the_dense_one(spark, seed, d, spread):
    rows = random_rows(seed, 120, d, spread)
    rows += rows[:7]
    x = np.array([[math.floor(64 * float(np.float32(v))) + 1_000_000 for v in r[1]] for r in rows])
    got = wh.whiten(table(spark, rows + (ODD if d == 5 else [])).repartition(3)).collect()
    check_whitened(got, x)


def test_whitening_edges(spark):
    assert wh.whiten(table(spark, ODD)).where("vec_id <> 500").count() == 0
    assert wh.whiten(table(spark, ODD).limit(0)).count() == 0
    assert wh.whiten(table(spark, [(1, [], 1), (2, [], 1)])).count() == 0
    one = wh.whiten(table(spark, [(7, [0.5, 0.25], 1)])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(7, c, 1, 0, None, None, None) for c in (1, 2)]
    flat = wh.whiten(table(spark, [(i, [float(i), 2.0 * i, 1.0], 1) for i in range(5)] + [(9, [1.0], 1)])).collect()
    assert len(flat) == 15 and all((r.whitened is None) == (r.component > 1) for r in flat)
    assert {round(r.explained, 9) for r in flat} == {1.0, 0.0}
    # two equal eigenvalues: any orthonormal pair will do
    square = wh.whiten(table(spark, [(1, [1.0, 0.0], 1), (2, [-1.0, 0.0], 1), (3, [0.0, 1.0], 1), (None, [0.0, -1.0], 1)])).collect()
    assert all(abs(r.explained - 0.5) < 1e-12 and r.identity_error < 1e-9 for r in square)
    far = wh.whiten(table(spark, [(1, [3e38, 0.0], 1), (2, [1.0, 5.0], 1)])).collect()
    assert all(r.deviation is None for r in far)
