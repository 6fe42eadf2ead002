"""Whitening against exact fractions and against numpy on small tables."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from cohortry.llm import whitening as W


def test_grams_of_limbs_are_exact():
    rng = random.Random(1)
    for low, high, n in ((0, 10, 5), (-(1 << 20), 1 << 21, 3_000), (-(1 << 62), 1 << 62, 400), (W.LONG.min, W.LONG.max, 9)):
        rows = [[rng.randint(low, high) for _ in range(4)] for _ in range(n)]
        want = [[sum(r[i] * r[j] for r in rows) for j in range(4)] for i in range(4)]
        assert W.exact_gram(np.array(rows, np.int64)).tolist() == want
    for number in (0, 1, -1, 1 << 150, -(1 << 150) + 12345, (1 << 160) - 1):
        assert W.number_of(W.digits_of(number)) == number


def test_integers_of_any_finite_value():
    values = np.array([0.0, -0.001, 0.015625, 1e17, -1e17, 1e30, -1e300, 1.7e308, 2.0**56, 2.0**57, -(2.0**57)])
    want = [min(W.LONG.max, max(W.LONG.min, math.floor(Fraction(v) * 64) + 1_000_000)) for v in values.tolist()]
    assert W.as_integers(values.reshape(-1, 1)).ravel().tolist() == want


def test_small_eigenvalues_keep_their_digits():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    q = q.astype(np.longdouble)
    for _ in range(4):
        q = q @ (1.5 * np.eye(12) - 0.5 * (q.T @ q))
    want = 10.0 ** np.arange(12, 0, -1).astype(np.longdouble)
    values, vectors = W.eigen((q * want) @ q.T)
    assert np.allclose(values, want.astype(float), rtol=1e-5) and np.allclose(vectors.T @ vectors, np.eye(12), atol=1e-12)


def literal(rows):
    """The contract with exact fractions up to the eigenvectors."""
    x = [(k, [math.floor(Fraction(c) * 64) + 1_000_000 for c in v]) for k, v in rows]
    n, width = len(x), len(x[0][1])
    sums = [sum(v[d] for _, v in x) for d in range(width)]
    away = [[n * v[d] - sums[d] for d in range(width)] for _, v in x]
    cov = np.array([[float(Fraction(sum(a[i] * a[j] for a in away), n**3)) for j in range(width)] for i in range(width)])
    values = np.linalg.eigvalsh(cov)[::-1]
    return [sum(c * c for c in a) for a in away], np.array(away, float) / n, values, np.trace(cov)


def test_whitening_equals_a_literal_reading(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 6)) @ np.diag([30, 10, 5, 2, 1, 0.5]) @ rng.normal(size=(6, 6))
    good = [(int(k) if k % 50 else None, [float(np.float32(c)) for c in v]) for k, v in enumerate(base)]
    good += good[:5]
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (902, [float("nan")] * 6), (903, [1.0, 2.0, float("inf"), 0.0, 0.0, 0.0]), (904, []), (905, [1.0, 2.0])]
    table = spark.createDataFrame([(k, v, "clash", "clash") for k, v in good + bad], "vec_id long, embedding array<float>, ident string, `values` string").repartition(7)
    got = W.whitened(table, components=4).collect()
    away, centred, values, trace = literal(good)
    assert len(got) == 4 * len(good) and {r.n for r in got} == {len(good)}
    assert sorted(r.deviation for r in got if r.component == 2) == sorted(away) and all(str(r.deviation) == r.deviation_text for r in got)
    for k in range(1, 5):
        assert {r.explained for r in got if r.component == k}.pop() == pytest.approx(values[k - 1] / trace, rel=1e-9)
    # Squares of whitened values don't depend on signs: each row's sum is its Mahalanobis distance within the components.
    _, vectors = np.linalg.eigh(centred.T @ centred / len(centred))
    want = centred @ vectors[:, ::-1][:, :4] / np.sqrt(values[:4])
    for k in range(4):
        mine = np.array(sorted(r.whitened for r in got if r.component == k + 1))
        theirs = np.sort(want[:, k])
        assert np.allclose(mine, theirs, atol=1e-6) or np.allclose(mine, np.sort(-want[:, k]), atol=1e-6)
    assert max(r.identity_error for r in got) < 1e-9


def test_flat_tables_and_no_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert W.whitened(spark.createDataFrame([(1, None)], schema)).count() == 0 and W.whitened(spark.createDataFrame([], schema)).count() == 0
    one = W.whitened(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], schema)).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in one)
    flat = W.whitened(spark.createDataFrame([(1, [0.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert sorted((r.component, r.whitened, r.explained) for r in flat if r.component == 1) == [(1, -1.0, 1.0), (1, 1.0, 1.0)]
    assert all(r.whitened is None and r.explained == 0 for r in flat if r.component == 2)


def test_deviations_beyond_a_long(spark):
    rows = [(1, [1e16, 0.0]), (2, [-1e16, 1.0]), (3, [5.0, 2.0])]
    got = W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("component = 1").collect()
    away, *_ = literal(rows)
    assert sorted(int(r.deviation_text) for r in got) == sorted(away) and all(r.deviation is None or r.deviation == int(r.deviation_text) for r in got)
    assert any(r.deviation is None for r in got)
