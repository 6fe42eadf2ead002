"""Exact proportion tests, simulated nulls, adjusted p, divergence and affine transforms against plain readings."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import clustering, normative, proportions, relational, similarity, voxels


def plain_p(b, n, c, m, points=4001):
    """The supremum by enumeration of all tables on a fine grid, with binomial coefficients."""
    if n == 0 or m == 0 or b + c in (0, n + m):
        return 1.0

    def z(x, y):
        p = (x + y) / (n + m)
        return abs(x / n - y / m) / math.sqrt(p * (1 - p) * (1 / n + 1 / m)) if 0 < p < 1 else 0.0

    far = [(x, y) for x in range(n + 1) for y in range(m + 1) if z(x, y) >= z(b, c) - 1e-9]
    at = np.linspace(0, 1, points)
    return min(1.0, max(sum(math.comb(n, x) * math.comb(m, y) * at ** (x + y) * (1 - at) ** (n + m - x - y) for x, y in far)))


def test_exact_p_equals_enumeration():
    rng = random.Random(1)
    for _ in range(60):
        n, m = rng.randint(1, 12), rng.randint(1, 12)
        b, c = rng.randint(0, n), rng.randint(0, m)
        assert proportions.unconditional_p(b, n, c, m) == pytest.approx(plain_p(b, n, c, m), abs=2e-6), (b, n, c, m)
        assert proportions.unconditional_p(b, n, c, m) == pytest.approx(proportions.unconditional_p(c, m, b, n), abs=1e-9)
    assert proportions.unconditional_p(7, 15, 12, 16, cells=20) == pytest.approx(proportions.unconditional_p(7, 15, 12, 16), abs=1e-12)
    assert proportions.unconditional_p(30, 1000, 90, 1000) < 1e-6 and proportions.unconditional_p(0, 3, 0, 5) == 1.0


def test_exact_p_of_large_tables_needs_no_table_of_outcomes():
    before = time.process_time()
    found = proportions.unconditional_p(3_600, 7_200, 3_750, 7_203)
    assert found == pytest.approx(math.erfc(abs(3_600 / 7_200 - 3_750 / 7_203) / math.sqrt(0.51 * 0.49 * (1 / 7_200 + 1 / 7_203)) / math.sqrt(2)), rel=0.05)
    assert time.process_time() - before < 15


def test_tests_are_dealt_over_tasks_and_solved_once(spark):
    rows = [(k, 10 + k, 3, 20) for k in range(40)]
    got = proportions.with_exact_p(spark.createDataFrame(rows, "b int, n int, c int, m int"), "b", "n", "c", "m")
    solved = [f for f in got.inputFiles() if "/exact-" in f]
    assert len(solved) > 1 and got.count() == 40


def step_up(ps):
    order = sorted(range(len(ps)), key=lambda k: ps[k])
    out, low = [0.0] * len(ps), 1.0
    for rank in range(len(ps), 0, -1):
        low = min(low, ps[order[rank - 1]] * len(ps) / rank)
        out[order[rank - 1]] = low
    return out


def test_pairs_of_clusters_and_the_one_above_all(spark):
    counts = [("t", 1, 19, 20), ("t", 2, 2, 20), ("t", 3, 3, 20), ("u", 1, 0, 5), ("u", 2, 0, 9), ("w", 1, 4, 8), ("w", 2, 0, 0), ("x", 5, 1, 2)]
    pairs = proportions.pairwise_proportions(spark.createDataFrame(counts, "term string, cluster int, hits long, size long"), "term", "cluster", "hits", "size")
    rows = {(r.term, r.cluster_i, r.cluster_j): r for r in pairs.collect()}
    assert set(rows) == {("t", 2, 1), ("t", 3, 1), ("t", 3, 2), ("u", 2, 1), ("w", 2, 1)}
    for r in rows.values():
        assert r.p == pytest.approx(plain_p(r.hits_i, r.size_i, r.hits_j, r.size_j), abs=2e-6)
    assert rows["t", 2, 1].estimate == pytest.approx(-17 / 20) and rows["u", 2, 1].estimate == rows["w", 2, 1].estimate == 0
    own = [rows[k] for k in sorted(rows)]
    assert [r.q for r in own] == pytest.approx(step_up([r.p for r in own]))
    term = [r for r in own if r.term == "t"]
    assert [r.q_term for r in term] == pytest.approx(step_up([r.p for r in term]))
    assert [(r.term, r.winner) for r in proportions.beating_all_others(pairs, "term").collect()] == [("t", 1)]


def test_null_and_impossible_counts_have_no_p(spark):
    rows = spark.createDataFrame([(1, 2, None, 3), (5, 2, 1, 3), (-1, 2, 1, 3), (1, 2, 1, 3)], "b int, n int, c int, m int")
    assert sorted((r.p is None) for r in proportions.with_exact_p(rows, "b", "n", "c", "m").collect()) == [False, True, True, True]


@pytest.mark.parametrize("buckets", [2, 7, 256])
def test_adjusting_over_all_rows_by_ranges(spark, buckets):
    rng = random.Random(buckets)
    ps = [round(rng.random() ** 2, 2) for _ in range(300)]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(ps)] + [(-1, None)], "id int, p double")
    got = {r.id: r.q for r in relational.bh_over_all(rows, "p", "q", buckets).collect()}
    assert got.pop(-1) is None and [got[k] for k in range(300)] == pytest.approx(step_up(ps))


def test_simulated_tables_have_the_margins_and_the_right_p(spark):
    rows, columns = np.array([7, 4, 5]), np.array([6, 10])
    drawn = proportions.simulated_tables(rows, columns, "s", 500)
    assert (drawn.sum(axis=2) == rows).all() and (drawn.sum(axis=1) == columns).all() and (drawn >= 0).all()
    assert (drawn == proportions.simulated_tables(rows, columns, "s", 500)).all()
    labels = [(a, b) for a, b, n in (("p", "x", 8), ("p", "y", 2), ("q", "x", 3), ("q", "y", 9), (None, "y", 2)) for _ in range(n)]
    table = spark.createDataFrame(labels, "a string, b string")
    r = proportions.simulated_chi_squared(table, "a", "b", draws=4_000).collect()[0]
    exact = exact_p([10, 12, 2], [11, 13], [[8, 2], [3, 9], [0, 2]])
    assert abs(r.p - exact) < 3 * math.sqrt(exact * (1 - exact) / 4_000) + 1 / 4_000
    assert proportions.simulated_chi_squared(table.limit(0), "a", "b").collect()[0].chi2 is None


def exact_p(rows, columns, observed):
    """Over all tables of two columns with these margins, by the multivariate hypergeometric law."""
    n = sum(rows)

    def chi2(first):
        t = [(x, r - x) for x, r in zip(first, rows)]
        return sum((t[i][j] - rows[i] * columns[j] / n) ** 2 / (rows[i] * columns[j] / n) for i in range(len(rows)) for j in range(2))

    bar, total = chi2([r[0] for r in observed]) - 1e-9, 0.0
    for x in range(rows[0] + 1):
        for y in range(rows[1] + 1):
            z = columns[0] - x - y
            if 0 <= z <= rows[2] and chi2([x, y, z]) >= bar:
                total += math.comb(rows[0], x) * math.comb(rows[1], y) * math.comb(rows[2], z) / math.comb(n, columns[0])
    return total


def test_divergence_is_infinite_where_weight_has_none(spark):
    values = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (2, 0, 1.0), (2, 1, 0.0), (3, 0, 0.25), (3, 1, 0.75)], "k int, at int, value double")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "a int, b int")
    got = {(r.a, r.b): r.kl for r in similarity.pair_similarity(values, pairs, "k", "at", "value", ["kl"]).collect()}
    assert got[1, 2] == math.inf and got[2, 1] == pytest.approx(math.log(2)) and got[1, 3] == pytest.approx(0.5 * math.log(2) + 0.5 * math.log(2 / 3))


def test_affine_matrices_compose_and_invert(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(20):
        first, then = (np.vstack([rng.normal(size=(3, 4)), [0, 0, 0, 1]]) for _ in range(2))
        rows.append((*rng.normal(size=3).tolist(), first.ravel().tolist(), then.ravel().tolist()))
    table = spark.createDataFrame([*rows, (1.0, 2.0, 3.0, [0.0] * 15 + [1.0], [0.0] * 15 + [1.0])], "x double, y double, z double, a array<double>, b array<double>")
    table = table.withColumns({"m": voxels.composed(F.col("a"), F.col("b")), "back": voxels.inverted(F.col("a"))})
    for r in voxels.transformed(table, F.col("m")).collect():
        want = next((q for q in rows if q[3] == r.a), None)
        if want is None:
            assert r.back is None
            continue
        a, b = (np.array(v).reshape(4, 4) for v in (r.a, r.b))
        assert np.allclose([r.x, r.y, r.z, 1], b @ a @ [*want[:3], 1], atol=1e-9) and np.allclose(np.array(r.back).reshape(4, 4) @ a, np.eye(4), atol=1e-9)


def test_normative_z_does_not_move_with_the_mean(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(k % 2), float(rng.uniform(5, 20)), "FM"[k % 3 > 0], bool(k % 4), float(rng.normal())) for k in range(300)]
    table = spark.createDataFrame(rows, "id int, place int, age double, sex string, ctrl boolean, value double")
    near, far = ({r.id: r.z for r in normative.spline_z(t, "ctrl", "place", "age", "sex", ["F", "M"]).collect()} for t in (table, table.withColumn("value", F.col("value") + 1e8)))
    assert max(abs(near[k] - far[k]) for k in near) < 1e-6


def test_within_squares_fall_along_a_merge_tree(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 0.1, (6, 3)) for c in (0, 5, 20)]) + 1e6
    rows = spark.createDataFrame([(i, v, float(x[i, v])) for i in range(18) for v in range(3)], "image long, voxel int, value double")
    pairs = clustering.distances(rows).withColumn("analysis", F.lit(0).cast("long"))
    labels = clustering.hierarchical(pairs, [1, 2, 3, 18])
    got = {r.nk: (r.within, r.share) for r in clustering.within_squares(rows, labels).collect()}
    for nk in got:
        own = {r.image: r.k for r in labels.filter(F.col("nk") == nk).collect()}
        groups = [x[[i for i in own if own[i] == k]] for k in set(own.values())]
        assert got[nk][0] == pytest.approx(sum(((g - g.mean(axis=0)) ** 2).sum() for g in groups), abs=1e-6)
    assert got[1][1] == pytest.approx(1.0) and got[18][0] == pytest.approx(0, abs=1e-9) and got[3][1] < 0.01 < got[2][1] < 0.2
