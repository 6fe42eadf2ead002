"""Nulls of enrichment against plain loops: draws, step curves on a grid, missing classes."""

import hashlib

from pyspark.sql import functions as F

from cohortry.operators import bands as B


def test_draws_are_seeded_and_nested(spark):
    terms = spark.createDataFrame([(i, float(i % 7)) for i in range(60)], "term long, score double")
    got = B.null_targets(terms.repartition(5), "term", [5, 20], 3).collect()
    assert len(got) == 60 * 3 * 2
    for seed in (1, 2, 3):
        order = sorted(range(60), key=lambda i: (hashlib.md5(f"{i}-{seed}".encode()).hexdigest(), i))
        for n in (5, 20):
            assert {r.term for r in got if r.seed == seed and r.n_true == n and r.drawn} == set(order[:n])


def test_places_of_repeated_rows_differ(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (None, 1), (1, 2)], "id long, seed int")
    got = [(r.seed, r.place) for r in B.seeded_places(rows, "id", "seed").collect()]
    assert sorted(got) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1)]


def test_curves_on_a_grid(spark):
    data = [(g, (i * 37 + g * 11) % 23 / 4, (i * 13 + g) % 5 < 2) for g in range(4) for i in range(50 + g)] + [(9, 1.0, True), (0, None, True)]
    rows = spark.createDataFrame(data, "g int, score double, hit boolean")
    got = {(r.g, r.at): r.rate for r in B.on_grid(B.roc_steps(rows, "score", F.col("hit"), ["g"]), ["g"], 8).collect()}
    want = {}
    for g in range(4):
        own = [(s, h) for k, s, h in data if k == g and s is not None]
        pos, neg = sum(h for _, h in own), sum(not h for _, h in own)
        for at in range(9):
            points = [(sum(h for s, h in own if s >= t) / pos, sum(not h for s, h in own if s >= t)) for t in {s for s, _ in own}]
            want[g, at] = max([tpr for tpr, alarms in points if alarms * 8 <= at * neg], default=0.0)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_empty(spark):
    terms = spark.createDataFrame([], "term long, score double")
    steps = B.roc_steps(B.null_targets(terms, "term", [5], 2), "score", F.col("drawn"), ["n_true", "seed"])
    assert B.on_grid(steps, ["n_true", "seed"], 4).count() == 0


def test_rows_of_seeds_are_not_broadcast(spark, tmp_path):
    spark.range(20_000).select(F.col("id").alias("term"), (F.col("id") % 9).cast("double").alias("score")).write.parquet(f"{tmp_path}/terms")
    drawn = B.null_targets(spark.read.parquet(f"{tmp_path}/terms"), "term", [10], 20)
    assert "Broadcast" not in drawn._jdf.queryExecution().executedPlan().toString()
