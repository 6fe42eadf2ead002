"""Hand-computed small cases: ties, nulls, empty groups, degenerate values."""

import gzip
import hashlib
import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import clustering, effects, enrichment, hierarchy, registry, relational, resampling, similarity, stats, voxels
from cohortry.sources import files, volumes


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order or df.columns).collect()]


def images(spark, *rows):
    return spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(rows)], "image long, voxel int, value double")


def test_bh_is_monotone_and_capped(spark):
    df = spark.createDataFrame([("g", p) for p in (0.01, 0.04, 0.03, 0.005, 0.5)], "g string, p double")
    assert [round(q, 9) for _, _, q in values(relational.bh_adjusted(df, "p", ["g"]), "p")] == [0.025, 0.025, 0.05, 0.05, 0.5]


def test_top_keeps_ties_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, 5), (2, 4), (3, 4), (4, 1), (5, None)], "id int, v int")
    assert [r[0] for r in values(relational.top_with_ties(df, F.col("v"), 2), "id")] == [1, 2, 3]


def test_latest_nonempty_adds_missing_keys(spark):
    df = spark.createDataFrame([("a", 1, 3.0, None), ("a", 2, None, None), ("b", 1, None, None)], "k string, t int, x double, y double")
    assert values(relational.latest_nonempty(df, "k", "t", ["x", "y"]), "k") == [("a", 1, 3.0, None), ("b", None, None, None)]


def test_binned_is_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (3.0,)], "v double")
    assert [r[0] for r in values(df.select(relational.binned(F.col("v"), [0, 1, 2]).alias("b"), "v"), "v")] == [None, 0, 1, None]


def test_complete_columns(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    assert relational.complete_columns(df, ["a", "b"], 0.5) == ["a"]


def test_top_threshold_keeps_floor_of_candidates(spark):
    v = images(spark, 0, 1, -3, 2, 0.5)
    assert [r[2] for r in values(voxels.top_threshold(v, 0.5), "voxel")] == [0, 0, -3, 2, 0]
    assert [r[2] for r in values(voxels.top_threshold(v, -1, symmetric=False), "voxel")] == [0, 0, -3, 0, 0]
    assert [r[2] for r in values(voxels.top_threshold(images(spark, 0, 0), 0.5), "voxel")] == [0, 0]
    with pytest.raises(ValueError):
        voxels.top_threshold(v, 0)


def test_intensity_threshold_is_strict(spark):
    assert [r[2] for r in values(voxels.intensity_threshold(images(spark, 0.5, -0.6, 0.7)), "voxel")] == [0, -0.6, 0.7]
    assert [r[2] for r in values(voxels.intensity_threshold(images(spark, 0.5, -0.6, 0.7), symmetric=False), "voxel")] == [0, 0, 0.7]


def test_scatter_fills_zero(spark):
    grid = spark.createDataFrame([(1, 0), (1, 1)], "image long, voxel int")
    assert values(voxels.scattered(images(spark, 4.0), grid), "voxel") == [(1, 0, 4.0), (1, 1, 0.0)]


def test_similarity_of_constant_vectors_is_null(spark):
    v = spark.createDataFrame([(k, p, float(x)) for k, row in enumerate([(1, 2, 3), (2, 4, 6), (5, 5, 5)]) for p, x in enumerate(row)], "k int, at int, value double")
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a int, b int")
    got = {r.b: r for r in similarity.pair_similarity(v, pairs, "k", "at", "value", list(similarity.METRICS)).collect()}
    assert got[1].correlation == pytest.approx(1) and got[1].cosine == pytest.approx(1) and got[2].correlation is None
    assert got[1].euclidean == pytest.approx(14**0.5) and got[1].manhattan == pytest.approx(6**0.5)
    assert got[1].kl == pytest.approx(6 * np.log(0.5))


def test_signed_mean_ignores_unknown(spark):
    s = spark.createDataFrame([(1, 2, 1, 0.5), (1, 2, -1, float("nan")), (1, 3, 1, None)], "a int, b int, sign int, c double")
    assert values(similarity.over_signs(s, "c"), "b") == [(1, 2, 0.5), (1, 3, None)]


def test_permutation_keeps_the_label_multiset(spark):
    c = spark.createDataFrame([(i, 3, i % 3 if i < 9 else 7) for i in range(10)], "id int, nk int, k int")
    p = resampling.permuted_labels(c, spark.range(1, 4).select(F.col("id").alias("seed")), least=2)
    by = {}
    for r in p.collect():
        by.setdefault(r.seed, []).append(r.k)
    assert {s: sorted(k) for s, k in by.items()} == {s: [-1, 0, 0, 0, 1, 1, 1, 2, 2, 2] for s in (1, 2, 3)}
    assert len({tuple(x) for x in by.values()}) > 1


def test_empirical_p_counts_equal_values(spark):
    o = spark.createDataFrame([(2, 1.0), (2, 9.0)], "nk int, v double")
    n = spark.createDataFrame([(2, 1.0), (2, 0.5), (2, 2.0), (2, 0.1)], "nk int, v double")
    assert values(resampling.empirical_p(o, n, ["nk"], "v"), "v") == [(2, 1.0, 0.5), (2, 9.0, 0.0)]


def test_hypergeometric_matches_direct_sums(spark):
    from math import comb

    c = spark.createDataFrame([("t", "m", 3, 5, 6, 20), ("t", "z", 0, 4, 6, 20)], "target string, module string, hit long, size long, chosen long, total long")
    got = {r.module: r for r in enrichment.hypergeometric(c, enrichment.log_factorials(spark, 20), ["target", "module"]).collect()}
    assert got["m"].p == pytest.approx(sum(comb(5, k) * comb(15, 6 - k) for k in range(3, 6)) / comb(20, 6))
    assert got["m"].enrichment == pytest.approx(2.0) and got["z"].p == 1.0


def test_roc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 1, False), ("a", 2, True), ("b", 1, True)], "g string, s int, y boolean")
    assert [(r.g, r.auc) for r in enrichment.roc_area(df, "s", F.col("y"), ["g"]).orderBy("g").collect()] == [("a", 0.75), ("b", None)]


def test_hierarchy_with_two_parents(spark):
    t = spark.createDataFrame([("r", None), ("a", "r"), ("b", "r"), ("c", "a"), ("c", "b"), ("d", "c")], "node string, parent string")
    assert dict(values(hierarchy.levels(t))) == {"r": 0, "a": 1, "b": 1, "c": 2, "d": 3}
    cut = spark.createDataFrame([("c",), ("missing",)], "node string")
    assert {r[0] for r in values(hierarchy.pruned_below(t, cut))} == {"r", "a", "b", "c"}
    assert {r[0] for r in values(hierarchy.pruned_at(t, cut))} == {"r", "a", "b"}
    with pytest.raises(ValueError):
        hierarchy.closure(spark.createDataFrame([("x", "y"), ("y", "x")], "node string, parent string"), 5)


def test_matched_controls_fall_back(spark):
    p = spark.createDataFrame([(1, "x", "s", 10.0), (2, "y", "s", 10.0)], "id long, site string, sex string, age double")
    c = spark.createDataFrame([(11, "x", "s", 9.0), (12, "x", "s", 14.0), (13, "z", "s", 10.0), (14, "z", "t", 10.0)], "id long, site string, sex string, age double")
    got = values(effects.matched_controls(p, c, ["site", "sex"], [["sex"]], "age", 2, 1).select("patient", "control", "tier"))
    assert got == [(1, 11, 0), (1, 12, 0), (2, 11, 1), (2, 13, 1)]


def test_matched_controls_equal_all_pairs_and_meet_few(spark):
    rng = np.random.default_rng(4)
    ages = [None if k % 97 == 0 else float("nan") if k % 89 == 0 else float(rng.integers(0, 40)) for k in range(600)]
    p = [(k, ["x", "y", "z", None][k % 4], "s", ages[k]) for k in range(60)]
    c = [(1000 + k, "x" if k < 440 else "y" if k < 447 else "w", "s", ages[k]) for k in range(600)]
    kind = "id long, site string, sex string, age double"
    got = effects.matched_controls(spark.createDataFrame(p, kind), spark.createDataFrame(c, kind), ["site", "sex"], [["sex"]], "age", 9, 3)
    want = []
    for i, site, _, age in p:
        strict = [r for r in c if r[1] == site and site is not None]
        tier, near = (0, strict) if len(strict) >= 9 else (1, c)

        def place(r):
            gap = None if age is None or r[3] is None else abs(age - r[3])
            return gap is None, gap is not None and math.isnan(gap), gap if gap is not None and not math.isnan(gap) else 0, hashlib.md5(f"{i}-{r[0]}-3".encode()).hexdigest(), r[0]

        want += [(i, r[0], tier) for r in sorted(near, key=place)[:9]]
    assert values(got.select("patient", "control", "tier")) == sorted(want)
    even = [(k, "x", "s", float(k)) for k in range(4_000)]
    near = effects._near_ages(spark.createDataFrame(even, kind), spark.createDataFrame(even, kind), ["site", "sex"], 5)
    assert near.count() <= 4_000 * 6


def test_bridged_pairs_are_shuffled_as_lists(spark):
    rng = np.random.default_rng(6)
    rows = sorted({(int(b), int(k)) for b, k in zip(rng.integers(0, 30, 400), rng.integers(0, 25, 400))})
    members = spark.createDataFrame([*rows, (None, 3), (4, None)], "bridge_ long, key_ long")
    got = relational.bridged_pairs(members, "bridge_", "key_", 3)
    assert values(got.select("a", "b")) == sorted({(x, y) for p, x in rows for q, y in rows if p == q})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" not in plan and "hashpartitioning(i#" in plan


def test_normative_z_equals_least_squares(spark):
    rng = np.random.default_rng(0)
    x, s = rng.uniform(3, 20, 40), rng.integers(0, 2, 40)
    y = 2 * x + 3 * s + rng.normal(0, 1, 40)
    df = spark.createDataFrame([(k, 0, float(a), int(b), k < 30, float(c)) for k, (a, b, c) in enumerate(zip(x, s, y))], "id long, at long, x double, sex int, ctrl boolean, value double")
    got = {r.id: r.z for r in effects.normative_z(df, "ctrl", "at", "x", "sex").collect()}
    d = np.c_[np.ones(40), x, s]
    f = d[:30]
    inv = np.linalg.inv(f.T.dot(f))
    beta = inv.dot(f.T.dot(y[:30]))
    s2 = ((y[:30] - f.dot(beta)) ** 2).sum() / 27
    want = (y - d.dot(beta)) / np.sqrt(s2 * (1 + np.einsum("ij,jk,ik->i", d, inv, d)))
    assert np.allclose([got[k] for k in range(40)], want)


def test_effect_of_constant_controls_is_zero(spark):
    df = spark.createDataFrame([("s", "WT", 1, 2.0), ("s", "WT", 1, 2.0), ("s", "M", 1, 5.0)], "study string, genotype string, place int, value double")
    assert values(effects.effect_sizes(df, "WT", ["place"])) == [("s", "M", 1, 0.0)]


def test_adjusted_rand_of_itself(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (3, 3)], "a int, b int")
    assert stats.adjusted_rand(df, "a", "b").first().ari == pytest.approx(1)


def test_rank_sum_needs_two_classes(spark):
    df = spark.createDataFrame([("g", 1.0, 1), ("g", 2.0, 0), ("g", None, 1), ("h", 1.0, 1)], "g string, v double, c int")
    assert [(r.g, r.u) for r in stats.rank_sum(df, "v", F.col("c") == 1, ["g"]).orderBy("g").collect()] == [("g", 0.0), ("h", None)]


def test_spectral_finds_blocks():
    w = np.full((6, 6), 0.01)
    w[:3, :3] = w[3:, 3:] = 1
    labels = clustering.spectral_labels(w, 2)
    assert len(set(labels[:3])) == len(set(labels[3:])) == 1 and labels[0] != labels[5]
    assert np.allclose(clustering.fused([w, w], 3), clustering.fused([w, w], 3).T)


def test_registry_round_trip(spark):
    empty = spark.createDataFrame([], "id string, a string, b string")
    rows = spark.createDataFrame([("1", None), ("1", "x"), ("1", None)], "a string, b string")
    once = registry.upserted(empty, rows, ["a", "b"])
    assert once.count() == 2 and registry.upserted(once, rows, ["a", "b"]).count() == 2
    assert registry.fetch_id(once, a=1, b=None) and registry.fetch_id(once, a="2") is None
    with pytest.raises(LookupError):
        registry.fetch_id(once, a=1)


def test_file_sources(spark, tmp_path):
    (tmp_path / "sets.gmt").write_text("m1\tTitle\tg1\tg2\t\nm2\tOther\n")
    assert values(files.gene_sets(spark, str(tmp_path / "sets.gmt")).withColumn("genes", F.size("genes"))) == [("m1", "Title", 2), ("m2", "Other", 0)]
    (tmp_path / "tree.json").write_text(json.dumps({"id": 1, "name": "root", "children": [{"id": 2, "name": "a", "children": [{"id": 3, "name": "b"}]}]}))
    assert values(files.tree_json(spark, str(tmp_path / "tree.json"))) == [("1", None, "root"), ("2", "1", "a"), ("3", "2", "b")]
    for k in (1, 12):
        (tmp_path / f"similarity_permutation_{k}.csv").write_text(f"a,v\nx,{k}.5\n")
    (tmp_path / "other.csv").write_text("a,v\nx,0\n")
    assert values(files.numbered_files(spark, str(tmp_path), r"permutation_(\d+)", "a string, v double"), "number") == [("x", 1.5, 1), ("x", 12.5, 12)]
    assert files.csv(spark, str(tmp_path / "other.csv")).dtypes == [("a", "string"), ("v", "string")]


def test_volume_source(spark, tmp_path):
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 2, 2, 1, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 4)
    struct.pack_into("<3f", head, 108, 352.0, 2.0, 1.0)
    (tmp_path / "one.nii.gz").write_bytes(gzip.compress(bytes(head) + struct.pack("<4h", 1, 2, 3, 4)))
    assert values(volumes.volumes(spark, str(tmp_path)), "voxel") == [("one", k, 2.0 * (k + 1) + 1) for k in range(4)]


def test_stream_gives_the_same_windows(spark, tmp_path):
    from cohortry.streaming.visits import event_stream, windowed_visits

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(200)
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed_visits(event_stream(spark, str(tmp_path / "in"), events.schema), "1 hour")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.start, r.event_type): r.n for r in spark.table("windows").collect()}
    assert got == {(r.start, r.event_type): r.n for r in windowed_visits(spark.read.parquet(str(tmp_path / "in")), "1 hour").collect()}
