"""Edge cases of imported tables."""

from pyspark.sql import functions as F

from cohortry.operators import imports


def test_similarity_keys_and_unknown_values(spark):
    rows = [("a/absolute/c_nk_2_k_1.mnc", "b_nk_10/relative/c_nk_3_k_2.mnc", 1.0), ("a/relative/c_nk_2_k_1.mnc", "b/relative/c_nk_3_k_2.mnc", 3.0), ("a/c_nk_2_k_2.mnc", "b/plain.mnc", 5.0), ("a/absolute/c_nk_2_k_2.mnc", "b/plain.mnc", float("nan")), (None, "b/plain.mnc", None)]
    keyed = imports.with_cluster_keys(spark.createDataFrame(rows, "img1 string, img2 string, similarity double"))
    assert {(r.img1_jacobians, r.img2_nk) for r in keyed.collect()} == {("absolute", 3), ("relative", 3), (None, None), ("absolute", None)}
    got = {(r.img1_cluster_id, r.img2_cluster_id): r.similarity for r in imports.combined_jacobians(keyed).collect()}
    assert got == {("2-1", "3-2"): 2.0, ("2-2", "NA-NA"): None, ("NA-NA", "NA-NA"): None}


def test_homologues_with_several_names(spark):
    first = spark.createDataFrame([("Aa", 1, 1.0), ("Bb", 1, 2.0), ("Cc", 1, 3.0), (None, 1, 4.0)], "gene string, sample int, value double")
    second = spark.createDataFrame([("A", 7, 1.0), ("B1", 7, 2.0), ("B2", 7, 3.0), ("D", 7, 4.0)], "gene string, sample int, value double")
    pairs = spark.createDataFrame([("Aa", "A"), ("Aa", "A"), ("Bb", "B1"), ("Bb", "B2"), ("Cc", "C"), ("Dd", "D"), (None, "A")], "first_gene string, second_gene string")
    a, b = imports.intersected_homologues(first, second, pairs)
    assert sorted(map(tuple, a.collect())) == [("A", 1, 1.0), ("B1", 1, 2.0), ("B2", 1, 2.0)]
    assert sorted(r.gene for r in b.collect()) == ["A", "B1", "B2"]


def test_samples_without_flags_go(spark):
    samples = spark.createDataFrame([(k, 1.0, 2.0, 3.0) for k in range(4)], "sample int, x double, y double, z double")
    flags = spark.createDataFrame([(0, True), (1, False), (2, None), (0, False), (9, True)], "sample int, keep boolean")
    shift = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 10, 0, 1, 0, 20, 0, 0, 1, 30, 0, 0, 0, 1)])
    assert [tuple(r) for r in imports.prepared_samples(samples, flags, shift).collect()] == [(0, -9.0, -18.0, 33.0)]
