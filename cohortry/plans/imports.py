"""Queries of imported similarity, homologous expression and sample coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators import imports as I
from cohortry.operators.relational import dealt
from cohortry.plans.fixtures import Register, rounded, table

register = Register()

_PATHS = "SELECT 'human/' || CASE WHEN l_returnflag = 'N' THEN 'absolute' ELSE 'relative' END || '/centroid_nk_' || l_linenumber || '_k_' || (l_suppkey % 5) || '.mnc' AS img1, 'mouse/' || CASE WHEN l_linestatus = 'O' THEN 'absolute' ELSE 'relative' END || '/centroid_nk_' || (l_partkey % 3) || '.mnc' AS img2, l_discount::DOUBLE AS similarity FROM lineitem"


@register(f"WITH p AS ({_PATHS}), n AS (SELECT nullif(regexp_extract(img1, '_nk_([0-9]+)', 1), '')::BIGINT AS img1_nk, nullif(regexp_extract(img1, '_k_([0-9]+)', 1), '')::BIGINT AS img1_k, nullif(regexp_extract(img2, '_nk_([0-9]+)', 1), '')::BIGINT AS img2_nk, nullif(regexp_extract(img2, '_k_([0-9]+)', 1), '')::BIGINT AS img2_k, similarity FROM p) SELECT coalesce(img1_nk::VARCHAR, 'NA') || '-' || coalesce(img1_k::VARCHAR, 'NA') AS img1_cluster_id, img1_nk, img1_k, coalesce(img2_nk::VARCHAR, 'NA') || '-' || coalesce(img2_k::VARCHAR, 'NA') AS img2_cluster_id, img2_nk, img2_k, round(avg(similarity), 6) AS similarity FROM n GROUP BY ALL")
def imported_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as similarities of two images, whose paths are read back and whose Jacobians are averaged."""
    kind = lambda c, v: F.when(F.col(c) == v, "absolute").otherwise("relative")
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit("human/"), kind("l_returnflag", "N"), F.lit("/centroid_nk_"), "l_linenumber", F.lit("_k_"), F.col("l_suppkey") % 5, F.lit(".mnc")).alias("img1"),
        F.concat(F.lit("mouse/"), kind("l_linestatus", "O"), F.lit("/centroid_nk_"), F.col("l_partkey") % 3, F.lit(".mnc")).alias("img2"),
        F.col("l_discount").cast("double").alias("similarity"),
    )
    return rounded(I.combined_jacobians(I.with_cluster_keys(rows)), "similarity")


@register("WITH a AS (SELECT l_partkey AS gene, l_linenumber::VARCHAR AS sample, avg(l_quantity) AS value FROM lineitem GROUP BY ALL), b AS (SELECT o_custkey AS gene, o_orderstatus AS sample, avg(o_totalprice) AS value FROM orders GROUP BY ALL), p AS (SELECT DISTINCT l_partkey AS x, l_suppkey AS y FROM lineitem WHERE l_suppkey IN (SELECT gene FROM b)) SELECT 'first' AS species, y AS gene, sample, round(value, 4) AS value FROM a JOIN p ON gene = x UNION ALL SELECT 'second', gene, sample, round(value, 4) FROM b WHERE gene IN (SELECT y FROM p)")
def homologous_expression(spark, sf):
    """Parts and customers as genes of two species that suppliers' numbers pair."""
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    n, m = lines.count(), orders.count()
    taken = lines.select(F.col("l_partkey").alias("gene"), F.col("l_linenumber").cast("string").alias("sample"), "l_quantity")
    first = dealt(taken, n, "gene", "sample").groupBy("gene", "sample").agg(F.avg("l_quantity").alias("value"))
    priced = orders.select(F.col("o_custkey").alias("gene"), F.col("o_orderstatus").alias("sample"), "o_totalprice")
    second = dealt(priced, m, "gene", "sample").groupBy("gene", "sample").agg(F.avg("o_totalprice").alias("value"))
    both = I.intersected_homologues(first, second, lines.select(F.col("l_partkey").alias("first_gene"), F.col("l_suppkey").alias("second_gene")), max(n, m))
    named = [df.select(F.lit(name).alias("species"), "gene", "sample", "value") for name, df in zip(("first", "second"), both, strict=True)]
    return rounded(named[0].unionByName(named[1]), "value", places=4)


@register("SELECT vec_id AS sample, round(2 * e[1]::DOUBLE - 0.5 * e[3]::DOUBLE - 1, 6) AS x, round(e[2]::DOUBLE - 2, 6) AS y, round(-0.25 * e[1]::DOUBLE + e[3]::DOUBLE + 3, 6) AS z FROM (SELECT vec_id, label, embedding AS e FROM embeddings) WHERE label % 3 <> 0")
def prepared_samples(spark, sf):
    """Embeddings as samples with coordinates, kept by a flag and moved to another space."""
    rows = table(spark, sf, "embeddings")
    samples = rows.select(F.col("vec_id").alias("sample"), *[F.col("embedding")[i].cast("double").alias(w) for i, w in enumerate("xyz")])
    matrix = F.array(*[F.lit(float(x)) for x in (2, 0, 0.5, 1, 0, 1, 0, 2, 0.25, 0, 1, 3, 0, 0, 0, 1)])
    return rounded(I.prepared_samples(samples, rows.select(F.col("vec_id").alias("sample"), (F.col("label") % 3 != 0).alias("keep")), matrix), "x", "y", "z")
