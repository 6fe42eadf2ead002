"""Queries of exact proportion tests, simulated nulls, adjusted p over all rows, divergence and affine transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators import proportions as E
from cohortry.operators import relational as R
from cohortry.operators import similarity as S
from cohortry.operators import voxels as V
from cohortry.plans.fixtures import Register, rounded, table

register = Register()


def _shares(spark, sf):
    """Nations stand in for terms, market segments for clusters: customers, and those of a high balance."""
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("term"), F.col("c_mktsegment").alias("cluster")).agg(F.count_if(F.col("c_acctbal") > 5000).alias("hits"), F.count("*").alias("size"))


def _compared(spark, sf):
    return E.pairwise_proportions(_shares(spark, sf), "term", "cluster", "hits", "size")


@register()
def pairwise_proportions(spark: SparkSession, sf: str) -> DataFrame:
    """Every two clusters of every term by the unconditional exact test, adjusted within terms and over all."""
    return rounded(_compared(spark, sf), "estimate", "p", "q_term", "q")


@register()
def clusters_beating_all_others(spark, sf):
    """Clusters above every other one of their term. The bar is low, as the test tables' shares are all alike."""
    return rounded(E.beating_all_others(_compared(spark, sf), "term", most=0.9), "least_estimate")


@register("SELECT count(*) AS pairs, round(sum((h_i / s_i::DOUBLE) - (h_j / s_j::DOUBLE)), 6) AS estimates FROM (SELECT x.n AS h_i, x.s AS s_i, y.n AS h_j, y.s AS s_j FROM (SELECT c_nationkey AS t, c_mktsegment AS k, count(*) FILTER (c_acctbal > 5000) AS n, count(*) AS s FROM customer GROUP BY ALL) x JOIN (SELECT c_nationkey AS t, c_mktsegment AS k, count(*) FILTER (c_acctbal > 5000) AS n, count(*) AS s FROM customer GROUP BY ALL) y ON x.t = y.t AND x.k > y.k)")
def proportion_differences(spark, sf):
    return rounded(_compared(spark, sf).agg(F.count("*").alias("pairs"), F.sum("estimate").alias("estimates")), "estimates")


@register()
def simulated_chi_squared(spark, sf):
    return rounded(E.simulated_chi_squared(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"), "chi2", "p")


@register("WITH p AS (SELECT c_custkey, (abs(c_acctbal) % 100) / 100 AS p FROM customer), r AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS raw FROM p) SELECT c_custkey, round(least(1, min(raw) OVER (ORDER BY p DESC)), 6) AS q FROM r")
def bh_over_all(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", ((F.abs("c_acctbal") % 100) / 100).alias("p"))
    return rounded(R.bh_over_all(rows, "p", "q").select("c_custkey", "q"), "q")


_VALUES = "v AS (SELECT label AS k, (i - 1)::INT AS at, avg(abs(embedding[i]::DOUBLE)) AS value FROM embeddings, range(1, 65) r(i) GROUP BY ALL)"


@register(f"WITH {_VALUES} SELECT x.k AS a, y.k AS b, round(sum(x.value * ln(x.value / y.value)), 6) AS kl FROM v x JOIN v y ON x.at = y.at AND x.k < y.k GROUP BY ALL")
def cluster_divergence(spark, sf):
    """Kullback-Leibler divergence between the clusters' mean magnitudes."""
    values = table(spark, sf, "embeddings").select(F.col("label").alias("k"), F.posexplode("embedding").alias("at", "value")).groupBy("k", "at").agg(F.avg(F.abs(F.col("value").cast("double"))).alias("value"))
    names = values.select("k").distinct()
    pairs = names.select(F.col("k").alias("a")).join(names.select(F.col("k").alias("b")), F.col("a") < F.col("b"))
    return rounded(S.pair_similarity(values, pairs, "k", "at", "value", ["kl"]), "kl")


def _affine(label):
    """A matrix that differs by label: scaled axes, a shear and a shift."""
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.array(one + label, F.lit(0.5), zero, label, zero, F.lit(2.0), F.lit(0.25), F.lit(-3.0), F.lit(0.1), zero, one, F.lit(7.0), zero, zero, zero, one)


@register("SELECT vec_id, round((1 + label) * e[1]::DOUBLE + 0.5 * e[2]::DOUBLE + label, 6) AS x, round(2 * e[2]::DOUBLE + 0.25 * e[3]::DOUBLE - 3, 6) AS y, round(0.1 * e[1]::DOUBLE + e[3]::DOUBLE + 7, 6) AS z FROM (SELECT vec_id, label, embedding AS e FROM embeddings)")
def affine_points(spark, sf):
    return rounded(V.transformed(_points(spark, sf), _affine(F.col("label"))).drop("label"), "x", "y", "z")


@register("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y, round(embedding[3]::DOUBLE, 6) AS z FROM embeddings")
def affine_round_trip(spark, sf):
    """Points moved by two matrices in one, and back by its inverse."""
    both = V.composed(_affine(F.col("label")), _affine(F.col("label") + 1))
    there = V.transformed(_points(spark, sf).withColumn("m", both), F.col("m"))
    return rounded(V.transformed(there, V.inverted(F.col("m"))).drop("m", "label"), "x", "y", "z")


def _points(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), *[e[k].cast("double").alias(w) for k, w in enumerate("xyz")])
