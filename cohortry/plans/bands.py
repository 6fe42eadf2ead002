"""Queries of enrichment nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators import bands as B
from cohortry.operators import enrichment as N
from cohortry.plans.fixtures import Register, rounded, table

register = Register()

SIZES, SEEDS, CELLS = [10, 50], 20, 20


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    """Parts stand in for terms, their prices for scores of enrichment."""
    return B.null_targets(table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("score")), "p_partkey", SIZES, SEEDS)


_DRAWN = "r AS (SELECT p_retailprice AS score, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(p_partkey || '-' || seed), p_partkey) AS place FROM part, range(1, 21) s(seed)), d AS (SELECT n_true, seed, score, count_if(place <= n_true) AS pos, count_if(place > n_true) AS neg FROM r, (VALUES (10), (50)) t(n_true) GROUP BY ALL)"
_BANDS = "round(quantile_cont({v}, 0.025), 6) AS lower, round(quantile_cont({v}, 0.5), 6) AS middle, round(quantile_cont({v}, 0.975), 6) AS upper"


@register(f"WITH {_DRAWN}, c AS (SELECT n_true, seed, sum(pos) OVER w AS hits, sum(neg) OVER w AS alarms, sum(pos) OVER g AS positives, sum(neg) OVER g AS negatives FROM d WINDOW g AS (PARTITION BY n_true, seed), w AS (PARTITION BY n_true, seed ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), y AS (SELECT n_true, seed, i::INT AS cell, coalesce(max(hits / positives) FILTER (alarms * 20 <= i * negatives), 0) AS rate FROM c, range(0, 21) x(i) GROUP BY ALL) SELECT n_true, cell, {_BANDS.format(v='rate')} FROM y GROUP BY ALL")
def null_roc_bands(spark: SparkSession, sf: str) -> DataFrame:
    """95 % bands of the ROC curves of random targets, at 21 false positive rates."""
    curves = B.on_grid(B.roc_steps(_targets(spark, sf), "score", F.col("drawn"), ["n_true", "seed"]), ["n_true", "seed"], CELLS)
    return rounded(B.quantile_bands(curves.withColumnRenamed("at", "cell"), "rate", ["n_true", "cell"]), "lower", "middle", "upper")


@register(f"WITH {_DRAWN}, b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY n_true, seed ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d), y AS (SELECT n_true, seed, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM b GROUP BY ALL) SELECT n_true, {_BANDS.format(v='auc')} FROM y GROUP BY 1")
def null_area_bands(spark: SparkSession, sf: str) -> DataFrame:
    """The same of the areas below them."""
    areas = N.roc_area(_targets(spark, sf), "score", F.col("drawn"), ["n_true", "seed"])
    return rounded(B.quantile_bands(areas, "auc", ["n_true"]), "lower", "middle", "upper")
