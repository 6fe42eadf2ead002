"""Nulls of enrichment: random target sets per seed, their ROC curves on a common grid, quantile bands over seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.operators.resampling import order_key


def seeded_places(rows: DataFrame, ident: str, seed: str, out: str = "place") -> DataFrame:
    """rows with their place, from 1, in the seeded order of each seed; ties by ident.

    A seed's rows are dealt to 4,096 ranges of the order, numbered within them, and the sizes of the ranges before are added: no task
    numbers all rows of a seed. Rows that agree in seed and ident are told apart by nothing, and get different places.
    Spark takes rows of an explode to be fewer than they are, so it is told not to broadcast them: they are dealt and ordered already.
    """
    keyed = rows.withColumn("__key", order_key(ident, seed)).withColumn("__range", F.substring("__key", 1, 3))
    sizes = keyed.groupBy(seed, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(seed).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(seed, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(seed, "__range").orderBy("__key", ident))
    return keyed.withColumn("__at", within).join(starts.hint("merge"), [seed, "__range"]).withColumn(out, F.col("__before") + F.col("__at")).drop("__key", "__range", "__at", "__before")


def null_targets(terms: DataFrame, term: str, sizes: list[int], seeds: int) -> DataFrame:
    """terms for each seed 1..seeds and size: drawn is true for `n_true` terms without replacement; a larger size has a smaller one's terms."""
    every = terms.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))
    placed = seeded_places(every, term, "seed")
    return placed.withColumn("n_true", F.explode(F.array(*map(F.lit, sizes)))).withColumn("drawn", F.col("place") <= F.col("n_true")).drop("place")


def roc_steps(rows: DataFrame, score: str, truth: Column, groups: list[str]) -> DataFrame:
    """(groups, hits, alarms, positives, negatives): true and false positives at each distinct score, the highest first. Null scores are left out.

    Scores are counted before they are ordered; each curve is one window over its distinct scores.
    """
    counted = rows.filter(F.col(score).isNotNull()).groupBy(*groups, score).agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))
    down, whole = Window.partitionBy(*groups).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*groups)
    return counted.select(*groups, F.sum("pos").over(down).alias("hits"), F.sum("neg").over(down).alias("alarms"), F.sum("pos").over(whole).alias("positives"), F.sum("neg").over(whole).alias("negatives"))


def on_grid(steps: DataFrame, groups: list[str], cells: int) -> DataFrame:
    """(groups, at, rate): each step curve's true positive rate at false positive rates at / cells, at = 0..cells: the last step that is not beyond.

    A step belongs to the first place of the grid that it doesn't exceed, by whole numbers, so curves shrink to cells + 1 rows before
    they are ordered and no step meets the grid in a join. Curves without positives or negatives are left out.
    """
    usable = steps.filter((F.col("positives") > 0) & (F.col("negatives") > 0))
    first = F.expr(f"(alarms * {cells} + negatives - 1) div negatives")
    best = usable.groupBy(*groups, first.alias("at")).agg(F.max(F.col("hits") / F.col("positives")).alias("rate"))
    packed = best.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("at", "rate"))).alias("rates"))
    filled = packed.select(*groups, "rates", F.explode(F.sequence(F.lit(0), F.lit(cells))).alias("at")).select(*groups, "at", F.expr("rates[CAST(at AS BIGINT)]").alias("rate"))
    so_far = Window.partitionBy(*groups).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn("rate", F.coalesce(F.max("rate").over(so_far), F.lit(0.0)))


def quantile_bands(rows: DataFrame, value: str, groups: list[str], lower: float = 0.025, upper: float = 0.975) -> DataFrame:
    """(groups, lower, middle, upper): quantiles of value, interpolated; groups hold a value per seed."""
    return rows.groupBy(*groups).agg(*[F.percentile(value, share).alias(name) for name, share in (("lower", lower), ("middle", 0.5), ("upper", upper))])
