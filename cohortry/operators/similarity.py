"""Signatures of images over expression tables, and the similarity of long vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signatures(masks: DataFrame, expression: DataFrame) -> DataFrame:
    """Mean expression per image, sign and gene. masks: image, unit, sign (-1, 0, 1); expression: unit, gene, value.

    Both sides travel by unit; units outside the mask are dropped before.
    """
    live = masks.filter("sign <> 0")
    return live.join(expression, "unit").groupBy("image", "sign", "gene").agg(F.avg("value").alias("value"))


METRICS = {
    "correlation": lambda x, y: F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)),
    "cosine": lambda x, y: F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))),
    "euclidean": lambda x, y: F.sqrt(F.sum((x - y) * (x - y))),
    "manhattan": lambda x, y: F.sqrt(F.sum(F.abs(x - y))),
    # Infinite where x has weight and y has none, or where a value is negative.
    "kl": lambda x, y: F.sum(F.when((x > 0) & (y > 0), x * F.ln(x / y)).when((x == 0) & (y >= 0), 0.0).when(x.isNotNull() & y.isNotNull(), float("inf"))),
}


def pair_similarity(vectors: DataFrame, pairs: DataFrame, key: str, at: str, value: str, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Metrics of the vectors (key, at, value) named by pairs (a, b), per group of by (such as a sign)."""
    by = by or []
    left = vectors.select(F.col(key).alias("a"), *by, F.col(at).alias("at"), F.col(value).alias("x"))
    right = vectors.select(F.col(key).alias("b"), *by, F.col(at).alias("at"), F.col(value).alias("y"))
    met = pairs.join(left, "a").join(right, ["b", "at", *by])
    return met.groupBy("a", "b", *by).agg(*[METRICS[m](F.col("x"), F.col("y")).alias(m) for m in metrics])


def over_signs(similarity: DataFrame, column: str) -> DataFrame:
    """Mean over the signs whose similarity is known; null if none is."""
    return similarity.groupBy("a", "b").agg(F.avg(F.nanvl(column, F.lit(None).cast("double"))).alias(column))


def gram(vectors: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Products of all pairs of vectors that share a place, by place. For as many keys as a square table may have."""
    a = vectors.select(F.col(key).alias("a"), F.col(at).alias("at"), F.col(value).alias("x"))
    b = vectors.select(F.col(key).alias("b"), F.col(at).alias("at"), F.col(value).alias("y"))
    return a.join(b, "at").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
