"""Seeded permutations, draws and splits, the same on any partitioning; empirical p values and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(*parts) -> Column:
    """The order of a seeded shuffle: md5 of the parts. Linear hashes would only rotate it from seed to seed."""
    return F.md5(F.concat_ws("-", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]).cast("binary"))


def permuted_labels(clusters: DataFrame, seeds: DataFrame, least: int = 1) -> DataFrame:
    """(seed, nk, id, k): labels shuffled without replacement within each nk and seed; clusters below least rows become -1.

    clusters: id, nk, k. Every seed and nk is ordered by itself, so work is spread over seeds x nk.
    """
    size = Window.partitionBy("nk", "k")
    sized = clusters.withColumn("k", F.when(F.count("*").over(size) >= least, F.col("k")).otherwise(-1))
    every = sized.join(F.broadcast(seeds))
    own = Window.partitionBy("seed", "nk")
    ids = every.select("seed", "nk", "id", F.row_number().over(own.orderBy("id")).alias("at"))
    labels = every.select("seed", "nk", "k", F.row_number().over(own.orderBy(order_key("id", "nk", "seed"), "id")).alias("at"))
    return ids.join(labels, ["seed", "nk", "at"]).select("seed", "nk", "id", "k")


def empirical_p(observed: DataFrame, null: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per observed row: the share of null values of its keys that are at least as high (no correction by one)."""
    drawn = null.select(*keys, F.col(value).alias("__null"))
    names = [c for c in observed.columns]
    return observed.join(drawn, keys).groupBy(*names).agg(F.avg((F.col("__null") >= F.col(value)).cast("double")).alias("p"))


def drawn_rows(rows: DataFrame, group: str, draws: int) -> DataFrame:
    """Bootstrap rows per group with replacement: draw, group, value. rows: group, id, value.

    The row for each place of a draw is named by the hash of group, draw and place, modulo the group's size.
    """
    own = Window.partitionBy(group)
    placed = rows.withColumns({"at": F.row_number().over(own.orderBy("id")) - 1, "size": F.count("*").over(own)})
    wanted = placed.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    hashed = F.conv(F.substring(order_key(group, "draw", "at"), 1, 8), 16, 10).cast("long")
    wanted = wanted.select(F.col(group).alias("__group"), "draw", (hashed % F.col("size")).alias("take"))
    return wanted.join(placed, (F.col("__group") == F.col(group)) & (F.col("take") == F.col("at"))).select("draw", group, "value")


def bootstrap_interval(rows: DataFrame, group: str, draws: int, share: float = 0.95) -> DataFrame:
    """Per group the mean and its percentile interval over draws."""
    means = drawn_rows(rows, group, draws).groupBy(group, "draw").agg(F.avg("value").alias("m"))
    tail = (1 - share) / 2
    return means.groupBy(group).agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high")).join(rows.groupBy(group).agg(F.avg("value").alias("mean")), group)


def split(rows: DataFrame, key: str, seed: int, share: float, groups: list[str]) -> DataFrame:
    """rows with train: true for the first share of each group in seeded order (rounded down)."""
    own = Window.partitionBy(*groups)
    place = F.row_number().over(own.orderBy(order_key(key, F.lit(str(seed))), key))
    return rows.withColumn("train", place <= F.floor(F.count("*").over(own) * share))


def pooled_p(observed: DataFrame, null: DataFrame, value: str, off_diagonal: int = 1, least: int = 2) -> DataFrame:
    """observed (nk1, nk2, and more) with p: the share of the null's values of (nk1, nk2), pooled over clusters and permutations, that are as high.

    Of pairs of solutions with at least `least` clusters, at most off_diagonal apart. Both sides are counted by value
    first, and meet in one window per pair of solutions, not in a join of every value with every other.
    """
    near = (F.abs(F.col("nk1") - F.col("nk2")) <= off_diagonal) & (F.col("nk1") >= least) & (F.col("nk2") >= least)
    counted = null.filter(near & F.col(value).isNotNull()).groupBy("nk1", "nk2", value).agg(F.count("*").alias("m"))
    wanted = observed.filter(near & F.col(value).isNotNull()).select("nk1", "nk2", value).distinct().withColumn("m", F.lit(0).cast("long"))
    both = counted.unionByName(wanted)
    pair = Window.partitionBy("nk1", "nk2")
    run = both.select("*", (F.sum("m").over(pair.orderBy(F.desc(value))) / F.sum("m").over(pair)).alias("p")).filter("m = 0").drop("m")
    return observed.filter(near).join(run, ["nk1", "nk2", value], "left")


def uniform(*parts) -> Column:
    """A number in (0, 1) from the hash of the parts, the same on any partitioning and in SQL."""
    return (F.conv(F.substring(order_key(*parts), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(*parts) -> Column:
    """A standard normal number from the hash of the parts."""
    return F.sqrt(-2 * F.ln(uniform(*parts, F.lit("r")))) * F.cos(2 * F.pi() * uniform(*parts, F.lit("a")))


def first_of_each(rows: DataFrame, key: str, ident: str, seed, more: list[str]) -> DataFrame:
    """One row per key (and columns of more) in seeded order: partial minima, so a key of many rows is no hot group. seed: a column or literal."""
    rest = [c for c in rows.columns if c != key and c not in more]
    best = rows.groupBy(key, *more).agg(F.min_by(F.struct(*rest), F.struct(order_key(ident, seed), ident)).alias("x"))
    return best.select(key, *more, "x.*")
