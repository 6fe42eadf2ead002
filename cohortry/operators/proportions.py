"""Exact tests of two proportions, all pairs of clusters by term, and chi-squared with a simulated null."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators.relational import bh_adjusted, bh_over_all
from cohortry.sources.files import scratch


def _log_binomials(n: int) -> np.ndarray:
    """log of n over k for k = 0..n."""
    steps = np.log(np.arange(1, n + 1))
    whole = np.r_[0.0, np.cumsum(steps)]
    return whole[-1] - whole - whole[::-1]


def _probabilities(n: int, at: np.ndarray) -> np.ndarray:
    """Binomial probabilities of 0..n (rows) at each success probability (columns), with 0 and 1 as limits."""
    k = np.arange(n + 1)[:, None]
    inner = np.clip(at, 1e-300, 1 - 1e-16)
    out = np.exp(_log_binomials(n)[:, None] + k * np.log(inner) + (n - k) * np.log1p(-inner))
    out[:, at <= 0] = k == 0
    out[:, at >= 1] = k == n
    return out


def unconditional_p(b: int, n: int, c: int, m: int, grid: int = 201, rounds: int = 4, cells: int = 4_000_000) -> float:
    """Two-sided p of b of n against c of m: all pairs of outcomes whose pooled z is at least as far from zero, at the worst common probability.

    The supremum is sought on a grid, then on ever finer ones around the best point. For each x of n, z falls as y of m
    rises, so the outcomes at least as far are those up to one y and those from another on; both are found by bisection and
    weighed by sums of the binomial from either end. Work and memory grow with n + m, not with n * m; some points of the
    grid are handled at a time. 1 where a margin is zero.
    """
    if n <= 0 or m <= 0 or b + c in (0, n + m):
        return 1.0

    def z(x, y):
        p = (x + y) / (n + m)
        spread = p * (1 - p) * (1 / n + 1 / m)
        return (x / n - y / m) / np.sqrt(np.where(spread > 0, spread, 1))

    far, x = abs(z(b, c)) - 1e-9, np.arange(n + 1)
    if far <= 0:
        return 1.0

    def first(reached):
        """For each x the least y, or m + 1, from which on reached(x, y) holds."""
        low, high = np.zeros(n + 1, np.int64), np.full(n + 1, m + 1)
        while (low < high).any():
            middle = (low + high) // 2
            held = reached(x, np.minimum(middle, m))
            low, high = np.where((low < high) & ~held, middle + 1, low), np.where((low < high) & held, middle, high)
        return low

    below, above = first(lambda x, y: z(x, y) < far), first(lambda x, y: z(x, y) <= -far)
    step = max(1, cells // (max(n, m) + 1))

    def tail(at):
        out = []
        for low in range(0, len(at), step):
            px, py = (_probabilities(size, at[low : low + step]) for size in (n, m))
            none = np.zeros((1, py.shape[1]))
            up, down = np.r_[none, py.cumsum(axis=0)], np.r_[py[::-1].cumsum(axis=0)[::-1], none]
            out.append((px * (up[below] + down[above])).sum(axis=0))
        return np.concatenate(out)

    low, high, best = 0.0, 1.0, 0.0
    for _ in range(rounds):
        at = np.linspace(low, high, grid)
        found = tail(at)
        k, best = int(found.argmax()), max(best, float(found.max()))
        low, high = at[max(0, k - 1)], at[min(grid - 1, k + 1)]
    return min(1.0, best)


def with_exact_p(tables: DataFrame, b: str, n: str, c: str, m: str, p: str = "p") -> DataFrame:
    """tables with the unconditional exact p of b of n against c of m. Every distinct table is solved once, dealt over tasks, and joined back.

    b of n against c of m is the same test as c of m against b of n, so only one of the two is solved. Null where a count is
    null, negative or above its size.
    """
    swap = (F.col(n) > F.col(m)) | ((F.col(n) == F.col(m)) & (F.col(b) > F.col(c)))
    named = dict(zip(("__b", "__n", "__c", "__m"), ((b, c), (n, m), (c, b), (m, n)), strict=True))
    keyed = tables.withColumns({k: F.when(swap, F.col(y)).otherwise(F.col(x)).cast("int") for k, (x, y) in named.items()})

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(p=[unconditional_p(*map(int, row)) for row in pdf.itertuples(index=False)])

    fine = (F.col("__b") >= 0) & (F.col("__b") <= F.col("__n")) & (F.col("__c") >= 0) & (F.col("__c") <= F.col("__m"))
    # Dealt by hash, as large tables cost more and stand next to each other. A repartition by the columns themselves is
    # dropped after distinct(), and few rows are then put in one task.
    spark = tables.sparkSession
    distinct = keyed.filter(fine).select(*named).distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*named))
    # Written once, as adjusting p reads it several times.
    path, schema = scratch(spark, "exact"), "__b int, __n int, __c int, __m int, p double"
    distinct.mapInPandas(solve, schema).write.parquet(path)
    solved = spark.read.schema(schema).parquet(path).select(*[F.col(k).alias(f"{k}_") for k in named], F.col("p").alias("__p"))
    met = keyed.join(solved, [F.col(k) == F.col(f"{k}_") for k in named], "left")
    return met.select(*tables.columns, F.col("__p").alias(p))


def pairwise_proportions(counts: DataFrame, term: str, cluster: str, hits: str, size: str) -> DataFrame:
    """Every two clusters of every term compared: (term, cluster_i, cluster_j, hits and sizes, estimate, p, q_term, q).

    counts has one row a term and cluster; cluster_i is the higher one. estimate is the difference of proportions, 0 with p = 1
    where nothing or everything is hit or a size is zero. q_term is adjusted within the term, q over all pairs of all terms.
    """
    one, other = (counts.select(F.col(term), *[F.col(x).alias(f"{y}_{s}") for x, y in ((cluster, "cluster"), (hits, "hits"), (size, "size"))]) for s in "ij")
    pairs = one.join(other, [term]).filter("cluster_i > cluster_j")
    none = (F.col("size_i") == 0) | (F.col("size_j") == 0) | (F.col("hits_i") + F.col("hits_j") == 0) | (F.col("hits_i") + F.col("hits_j") == F.col("size_i") + F.col("size_j"))
    difference = F.try_divide("hits_i", "size_i") - F.try_divide("hits_j", "size_j")
    tested = with_exact_p(pairs, "hits_i", "size_i", "hits_j", "size_j").withColumn("estimate", F.when(none, 0.0).otherwise(difference))
    within = bh_adjusted(tested, "p", [term], "q_term", ["cluster_i", "cluster_j"])
    return bh_over_all(within, "p", "q")


def beating_all_others(pairs: DataFrame, term: str, q: str = "q_term", most: float = 0.05) -> DataFrame:
    """(term, winner, least_estimate): clusters whose proportion is significantly above that of every other cluster of the term."""
    ends = F.array(F.struct(F.col("cluster_i").alias("winner"), F.col("estimate").alias("gain")), F.struct(F.col("cluster_j").alias("winner"), (-F.col("estimate")).alias("gain")))
    each = pairs.select(term, q, F.explode(ends).alias("x")).select(term, q, "x.*")
    won = (F.col(q) <= most) & (F.col("gain") > 0)
    return each.groupBy(term, "winner").agg(F.count("*").alias("met"), F.count_if(won).alias("won"), F.min("gain").alias("least_estimate")).filter("met = won").drop("met", "won")


def simulated_tables(rows: np.ndarray, columns: np.ndarray, seed: str, draws: int) -> np.ndarray:
    """draws random tables with these margins, as if the labels were shuffled: (draws, rows, columns)."""
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "big"))
    out, left = np.zeros((draws, len(rows), len(columns)), np.int64), np.tile(columns, (draws, 1))
    for i, n in enumerate(rows[:-1]):
        # A row's cells one by one: each is hypergeometric given those before it.
        rest = np.full(draws, n)
        below = left.sum(axis=1)
        for j in range(len(columns) - 1):
            below = below - left[:, j]
            own = rng.hypergeometric(left[:, j], below, rest)
            out[:, i, j], rest = own, rest - own
        out[:, i, -1] = rest
        left -= out[:, i]
    out[:, -1] = left
    return out


def simulated_chi_squared(rows: DataFrame, a: str, b: str, draws: int = 2_000, seed: int = 1, at_once: int = 250) -> DataFrame:
    """(chi2, p, draws): Pearson's statistic of a against b, and the share of random tables with the same margins that reach it, itself included.

    What the tasks need are the margins: a table of categories, not of rows. Draws are made at_once at a time, each lot
    by its own seed, so they are the same however they are dealt. Null labels are a category. No rows: null statistic.
    """
    spark = rows.sparkSession
    cells = rows.groupBy(F.coalesce(F.col(a).cast("string"), F.lit("\0")).alias("a"), F.coalesce(F.col(b).cast("string"), F.lit("\0")).alias("b")).agg(F.count("*").alias("o"))
    margins = {k: np.array([r["n"] for r in cells.groupBy(k).agg(F.sum("o").alias("n")).orderBy(k).collect()], np.int64) for k in ("a", "b")}
    if not len(margins["a"]):
        return spark.createDataFrame([(None, None, draws)], "chi2 double, p double, draws long")
    total = int(margins["a"].sum())
    expected = np.outer(margins["a"], margins["b"]) / total
    table = np.zeros(expected.shape)
    place = [{r["k"]: n for n, r in enumerate(cells.select(F.col(k).alias("k")).distinct().orderBy("k").collect())} for k in ("a", "b")]
    for r in cells.collect():
        table[place[0][r["a"]], place[1][r["b"]]] = r["o"]
    observed = float((table * table / expected).sum() - total)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lot in pdf.id:
                found = simulated_tables(margins["a"], margins["b"], f"{seed}-{lot}", min(at_once, draws - lot * at_once))
                chi2 = (found * found / expected).sum(axis=(1, 2)) - total
                yield pd.DataFrame({"reached": [int((chi2 >= observed - 1e-7 * max(1.0, observed)).sum())]})

    lots = spark.range(-(-draws // at_once))
    return lots.mapInPandas(drawn, "reached long").agg(F.lit(observed).alias("chi2"), ((F.sum("reached") + 1) / (draws + 1)).alias("p"), F.lit(draws).cast("long").alias("draws"))
