"""Relational verbs whose semantics need care: recoding, completeness, lookups, grids, ranks, corrections, set overlaps."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sentinels_to_null(df: DataFrame, columns: Iterable[str], values: Iterable) -> DataFrame:
    """Values that stand for 'missing' become null in every given column."""
    values = list(values)
    return df.withColumns({c: F.when(~F.col(c).isin(values), F.col(c)) for c in columns})


def censored_to_number(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Text such as '<40', or any that isn't a number, becomes null; the rest double."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def complete_cases(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.na.drop(how="any", subset=list(columns))


def complete_columns(df: DataFrame, columns: Iterable[str], share: float) -> list[str]:
    """Those columns whose share of non-null rows is above share. One aggregation, one row."""
    columns = list(columns)
    row = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns]).first()
    return [c for c in columns if (row[c] or 0.0) > share]


def recoded(df: DataFrame, column: str, codes: DataFrame, code: str, value: str) -> DataFrame:
    """column replaced through a lookup of codes; values without a code stay. The first value of a repeated code counts."""
    look = codes.groupBy(F.col(code).alias("__code")).agg(F.min(value).alias("__value"))
    return df.join(look, F.col(column) == F.col("__code"), "left").withColumn(column, F.coalesce("__value", column)).drop("__code", "__value")


def first_match(df: DataFrame, right: DataFrame, on: str, order: list, columns: list[str]) -> DataFrame:
    """Each row of df with the columns of the first row of right, by order, that has its key; null where none has."""
    best = right.groupBy(F.col(on).alias("__on")).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__first"))
    joined = df.join(best, F.col(on) == F.col("__on"), "left")
    return joined.select(*df.columns, *[F.col(f"__first.{c}").alias(c) for c in columns])


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joined on all shared columns; null matches null."""
    shared = [c for c in left.columns if c in right.columns]
    renamed = right.select(*[F.col(c).alias(f"__r_{c}" if c in shared else c) for c in right.columns])
    on = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in shared]
    return left.join(renamed, on, how).drop(*[f"__r_{c}" for c in shared])


def on_grid(df: DataFrame, grid: DataFrame, keys: list[str], fill: dict[str, object]) -> DataFrame:
    """Every row of grid, with df's values or, where df has none, those of fill."""
    return grid.join(df, keys, "left").fillna(fill)


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, distance: int) -> DataFrame:
    """Pairs of integers at most distance apart. Right rows are offered at each offset, so the join is on equality."""
    offered = right.withColumn("__at", F.explode(F.transform(F.sequence(F.lit(-distance), F.lit(distance)), lambda d: F.col(b) + d)))
    return left.join(offered, F.col(a) == F.col("__at")).drop("__at")


def top_with_ties(df: DataFrame, by: Column, n: int, groups: list[str] | None = None) -> DataFrame:
    """Rows of the n highest values of by, per group; rows that tie with the last one stay.

    Without groups, the n-th value is found by a bounded top-n and rows are filtered by it: no global sort.
    """
    if groups:
        return df.withColumn("__rank", F.rank().over(Window.partitionBy(*groups).orderBy(by.desc_nulls_last()))).filter(F.col("__rank") <= n).drop("__rank")
    cut = df.select(by.alias("__by")).filter("__by IS NOT NULL").orderBy(F.desc("__by")).limit(n).agg(F.min("__by").alias("__cut"))
    return df.withColumn("__value", by).join(F.broadcast(cut), F.col("__value") >= F.col("__cut")).drop("__value", "__cut")


def group_maxima(df: DataFrame, groups: list[str], column: str) -> DataFrame:
    """Rows that have the highest value of their group; ties stay."""
    return df.withColumn("__max", F.max(column).over(Window.partitionBy(*groups))).filter(F.col(column) == F.col("__max")).drop("__max")


def zscored(df: DataFrame, columns: Iterable[str], groups: list[str]) -> DataFrame:
    """(x - mean) / sample standard deviation within the group; null where that is zero."""
    w = Window.partitionBy(*groups)
    return df.withColumns({c: F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w)) for c in columns})


def bh_adjusted(df: DataFrame, p: str, groups: list[str], out: str = "q", tie: list[str] | None = None) -> DataFrame:
    """False-discovery-rate adjusted p values (step-up), within the group."""
    up = Window.partitionBy(*groups).orderBy(F.col(p), *(tie or []))
    down = Window.partitionBy(*groups).orderBy(F.desc(p), *[F.desc(t) for t in tie or []]).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(p).over(Window.partitionBy(*groups))
    return df.withColumn("__raw", F.col(p) * n / F.row_number().over(up)).withColumn(out, F.least(F.lit(1.0), F.min("__raw").over(down))).drop("__raw")


def bh_over_all(df: DataFrame, p: str, out: str = "q", buckets: int = 256) -> DataFrame:
    """bh_adjusted() over all rows at once, by ranges of p: no task holds more than a range of distinct values.

    Equal values are counted and have one result. The minimum over higher values is taken within each range, and over the
    least ones of the ranges above. Null values count for nothing and stay null.
    """
    counted = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("__n"))
    total = counted.agg(F.sum("__n").alias("__total"))
    raw = below_sums(counted, "__p", ["__n"], buckets=buckets).join(F.broadcast(total)).withColumn("__raw", F.col("__p") * F.col("__total") / (F.col("below___n") + F.col("__n")))
    cuts = counted.agg(F.percentile_approx("__p", F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), F.lit(10_000)).alias("__cuts"))
    placed = raw.join(F.broadcast(cuts)).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col("__p")))).drop("__cuts")
    above = Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    least = placed.groupBy("__range").agg(F.min("__raw").alias("__least")).select("__range", F.min("__least").over(above).alias("__above"))
    within = Window.partitionBy("__range").orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)
    solved = placed.withColumn("__own", F.min("__raw").over(within)).join(F.broadcast(least), "__range")
    solved = solved.select(F.col("__p").alias("__key"), F.least(F.lit(1.0), "__own", "__above").alias(out))
    return df.join(solved, F.col(p) == F.col("__key"), "left").drop("__key")


def latest_nonempty(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Per key its latest row with a value in any of columns; keys without one get nulls. Ties at the latest order stay."""
    filled = df.filter(functools.reduce(lambda x, y: x | y, [F.col(c).isNotNull() for c in columns]))
    kept = group_maxima(filled, [key], order).select(key, order, *columns)
    rest = df.select(key).distinct().join(kept.select(key), key, "left_anti")
    return kept.unionByName(rest, allowMissingColumns=True)


def completeness_curve(long: DataFrame, subject: str, variable: str, value: str) -> DataFrame:
    """(n_variables, n_complete): subjects complete in the n most complete variables, for every n.

    long has a row per subject and variable, with null values. Each subject counts until the first variable it lacks.
    """
    order = long.groupBy(variable).agg(F.count(value).alias("__have"))
    ranked = order.withColumn("__rank", F.row_number().over(Window.orderBy(F.desc("__have"), variable))).select(variable, "__rank")
    first = long.join(ranked, variable).groupBy(subject).agg(F.min(F.when(F.col(value).isNull(), F.col("__rank"))).alias("__first"))
    stops = first.groupBy("__first").agg(F.count("*").alias("__n"))
    total = stops.agg(F.sum("__n").alias("__total"))
    grid = ranked.select(F.col("__rank").alias("n_variables"))
    gone = grid.join(stops, F.col("__first") <= F.col("n_variables"), "left").groupBy("n_variables").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__gone"))
    return gone.join(F.broadcast(total)).select("n_variables", (F.col("__total") - F.col("__gone")).alias("n_complete"))


#: Rows of a few numbers that a task takes on average where its partitions are counted out: less than 200 MB sorted or hashed.
TASK_ROWS = 500_000
#: Partitions at most: beyond, what was quadratic in one group makes tasks larger, which spill.
MOST_TASKS = 20_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of about so many rows, dealt by keys to partitions of TASK_ROWS on average: what a task holds doesn't grow with the input.

    The number depends on the rows alone, not on the session's partitions, and is not made smaller at run time.
    """
    return df.repartition(max(1, min(MOST_TASKS, -(-rows // TASK_ROWS))), *keys)


def ecdf_at(df: DataFrame, value: str, thresholds: DataFrame, at: str, groups: list[str] | None = None) -> DataFrame:
    """Shares of values at most, and at least, each threshold of a small table: partial counts per task, one row per threshold."""
    rows = df.select(*(groups or []), value).join(F.broadcast(thresholds))
    return rows.groupBy(*(groups or []), at).agg(F.avg((F.col(value) <= F.col(at)).cast("double")).alias("share_le"), F.avg((F.col(value) >= F.col(at)).cast("double")).alias("share_ge"))


def binned(value: Column, edges: list[float]) -> Column:
    """Number of the right-closed interval (edges[k], edges[k+1]] that holds the value, from 0; null outside."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        out = F.when((value > edges[k]) & (value <= edges[k + 1]), k).otherwise(out)
    return out


def set_overlaps(members: DataFrame, group: str, item: str) -> DataFrame:
    """Jaccard, overlap coefficient and containments of every pair of groups that share an item, from distinct members."""
    m = members.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    sizes = m.groupBy("g").agg(F.count("*").alias("n"))
    both = m.alias("x").join(m.select(F.col("g").alias("h"), F.col("i").alias("j")), (F.col("i") == F.col("j")) & (F.col("g") < F.col("h"))).groupBy("g", "h").agg(F.count("*").alias("shared"))
    sized = both.join(sizes.withColumnRenamed("n", "n_a"), "g").join(sizes.select(F.col("g").alias("h"), F.col("n").alias("n_b")), "h")
    n = F.col("shared").cast("double")
    return sized.select(F.col("g").alias("a"), F.col("h").alias("b"), "shared", (n / (F.col("n_a") + F.col("n_b") - n)).alias("jaccard"), (n / F.least("n_a", "n_b")).alias("overlap"), (n / F.col("n_a")).alias("a_in_b"), (n / F.col("n_b")).alias("b_in_a"))


def bridged_pairs(members: DataFrame, bridge: str, key: str, blocks: int = 8) -> DataFrame:
    """(a, b): the distinct ordered pairs of keys that share a bridge, each with itself. members: distinct bridge and key.

    Keys are dealt to blocks, and for every two blocks a bridge sends its keys of both as lists to the task that makes
    their pairs and drops repeated ones: what is shuffled are lists, not pairs, and each two blocks once.
    """
    known = members.filter(F.col(bridge).isNotNull() & F.col(key).isNotNull())
    sets = known.groupBy(F.col(bridge).alias("bridge"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("i")).agg(F.collect_list(key).alias("own"))
    met = sets.join(sets.select("bridge", F.col("i").alias("j"), F.col("own").alias("others")), "bridge").filter("i <= j")
    dealt = met.select("i", "j", "own", "others").repartition("i", "j")
    pairs = dealt.select("i", "j", "others", F.explode("own").alias("a")).select("i", "j", "a", F.explode("others").alias("b")).distinct()
    turned = F.array(F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    each = F.when(F.col("i") < F.col("j"), F.concat(F.array(F.struct("a", "b")), turned)).otherwise(F.array(F.struct("a", "b")))
    return pairs.select(F.inline(each))


def below_sums(rows: DataFrame, order: str, columns: list[str], descending: bool = False, buckets: int = 256) -> DataFrame:
    """rows, of which each value of order has one, with below_<column>: the sum over rows of lower (or higher) order.

    Rows are dealt to ranges between approximate percentiles, summed within each range, and the sums of the ranges before
    are added: no task holds more than a range, and one row of percentiles and one sum a range are broadcast.
    """
    cuts = rows.agg(F.percentile_approx(order, F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), F.lit(10_000)).alias("__cuts"))
    # Ranges are numbered in the order of summation.
    passed = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(order))), F.lit(0))
    placed = rows.join(F.broadcast(cuts)).withColumn("__range", -passed if descending else passed).drop("__cuts")
    by = F.desc(order) if descending else F.asc(order)
    within = Window.partitionBy("__range").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("__range").agg(*[F.sum(c).alias(f"__all_{c}") for c in columns])
    totals = totals.select("__range", *[F.coalesce(F.sum(f"__all_{c}").over(before), F.lit(0)).alias(f"__before_{c}") for c in columns])
    own = placed.withColumns({f"__own_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in columns})
    return own.join(F.broadcast(totals), "__range").select(*rows.columns, *[(F.col(f"__own_{c}") + F.col(f"__before_{c}")).alias(f"below_{c}") for c in columns])


def selected(df: DataFrame, starts: str | None = None, contains: str | None = None, matches: str | None = None, names: Iterable[str] = (), keep_rest: bool = False) -> DataFrame:
    """The columns that a helper names, in the frame's order, each once; keep_rest puts the others behind them."""
    chosen = [c for c in df.columns if c in set(names) or (starts and c.startswith(starts)) or (contains and contains in c) or (matches and re.search(matches, c))]
    return df.select(*chosen, *([c for c in df.columns if c not in chosen] if keep_rest else []))


def without_metadata_rows(df: DataFrame, column: str, labels: Iterable[str]) -> DataFrame:
    """Rows but those that repeat a header or hold units: their column has one of labels. Rows of a file have no order in Spark, so they are known by content."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*labels))


def bound(left: DataFrame, right: DataFrame, row: str) -> DataFrame:
    """Columns of both side by side, by an explicit row number; a number that one side lacks is an error of the data and gives nulls."""
    return left.join(right, row, "full_outer")


def in_order(df: DataFrame, column: str, levels: list) -> DataFrame:
    """df with place: the position of column's value among levels; null for values that have none."""
    return df.withColumn("place", F.nullif(F.array_position(F.array(*map(F.lit, levels)), F.col(column)), F.lit(0).cast("long")).cast("int"))
