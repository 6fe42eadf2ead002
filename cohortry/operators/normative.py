"""Normative models: natural splines of age with sex and batch, fitted on controls from sums, and z-scores of everyone."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.distributions import normal_below, t_quantile
from cohortry.operators.resampling import uniform
from cohortry.sources.files import scratch


def _written(small: DataFrame, name: str) -> DataFrame:
    """A row per place, written once: Spark knows its size before it plans the join, so rows aren't shuffled to few places."""
    path = scratch(small.sparkSession, name)
    small.write.parquet(path)
    return small.sparkSession.read.schema(small.schema).parquet(path)


def batch_residuals(rows: DataFrame, at: str, batch: str, value: str = "value") -> DataFrame:
    """rows with value less its mean over the rows of its place and batch, which is what a fit on batches leaves."""
    means = _written(rows.groupBy(at, batch).agg(F.avg(value).alias("__mean")), "means")
    return rows.join(means, [at, batch]).withColumn(value, F.col(value) - F.col("__mean")).drop("__mean")


def knots(rows: DataFrame, place: str, x: str, df: int) -> DataFrame:
    """Per place the boundary knots and df - 1 inner ones, at equal shares of x."""
    return rows.groupBy(place).agg(_knots(x, df))


def _knots(x: str, df: int) -> Column:
    inner = F.percentile(x, [k / df for k in range(1, df)]) if df > 1 else None
    return F.array(F.min(x).cast("double"), *[inner[k] for k in range(df - 1)], F.max(x).cast("double")).alias("knots")


def spline_basis(x: Column, at: Column, df: int) -> list[Column]:
    """df columns that span the natural cubic splines of x (linear beyond the boundary), without the constant. at: the knots.

    Truncated powers, scaled by the range of x: another basis of the same space as B-splines, with the same fits.
    """
    low, high = at[0], at[df]
    span = F.nullif(high - low, F.lit(0.0))

    def cube(k):
        over = F.greatest((x - at[k]) / span, F.lit(0.0))
        return over * over * over

    def d(k):
        return F.try_divide(cube(k) - cube(df), (high - at[k]) / span)

    return [(x - low) / span, *(d(k) - d(df - 1) for k in range(df - 1))]


def _designed(rows: DataFrame, x: str, sex: str, levels: list[str], df: int) -> DataFrame:
    """rows, which have knots, with the array __x of the model's columns."""
    one = [F.lit(1.0), *[(F.col(sex) == s).cast("double") for s in levels[1:]]]
    return rows.withColumn("__x", F.array(*one, *spline_basis(F.col(x).cast("double"), F.col("knots"), df))).drop("knots")


def fitted_models(rows: DataFrame, place: str, size: int) -> DataFrame:
    """(place, beta, inverse, scale, n) by least squares of value on the array __x, from sums per place: no rows are gathered.

    Values count from the column centre, their place's mean, so that a mean that is large against the spread costs no digits. inverse is that of the cross products, row by row; scale is the residual standard error times the t quantile of a
    one-sigma interval. Null where the sums are singular or no degree of freedom is left.
    """
    return _solved(_cross_products(rows, [place], size), [place], size)


def _cross_products(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Sums of products of the columns of __x, of those with value less centre, and its square, per keys; partial aggregates, no rows are gathered."""
    sums = [F.sum(F.col("__x")[a] * F.col("__x")[b]).alias(f"s{a}_{b}") for a in range(size) for b in range(a, size)]
    value = F.col("value") - F.col("centre")
    sums += [F.sum(F.col("__x")[a] * value).alias(f"y{a}") for a in range(size)]
    return rows.filter(F.col("value").isNotNull() & F.forall("__x", lambda v: v.isNotNull())).groupBy(*keys).agg(*sums, F.sum(value * value).alias("yy"), F.count("*").alias("n"))


def _solved(table: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, beta, inverse, scale, n) from sums."""
    kinds = dict(table.dtypes)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                own = tuple(getattr(row, k) for k in keys)
                m, y = np.zeros((size, size)), np.array([getattr(row, f"y{a}") for a in range(size)])
                for a in range(size):
                    for b in range(a, size):
                        m[a, b] = m[b, a] = getattr(row, f"s{a}_{b}")
                free = row.n - size
                if free < 1 or np.linalg.matrix_rank(m) < size:
                    out.append((*own, None, None, None, row.n))
                    continue
                inverse = np.linalg.inv(m)
                beta = inverse @ y
                scale = np.sqrt(max(row.yy - beta @ y, 0.0) / free) * float(t_quantile(normal_below(1.0), free))
                out.append((*own, beta.tolist(), inverse.ravel().tolist(), float(scale), row.n))
            yield pd.DataFrame(out, columns=[*keys, "beta", "inverse", "scale", "n"])

    return table.mapInPandas(solve, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", beta array<double>, inverse array<double>, scale double, n long")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normative_model(rows: DataFrame, fit: str, at: str, x: str, sex: str, levels: list[str], df: int = 3, batch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(models, knots) of value ~ sex + natural spline of x with df degrees of freedom, fitted per place on the rows where fit is true."""
    rows = batch_residuals(rows, at, batch) if batch else rows
    train = rows.filter(fit)
    where = _written(train.groupBy(at).agg(_knots(x, df), F.avg("value").alias("centre")), "knots")
    return _written(fitted_models(_designed(train.join(where, at), x, sex, levels, df), at, len(levels) + df), "models"), where


def spline_z(rows: DataFrame, fit: str, at: str, x: str, sex: str, levels: list[str], df: int = 3, batch: str | None = None) -> DataFrame:
    """rows with z: the residual over the half width of the one-sigma prediction interval of the normative model.

    batch: values are first taken about the means of place and batch, over all rows. The value column holds what was
    modelled. Null where a place has no model, x or sex is null, or nothing varies.
    """
    rows = batch_residuals(rows, at, batch) if batch else rows
    models, where = normative_model(rows, fit, at, x, sex, levels, df)
    size = len(levels) + df
    own = _designed(rows.join(where, at, "left"), x, sex, levels, df).join(models, at, "left")
    return own.withColumn("z", _z(size)).drop("__x", "beta", "inverse", "scale", "n", "centre")


def _z(size: int) -> Column:
    """z of a row that has its design and its model."""
    x, beta, inverse = ([F.col(c)[k] for k in range(n)] for c, n in (("__x", size), ("beta", size), ("inverse", size * size)))

    def dot(a, b):
        return sum((p * q for p, q in zip(a, b, strict=True)), F.lit(0.0))

    lever = dot(x, [dot(inverse[a * size : (a + 1) * size], x) for a in range(size)])
    return F.try_divide(F.col("value") - F.col("centre") - dot(x, beta), F.col("scale") * F.sqrt(1 + lever))


def normative_curves(rows: DataFrame, grid: list[tuple[float, str]], fit: str, at: str, x: str, sex: str, levels: list[str], df: int = 3, batch: str | None = None) -> DataFrame:
    """(place, x, sex, expected): the model's curve at each of the grid's pairs of x and sex."""
    models, where = normative_model(rows, fit, at, x, sex, levels, df, batch)
    points = where.withColumn("point", F.explode(F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(b).alias("sex")) for a, b in grid])))
    points = _designed(points.select(at, "knots", "centre", F.col("point.x").alias(x), F.col("point.sex").alias(sex)), x, sex, levels, df)
    return points.join(models.select(at, "beta"), at).select(at, x, sex, (F.col("centre") + _dot(F.col("__x"), F.col("beta"))).alias("expected"))


def cross_validated_z(rows: DataFrame, fit: str, ident: str, at: str, x: str, sex: str, levels: list[str], seeds: int, share: float = 0.2, df: int = 3, batch: str | None = None) -> DataFrame:
    """Held-out rows of the controls (where fit is true) with seed 1..seeds and z by the model of the seed's other controls.

    A seed holds out the controls whose draw by ident and seed is below share, at all places alike. Models are down-dated: cross
    products of all controls are summed once per place, those of a seed's held-out rows are taken off, and no seed reads the rest
    again. The controls with their design, which are read three times, are written once below spark.checkpoint.dir. Knots, centre and batch means are those of all controls and rows, so seeds share one design. z is null where a
    model has no degree of freedom, or value, x or sex is null.
    """
    rows = batch_residuals(rows, at, batch) if batch else rows
    train, size = rows.filter(fit), len(levels) + df
    where = knots(train, at, x, df).join(train.groupBy(at).agg(F.avg("value").alias("centre")), at)
    path = scratch(rows.sparkSession, "controls")
    _designed(train.join(where, at), x, sex, levels, df).write.parquet(path)
    designed = rows.sparkSession.read.parquet(path)
    out_of = F.filter(F.sequence(F.lit(1), F.lit(seeds)), lambda s: uniform(F.col(ident), s) < share)
    held = designed.withColumn("seed", F.explode(out_of))
    whole, part = _cross_products(designed, [at], size), _cross_products(held, [at, "seed"], size)
    sums = [c for c in whole.columns if c != at]
    left = part.join(whole.select(at, *[F.col(c).alias(f"whole_{c}") for c in sums]), at)
    models = _solved(left.select(at, "seed", *[(F.col(f"whole_{c}") - F.col(c)).alias(c) for c in sums]), [at, "seed"], size)
    return held.join(models, [at, "seed"], "left").withColumn("z", _z(size)).drop("__x", "beta", "inverse", "scale", "n", "centre")
