"""Low-rank and discriminant models from cross products: principal components, linear discriminants, partial least squares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cross_products(rows: DataFrame, vector: str, weight: str | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sum of the vectors and sum of their outer products; tasks sum their own rows, so only square tables travel.

    For vectors of a bounded number of places (documented: a table of its square must fit the driver).
    """
    columns = [F.col(vector)] + ([F.col(weight)] if weight else [])

    def partial(batches):
        n, s, q = 0, None, None
        for pdf in batches:
            x = np.array(pdf.iloc[:, 0].tolist(), float).reshape(len(pdf), -1)
            if len(x):
                s, q, n = x.sum(axis=0) + (0 if s is None else s), x.T @ x + (0 if q is None else q), n + len(x)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "q": [q.ravel().tolist()]})

    parts = rows.select(*columns).mapInPandas(partial, "n long, s array<double>, q array<double>")
    summed = parts.agg(F.sum("n").alias("n")).first().n or 0
    if not summed:
        return 0, np.zeros(0), np.zeros((0, 0))

    def places(column):
        got = parts.select(F.posexplode(column).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
        return np.array([r.v for r in got])

    s = places("s")
    return summed, s, places("q").reshape(len(s), len(s))


def _signed(columns: np.ndarray) -> np.ndarray:
    """Columns whose largest entry by size is positive, so that signs don't depend on the solver."""
    top = columns[np.abs(columns).argmax(axis=0), np.arange(columns.shape[1])]
    return columns * np.where(top < 0, -1, 1)


def principal_components(rows: DataFrame, vector: str, k: int, scaled: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, loadings, variances) of the first k components of centred (and scaled) vectors; places without spread have scale 1."""
    n, s, q = cross_products(rows, vector)
    mean = s / n
    cov = (q - n * np.outer(mean, mean)) / (n - 1)
    scale = np.sqrt(np.diag(cov)) if scaled else np.ones(len(mean))
    scale = np.where(scale > 0, scale, 1.0)
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(-values, kind="stable")[:k]
    return mean, scale, _signed(vectors[:, order]), values[order]


def projected(rows: DataFrame, vector: str, mean: np.ndarray, scale: np.ndarray, loadings: np.ndarray, out: str = "scores") -> DataFrame:
    """rows with the scores of their vectors, as an array: one dot product a component, in the JVM."""
    def dot(weights, shift):
        return F.aggregate(F.zip_with(F.col(vector), F.array(*map(F.lit, weights.tolist())), lambda x, w: x.cast("double") * w), F.lit(0.0), lambda s, x: s + x) - float(shift)

    weights = loadings / scale[:, None]
    return rows.withColumn(out, F.array(*[dot(weights[:, k], mean @ weights[:, k]) for k in range(weights.shape[1])]))


def linear_discriminant(rows: DataFrame, vector: str, label: str) -> tuple[np.ndarray, float]:
    """(weights, cut) of two classes (label 0 or 1) with equal priors: label 1 where the weighted sum exceeds cut. The pooled within-class covariance is pseudo-inverted."""
    parts = {k: cross_products(rows.filter(F.col(label) == k), vector) for k in (0, 1)}
    if not parts[0][0] or not parts[1][0]:
        raise ValueError("a discriminant needs rows of both classes")
    means = {k: s / n for k, (n, s, _) in parts.items()}
    within = sum(q - n * np.outer(means[k], means[k]) for k, (n, _, q) in parts.items()) / max(1, parts[0][0] + parts[1][0] - 2)
    weights = np.linalg.pinv(within) @ (means[1] - means[0])
    return weights, float(weights @ (means[0] + means[1]) / 2)


def partial_least_squares(rows: DataFrame, vector: str, label: str, k: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, rotations) of k components of scaled vectors against a 0/1 label, from cross products (deflating the covariance, not the rows)."""
    joined = rows.select(F.concat(F.transform(F.col(vector), lambda v: v.cast("double")), F.array(F.col(label).cast("double"))).alias("v"))
    n, s, q = cross_products(joined, "v")
    mean = s / n
    cov = (q - n * np.outer(mean, mean)) / (n - 1)
    scale = np.sqrt(np.diag(cov))
    scale = np.where(scale > 0, scale, 1.0)
    cov = cov / np.outer(scale, scale)
    xx, xy = cov[:-1, :-1], cov[:-1, -1]
    weights, loadings = [], []
    for _ in range(k):
        w = xy / np.linalg.norm(xy)
        t = w @ xx @ w
        p = xx @ w / t
        weights.append(w)
        loadings.append(p)
        xy = xy - p * (w @ xy)
        xx = xx - t * np.outer(p, p)
    w, p = np.array(weights).T, np.array(loadings).T
    return mean[:-1], scale[:-1], _signed(w @ np.linalg.inv(p.T @ w))
