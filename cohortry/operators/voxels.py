"""Images as long tables (image, voxel, value): masking, thresholds, label counts, correlation, peaks, centroids."""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def voxel_table(df: DataFrame, image: str, values: str) -> DataFrame:
    """(image, voxel, value) from arrays; voxel from 0. The array column is exploded in the scan's stage, no shuffle."""
    return df.select(F.col(image).alias("image"), F.posexplode(values).alias("voxel", "value")).select("image", "voxel", F.col("value").cast("double").alias("value"))


def masked(voxels: DataFrame, mask: DataFrame, above: float = 0.5) -> DataFrame:
    """Voxels whose mask weight is above the given one. The mask is one image in size, so it may be broadcast by Spark."""
    return voxels.join(mask.filter(F.col("w") > above).select("voxel"), "voxel", "left_semi")


def scattered(values: DataFrame, grid: DataFrame) -> DataFrame:
    """Each image's values on the whole grid (image x voxel), 0 where it has none."""
    return grid.join(values, ["image", "voxel"], "left").fillna({"value": 0.0})


def intensity_threshold(voxels: DataFrame, threshold: float = 0.5, symmetric: bool = True, above: bool = True) -> DataFrame:
    """Values beyond the threshold, strictly; the rest 0. symmetric: magnitudes are compared."""
    v, t = (F.abs("value"), abs(threshold)) if symmetric else (F.col("value"), threshold)
    return voxels.withColumn("value", F.when(v > t if above else v < t, F.col("value")).otherwise(0.0))


def top_threshold(voxels: DataFrame, n: float = 0.2, symmetric: bool = True, tolerance: float = 1e-5) -> DataFrame:
    """The n highest values of each image, others 0; 0 < n < 1 is a share of candidates, n < 0 asks for the lowest ones.

    Candidates are above the tolerance in magnitude and, unless symmetric, of the sign asked for. Ties go to the lower voxel.
    """
    if n == 0 or (symmetric and n < 0):
        raise ValueError("n is 0, or negative with symmetric=True")
    size = F.abs("value") if symmetric else F.col("value") if n > 0 else -F.col("value")
    candidate = (size > 0) & (F.abs("value") > tolerance)
    image = Window.partitionBy("image")
    count = F.count_if(candidate).over(image)
    keep = F.floor(F.lit(abs(n)) * count) if abs(n) < 1 else F.lit(int(abs(n)))
    rank = F.row_number().over(image.orderBy(F.when(candidate, size).desc_nulls_last(), "voxel"))
    ranked = voxels.withColumns({"__keep": keep, "__rank": rank, "__is": candidate})
    return ranked.withColumn("value", F.when(F.col("__is") & (F.col("__rank") <= F.col("__keep")), F.col("value")).otherwise(0.0)).drop("__keep", "__rank", "__is")


def sign_mask(value: Column, signed: bool = True) -> Column:
    return F.signum(value).cast("int") if signed else (value != 0).cast("int")


def label_counts(voxels: DataFrame, labels: DataFrame, definitions: DataFrame, sign: int = 0) -> DataFrame:
    """Per image and defined label: surviving voxels and their share; labels that no voxel has count 0. sign: only + or - values."""
    live = voxels.filter(F.col("value") != 0 if sign == 0 else F.signum("value") == sign)
    counted = live.join(labels.filter("label <> 0"), "voxel").groupBy("image", "label").agg(F.count("*").alias("n"))
    grid = voxels.select("image").distinct().join(F.broadcast(definitions))
    full = grid.join(counted, ["image", "label"], "left").fillna({"n": 0})
    return full.withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy("image"))), F.lit(0.0)))


def correlated(pairs: DataFrame, x: str, y: str, groups: list[str]) -> DataFrame:
    """Pearson correlation per group; null where one side is constant."""
    return pairs.groupBy(*groups).agg(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r"))


def centroids(voxels: DataFrame, clusters: DataFrame, how: str = "mean") -> DataFrame:
    """Voxel-wise mean, median or standard deviation of the images of each cluster (nk, k). clusters: image, nk, k."""
    agg = {"mean": F.avg, "median": F.median, "sd": F.stddev_samp}[how]
    return voxels.join(clusters, "image").groupBy("nk", "k", "voxel").agg(agg("value").alias("value"))


def peaks(voxels: DataFrame, width: int) -> DataFrame:
    """Voxels of a width x ... plane that are higher than all of their up to eight neighbours."""
    at = voxels.select("image", "voxel", "value", (F.col("voxel") % width).alias("x"), F.floor(F.col("voxel") / width).cast("int").alias("y"))
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)])
    near = at.select("image", F.col("value").alias("other"), F.explode(steps).alias("d"), "x", "y").select("image", "other", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"))
    high = near.groupBy("image", "x", "y").agg(F.max("other").alias("highest"))
    return at.join(high, ["image", "x", "y"], "left").filter(F.col("highest").isNull() | (F.col("value") > F.col("highest"))).select("image", "voxel", "value")


def one_sample_t(voxels: DataFrame) -> DataFrame:
    """Per voxel the mean over images, its t statistic against 0 and the count."""
    out = voxels.groupBy("voxel").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))
    return out.select("voxel", "mean", F.try_divide(F.col("mean") * F.sqrt("n"), F.col("sd")).alias("t"), "n")


def nearest_voxel(points: DataFrame, origin: tuple[float, float, float], step: float) -> DataFrame:
    """World coordinates (x, y, z) to voxel numbers (i, j, k) of a grid, nearest, halves to even."""
    return points.withColumns({v: F.rint((F.col(w) - o) / step).cast("int") for v, w, o in zip("ijk", "xyz", origin, strict=True)})


def flipped(points: DataFrame) -> DataFrame:
    """Coordinates between right-anterior-superior and left-posterior-superior: x and y change sign."""
    return points.withColumns({"x": -F.col("x"), "y": -F.col("y")})


def thresholded(voxels: DataFrame, method: str, **options) -> DataFrame:
    """intensity_threshold or top_threshold, by name."""
    return {"intensity": intensity_threshold, "top_n": top_threshold}[method](voxels, **options)


def partial_mask(mask: DataFrame, n: int, above: float = 0.5) -> DataFrame:
    """The first n voxels of a mask (voxel, w), by number."""
    return mask.filter(F.col("w") > above).orderBy("voxel").limit(n)


def peaks_in_space(voxels: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Voxels of a grid (x fastest) that are higher than all of their up to 26 neighbours."""
    nx, ny, _ = shape
    at = voxels.select("image", "voxel", "value", (F.col("voxel") % nx).alias("x"), (F.floor(F.col("voxel") / nx) % ny).cast("int").alias("y"), F.floor(F.col("voxel") / (nx * ny)).cast("int").alias("z"))
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(d, ("dx", "dy", "dz"), strict=True)]) for d in itertools.product((-1, 0, 1), repeat=3) if d != (0, 0, 0)])
    near = at.select("image", F.col("value").alias("other"), F.explode(steps).alias("d"), "x", "y", "z").select("image", "other", *[(F.col(c) + F.col(f"d.d{c}")).alias(c) for c in "xyz"])
    high = near.groupBy("image", "x", "y", "z").agg(F.max("other").alias("highest"))
    return at.join(high, ["image", "x", "y", "z"], "left").filter(F.col("highest").isNull() | (F.col("value") > F.col("highest"))).select("image", "voxel", "value")


def _cell(m: Column, i: int, j: int) -> Column:
    return m[4 * i + j]


def composed(first: Column, then: Column) -> Column:
    """The affine matrix (16 doubles, row by row) that applies `first` and then `then`."""
    return F.array(*[functools.reduce(operator.add, [_cell(then, i, k) * _cell(first, k, j) for k in range(4)]) for i in range(4) for j in range(4)])


def inverted(m: Column) -> Column:
    """The inverse of an affine matrix whose last row is 0 0 0 1; null where it flattens space."""
    a = [[_cell(m, i, j) for j in range(3)] for i in range(3)]

    def minor(i, j):
        (p, q), (r, s) = ([k for k in range(3) if k != x] for x in (i, j))
        return (a[p][r] * a[q][s] - a[p][s] * a[q][r]) * (-1 if (i + j) % 2 else 1)

    size = a[0][0] * minor(0, 0) + a[0][1] * minor(0, 1) + a[0][2] * minor(0, 2)
    turned = [[minor(j, i) / F.nullif(size, F.lit(0.0)) for j in range(3)] for i in range(3)]
    moved = [-(turned[i][0] * _cell(m, 0, 3) + turned[i][1] * _cell(m, 1, 3) + turned[i][2] * _cell(m, 2, 3)) for i in range(3)]
    zero = F.lit(0.0)
    return F.when(size != 0, F.array(*[x for i in range(3) for x in (*turned[i], moved[i])], zero, zero, zero, F.lit(1.0)))


def transformed(points: DataFrame, matrix: Column) -> DataFrame:
    """Coordinates x, y, z moved by an affine matrix, which may differ by row; other columns stay."""
    return points.withColumn("__m", matrix).withColumns({w: _cell(F.col("__m"), i, 0) * F.col("x") + _cell(F.col("__m"), i, 1) * F.col("y") + _cell(F.col("__m"), i, 2) * F.col("z") + _cell(F.col("__m"), i, 3) for i, w in enumerate("xyz")}).drop("__m")


def over_voxels(voxels: DataFrame, function: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str, per_block: int = 4096) -> DataFrame:
    """(voxel, then schema) of a vectorised user function over all images' values of each voxel.

    function gets a matrix of images by voxels, NaN where an image lacks a voxel, and the sorted images, and returns an array per
    column of schema, an entry per voxel. Voxels go to blocks of per_block neighbours by number, so a task holds images x per_block
    values at a time, whatever the volume; the function sees each voxel whole and once, and results don't depend on per_block as long
    as it treats voxels apart. Nulls are as if missing; a voxel twice in an image is an error.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        images, row = np.unique(pdf.image.to_numpy(), return_inverse=True)
        places, column = np.unique(pdf.voxel.to_numpy(), return_inverse=True)
        if len(np.unique(row * len(places) + column)) < len(pdf):
            raise ValueError("an image has a voxel twice")
        matrix = np.full((len(images), len(places)), np.nan)
        matrix[row, column] = pdf.value.to_numpy(float)
        return pd.DataFrame({"voxel": places} | function(matrix, images))

    rows = voxels.select("image", "voxel", F.col("value").cast("double").alias("value"), F.floor(F.col("voxel") / per_block).alias("block"))
    return rows.groupBy("block").applyInPandas(run, f"voxel {dict(voxels.dtypes)['voxel']}, {schema}")
