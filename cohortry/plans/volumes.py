"""Queries of volumes written and read as files, and of user functions over voxels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators import voxels as V
from cohortry.plans.fixtures import VOXELS, Register, rounded, voxels
from cohortry.sources import volumes as S
from cohortry.sources.files import scratch

register = Register()

#: The 64 values of an embedding stand in for a volume.
SHAPE = (4, 4, 4)


@register(f"WITH {VOXELS}, mask AS (SELECT voxel FROM voxels GROUP BY 1 HAVING avg(value) > 0) SELECT image, voxel, value FROM voxels JOIN mask USING (voxel)")
def masked_volumes(spark: SparkSession, sf: str) -> DataFrame:
    """Every image written as a volume and read back within a mask, itself a volume: the voxels whose mean is positive."""
    folder, rows = scratch(spark, "volumes"), voxels(spark, sf)
    S.write_volumes(rows, f"{folder}/images", SHAPE)
    mask = rows.groupBy("voxel").agg((F.avg("value") > 0).cast("double").alias("value")).withColumn("image", F.lit("mask"))
    S.write_volumes(mask, f"{folder}/mask", SHAPE)
    return S.read_volumes(spark, f"{folder}/images", f"{folder}/mask/mask.nii.gz").withColumn("image", F.col("image").cast("long"))


def moments(matrix: np.ndarray, images: np.ndarray) -> dict[str, np.ndarray]:
    """Mean, standard deviation and slope over the images' numbers."""
    x = images - images.mean()
    return {"mean": matrix.mean(axis=0), "sd": matrix.std(axis=0, ddof=1), "slope": x @ (matrix - matrix.mean(axis=0)) / (x @ x)}


@register(f"WITH {VOXELS} SELECT voxel, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(1000 * regr_slope(value, image), 6) AS slope FROM voxels GROUP BY 1")
def voxel_function(spark: SparkSession, sf: str) -> DataFrame:
    """A user function over all images of each voxel, in blocks of 16 voxels."""
    done = V.over_voxels(voxels(spark, sf), moments, "mean double, sd double, slope double", per_block=16)
    return rounded(done.withColumn("slope", F.col("slope") * 1000), "mean", "sd", "slope")
