"""Volumes written and read back: masks, checks, failures; user functions over voxels against the built-in ones."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import voxels as V
from cohortry.sources import volumes as S

SCHEMA = "image string, voxel int, value double"


def rows(df):
    return sorted((r.image, r.voxel, r.value) for r in df.collect())


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "volumes")
    data = [(f"s{i}", v, i + v / 7) for i in range(40) for v in range(24) if (i + v) % 5]
    S.write_volumes(spark.createDataFrame(data, SCHEMA).repartition(7), path, (2, 3, 4), (0.5, 0.5, 1.0))
    assert sorted(os.listdir(path)) == sorted(f"s{i}.nii.gz" for i in range(40))
    held = {(i, v): x for i, v, x in data}
    want = sorted((f"s{i}", v, held.get((f"s{i}", v), 0.0)) for i in range(40) for v in range(24))
    assert rows(S.read_volumes(spark, path)) == want == rows(S.volumes(spark, path))
    assert S.volume_grid((tmp_path / "volumes" / "s3.nii.gz").read_bytes()) == ((2, 3, 4), (0.5, 0.5, 1.0))
    mask = str(tmp_path / "mask")
    S.write_volumes(spark.createDataFrame([("m", v, [0.4, 0.6, 1.0][v % 3]) for v in range(24)], SCHEMA), mask, (2, 3, 4), (0.5, 0.5, 1.0))
    assert rows(S.read_volumes(spark, path, f"{mask}/m.nii.gz")) == [r for r in want if r[1] % 3]
    assert rows(S.read_volumes(spark, path, f"{mask}/m.nii.gz", above=0.8)) == [r for r in want if r[1] % 3 == 2]
    S.write_volumes(spark.createDataFrame([("t", 1, None), ("t", 2, 3.0)], SCHEMA), path, (2, 3, 4), (0.5, 0.5, 1.0), fill=-1.0, mode="append")
    new = S.read_volumes(spark, path).filter("image = 't'").orderBy("voxel").collect()
    assert np.isnan(new[1].value) and [r.value for r in new[2:4]] == [3.0, -1.0] and len(os.listdir(path)) == 41
    S.write_volumes(spark.createDataFrame([("u", 0, 1.0)], SCHEMA), path, (1, 1, 1))
    assert os.listdir(path) == ["u.nii.gz"]


def test_different_grids_are_an_error(spark, tmp_path):
    path = str(tmp_path / "volumes")
    S.write_volumes(spark.createDataFrame([("a", 0, 1.0)], SCHEMA), path, (2, 2))
    S.write_volumes(spark.createDataFrame([("m", 0, 1.0)], SCHEMA), str(tmp_path / "mask"), (2, 2), (2.0, 1.0))
    with pytest.raises(Exception, match="mask have different"):
        S.read_volumes(spark, path, str(tmp_path / "mask" / "m.nii.gz")).collect()
    S.write_volumes(spark.createDataFrame([("b", 0, 1.0)], SCHEMA), path, (3, 2), mode="append")
    with pytest.raises(Exception, match="volumes have different"):
        S.read_volumes(spark, path).collect()


@pytest.mark.parametrize("bad", [("z", 99, 1.0), ("z", -1, 1.0), ("a0", 0, 1.0), (None, 0, 1.0), ("z", None, 1.0), ("x/y", 0, 1.0)])
def test_a_failed_job_leaves_no_file(spark, tmp_path, bad):
    path = str(tmp_path / "volumes")
    S.write_volumes(spark.createDataFrame([("old", 0, 1.0)], SCHEMA), path, (2, 2))
    data = [(f"a{k}", v, 1.0) for k in range(20) for v in range(4)] + [bad]
    with pytest.raises(Exception):
        S.write_volumes(spark.createDataFrame(data, SCHEMA), path, (2, 2))
    assert os.listdir(path) == ["old.nii.gz"]


def test_empty(spark, tmp_path):
    path = str(tmp_path / "volumes")
    S.write_volumes(spark.createDataFrame([], SCHEMA), path, (2, 2))
    assert S.read_volumes(spark, path).count() == 0


def test_functions_over_voxels(spark):
    rng = np.random.default_rng(1)
    data = [(f"i{i}", v, float(rng.normal()) if rng.random() > 0.1 else None) for i in range(30) for v in range(50) if rng.random() > 0.1]
    table = spark.createDataFrame(data, SCHEMA)

    def summary(matrix, images):
        assert list(images) == sorted(images)
        return {"mean": np.nanmean(matrix, axis=0), "sd": np.nanstd(matrix, axis=0, ddof=1), "n": np.isfinite(matrix).sum(axis=0)}

    want = {r.voxel: r for r in table.groupBy("voxel").agg(F.avg("value").alias("mean"), F.stddev("value").alias("sd"), F.count("value").alias("n")).collect()}
    for per_block in (1, 7, 4096):
        got = V.over_voxels(table, summary, "mean double, sd double, n long", per_block).collect()
        assert len(got) == 50
        for r in got:
            assert abs(r.mean - want[r.voxel].mean) < 1e-12 and abs(r.sd - want[r.voxel].sd) < 1e-12 and r.n == want[r.voxel].n
    with pytest.raises(Exception, match="voxel twice"):
        V.over_voxels(table.union(table), summary, "mean double, sd double, n long").collect()
    assert V.over_voxels(table.limit(0), summary, "mean double, sd double, n long").count() == 0
