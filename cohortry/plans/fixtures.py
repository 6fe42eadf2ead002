"""How the test tables stand in for cohorts, images and gene sets, and the register of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators.voxels import voxel_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Register:
    """Queries by name, with the DuckDB SQL that says the same."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Sums depend on their order in the last digits, so what is compared is rounded; + 0.0 makes -0.0 positive."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) + F.lit(0.0) for c in columns})


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxel_table(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long cluster labels of the images: nk 2, 5 and 10."""
    wide = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), (F.col("label") % 2).alias("2"), (F.col("label") % 5).alias("5"), F.col("label").alias("10"))
    return wide.unpivot("image", ["2", "5", "10"], "nk", "k").withColumns({"nk": F.col("nk").cast("int"), "k": F.col("k").cast("int")})


#: The same in SQL.
VOXELS = "voxels AS (SELECT vec_id AS image, (i - 1)::INT AS voxel, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) r(i))"
CLUSTERS = "clusters AS (SELECT vec_id AS image, nk::INT AS nk, (label % nk)::INT AS k FROM embeddings, (VALUES (2), (5), (10)) v(nk))"
