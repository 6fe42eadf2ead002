"""What the text operators share: table reading, a shared scratch folder, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the session has no such setting, a local master gets a temporary one (tests); a cluster is refused, as its
    machines would write to folders of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cohortry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/cohortry-{uuid.uuid4().hex}"


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FILE, ROW = "__file", "__row"


def with_row_keys(docs: DataFrame) -> DataFrame:
    """docs with two columns more that name each row: the hash of its file's path and its place in that file.

    They are the same at every reading. Rows that don't come straight from files are written first.
    """
    try:
        return docs.withColumns({FILE: F.xxhash64("_metadata.file_path"), ROW: F.col("_metadata.row_index")})
    except AnalysisException:
        return written(docs).withColumns({FILE: F.xxhash64("_metadata.file_path"), ROW: F.col("_metadata.row_index")})


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs, which with_row_keys() has made, without those of rows. Where rows are few, Spark broadcasts them, by its size threshold."""
    gone = written(rows.select(F.col(FILE).alias("gone_file"), F.col(ROW).alias("gone_row")))
    return docs.join(gone, (F.col(FILE) == F.col("gone_file")) & (F.col(ROW) == F.col("gone_row")), "left_anti").drop(FILE, ROW)


def all_but_first(rows: DataFrame, group: list[str], ident: str) -> DataFrame:
    """Of rows with row keys those that aren't the first of their group, by ident (null last) and row key.

    First ones are partial minima, and meet the rows by row key, so that a large group is no hot key.
    """
    first = rows.groupBy(*group).agg(F.min(F.struct(F.col(ident).isNull().alias("none"), F.col(ident).alias("ident"), FILE, ROW)).alias("x"))
    first = first.select(F.col(f"x.{FILE}").alias("first_file"), F.col(f"x.{ROW}").alias("first_row"))
    return rows.join(first, (F.col(FILE) == F.col("first_file")) & (F.col(ROW) == F.col("first_row")), "left_anti")


def opened(path: str):
    """The file system of a path or URI (file, hdfs, s3, gs) and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def arrow_map(df: DataFrame, make: Callable[[], Callable], schema) -> DataFrame:
    """mapInArrow where make() is called once per task and gives a function from a batch iterator to column lists."""
    from pyspark.sql.types import StructType

    spark_schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in make()(batches):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, spark_schema)


def crc_mod(key: str, n: int):
    """crc32 of the key written as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n
