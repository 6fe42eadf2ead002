"""Readers and writers of the file kinds that cohort pipelines exchange."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, schema: str | None = None, separator: str = ",") -> DataFrame:
    """A CSV or TSV file with a header. Without a schema all columns are text: types are never guessed from the data."""
    reader = spark.read.option("header", True).option("sep", separator)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", False).csv(path)


def gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, genes) from lines of tab-separated id, title and genes; repeated ids get a running number."""
    parts = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_path"), F.monotonically_increasing_id().alias("at"), F.split("value", "\t").alias("p"))
    again = F.row_number().over(Window.partitionBy(F.get("p", F.lit(0))).orderBy("file_path", "at")) - 1
    own = F.get("p", F.lit(0))
    return parts.select(F.concat(own, F.when(again > 0, F.concat(F.lit("."), again.cast("string"))).otherwise("")).alias("id"), F.get("p", F.lit(1)).alias("title"), F.filter(F.expr("slice(p, 3, greatest(size(p) - 2, 0))"), lambda g: g != "").alias("genes"))


def members(sets: DataFrame) -> DataFrame:
    return sets.select(F.col("id").alias("module"), F.explode("genes").alias("gene")).distinct()


def tree_json(spark: SparkSession, path: str, children: str = "children", deepest: int = 32) -> DataFrame:
    """(node, parent, name) from JSON objects nested through a list of children, one document a file.

    The document is parsed once; each level is exploded as text, so the depth needn't be known beforehand.
    """
    level = spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"), F.lit(None).cast("string").alias("parent"))
    out = None
    for _ in range(deepest):
        rows = level.select(F.get_json_object("doc", "$.id").alias("node"), "parent", F.get_json_object("doc", "$.name").alias("name"), F.get_json_object("doc", f"$.{children}").alias("below"))
        out = rows.drop("below") if out is None else out.unionByName(rows.drop("below"))
        level = rows.filter("below IS NOT NULL").select(F.explode(F.from_json("below", "array<string>")).alias("doc"), F.col("node").alias("parent"))
        if level.isEmpty():
            return out
    raise ValueError(f"the tree is deeper than {deepest} levels")


def with_file_id(df: DataFrame, pattern: str, name: str, kind: str = "int") -> DataFrame:
    """df, read from many files, with the part of each file's name that the pattern captures; null where it doesn't match."""
    captured = F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)
    return df.select("*", F.when(captured != "", captured).cast(kind).alias(name))


def numbered_files(spark: SparkSession, folder: str, pattern: str, schema: str, name: str = "number", glob: str = "*.csv") -> DataFrame:
    """All CSV files of a folder whose names match, in one read, with their number."""
    rows = spark.read.option("header", True).option("pathGlobFilter", glob).schema(schema).csv(folder)
    return with_file_id(rows, pattern, name).filter(F.col(name).isNotNull())


def long_matrix(df: DataFrame, key: str) -> DataFrame:
    """(key, at, value) from a wide numeric table with one column per place; at is the column's name."""
    places = [c for c in df.columns if c != key]
    return df.unpivot(key, places, "at", "value").withColumn("value", F.col("value").cast("double"))


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def to_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def to_tags(points: DataFrame, path: str) -> None:
    """Point lines ' x y z "label"' of coordinate tags."""
    points.select(F.format_string(' %f %f %f "%s"', "x", "y", "z", F.col("label").cast("string"))).write.mode("overwrite").text(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files, below spark.checkpoint.dir, which driver and executors share; only a local master may do without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
