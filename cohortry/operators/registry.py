"""A parameter registry: rows of text parameters with an id, kept as Parquet; look-up and insertion by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(registry: DataFrame, **parameters) -> DataFrame:
    """Rows that have all given parameters; None matches null. Without parameters all rows."""
    for name, value in parameters.items():
        registry = registry.filter(F.col(name).eqNullSafe(F.lit(None if value is None else str(value)).cast("string")))
    return registry


def fetch_id(registry: DataFrame, **parameters) -> str | None:
    """The id of the one row that has the parameters; None without one. Several are an error."""
    found = lookup(registry, **parameters).select("id").limit(2).collect()
    if len(found) > 1:
        raise LookupError(f"several rows have {parameters}")
    return found[0].id if found else None


def with_ids(rows: DataFrame, parameters: list[str]) -> DataFrame:
    """Rows with an id made of their content: equal parameters have equal ids, on any machine."""
    parts = [F.concat(F.lit(f"{p}="), F.coalesce(F.col(p).cast("string"), F.lit("\0"))) for p in sorted(parameters)]
    return rows.withColumn("id", F.left(F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256), F.lit(16)))


def upserted(registry: DataFrame, rows: DataFrame, parameters: list[str]) -> DataFrame:
    """registry and those of rows it hasn't, each with its content id. Known rows keep the id they have."""
    new = with_ids(rows.select(*[F.col(p).cast("string").alias(p) for p in parameters]).distinct(), parameters)
    known = registry.select(*[F.col(p).alias(f"__{p}") for p in parameters])
    fresh = new.join(known, [F.col(p).eqNullSafe(F.col(f"__{p}")) for p in parameters], "left_anti")
    return registry.unionByName(fresh, allowMissingColumns=True)
