"""What is read in before cohorts meet: similarity tables by their image paths, expression of homologous genes, coordinates of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.operators.relational import dealt
from cohortry.operators.voxels import flipped, transformed


def _number(path: str, mark: str) -> Column:
    """The number behind a mark in the file name of a path; null without one."""
    found = F.regexp_extract(F.element_at(F.split(path, "/"), -1), f"_{mark}_([0-9]+)", 1)
    return F.when(found != "", found.cast("long"))


def with_cluster_keys(pairs: DataFrame) -> DataFrame:
    """Pairs of image paths (img1, img2) with nk, k, Jacobians and cluster id 'nk-k' of either; 'NA' stands for a number that a name lacks."""
    keys: dict[str, Column] = {}
    for image in ("img1", "img2"):
        nk, k, kind = _number(image, "nk"), _number(image, "k"), F.regexp_extract(image, "absolute|relative", 0)
        keys |= {f"{image}_nk": nk, f"{image}_k": k, f"{image}_jacobians": F.when(kind != "", kind)}
        keys[f"{image}_cluster_id"] = F.concat_ws("-", *[F.coalesce(x.cast("string"), F.lit("NA")) for x in (nk, k)])
    return pairs.withColumns(keys)


def combined_jacobians(pairs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """The mean similarity of two clusters over all their Jacobians, from with_cluster_keys(); null where one is unknown.

    also: further keys, as the permutation a row is of. One aggregation, partial before it shuffles.
    """
    keys = [f"{image}_{x}" for image in ("img1", "img2") for x in ("cluster_id", "nk", "k")]
    known = F.nanvl(F.col("similarity").cast("double"), F.lit(None).cast("double"))
    return pairs.groupBy(*also, *keys).agg(F.when(F.count(known) == F.count("*"), F.avg(known)).alias("similarity"))


def intersected_homologues(first: DataFrame, second: DataFrame, pairs: DataFrame, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Expression (gene, ...) of two species where both have the gene: the first's under the second's names, and the second's.

    pairs: first_gene, second_gene; repeated pairs count once. A gene with several homologues gives its rows to each of them.
    rows: of the longest of the three tables, counted if not given; the number of tasks follows from it. Pairs travel twice,
    by the second gene to be sought there, and by the first to be made distinct and joined.
    """
    rows = max(df.count() for df in (first, second, pairs)) if rows is None else rows
    there = dealt(second.select(F.col("gene").alias("second_gene")), rows, "second_gene").distinct()
    known = dealt(pairs.select("first_gene", "second_gene").dropna(), rows, "second_gene").join(there, "second_gene", "left_semi")
    both = dealt(known, rows, "first_gene").distinct()
    named = dealt(first.withColumnRenamed("gene", "first_gene"), rows, "first_gene")
    renamed = named.join(both, "first_gene").drop("first_gene").withColumnRenamed("second_gene", "gene").select(*first.columns)
    kept = both.join(named.select("first_gene").distinct(), "first_gene", "left_semi").select(F.col("second_gene").alias("gene")).distinct()
    return renamed, second.join(kept, "gene", "left_semi").select(*second.columns)


def prepared_samples(samples: DataFrame, flags: DataFrame, matrix: Column) -> DataFrame:
    """Samples (sample, x, y, z, ...) that flags (sample, keep) keep, moved by an affine matrix between left-posterior-superior spaces.

    Coordinates come and go as right-anterior-superior. A sample without a flag, or with a null one, goes; one of several flags that keeps suffices.
    """
    kept = samples.join(flags.filter("keep").select("sample"), "sample", "left_semi")
    return flipped(transformed(flipped(kept), matrix)).select(*samples.columns)
