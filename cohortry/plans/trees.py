"""Hierarchy queries: region, nation and supplier stand in for an anatomical tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators import hierarchy as H
from cohortry.plans.fixtures import Register, rounded, table

register = Register()

_TREE = "WITH tree AS (SELECT 'root' AS node, NULL AS parent UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), c AS (SELECT node, node AS ancestor, 0 AS distance FROM tree UNION ALL SELECT t.node, p.parent, 1 FROM tree t JOIN tree p ON p.node = t.node WHERE p.parent IS NOT NULL UNION ALL SELECT t.node, g.parent, 2 FROM tree t JOIN tree g ON g.node = t.parent WHERE g.parent IS NOT NULL UNION ALL SELECT t.node, g.parent, 3 FROM tree t JOIN tree p ON p.node = t.parent JOIN tree g ON g.node = p.parent WHERE g.parent IS NOT NULL)"


def _tree(spark, sf):
    root = spark.createDataFrame([("root", None)], "node string, parent string")
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("root").alias("parent"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    return root.union(r).union(n).union(s)


def _cuts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


@register(f"{_TREE} SELECT node, max(distance)::INT AS level FROM c GROUP BY 1")
def tree_levels(spark: SparkSession, sf: str) -> DataFrame:
    return H.levels(_tree(spark, sf))


@register(f"{_TREE} SELECT node, ancestor, distance::INT AS distance FROM c")
def tree_closure(spark, sf):
    return H.closure(_tree(spark, sf))


@register(f"{_TREE} SELECT node, parent FROM tree WHERE node NOT IN (SELECT node FROM c WHERE ancestor IN ('r1', 'n0'))")
def prune_at(spark, sf):
    return H.pruned_at(_tree(spark, sf), _cuts(spark, "r1", "n0")).select("node", "parent")


@register(f"{_TREE} SELECT node, parent FROM tree WHERE node NOT IN (SELECT node FROM c WHERE ancestor IN ('r1', 'n0') AND distance > 0)")
def prune_below(spark, sf):
    return H.pruned_below(_tree(spark, sf), _cuts(spark, "r1", "n0")).select("node", "parent")


@register(f"{_TREE} SELECT node, parent FROM tree WHERE node IN (SELECT ancestor FROM c WHERE node IN ('s1', 's2', 'n5'))")
def keep_paths(spark, sf):
    return H.to_targets(_tree(spark, sf), _cuts(spark, "s1", "s2", "n5")).select("node", "parent")


@register(f"{_TREE} SELECT node, parent FROM tree WHERE node NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL)")
def tree_leaves(spark, sf):
    return H.leaves(_tree(spark, sf)).select("node", "parent")


@register(f"{_TREE} SELECT t.node, m.label FROM tree t LEFT JOIN (SELECT ancestor AS node, min(s_suppkey) AS label FROM c JOIN supplier ON c.node = 's' || s_suppkey GROUP BY 1) m USING (node)")
def relabel_subtrees(spark, sf):
    labels = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_suppkey").alias("label"))
    return H.relabelled(_tree(spark, sf), labels)


@register(f"{_TREE} SELECT ancestor AS node, round(sum(s_acctbal), 2) AS total, count(*) AS n FROM c JOIN supplier ON c.node = 's' || s_suppkey GROUP BY 1")
def aggregate_up(spark, sf):
    values = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_acctbal").alias("value"))
    return rounded(H.aggregated_up(_tree(spark, sf), values), "total", places=2)


@register(f"{_TREE} SELECT node, arg_min(ancestor, distance) AS structure FROM c WHERE ancestor IN ('r0', 'r2', 'n3', 'root') GROUP BY 1")
def coarse_structure(spark, sf):
    return H.coarse_label(_tree(spark, sf), _cuts(spark, "r0", "r2", "n3", "root"))
