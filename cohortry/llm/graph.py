"""Connected components over edge tables, by rounds of label spreading and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import arrow_map, written


def thinned(edges: DataFrame, at_once: int = 500_000) -> DataFrame:
    """Edges (a, b) with the same components and no cycles within a task's blocks of at_once edges: union-find before any shuffle."""

    def make():
        def run(batches):
            parent: dict[int, int] = {}

            def root(x):
                while (p := parent.setdefault(x, x)) != x:
                    parent[x] = x = parent[p]
                return x

            def forest():
                pairs = [(root(x), x) for x in list(parent)]
                pairs = [(r, x) for r, x in pairs if r != x]
                parent.clear()
                return [r for r, _ in pairs], [x for _, x in pairs]

            n = 0
            for batch in batches:
                for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    a, b = root(a), root(b)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                    n += 1
                    if n >= at_once:
                        yield forest()
                        n = 0
            if parent:
                yield forest()

        return run

    return arrow_map(edges.select(F.col("a").cast("long"), F.col("b").cast("long")), make, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is one node of its component, the same for all of them.

    Each round keeps, for every node, the smallest root among its own and its neighbours' roots, hooks the old root
    to it, and jumps once along the pointers. Messages are pre-aggregated before they travel, so a node with many
    neighbours is a partial minimum per task. Rounds end when nothing changes, as roots only ever fall; each is a
    written table.
    """
    edges = written(thinned(edges))
    both = written(edges.union(edges.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "n"), F.col("b") == F.col("n")).groupBy(F.col("a").alias("m")).agg(F.min("root").alias("low"))
        better = labels.join(near, F.col("node") == F.col("m")).select("node", "root", F.least("root", "low").alias("low"))
        # A root learns the smallest root any of its nodes has seen; the node itself takes it too.
        better = written(better)
        told = better.filter("low < root").groupBy(F.col("root").alias("r")).agg(F.min("low").alias("hook"))
        if not told.limit(1).count():
            return labels
        told = told.select((F.col("r") + F.lit(0)).alias("r"), "hook")
        hooked = better.join(told, F.col("root") == F.col("r"), "left").select("node", F.least("low", F.coalesce("hook", "low")).alias("root"))
        hooked = written(hooked)
        jump = hooked.select(F.col("node").alias("t"), F.col("root").alias("up"))
        labels = written(hooked.join(jump, F.col("root") == F.col("t"), "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root")))
