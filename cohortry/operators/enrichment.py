"""Gene-set enrichment: modules, hypergeometric tests, networks, agreement, ROC, precision and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.operators.relational import below_sums, dealt


def log_factorials(spark: SparkSession, most: int) -> DataFrame:
    """(n, lf): logarithms of n! for 0..most, summed in blocks so that no window holds all of them.

    A block has at most 1,000 rows, and there is one row per block for what lies below it.
    """
    rows = spark.range(0, most + 1).select(F.col("id").alias("n"), F.floor(F.col("id") / 1000).alias("block"), F.when(F.col("id") > 0, F.ln(F.col("id").cast("double"))).otherwise(0.0).alias("l"))
    within = rows.withColumn("part", F.sum("l").over(Window.partitionBy("block").orderBy("n")))
    sums = rows.groupBy("block").agg(F.sum("l").alias("s"))
    below = sums.withColumn("below", F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("block", F.coalesce("below", F.lit(0.0)).alias("below"))
    return within.join(F.broadcast(below), "block").select("n", (F.col("part") + F.col("below")).alias("lf"))


def overlap_counts(foreground: DataFrame, universe: DataFrame, modules: DataFrame) -> DataFrame:
    """Per target set and module: hit (foreground genes in it), size (universe genes in it), chosen and total (all of either).

    foreground: target, gene; universe: gene, to which the foreground is added; modules: module, gene. Sets are made
    distinct; modules without universe genes are dropped, those without foreground genes have hit = 0.
    """
    fg = foreground.select("target", "gene").distinct()
    every = universe.select("gene").union(fg.select("gene")).distinct()
    inside = modules.select("module", "gene").distinct().join(every, "gene", "left_semi")
    big = inside.groupBy("module").agg(F.count("*").alias("size"))
    small = fg.groupBy("target").agg(F.count("*").alias("chosen"))
    hits = fg.join(inside, "gene").groupBy("target", "module").agg(F.count("*").alias("hit"))
    total = every.agg(F.count("*").alias("total"))
    grid = small.join(big).join(F.broadcast(total))
    return grid.join(hits, ["target", "module"], "left").fillna({"hit": 0})


def hypergeometric(counts: DataFrame, factorials: DataFrame, keys: list[str]) -> DataFrame:
    """counts (hit, size, chosen, total) with enrichment = (hit/chosen) / (size/total) and p = P(X >= hit).

    p sums exponentials of log factorials over the tail, at most min(chosen, size) - hit + 1 terms a row. hit = 0 has
    p = 1. The log factorials, one row for each number up to total, are joined by number.
    """
    terms = counts.filter("hit > 0").withColumn("k", F.explode(F.sequence("hit", F.least("chosen", "size"))))
    terms = terms.filter("chosen - k <= total - size")
    signs = {"size": 1, "total - size": 1, "chosen": 1, "total - chosen": 1, "k": -1, "size - k": -1, "chosen - k": -1, "total - size - chosen + k": -1, "total": -1}
    needed = F.array(*[F.struct(F.expr(x).alias("number"), F.lit(sign).alias("sign")) for x, sign in signs.items()])
    logs = terms.select(*keys, "k", F.explode(needed).alias("f")).join(factorials, F.col("f.number") == F.col("n"))
    logs = logs.groupBy(*keys, "k").agg(F.sum(F.col("f.sign") * F.col("lf")).alias("log"))
    tail = logs.groupBy(*keys).agg(F.sum(F.exp("log")).alias("p"))
    rate = F.try_divide(F.col("hit") * F.col("total").cast("double"), F.col("chosen") * F.col("size"))
    return counts.join(tail, keys, "left").select(*keys, "hit", "size", "chosen", "total", rate.alias("enrichment"), F.least(F.lit(1.0), F.coalesce("p", F.lit(1.0))).alias("p"))


def co_occurrence(members: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, score): items a < b and the pairs of their rows within groups; rows without group or item have none.

    Pairs may be many times the rows, so both are counted first (from group sizes, in a run of its own), and dealt to tasks
    by their number. The join makes a group's pairs one after the other; no task holds them as a list.
    """
    known = members.select(F.col(group).alias("group"), F.col(item).alias("a")).dropna()
    n = known.count()
    sizes = dealt(known.select("group"), n, "group").groupBy("group").agg(F.count("*").alias("n"))
    most = sizes.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
    rows = dealt(known, n, "group")
    pairs = rows.join(rows.withColumnRenamed("a", "b"), "group").filter("a < b").select("a", "b")
    return dealt(pairs, most, "a", "b").groupBy("a", "b").agg(F.count("*").alias("score"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, least: float) -> DataFrame:
    """(seed, gene): partners of each seed along edges (a, b, score) of at least `least`, and the seed; itself alone if it has none."""
    strong = edges.filter(F.col("score") >= least)
    ends = strong.select(F.explode(F.array(F.struct(F.col("a").alias("seed"), F.col("b").alias("gene")), F.struct(F.col("b").alias("seed"), F.col("a").alias("gene")))).alias("e")).select("e.*")
    return ends.join(seeds, "seed", "left_semi").union(seeds.select("seed", F.col("seed").alias("gene"))).distinct()


def bridged(genes: DataFrame, bridge: DataFrame, source: str, target: str) -> DataFrame:
    """Genes (gene) of one species in the other, through classes: bridge has class, species, symbol."""
    a = bridge.filter(F.col("species") == source).select("class", F.col("symbol").alias("gene"))
    b = bridge.filter(F.col("species") == target).select("class", F.col("symbol").alias("other"))
    return genes.join(a, "gene").join(b, "class").select("gene", "other").distinct()


def confusion(rows: DataFrame, truth: Column, guess: Column, groups: list[str] | None = None) -> DataFrame:
    agg = [F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn")]
    out = rows.groupBy(*(groups or [])).agg(*agg)
    return out.withColumns({
        "accuracy": F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")),
        "sensitivity": F.try_divide("tp", F.col("tp") + F.col("fn")),
        "specificity": F.try_divide("tn", F.col("tn") + F.col("fp")),
        "ppv": F.try_divide("tp", F.col("tp") + F.col("fp")),
        "npv": F.try_divide("tn", F.col("tn") + F.col("fn")),
    })


def roc_area(rows: DataFrame, score: str, truth: Column, groups: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve from counts per distinct score, ties counting half; null with one class only.

    Scores are counted before they are ordered: a window row per distinct score, not per row.
    """
    groups = groups or []
    counted = rows.groupBy(*groups, score).agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))
    if groups:
        w = Window.partitionBy(*groups).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    else:
        placed = below_sums(counted, score, ["neg"]).withColumnRenamed("below_neg", "below")
    return placed.groupBy(*groups).agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def precision_recall(rows: DataFrame, score: str, truth: Column) -> DataFrame:
    """(score, precision, recall) at each distinct score, rows of that score or higher counted as positive."""
    counted = rows.groupBy(score).agg(F.count_if(truth).alias("pos"), F.count("*").alias("n"))
    total = counted.agg(F.sum("pos").alias("total"))
    run = below_sums(counted, score, ["pos", "n"], descending=True).select(score, (F.col("below_pos") + F.col("pos")).alias("tp"), (F.col("below_n") + F.col("n")).alias("called")).join(F.broadcast(total))
    return run.select(score, (F.col("tp") / F.col("called")).alias("precision"), F.try_divide("tp", "total").alias("recall"))


def mutual_information(rows: DataFrame, x: Column, y: Column, groups: list[str]) -> DataFrame:
    """Mutual information in bits of two booleans per group."""
    n = {(a, b): F.count_if((x if a else ~x) & (y if b else ~y)).cast("double").alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)}
    out = rows.groupBy(*groups).agg(*n.values())
    total = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")

    def term(a, b):
        joint, row, column = F.col(f"n{a}{b}"), F.col(f"n{a}0") + F.col(f"n{a}1"), F.col(f"n0{b}") + F.col(f"n1{b}")
        return F.when(joint > 0, joint / total * F.log2(joint * total / (row * column))).otherwise(0.0)

    return out.select(*groups, (term(0, 0) + term(0, 1) + term(1, 0) + term(1, 1)).alias("bits"))


def average_precision(rows: DataFrame, score: str, truth: Column) -> DataFrame:
    """One row: the area under precision over recall by steps, and the share of positive rows, which is what a random score gets."""
    counted = rows.groupBy(score).agg(F.count_if(truth).alias("pos"), F.count("*").alias("n"))
    run = below_sums(counted, score, ["pos", "n"], descending=True)
    out = run.agg(F.sum(F.col("pos") * (F.col("below_pos") + F.col("pos")) / (F.col("below_n") + F.col("n"))).alias("s"), F.sum("pos").alias("p"), F.sum("n").alias("all"))
    return out.select(F.try_divide("s", "p").alias("area"), F.try_divide("p", "all").alias("positive_share"))


def gene_names(models: DataFrame, renames: DataFrame, overrides: DataFrame, excluded: DataFrame) -> DataFrame:
    """models (id, name) with gene: the name before its bracket, renamed by (old, new), then overridden by (id, gene); excluded (name) models go.

    The tables are small parameters, and Spark joins them as their sizes allow.
    """
    left = models.join(excluded.select("name").distinct(), "name", "left_anti").withColumn("old", F.trim(F.regexp_extract("name", r"^([^(]*)", 1)))
    named = left.join(renames, "old", "left").join(overrides.withColumnRenamed("gene", "own"), "id", "left")
    return named.select("id", "name", F.coalesce("own", "new", "old").alias("gene"))


def complement_sets(members: DataFrame) -> DataFrame:
    """(target, gene): for each target the genes of all others together. members: target, gene.

    A gene's targets are counted: a gene that any other target has, is in the complement, so only targets x distinct
    genes, the size of the result, are made.
    """
    m = members.select("target", "gene").distinct()
    held = m.groupBy("gene").agg(F.count("*").alias("held"))
    grid = held.join(m.select("target").distinct())
    own = m.withColumn("own", F.lit(1))
    return grid.join(own, ["target", "gene"], "left").filter(F.col("held") > F.coalesce("own", F.lit(0))).select("target", "gene")


def term_list(modules: DataFrame, genes: DataFrame, least: int) -> DataFrame:
    """(module, n): modules with at least `least` of the genes. modules: module, gene; genes: gene."""
    return modules.distinct().join(genes.distinct(), "gene", "left_semi").groupBy("module").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def negative_log(q: Column, natural: bool = False) -> Column:
    """-log10 of q, or its natural logarithm; null at 0, where it has no value."""
    return F.when(q > 0, -(F.ln(q) if natural else F.log10(q)) + F.lit(0.0))
