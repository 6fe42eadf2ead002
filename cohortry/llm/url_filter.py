"""URL verdicts: host and path rules first, gradient-boosted trees over lexical features for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import table, written


@dataclass(frozen=True)
class Rule:
    name: str  # host and path, such as example.net/en/
    verdict: str  # allow or block

    @property
    def host(self) -> str:
        return self.name.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.name.partition("/")[2]


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))

FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "secure", "suffix_rows", "suffix_block", "folder_rows", "folder_block"]


def parts(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column; both empty for null and without '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null: its host or a subdomain, and a path that starts with its own."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is tested first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _entropy(text: Column, size: Column) -> Column:
    """Shannon entropy in bits of a string's characters, from its distinct characters only."""
    letters = F.array_distinct(F.split(text, ""))

    def term(c):
        n = (size - F.length(F.replace(text, c, F.lit("")))) / size
        return F.when((c != "") & (n > 0), -n * F.log2(n)).otherwise(0.0)

    return F.when(size > 0, F.aggregate(F.transform(letters, term), F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def lexical(urls: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """urls with the lexical features; suffix statistics are joined by with_statistics()."""
    u, h, p = F.coalesce(F.col(url), F.lit("")), F.col(host), F.col(path)
    size = F.length(u)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    out = {
        "url_length": size,
        "host_length": F.length(h),
        "path_length": F.length(p),
        "depth": F.size(F.filter(F.split(p, "/"), lambda x: x != "")),
        "labels": F.when(h == "", 0).otherwise(F.size(F.split(h, r"\."))),
        "digit_ratio": F.coalesce(F.try_divide(F.length(F.regexp_replace(u, "[^0-9]", "")), size), F.lit(0.0)),
        "entropy": _entropy(u, size),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")),
        "hyphens": F.length(h) - F.length(F.replace(h, F.lit("-"), F.lit(""))),
        "secure": F.startswith(u, F.lit("https://")),
        "suffix": F.regexp_extract(h, r"[^.]*$", 0),
        "folder": F.concat(F.regexp_extract(h, r"([^.]*)\.?[^.]*$", 1), F.lit("/"), F.regexp_extract(p, r"^/([^/]*)/", 1)),
    }
    return urls.withColumns({k: v.cast("string") if k in ("suffix", "folder") else v.cast("double") for k, v in out.items()})


def statistics(labelled: DataFrame, column: str, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Of each value of column that `least` labelled rows have, the log of its rows and its smoothed share of blocked ones.

    Two tables, both written: the `most` most frequent values (documented bound of what is broadcast), and all others.
    """
    counted = written(labelled.groupBy(column).agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).filter(F.col("n") >= least))
    common = written(counted.orderBy(F.desc("n"), column).limit(most).select(column))
    rest = counted.join(F.broadcast(common), column, "left_anti")

    def shares(df: DataFrame) -> DataFrame:
        return written(df.select(F.col(column).alias(f"{column}_key"), F.log1p("n").alias(f"{column}_rows"), ((F.col("blocked") + 1.0) / (F.col("n") + 2.0)).alias(f"{column}_block")))

    return shares(counted.join(F.broadcast(common), column, "left_semi")), shares(rest)


def with_statistics(rows: DataFrame, tables: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """rows with the statistics of their values; a value without any has none of its rows and a share of one half.

    Frequent values are broadcast. The rest is joined by key, where rows of frequent values, which meet nothing there,
    are dealt over salts so that they don't gather in one task.
    """
    for column, (common, rest) in tables.items():
        names = [f"{column}_rows", f"{column}_block"]
        rows = rows.join(F.broadcast(common), F.col(column) == F.col(f"{column}_key"), "left")
        rows = rows.withColumn("salt", F.when(F.col(f"{column}_key").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("url"), F.lit(1024)))).drop(f"{column}_key")
        rare = rest.select(F.col(f"{column}_key"), F.lit(0).cast("long").alias("rare_salt"), *[F.col(n).alias(f"rare_{n}") for n in names])
        rows = rows.join(rare, (F.col(column) == F.col(f"{column}_key")) & (F.col("salt") == F.col("rare_salt")), "left")
        rows = rows.withColumns({n: F.coalesce(n, f"rare_{n}", F.lit(0.0 if n.endswith("_rows") else 0.5)) for n in names}).drop("salt", "rare_salt", f"{column}_key", *[f"rare_{n}" for n in names])
    return rows


def url_verdicts(pages: DataFrame, labelled: DataFrame | None = None, key: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES, most_rows: int = 20_000, trees: int = 12, depth: int = 4, suffixes: int = 10_000, seed: int = 42) -> DataFrame:
    """One row per row of pages: key, host, path, rule, verdict (allow or block), blocked (the trees' probability, null under a rule).

    Trees learn from labelled (url, label 0 or 1, 1 is block) or, without it, from those urls of pages that a rule
    judges: about most_rows distinct ones, chosen by url hash (documented bound). A label above 0 means block. Suffix
    statistics are counted over all labelled rows and kept for all values that two of them have, as a single row's own
    label would tell the trees itself; those of the `suffixes` most frequent ones are broadcast. The last domain label is the suffix; the label before it with the first folder is another one.
    If labels are all alike, or there are none, the trees have nothing to learn: urls get that label, else allow.
    Null urls and such without '://' have empty host and path and no rule, and are judged by their features. Repeated
    rows are judged alike; no rows in, no rows out; other columns are left out.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    host, path = parts("url")
    base = pages.select(F.col(key).cast("long").alias("ident"), F.col(url).alias("url")).withColumns({"host": host, "path": path})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = base.withColumns({"rule": name, "ruled": verdict})
    if labelled is None:
        train = judged.filter("rule IS NOT NULL").select("url", "host", "path", (F.col("ruled") == "block").cast("double").alias("label"))
    else:
        train = labelled.select(F.col("url"), (F.col("label").cast("double") > 0).cast("double").alias("label")).withColumns({"host": host, "path": path}).filter("label IS NOT NULL")
    train = lexical(train, "url", "host", "path")
    kinds = train.agg(F.collect_set("label")).first()[0]
    if len(kinds) < 2:
        blocked = F.lit(kinds[0] if kinds else 0.0)
        scored = judged.withColumn("blocked", blocked)
    else:
        tables = {c: statistics(train, c, 2, suffixes) for c in ("suffix", "folder")}
        urls = train.dropDuplicates(["url", "label"])
        share = min(1.0, most_rows / urls.count())
        picked = urls.filter(F.abs(F.xxhash64(F.coalesce("url", F.lit(""))) % 1_000_003) / 1_000_003.0 < share)
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        sample = assembler.transform(written(with_statistics(picked, tables).select(*FEATURES, "label")))
        if sample.select("label").distinct().count() < 2:
            scored = judged.withColumn("blocked", F.lit(float(sample.first().label)))
        else:
            model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, seed=seed, cacheNodeIds=False).fit(sample)
            rows = assembler.transform(with_statistics(lexical(judged, "url", "host", "path"), tables))
            scored = model.transform(rows).withColumn("blocked", vector_to_array("probability")[1])
    return scored.select(
        F.col("ident").alias(key),
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(F.col("blocked") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("blocked")).alias("blocked"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))
