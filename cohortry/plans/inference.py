"""Resampling, significance, enrichment and classifier-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.operators import enrichment as N
from cohortry.operators import resampling as P
from cohortry.operators import stats as T
from cohortry.operators.relational import bh_adjusted
from cohortry.plans.fixtures import Register, rounded, table

register = Register()

_LABELS = "c AS (SELECT vec_id AS id, nk, (label % nk)::INT AS k FROM embeddings, (VALUES (2), (5)) v(nk))"
_PERMUTED = f"{_LABELS}, e AS (SELECT * FROM c, range(1, 6) s(seed)), i AS (SELECT seed, nk, id, row_number() OVER (PARTITION BY seed, nk ORDER BY id) AS place FROM e), l AS (SELECT seed, nk, k, row_number() OVER (PARTITION BY seed, nk ORDER BY md5(concat_ws('-', id, nk, seed)), id) AS place FROM e), p AS (SELECT seed, nk, id, k FROM i JOIN l USING (seed, nk, place))"


def _clusters(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.explode(F.array(F.lit(2), F.lit(5))).alias("nk"), "label")
    return e.select("id", "nk", (F.col("label") % F.col("nk")).alias("k"))


def _permuted(spark, sf):
    return P.permuted_labels(_clusters(spark, sf), spark.range(1, 6).select(F.col("id").alias("seed")))


@register(f"WITH {_PERMUTED} SELECT seed, nk, id, k FROM p")
def label_permutations(spark: SparkSession, sf: str) -> DataFrame:
    return _permuted(spark, sf)


@register(f"WITH {_PERMUTED}, v AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS value FROM embeddings), o AS (SELECT nk, k, round(avg(value), 9) AS m FROM c JOIN v USING (id) GROUP BY ALL), n AS (SELECT nk, k, seed, round(avg(value), 9) AS m FROM p JOIN v USING (id) GROUP BY ALL) SELECT o.nk, o.k, round(avg((n.m >= o.m)::INT), 6) AS p FROM o JOIN n ON o.nk = n.nk GROUP BY o.nk, o.k, o.m")
def empirical_p(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.element_at("embedding", 1).cast("double").alias("value"))
    observed = _clusters(spark, sf).join(v, "id").groupBy("nk", "k").agg(F.round(F.avg("value"), 9).alias("m"))
    null = _permuted(spark, sf).join(v, "id").groupBy("nk", "k", "seed").agg(F.round(F.avg("value"), 9).alias("m"))
    return rounded(P.empirical_p(observed, null, ["nk"], "m").drop("m"), "p")


@register("""WITH r AS (SELECT c_mktsegment AS g, c_acctbal AS value, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS place, count(*) OVER (PARTITION BY c_mktsegment) AS size FROM customer),
w AS (SELECT g, draw, ('0x' || left(md5(concat_ws('-', g, draw, place)), 8))::BIGINT % size AS take FROM r, range(1, 21) d(draw)), m AS (SELECT w.g, draw, avg(value) AS m FROM w JOIN r ON r.g = w.g AND r.place = w.take GROUP BY ALL)
SELECT g, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high, round((SELECT avg(value) FROM r WHERE r.g = m.g), 4) AS mean FROM m GROUP BY g""")
def bootstrap_interval(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    return rounded(P.bootstrap_interval(c, "g", 20), "low", "high", "mean", places=4)


@register("SELECT c_custkey AS id, c_mktsegment AS g, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat_ws('-', c_custkey, '11')), c_custkey) <= floor(count(*) OVER (PARTITION BY c_mktsegment) * 0.8) AS train FROM customer")
def train_split(spark, sf):
    return P.split(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("g")), "id", 11, 0.8, ["g"])


_SETS = """fg AS (SELECT DISTINCT c_mktsegment AS target, l_partkey AS gene FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'),
u AS (SELECT DISTINCT l_partkey AS gene FROM lineitem), i AS (SELECT DISTINCT p_brand AS module, p_partkey AS gene FROM part WHERE p_partkey IN (SELECT gene FROM u)),
c AS (SELECT target, module, (SELECT count(*) FROM fg f JOIN i j USING (gene) WHERE f.target = t.target AND j.module = m.module) AS b, B, n, (SELECT count(*) FROM u) AS N2 FROM (SELECT target, count(*) AS n FROM fg GROUP BY 1) t, (SELECT module, count(*) AS B FROM i GROUP BY 1) m)"""


def _sets(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, sf, "lineitem")
    fg = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("c_mktsegment").alias("target"), F.col("l_partkey").alias("gene"))
    modules = table(spark, sf, "part").select(F.col("p_brand").alias("module"), F.col("p_partkey").alias("gene"))
    return N.overlap_counts(fg, lines.select(F.col("l_partkey").alias("gene")), modules)


_COUNTS = _SETS.replace("(SELECT module, count(*) AS B FROM i GROUP BY 1) m)", "(SELECT module, count(*) AS big FROM i GROUP BY 1) m)").replace("AS b, B, n,", "AS hit, big, n,")


@register(f"WITH {_COUNTS} SELECT target, module, hit, big, n AS chosen, N2 AS everything FROM c")
def overlap_counts(spark, sf):
    return _sets(spark, sf).select("target", "module", "hit", F.col("size").alias("big"), "chosen", F.col("total").alias("everything"))


@register(f"""WITH {_COUNTS}, lf AS (SELECT i AS n, sum(CASE WHEN i > 0 THEN ln(i) ELSE 0 END) OVER (ORDER BY i) AS l FROM range(0, 30001) r(i)),
k AS (SELECT *, unnest(generate_series(hit, least(n, big))) AS k FROM c WHERE hit > 0), t AS (SELECT target, module, sum(exp(a.l + b.l - d.l - e.l - f.l - g.l - h.l + i.l + j.l)) AS p FROM k JOIN lf a ON a.n = big JOIN lf b ON b.n = N2 - big JOIN lf d ON d.n = k JOIN lf e ON e.n = big - k JOIN lf f ON f.n = k.n - k JOIN lf g ON g.n = N2 - big - k.n + k JOIN lf h ON h.n = N2 JOIN lf i ON i.n = k.n JOIN lf j ON j.n = N2 - k.n GROUP BY ALL),
r AS (SELECT target, module, round(hit * N2 / (c.n * big), 6) AS e, round(least(1.0, coalesce(p, 1.0)), 7) AS p FROM c LEFT JOIN t USING (target, module))
SELECT target, module, e, p, row_number() OVER (PARTITION BY target ORDER BY p, module) AS rank, round(least(1.0, min(raw) OVER (PARTITION BY target ORDER BY p DESC, module DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM (SELECT *, p * count(*) OVER (PARTITION BY target) / row_number() OVER (PARTITION BY target ORDER BY p, module) AS raw FROM r)""")
def enrichment_table(spark, sf):
    tested = N.hypergeometric(_sets(spark, sf), N.log_factorials(spark, table(spark, sf, "part").count()), ["target", "module"])
    tested = rounded(rounded(tested.select("target", "module", F.col("enrichment").alias("e"), "p"), "p", places=7), "e")
    ranked = bh_adjusted(tested, "p", ["target"], "q", ["module"]).withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("p", "module")))
    return rounded(ranked, "q")


@register("WITH e AS (SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS score FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL), d AS (SELECT a AS seed, b AS gene FROM e WHERE score >= 2 UNION SELECT b, a FROM e WHERE score >= 2) SELECT seed, gene FROM d UNION SELECT p_partkey, p_partkey FROM part")
def network_neighbourhood(spark, sf):
    edges = N.co_occurrence(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")
    seeds = table(spark, sf, "part").select(F.col("p_partkey").alias("seed"))
    return N.neighbourhood(edges, seeds, 2)


@register("SELECT lang, count_if(quality = 1 AND n_chars > 1000) AS tp, count_if(quality = 0 AND n_chars > 1000) AS fp, count_if(quality = 1 AND n_chars <= 1000) AS fn, count_if(quality = 0 AND n_chars <= 1000) AS tn, round(count_if((quality = 1) = (n_chars > 1000)) / count(*), 6) AS accuracy, round(count_if(quality = 1 AND n_chars > 1000) / nullif(count_if(quality = 1), 0), 6) AS sensitivity, round(count_if(quality = 0 AND n_chars <= 1000) / nullif(count_if(quality = 0), 0), 6) AS specificity, round(count_if(quality = 1 AND n_chars > 1000) / nullif(count_if(n_chars > 1000), 0), 6) AS ppv, round(count_if(quality = 0 AND n_chars <= 1000) / nullif(count_if(n_chars <= 1000), 0), 6) AS npv FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def confusion_metrics(spark, sf):
    return rounded(N.confusion(_judged(spark, sf), F.col("quality") == 1, F.col("n_chars") > 1000, ["lang"]), "accuracy", "sensitivity", "specificity", "ppv", "npv")


def _judged(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")


@register("WITH r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS rk FROM documents JOIN labels USING (doc_id)) SELECT round((sum(rk) FILTER (quality = 1) - count_if(quality = 1) * (count_if(quality = 1) + 1) / 2) / (count_if(quality = 1) * count_if(quality = 0)), 6) AS auc, count_if(quality = 1) AS positives, count_if(quality = 0) AS negatives FROM r")
def roc_area(spark, sf):
    return rounded(N.roc_area(_judged(spark, sf), "n_chars", F.col("quality") == 1), "auc")


@register("WITH c AS (SELECT n_chars, count_if(quality = 1) AS pos, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT n_chars, round(sum(pos) OVER w / sum(n) OVER w, 6) AS precision, round(sum(pos) OVER w / sum(pos) OVER (), 6) AS recall FROM c WINDOW w AS (ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING)")
def precision_recall(spark, sf):
    return rounded(N.precision_recall(_judged(spark, sf), "n_chars", F.col("quality") == 1), "precision", "recall")


@register("WITH n AS (SELECT lang, count(*) AS n, count_if(quality = 1 AND toxic = 1) AS a, count_if(quality = 1 AND toxic = 0) AS b, count_if(quality = 0 AND toxic = 1) AS c, count_if(quality = 0 AND toxic = 0) AS d FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT lang, round(coalesce(a / n * log2(nullif(a * n / nullif((a + b) * (a + c), 0), 0)), 0) + coalesce(b / n * log2(nullif(b * n / nullif((a + b) * (b + d), 0), 0)), 0) + coalesce(c / n * log2(nullif(c * n / nullif((c + d) * (a + c), 0), 0)), 0) + coalesce(d / n * log2(nullif(d * n / nullif((c + d) * (b + d), 0), 0)), 0), 6) AS bits FROM n")
def mutual_information(spark, sf):
    return rounded(N.mutual_information(_judged(spark, sf), F.col("quality") == 1, F.col("toxic") == 1, ["lang"]), "bits")


@register("WITH r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS rk FROM documents JOIN labels USING (doc_id)) SELECT lang, round(sum(rk) FILTER (quality = 1) - count_if(quality = 1) * (count_if(quality = 1) + 1) / 2, 3) AS u FROM r GROUP BY 1 HAVING count(DISTINCT quality) = 2")
def rank_sum_test(spark, sf):
    return rounded(T.rank_sum(_judged(spark, sf), "n_chars", F.col("quality") == 1, ["lang"]).filter("u IS NOT NULL").select("lang", "u"), "u", places=3)


@register("WITH r AS (SELECT c_mktsegment AS g, c_acctbal AS v, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 AS rk FROM customer), t AS (SELECT sum(n * n * n - n) AS tie FROM (SELECT count(*)::DOUBLE AS n FROM customer GROUP BY c_acctbal)), n AS (SELECT count(*)::DOUBLE AS n FROM customer), q AS (SELECT sum(s * s / m) AS q FROM (SELECT sum(rk) AS s, count(*) AS m FROM r GROUP BY g)), h AS (SELECT (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) AS h, n FROM n, q, t), s AS (SELECT sum(m * (a - (SELECT avg(v) FROM r)) * (a - (SELECT avg(v) FROM r))) / ((SELECT var_pop(v) FROM r) * sum(m)) AS eta FROM (SELECT avg(v) AS a, count(*) AS m FROM r GROUP BY g)) SELECT round(h, 4) AS h, round(h / (n - 1), 6) AS eta_h, round(eta, 6) AS eta FROM h, s")
def kruskal_wallis(spark, sf):
    return rounded(rounded(T.kruskal_wallis(table(spark, sf, "customer"), "c_acctbal", "c_mktsegment", []), "h", places=4), "eta_h", "eta")


@register("WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS o FROM orders GROUP BY ALL), e AS (SELECT *, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM c) SELECT round(sum(o * o / e) - sum(o), 4) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df FROM e")
def chi_squared(spark, sf):
    return rounded(T.chi_squared(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"), "chi2", places=4)


@register("SELECT l_returnflag, round(covar_pop(l_quantity, l_extendedprice) / var_pop(l_quantity), 4) AS slope, round(avg(l_extendedprice) - covar_pop(l_quantity, l_extendedprice) / var_pop(l_quantity) * avg(l_quantity), 3) AS intercept, round(covar_pop(l_quantity, l_extendedprice) ** 2 / (var_pop(l_quantity) * var_pop(l_extendedprice)), 6) AS r2 FROM lineitem GROUP BY 1")
def line_fit(spark, sf):
    out = T.line_fit(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return rounded(rounded(rounded(out, "slope", places=4), "intercept", places=3), "r2")


@register("SELECT c_custkey, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS mark FROM (SELECT c_custkey, (abs(c_acctbal) % 100) / 1000 AS p FROM customer)")
def significance_marks(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.stars((F.abs("c_acctbal") % 100) / 1000).alias("mark"))
