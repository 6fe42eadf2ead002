"""Image, signature, similarity and effect-size queries. The 64 embedding places stand in for voxels and for genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators import effects as E
from cohortry.operators import similarity as S
from cohortry.operators import stats as T
from cohortry.operators import voxels as V
from cohortry.operators.relational import bh_adjusted
from cohortry.plans.fixtures import CLUSTERS, VOXELS, Register, clusters, rounded, table, voxels

register = Register()


@register(f"WITH {VOXELS} SELECT image, voxel, round(value, 6) AS value FROM voxels WHERE voxel % 4 <> 0")
def masked_voxels(spark: SparkSession, sf: str) -> DataFrame:
    mask = spark.range(64).select(F.col("id").cast("int").alias("voxel"), F.when(F.col("id") % 4 == 0, 0.25).otherwise(1.0).alias("w"))
    return rounded(V.masked(voxels(spark, sf), mask).select("image", "voxel", "value"), "value")


@register(f"WITH {VOXELS} SELECT image, voxel, CASE WHEN abs(value) > 0.15 THEN round(value, 6) ELSE 0.0 END AS value FROM voxels")
def threshold_by_intensity(spark, sf):
    return rounded(V.intensity_threshold(voxels(spark, sf), 0.15), "value")


@register(f"WITH {VOXELS}, c AS (SELECT *, abs(value) > 1e-5 AS ok FROM voxels), r AS (SELECT *, count_if(ok) OVER (PARTITION BY image) AS n, row_number() OVER (PARTITION BY image ORDER BY CASE WHEN ok THEN abs(value) END DESC NULLS LAST, voxel) AS rk FROM c) SELECT image, voxel, CASE WHEN ok AND rk <= floor(0.2 * n) THEN sign(value)::INT ELSE 0 END AS sign FROM r")
def threshold_by_rank(spark, sf):
    return V.top_threshold(voxels(spark, sf), 0.2).select("image", "voxel", V.sign_mask(F.col("value")).alias("sign"))


@register(f"WITH {VOXELS}, c AS (SELECT image, voxel // 8 AS label, count(*) AS n FROM voxels WHERE value > 0.15 GROUP BY ALL), g AS (SELECT DISTINCT image, l AS label FROM voxels, range(1, 8) r(l)) SELECT image, label::INT AS label, coalesce(n, 0) AS n, round(coalesce(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY image), 0), 0), 6) AS share FROM g LEFT JOIN c USING (image, label)")
def label_tabulation(spark, sf):
    labels = spark.range(64).select(F.col("id").cast("int").alias("voxel"), F.floor(F.col("id") / 8).cast("int").alias("label"))
    definitions = spark.range(1, 8).select(F.col("id").cast("int").alias("label"))
    out = V.label_counts(V.intensity_threshold(voxels(spark, sf), 0.15), labels, definitions, sign=1)
    return rounded(out.select("image", "label", "n", "share"), "share")


@register(f"WITH {VOXELS}, {CLUSTERS} SELECT nk, k, voxel, round(avg(value), 6) AS value FROM voxels JOIN clusters USING (image) GROUP BY ALL")
def cluster_centroids(spark, sf):
    return rounded(V.centroids(voxels(spark, sf), clusters(spark, sf)), "value")


@register(f"WITH {VOXELS}, {CLUSTERS} SELECT nk, k, voxel, round(median(value), 6) AS value FROM voxels JOIN clusters USING (image) GROUP BY ALL")
def cluster_medians(spark, sf):
    return rounded(V.centroids(voxels(spark, sf), clusters(spark, sf), "median"), "value")


_CENTROIDS = f"WITH {VOXELS}, m AS (SELECT label AS image, voxel, round(avg(value), 9) AS value FROM voxels JOIN embeddings ON vec_id = image GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY abs(value) DESC, voxel) AS rk FROM m), t AS (SELECT image, voxel, CASE WHEN rk <= 12 THEN value ELSE 0.0 END AS value FROM r)"


def _centroids(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image"), F.lit(10).alias("nk"), F.col("label").alias("k"))
    means = V.centroids(voxels(spark, sf), labels).select(F.col("k").alias("image"), "voxel", F.round("value", 9).alias("value"))
    return V.top_threshold(means, 0.2)


def _pairs(spark, sf):
    k = table(spark, sf, "embeddings").select("label").distinct()
    return k.select(F.col("label").alias("a")).join(F.broadcast(k.select(F.col("label").alias("b"))), F.col("a") < F.col("b"))


@register(f"{_CENTROIDS} SELECT x.image AS a, y.image AS b, round(sum(x.value * y.value) / (sqrt(sum(x.value * x.value)) * sqrt(sum(y.value * y.value))), 6) AS cosine, round((avg(x.value * y.value) - avg(x.value) * avg(y.value)) / nullif(stddev_pop(x.value) * stddev_pop(y.value), 0), 6) AS correlation, round(sqrt(sum((x.value - y.value) * (x.value - y.value))), 6) AS euclidean, round(sqrt(sum(abs(x.value - y.value))), 6) AS manhattan FROM t x JOIN t y ON x.voxel = y.voxel AND x.image < y.image GROUP BY 1, 2")
def centroid_similarity(spark, sf):
    """Which cluster pairs have the most similar centroids once each keeps its top fifth of voxels."""
    metrics = ["cosine", "correlation", "euclidean", "manhattan"]
    return rounded(S.pair_similarity(_centroids(spark, sf), _pairs(spark, sf), "image", "voxel", "value", metrics), *metrics)


@register(f"{_CENTROIDS}, s AS (SELECT image, sign(value)::INT AS sign, label % 7 AS gene, avg(embedding[voxel + 1]) AS v FROM t, embeddings WHERE value <> 0 GROUP BY ALL) SELECT image, sign, gene::INT AS gene, round(v, 6) AS value FROM s")
def mask_signatures(spark, sf):
    mask = _centroids(spark, sf).select("image", F.col("voxel").alias("unit"), V.sign_mask(F.col("value")).alias("sign"))
    expression = table(spark, sf, "embeddings").select((F.col("label") % 7).alias("gene"), F.posexplode("embedding").alias("unit", "value")).select("gene", "unit", F.col("value").cast("double").alias("value"))
    return rounded(S.signatures(mask, expression), "value")


@register(f"{_CENTROIDS}, p AS (SELECT x.image AS a, y.image AS b, sign(x.value + 1e-12)::INT AS s, sum(x.value * y.value) / nullif(sqrt(sum(x.value * x.value)) * sqrt(sum(y.value * y.value)), 0) AS c FROM t x JOIN t y ON x.voxel = y.voxel AND x.image < y.image AND sign(x.value + 1e-12) = sign(y.value + 1e-12) GROUP BY ALL) SELECT a, b, round(avg(c), 6) AS cosine FROM p GROUP BY 1, 2")
def signed_similarity(spark, sf):
    signed = _centroids(spark, sf).withColumn("sign", F.signum(F.col("value") + 1e-12).cast("int"))
    both = S.pair_similarity(signed, _pairs(spark, sf), "image", "voxel", "value", ["cosine"], ["sign"])
    return rounded(S.over_signs(both, "cosine"), "cosine")


@register(f"WITH {VOXELS}, p AS (SELECT * FROM (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings)) SELECT a, b, round((avg(x.value * y.value) - avg(x.value) * avg(y.value)) / nullif(stddev_pop(x.value) * stddev_pop(y.value), 0), 6) AS r FROM p JOIN voxels x ON x.image = a JOIN voxels y ON y.image = b AND x.voxel = y.voxel GROUP BY 1, 2")
def image_correlation(spark, sf):
    v = voxels(spark, sf)
    left = v.select(F.col("image").alias("a"), (F.col("image") + 1).alias("b"), "voxel", F.col("value").alias("x"))
    return rounded(V.correlated(left.join(v.select(F.col("image").alias("b"), "voxel", F.col("value").alias("y")), ["b", "voxel"]), "x", "y", ["a", "b"]), "r")


@register(f"WITH {VOXELS}, g AS (SELECT image, voxel % 8 AS x, voxel // 8 AS y, voxel, value FROM voxels) SELECT image, voxel, round(value, 6) AS value FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.image = a.image AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.voxel <> b.voxel AND b.value >= a.value)")
def peak_voxels(spark, sf):
    return rounded(V.peaks(voxels(spark, sf), 8), "value")


@register(f"WITH {VOXELS} SELECT voxel, round(avg(value), 6) AS mean, round(avg(value) * sqrt(count(*)) / stddev_samp(value), 4) AS t, count(*) AS n FROM voxels GROUP BY 1")
def voxel_t(spark, sf):
    return rounded(rounded(V.one_sample_t(voxels(spark, sf)), "mean"), "t", places=4)


@register("WITH k AS (SELECT p_brand AS study, l_returnflag AS genotype, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING count(*) >= 6) SELECT study, genotype, n FROM k WHERE genotype <> 'N' AND study IN (SELECT study FROM k WHERE genotype = 'N')")
def model_list(spark, sf):
    return E.eligible_models(_scans(spark, sf), "N", 6)


def _scans(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.col("p_brand").alias("study"), F.col("l_returnflag").alias("genotype"), F.col("l_linenumber").alias("place"), F.col("l_extendedprice").alias("value"))


@register("WITH s AS (SELECT p_brand AS study, l_returnflag AS genotype, l_linenumber AS place, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT study, a.genotype, place, round(coalesce((a.m - w.m) / nullif(w.d, 0), 0), 6) AS effect FROM s a JOIN s w USING (study, place) WHERE w.genotype = 'N' AND a.genotype <> 'N'")
def group_effects(spark, sf):
    return rounded(E.effect_sizes(_scans(spark, sf), "N", ["place"]), "effect")


_MATCHED = """WITH p AS (SELECT s_suppkey AS id, s_nationkey AS site, n_regionkey AS region, s_acctbal AS age FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT c_custkey AS id, c_nationkey AS site, n_regionkey AS region, c_acctbal AS age FROM customer JOIN nation ON c_nationkey = n_nationkey),
t0 AS (SELECT p.id AS patient, c.id AS control, abs(p.age - c.age) AS gap, count(*) OVER (PARTITION BY p.id) AS f, row_number() OVER (PARTITION BY p.id ORDER BY abs(p.age - c.age), md5(concat_ws('-', p.id, c.id, '7')), c.id) AS r FROM p JOIN c ON p.site = c.site),
t1 AS (SELECT p.id AS patient, c.id AS control, abs(p.age - c.age) AS gap, row_number() OVER (PARTITION BY p.id ORDER BY abs(p.age - c.age), md5(concat_ws('-', p.id, c.id, '7')), c.id) AS r FROM p JOIN c ON p.region = c.region WHERE p.id NOT IN (SELECT patient FROM t0 WHERE f >= 60 )),
m AS (SELECT patient, control, 0 AS tier FROM t0 WHERE f >= 60 AND r <= 60 UNION ALL SELECT patient, control, 1 FROM t1 WHERE r <= 60)"""


def _matches(spark, sf):
    nation = F.broadcast(table(spark, sf, "nation").select(F.col("n_nationkey").alias("site"), F.col("n_regionkey").alias("region")))
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("site"), F.col("s_acctbal").alias("age")).join(nation, "site")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("site"), F.col("c_acctbal").alias("age")).join(nation, "site")
    return E.matched_controls(p, c, ["site"], [["region"]], "age", 60, 7)


@register(f"{_MATCHED} SELECT patient, control, tier::INT AS tier FROM m")
def matched_controls(spark, sf):
    return _matches(spark, sf).select("patient", "control", "tier")


@register(f"{_MATCHED} SELECT patient, 1 AS at, round(coalesce((any_value(s_acctbal) - avg(c_acctbal)) / nullif(stddev_samp(c_acctbal), 0), 0), 6) AS z FROM m JOIN customer ON control = c_custkey JOIN supplier ON patient = s_suppkey GROUP BY patient")
def matched_z(spark, sf):
    values = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("at"), F.col("c_acctbal").alias("value"))
    own = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(1).alias("at"), F.col("s_acctbal").alias("value"))
    return rounded(E.matched_z(own, values, _matches(spark, sf)), "z")


_NORM = "WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber AS place, l_quantity AS x, l_linestatus AS sex, l_returnflag = 'N' AS ctrl, l_extendedprice AS value FROM lineitem), g AS (SELECT place, sex, count(*) AS n, avg(x) AS mx, avg(value) AS my, var_pop(x) AS vx, covar_pop(x, value) AS cxy, var_pop(value) AS vy FROM r WHERE ctrl GROUP BY ALL), p AS (SELECT place, sum(n * vx) AS sxx, sum(n * cxy) AS sxy, sum(n * vy) AS syy, sum(n) AS m, count(*) AS k FROM g GROUP BY 1)"


@register(f"{_NORM} SELECT l_orderkey, l_linenumber, round((value - my - sxy / sxx * (x - mx)) / sqrt((syy - sxy * sxy / sxx) / (m - k - 1) * (1 + 1.0 / n + (x - mx) * (x - mx) / sxx)), 4) AS z FROM r JOIN g USING (place, sex) JOIN p USING (place)")
def normative_z(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("at"), F.col("l_quantity").alias("x"), F.col("l_linestatus").alias("sex"), (F.col("l_returnflag") == "N").alias("ctrl"), F.col("l_extendedprice").alias("value"))
    return rounded(E.normative_z(rows, "ctrl", "at", "x", "sex").select("l_orderkey", "l_linenumber", "z"), "z", places=4)


@register("WITH c AS (SELECT vec_id AS id, nk, (label % nk)::INT AS k FROM embeddings, (VALUES (2), (3), (4), (5)) v(nk)), f AS (SELECT a.nk, a.k, b.k AS child, count(*) AS n FROM c a JOIN c b ON a.id = b.id AND b.nk = a.nk + 1 GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY nk, k), 6) AS share FROM f")
def cluster_flow(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.explode(F.array(*[F.lit(n) for n in (2, 3, 4, 5)])).alias("nk"), "label")
    return rounded(T.flow(labels.select("id", "nk", (F.col("label") % F.col("nk")).alias("k"))), "share")


@register("SELECT a, b, shared, round(shared / (sum(shared) OVER (PARTITION BY a) + sum(shared) OVER (PARTITION BY b) - shared), 6) AS jaccard FROM (SELECT label % 5 AS a, label % 3 AS b, count(*) AS shared FROM embeddings GROUP BY ALL)")
def cluster_overlap(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("label") % 5).alias("a"), (F.col("label") % 3).alias("b"))
    return rounded(T.cluster_jaccard(e, "a", "b"), "jaccard")


@register("WITH c AS (SELECT label % 5 AS a, label AS b, count(*) AS n FROM embeddings GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari FROM s, x, y")
def rand_index(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("label") % 5).alias("a"), F.col("label").alias("b"))
    return rounded(T.adjusted_rand(e, "a", "b"), "ari")
