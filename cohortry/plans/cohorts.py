"""Cohort assembly and composite analyses: file names to keys, demographics, match grids, agreement, permuted nulls of classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.operators import enrichment as N
from cohortry.operators import relational as R
from cohortry.operators import resampling as P
from cohortry.operators import voxels as V
from cohortry.plans.fixtures import VOXELS, Register, rounded, table, voxels

register = Register()


@register("SELECT vec_id, 'absolute' AS jacobian, 5 AS nk, (label % 5)::INT AS k, '5-' || (label % 5) AS cluster_id FROM embeddings")
def keys_from_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Jacobian, nk and k from centroid paths; what doesn't match is null."""
    path = F.format_string("data/%s/centroid_nk_%d_k_%d.mnc", F.lit("absolute"), F.lit(5), F.col("label") % 5)
    rows = table(spark, sf, "embeddings").select("vec_id", path.alias("path"))
    part = lambda pattern: F.try_element_at(F.regexp_extract_all("path", F.lit(pattern), F.lit(1)), F.lit(1))
    out = rows.select("vec_id", part("(absolute|relative)").alias("jacobian"), part("_nk_([0-9]+)").cast("int").alias("nk"), part("_k_([0-9]+)").cast("int").alias("k"))
    return out.withColumn("cluster_id", F.concat_ws("-", "nk", "k"))


@register("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'view') DESC, ts, event_id) AS n FROM events) SELECT user_id AS subject, event_id AS scan, CASE event_type WHEN 'view' THEN 'baseline' WHEN 'error' THEN 'excluded' ELSE 'follow-up' END AS kind FROM r WHERE n = 1")
def one_scan_per_subject(spark, sf):
    """Of each subject's rows the preferred kind, then the earliest; recoded."""
    e = table(spark, sf, "events")
    first = e.groupBy("user_id").agg(F.min_by(F.struct("event_id", "event_type"), F.struct(F.col("event_type") != "view", "ts", "event_id")).alias("s"))
    kind = F.when(F.col("s.event_type") == "view", "baseline").when(F.col("s.event_type") == "error", "excluded").otherwise("follow-up")
    return first.select(F.col("user_id").alias("subject"), F.col("s.event_id").alias("scan"), kind.alias("kind"))


@register("SELECT 'c' || c_custkey AS subject, c_acctbal AS age, n_name AS site, 'first' AS cohort FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0 UNION ALL SELECT 's' || s_suppkey, s_acctbal, n_name, 'second' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0")
def demographics(spark, sf):
    """Two cohorts with one schema: site names looked up, unusable rows left out, source tagged."""
    site = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("site"))

    def cohort(name, prefix, tag):
        rows = table(spark, sf, name).select(F.concat(F.lit(prefix), F.col(f"{prefix}_{'custkey' if prefix == 'c' else 'suppkey'}").cast("string")).alias("subject"), F.col(f"{prefix}_acctbal").alias("age"), F.col(f"{prefix}_nationkey").alias("key"))
        return rows.filter("age >= 0").join(site, "key").select("subject", "age", "site", F.lit(tag).alias("cohort"))

    return cohort("customer", "c", "first").unionByName(cohort("supplier", "s", "second"))


@register("SELECT doc_id, (lang = 'en')::INT AS is_english, (n_chars > 2000)::INT AS is_long, (l.doc_id IS NOT NULL)::INT AS is_labelled FROM documents LEFT JOIN labels l USING (doc_id)")
def quality_flags(spark, sf):
    known = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("is_labelled"))
    d = table(spark, sf, "documents").select("doc_id", (F.col("lang") == "en").cast("int").alias("is_english"), (F.col("n_chars") > 2000).cast("int").alias("is_long"))
    return d.join(known, "doc_id", "left").fillna({"is_labelled": 0})


@register("SELECT r.r_regionkey AS a, s.r_regionkey AS b, coalesce(n, 0) >= 20 AS matched FROM region r CROSS JOIN region s LEFT JOIN (SELECT cn.n_regionkey AS a, sn.n_regionkey AS b, count(DISTINCT s_suppkey) AS n FROM customer JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY ALL) m ON m.a = r.r_regionkey AND m.b = s.r_regionkey")
def match_grid(spark, sf):
    """Which regions of customers and suppliers match, over the whole grid."""
    nation = table(spark, sf, "nation")
    c = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("a"))
    s = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("b"))
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    n = lines.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("a", "b").agg((F.count_distinct("s_suppkey") >= 20).alias("matched"))
    keys = table(spark, sf, "region").select("r_regionkey")
    grid = keys.select(F.col("r_regionkey").alias("a")).join(F.broadcast(keys.select(F.col("r_regionkey").alias("b"))))
    return R.on_grid(n, grid, ["a", "b"], {"matched": False})


@register("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def agreement(spark, sf):
    """Items found at all three settings: one pass, one shuffle."""
    found = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.bit_or(F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).when(F.col("l_returnflag") == "R", 4).otherwise(0)).alias("seen"))
    return found.filter("seen = 7").select(F.col("l_partkey").alias("p_partkey"))


@register("WITH m AS (SELECT DISTINCT label % nk AS k, nk, i AS term FROM embeddings, range(1, 65) r(i), (VALUES (3), (5)) v(nk) WHERE abs(embedding[i]) > 0.35), s AS (SELECT nk, k, count(*) AS n FROM m GROUP BY ALL), p AS (SELECT a.nk, a.k AS a, b.k AS b, count(*) AS common FROM m a JOIN m b ON a.nk = b.nk AND a.term = b.term AND a.k < b.k GROUP BY ALL) SELECT nk, round(1 - sum(common / (x.n + y.n - common)) / (nk * (nk - 1) / 2), 6) AS distance FROM p JOIN s x USING (nk) JOIN s y USING (nk) WHERE x.k = a AND y.k = b GROUP BY nk")
def mean_jaccard_distance(spark, sf):
    """Mean Jaccard distance of all pairs of clusters' term sets per solution; pairs without a shared term are at distance 1."""
    e = table(spark, sf, "embeddings").select(F.explode(F.array(F.lit(3), F.lit(5))).alias("nk"), "label", "embedding")
    m = e.select("nk", (F.col("label") % F.col("nk")).alias("k"), F.posexplode("embedding").alias("term", "v")).filter(F.abs("v") > 0.35).select("nk", "k", "term").distinct()
    s = m.groupBy("nk", "k").agg(F.count("*").alias("n"))
    p = m.alias("x").join(m.select("nk", "term", F.col("k").alias("b")), ["nk", "term"]).filter("k < b").groupBy("nk", "k", "b").agg(F.count("*").alias("both"))
    j = p.join(s, ["nk", "k"]).join(s.select("nk", F.col("k").alias("b"), F.col("n").alias("m")), ["nk", "b"])
    out = j.groupBy("nk").agg(F.sum(F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("shared"))
    return rounded(out.select("nk", (1 - F.col("shared") / (F.col("nk") * (F.col("nk") - 1) / 2)).alias("distance")), "distance")


@register(f"WITH {VOXELS}, m AS (SELECT label AS k, voxel, avg(value) AS v FROM voxels JOIN embeddings ON vec_id = image GROUP BY ALL) SELECT x.k AS a, y.k AS b, round(avg((x.v - y.v) * (x.v - y.v)), 6) AS mse, round(1 - (avg(x.v * y.v) - avg(x.v) * avg(y.v)) / (stddev_pop(x.v) * stddev_pop(y.v)), 6) AS distance FROM m x JOIN m y ON x.voxel = y.voxel AND x.k < y.k GROUP BY 1, 2")
def pairwise_fitness(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image"), F.lit(0).alias("nk"), F.col("label").alias("k"))
    c = V.centroids(voxels(spark, sf), labels)
    pairs = c.select(F.col("k").alias("a"), "voxel", F.col("value").alias("x")).join(c.select(F.col("k").alias("b"), "voxel", F.col("value").alias("y")), "voxel").filter("a < b")
    d = F.col("x") - F.col("y")
    out = pairs.groupBy("a", "b").agg(F.avg(d * d).alias("mse"), (1 - F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))).alias("distance"))
    return rounded(out, "mse", "distance")


@register(f"WITH {VOXELS}, s AS (SELECT voxel, image, (value - avg(value) OVER (PARTITION BY voxel)) / stddev_pop(value) OVER (PARTITION BY voxel) AS z FROM voxels) SELECT x.voxel AS a, y.voxel AS b, round(avg(x.z * y.z), 6) AS r FROM s x JOIN s y ON x.image = y.image AND x.voxel < y.voxel GROUP BY 1, 2")
def correlation_matrix(spark, sf):
    """Correlations of all pairs of the 64 places over images: products are summed within each image's array, not joined."""
    e = table(spark, sf, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    both = e.select("v", F.posexplode("v").alias("a", "x")).select("a", "x", F.posexplode("v").alias("b", "y")).filter("a < b")
    return rounded(V.correlated(both, "x", "y", ["a", "b"]), "r")


@register("WITH s AS (SELECT seed, count_if(quality = 1 AND h) AS tp, count_if(h) AS called FROM (SELECT seed, quality, row_number() OVER (PARTITION BY seed ORDER BY md5(concat_ws('-', doc_id, seed)), doc_id) <= 50 AS h FROM labels, range(1, 11) r(seed)) GROUP BY 1) SELECT seed, tp, round(tp / called, 6) AS share FROM s")
def classifier_null(spark, sf):
    """How many true items each of ten random choices of fifty hits."""
    every = table(spark, sf, "labels").join(F.broadcast(spark.range(1, 11).select(F.col("id").alias("seed"))))
    chosen = every.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy(P.order_key("doc_id", "seed"), "doc_id"))).filter("n <= 50")
    out = chosen.groupBy("seed").agg(F.count_if(F.col("quality") == 1).alias("tp"), F.count("*").alias("called"))
    return rounded(out.select("seed", "tp", (F.col("tp") / F.col("called")).alias("share")), "share")


@register("WITH r AS (SELECT p_brand AS study, l_returnflag AS genotype, l_extendedprice AS value, row_number() OVER w - 1 AS nth, count(*) OVER (PARTITION BY p_brand, l_returnflag) AS size FROM lineitem JOIN part ON l_partkey = p_partkey WINDOW w AS (PARTITION BY p_brand, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)), w AS (SELECT study, genotype, draw, ('0x' || left(md5(concat_ws('-', study || '/' || genotype, draw, nth)), 8))::BIGINT % size AS take FROM r, range(1, 6) d(draw)), s AS (SELECT study, genotype, draw, avg(value) AS m, stddev_samp(value) AS d FROM w JOIN r USING (study, genotype) WHERE nth = take GROUP BY ALL) SELECT study, a.genotype, draw, round(coalesce((a.m - b.m) / nullif(b.d, 0), 0), 5) AS effect FROM s a JOIN s b USING (study, draw) WHERE b.genotype = 'N' AND a.genotype <> 'N'")
def bootstrap_effects(spark, sf):
    """Effect sizes over five draws with replacement within study and genotype."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.select(F.concat_ws("/", "p_brand", "l_returnflag").alias("g"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"), F.col("l_extendedprice").alias("value"))
    drawn = P.drawn_rows(rows, "g", 5).select(F.split_part("g", F.lit("/"), F.lit(1)).alias("study"), F.split_part("g", F.lit("/"), F.lit(2)).alias("genotype"), "draw", "value")
    from cohortry.operators.effects import effect_sizes

    return rounded(effect_sizes(drawn, "N", ["draw"]), "effect", places=5)


@register("WITH x AS (SELECT vec_id, round((embedding[1]::DOUBLE - (-1)) / 0.25) AS i, round((embedding[2]::DOUBLE + 1) / 0.25) AS j, round((embedding[3]::DOUBLE + 1) / 0.25) AS k, label FROM embeddings) SELECT i::INT AS i, j::INT AS j, k::INT AS k, arg_max(label, vec_id)::INT AS label FROM x GROUP BY 1, 2, 3")
def points_to_labels(spark, sf):
    """World points to grid voxels; of several points in a voxel the last counts."""
    at = lambda n: F.element_at("embedding", n).cast("double")
    points = table(spark, sf, "embeddings").select("vec_id", "label", at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))
    return V.nearest_voxel(points, (-1.0, -1.0, -1.0), 0.25).groupBy("i", "j", "k").agg(F.max_by("label", "vec_id").cast("int").alias("label"))


@register("SELECT a.alpha, count_if(f < a.alpha AND s < a.alpha) AS both, count_if(f < a.alpha) AS first, count_if(s < a.alpha) AS second, count(*) AS n FROM (SELECT p_partkey, (p_retailprice % 100) / 100 AS f, ((p_retailprice * 7) % 100) / 100 AS s FROM part), (VALUES (0.05::DOUBLE), (0.2::DOUBLE), (0.5::DOUBLE)) a(alpha) GROUP BY 1")
def overlap_over_levels(spark, sf):
    """Items significant in both of two analyses, over a grid of levels."""
    p = table(spark, sf, "part").select(((F.col("p_retailprice") % 100) / 100).alias("f"), (((F.col("p_retailprice") * 7) % 100) / 100).alias("s"))
    grid = spark.createDataFrame([(0.05,), (0.2,), (0.5,)], "alpha double")
    f, s = F.col("f") < F.col("alpha"), F.col("s") < F.col("alpha")
    return p.join(F.broadcast(grid)).groupBy("alpha").agg(F.count_if(f & s).alias("both"), F.count_if(f).alias("first"), F.count_if(s).alias("second"), F.count("*").alias("n"))


@register("SELECT p_type, coalesce(n, 0) AS n FROM (SELECT DISTINCT p_type FROM part) LEFT JOIN (SELECT p_type, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS r FROM part) WHERE r <= 5 GROUP BY 1) USING (p_type)")
def root_counts_of_top_terms(spark, sf):
    """Of each brand's five dearest parts: how many are of each type, types without any included."""
    p = table(spark, sf, "part").select("p_brand", "p_type", "p_retailprice")
    top = R.top_with_ties(p, F.col("p_retailprice"), 5, ["p_brand"]).groupBy("p_type").agg(F.count("*").alias("n"))
    return R.on_grid(top, p.select("p_type").distinct(), ["p_type"], {"n": 0})


@register("SELECT DISTINCT l_partkey AS gene, s_nationkey AS other FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def homologues(spark, sf):
    """Parts to nations through suppliers, as genes to another species through classes."""
    lines = table(spark, sf, "lineitem")
    bridge = lines.select(F.col("l_suppkey").alias("class"), F.lit("part").alias("species"), F.col("l_partkey").alias("symbol")).distinct()
    bridge = bridge.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("class"), F.lit("nation").alias("species"), F.col("s_nationkey").cast("long").alias("symbol")))
    genes = lines.select(F.col("l_partkey").alias("gene")).distinct()
    return N.bridged(genes, bridge, "part", "nation").select("gene", F.col("other").cast("int").alias("other"))
