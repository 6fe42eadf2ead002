"""Remaining verbs, anatomy, gene sets, nulls, spaces, models and file round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.distributions import pchisq, pt
from cohortry.operators import enrichment as N
from cohortry.operators import hierarchy as H
from cohortry.operators import models as M
from cohortry.operators import normative as Z
from cohortry.operators import relational as R
from cohortry.operators import resampling as P
from cohortry.operators import similarity as S
from cohortry.operators import stats as T
from cohortry.operators import voxels as V
from cohortry.plans.fixtures import VOXELS, Register, rounded, table, voxels
from cohortry.sources import files as X

register = Register()


@register("SELECT c_custkey::VARCHAR AS id, round(c_acctbal, 2) AS balance FROM customer")
def metadata_row_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """A second header among the data goes, then types are cast."""
    text = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_acctbal").cast("string").alias("balance"))
    both = text.unionByName(spark.createDataFrame([("Identifier", "Account balance")], "id string, balance string"))
    return R.without_metadata_rows(both, "id", ["Identifier"]).select("id", F.round(F.col("balance").cast("double"), 2).alias("balance"))


@register("SELECT c_custkey, c_nationkey, c_acctbal, c_name FROM customer")
def selection_helpers(spark, sf):
    return R.selected(R.selected(table(spark, sf, "customer"), contains="acct", matches="key$", keep_rest=True), starts="c_n", contains="acct", names=["c_custkey"])


@register("SELECT n_nationkey AS row, n_name FROM nation WHERE n_nationkey % 3 = 1")
def flagged_rows(spark, sf):
    """A flag vector filters by explicit row number, not by position in a file."""
    flags = spark.range(25).select(F.col("id").cast("int").alias("row"), (F.col("id") % 3 == 1).alias("keep"))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("row"), "n_name").join(flags, "row").filter("keep").drop("keep")


@register("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT (l.quality = 1 AND d.n_chars > 500)")
def negated_compound(spark, sf):
    """Rows of which the compound is known to be false: an unknown quality keeps a row only where the other half is false."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.filter(~((F.col("quality") == 1) & (F.col("n_chars") > 500))).select("doc_id")


@register("SELECT coalesce(n_nationkey, r_regionkey) AS row, n_name, r_name FROM nation FULL JOIN region ON n_nationkey = r_regionkey")
def bound_columns(spark, sf):
    return R.bound(table(spark, sf, "nation").select(F.col("n_nationkey").alias("row"), "n_name"), table(spark, sf, "region").select(F.col("r_regionkey").alias("row"), "r_name"), "row")


@register("SELECT event_type, count(*) AS n, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 END AS place FROM events GROUP BY 1")
def custom_order(spark, sf):
    return R.in_order(table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")), "event_type", ["signup", "view", "click"])


@register("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws('-', event_id, '3')), event_id) = 1")
def seeded_first_row(spark, sf):
    return P.first_of_each(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.lit("3"), [])


@register("WITH r AS (SELECT seed, user_id, event_type, value FROM events, range(1, 6) s(seed) QUALIFY row_number() OVER (PARTITION BY seed, user_id ORDER BY md5(concat_ws('-', event_id, seed)), event_id) = 1), c AS (SELECT seed, event_type AS a, value > 50 AS b, count(*)::DOUBLE AS o FROM r GROUP BY ALL), e AS (SELECT *, sum(o) OVER (PARTITION BY seed, a) * sum(o) OVER (PARTITION BY seed, b) / sum(o) OVER (PARTITION BY seed) AS e FROM c) SELECT seed, round(sum(o * o / e) - sum(o), 4) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df FROM e GROUP BY 1")
def resampled_chi_squared(spark, sf):
    """One seeded row per subject, five times over, and the statistic of each draw."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value").withColumn("seed", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))))
    first = P.first_of_each(rows, "user_id", "event_id", "seed", ["seed"]).withColumn("high", F.col("value") > 50)
    return rounded(T.chi_squared(first, "event_type", "high", ["seed"]), "chi2", places=4)


@register()
def chi_squared_p(spark, sf):
    """The statistic's upper tail."""
    t = T.chi_squared(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")
    return rounded(t.withColumn("p", 1 - pchisq(F.col("chi2"), F.col("df").cast("double"))), "chi2", "p", places=4)


@register(f"WITH {VOXELS} SELECT voxel FROM voxels GROUP BY 1 HAVING avg(value) > 0 ORDER BY voxel LIMIT 10")
def partial_mask(spark, sf):
    """The first ten voxels of those whose mean over all images is above zero."""
    mask = voxels(spark, sf).groupBy("voxel").agg(F.avg("value").alias("w"))
    return V.partial_mask(mask, 10, above=0.0).select("voxel")


@register(f"WITH {VOXELS} SELECT image, count_if(abs(value) > 0.15) AS by_intensity, floor(0.5 * count_if(abs(value) > 1e-5))::BIGINT AS by_rank FROM voxels GROUP BY 1")
def threshold_by_name(spark, sf):
    v = voxels(spark, sf)
    kept = [V.thresholded(v, m, **o).groupBy("image").agg(F.count_if(F.col("value") != 0).alias(n)) for m, o, n in (("intensity", {"threshold": 0.15}, "by_intensity"), ("top_n", {"n": 0.5}, "by_rank"))]
    return kept[0].join(kept[1], "image")


@register(f"WITH {VOXELS}, g AS (SELECT image, voxel % 4 AS x, voxel // 4 % 4 AS y, voxel // 16 AS z, voxel, value FROM voxels) SELECT image, voxel, round(value, 6) AS value FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.image = a.image AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 AND a.voxel <> b.voxel AND b.value >= a.value)")
def peaks_in_space(spark, sf):
    return rounded(V.peaks_in_space(voxels(spark, sf), (4, 4, 4)), "value")


@register(f"WITH {VOXELS} SELECT label AS k, voxel, round(stddev_samp(value), 6) AS value FROM voxels JOIN embeddings ON vec_id = image GROUP BY ALL")
def cluster_spread(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image"), F.lit(0).alias("nk"), F.col("label").alias("k"))
    return rounded(V.centroids(voxels(spark, sf), labels, "sd").drop("nk"), "value")


_PARTS = f"WITH {VOXELS}, c AS (SELECT CASE WHEN image % 2 = 0 THEN 'human' ELSE 'mouse' END AS species, voxel, sum(value) AS v FROM voxels GROUP BY ALL), n AS (SELECT species, sign(v)::INT AS sign, 'region ' || (voxel // 8) AS region, count(*) AS n FROM c WHERE v <> 0 AND voxel >= 8 GROUP BY ALL), g AS (SELECT * FROM (VALUES ('human'), ('mouse')) s(species), (VALUES (1), (-1)) t(sign), (SELECT 'region ' || i AS region FROM range(1, 8) r(i))), f AS (SELECT species, sign, region, coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY species, sign), 0) AS share FROM g LEFT JOIN n USING (species, sign, region))"


def _anatomy(spark, sf):
    """Shares of each species' positive and negative voxels by region, in a region table with the name both species use."""
    species = F.when(F.col("image") % 2 == 0, "human").otherwise("mouse")
    summed = voxels(spark, sf).groupBy(species.alias("image"), "voxel").agg(F.sum("value").alias("value"))
    labels = spark.range(64).select(F.col("id").cast("int").alias("voxel"), F.floor(F.col("id") / 8).cast("int").alias("label"))
    names = spark.range(1, 8).select(F.col("id").cast("int").alias("label"), F.concat(F.lit("region "), F.col("id").cast("string")).alias("region"))
    sides = [V.label_counts(summed, labels, names.select("label"), sign).withColumn("sign", F.lit(sign)) for sign in (1, -1)]
    return sides[0].unionByName(sides[1]).join(names, "label").select(F.col("image").alias("species"), "sign", "region", "share")


@register(f"{_PARTS} SELECT a.region, a.sign, round(coalesce(a.share, 0), 6) AS human, round(coalesce(b.share, 0), 6) AS mouse FROM f a JOIN f b ON a.region = b.region AND a.sign = b.sign WHERE a.species = 'human' AND b.species = 'mouse' AND a.region <> 'region 7'")
def cross_species_anatomy(spark, sf):
    """Fractions of both species side by side, over the regions that both have."""
    both = _anatomy(spark, sf)
    homologous = spark.range(1, 7).select(F.concat(F.lit("region "), F.col("id").cast("string")).alias("region"))
    wide = both.join(homologous, "region", "left_semi").groupBy("region", "sign").pivot("species", ["human", "mouse"]).agg(F.first("share"))
    return rounded(wide, "human", "mouse")


@register(f"{_PARTS}, w AS (SELECT species, region, sum(coalesce(share, 0)) FILTER (sign = 1) AS positive, -sum(coalesce(share, 0)) FILTER (sign = -1) AS negative, region[8:]::INT AS place FROM f GROUP BY species, region) SELECT species, region, place, round(positive, 6) + 0.0 AS positive, round(negative, 6) + 0.0 AS negative FROM w UNION ALL SELECT species, region, 8, round(positive, 6) + 0.0, round(negative, 6) + 0.0 FROM w WHERE place = 1")
def radar_table(spark, sf):
    """Positive and negative fractions per region, and the first region again to close the circle."""
    both = _anatomy(spark, sf)
    wide = both.groupBy("species", "region").agg(F.sum(F.when(F.col("sign") == 1, F.col("share"))).alias("positive"), (-F.sum(F.when(F.col("sign") == -1, F.col("share")))).alias("negative"))
    wide = wide.withColumn("place", F.substring("region", 8, 9).cast("int"))
    return rounded(wide.unionByName(wide.filter("place = 1").withColumn("place", F.lit(8))), "positive", "negative")


_P = "o AS (SELECT a AS nk1, b AS nk2, k, (('0x' || left(md5(concat_ws('-', a, b, k, 'o')), 4))::BIGINT % 50)::INT AS v FROM range(1, 6) x(a), range(1, 6) y(b), range(1, 9) z(k)), n AS (SELECT (l_linenumber % 5) + 1 AS nk1, (l_suppkey % 5) + 1 AS nk2, (l_quantity::BIGINT % 50)::INT AS v FROM lineitem)"


@register(f"WITH {_P}, m AS (SELECT nk1, nk2, v, count(*) AS c FROM n GROUP BY ALL) SELECT o.nk1, o.nk2, o.k, o.v, round(sum(c) FILTER (m.v >= o.v) / sum(c), 6) AS p FROM o JOIN m ON m.nk1 = o.nk1 AND m.nk2 = o.nk2 WHERE abs(o.nk1 - o.nk2) <= 1 AND o.nk1 >= 2 AND o.nk2 >= 2 GROUP BY ALL")
def pooled_empirical_p(spark, sf):
    """p of cluster pairs near the diagonal against nulls pooled per pair of solutions."""
    grid = spark.range(1, 6).select(F.col("id").alias("nk1")).withColumn("nk2", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long")))).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))))
    observed = grid.withColumn("v", (F.conv(F.substring(P.order_key("nk1", "nk2", "k", F.lit("o")), 1, 4), 16, 10).cast("long") % 50).cast("int"))
    null = table(spark, sf, "lineitem").select((F.col("l_linenumber") % 5 + 1).cast("long").alias("nk1"), (F.col("l_suppkey") % 5 + 1).alias("nk2"), (F.col("l_quantity").cast("long") % 50).cast("int").alias("v"))
    out = P.pooled_p(observed, null, "v").withColumn("p", F.coalesce("p", F.lit(0.0)))
    return rounded(out.select("nk1", "nk2", "k", "v", "p"), "p")


_U = "(('0x' || left(md5(concat_ws('-', {0}, '{1}')), 8))::BIGINT + 0.5) / 4294967296.0"


@register(f"WITH g AS (SELECT seed, delta, i AS id, v AS variable, i % 2 AS grp FROM range(1, 4) s(seed), (VALUES (0), (2)) d(delta), (SELECT vec_id AS i FROM embeddings) r, range(3) q(v)) SELECT seed, delta::INT AS delta, id, variable, round(grp * delta + sqrt(-2 * ln({_U.format('seed, delta, id, variable', 'r')})) * cos(2 * pi() * ({_U.format('seed, delta, id, variable', 'a')})), 6) AS value FROM g")
def simulated_clusters(spark, sf):
    """Every image in one of two Gaussian groups delta apart, over a grid of seeds, distances and variables."""
    longs = lambda *v: F.array(*[F.lit(x).cast("long") for x in v])
    grid = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")).withColumn("seed", F.explode(longs(1, 2, 3))).withColumn("delta", F.explode(F.array(F.lit(0), F.lit(2)))).withColumn("variable", F.explode(longs(0, 1, 2)))
    return rounded(grid.select("seed", "delta", "id", "variable", ((F.col("id") % 2) * F.col("delta") + P.normal("seed", "delta", "id", "variable")).alias("value")), "value")


@register("WITH c AS (SELECT label % 5 AS child, label % 3 AS parent, count(*) AS n FROM embeddings GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY child) AS share FROM c) SELECT child, parent, round(share, 6) AS share FROM s QUALIFY row_number() OVER (PARTITION BY child ORDER BY share DESC, parent) = 1")
def parent_representative(spark, sf):
    """For each cluster the coarser one that most of its members are in; the lower of equals."""
    cells = table(spark, sf, "embeddings").groupBy((F.col("label") % 5).alias("child"), (F.col("label") % 3).alias("parent")).agg(F.count("*").alias("n"))
    best = cells.groupBy("child").agg(F.min_by(F.struct("parent", "n"), F.struct(-F.col("n"), "parent")).alias("b"), F.sum("n").alias("all"))
    return rounded(best.select("child", "b.parent", (F.col("b.n") / F.col("all")).alias("share")), "share")


@register("WITH m AS (SELECT p_partkey AS id, p_brand || '(' || p_size || ')' AS name, p_brand AS old FROM part) SELECT id, name, CASE WHEN id % 100 = 7 THEN 'own' WHEN old = 'Brand#11' THEN 'first' ELSE old END AS gene FROM m WHERE name NOT LIKE 'Brand#12(1%'")
def gene_names(spark, sf):
    models = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("("), F.col("p_size").cast("string"), F.lit(")")).alias("name"))
    renames = spark.createDataFrame([("Brand#11", "first")], "old string, new string")
    overrides = models.filter("id % 100 = 7").select("id", F.lit("own").alias("gene"))
    return N.gene_names(models, renames, overrides, models.filter("name LIKE 'Brand#12(1%'"))


_MEMBERS = "m AS (SELECT DISTINCT c_mktsegment AS target, o_orderpriority || (o_custkey % 40) AS gene FROM orders JOIN customer ON o_custkey = c_custkey)"


def _members(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_mktsegment").alias("target"), F.concat("o_orderpriority", (F.col("o_custkey") % 40).cast("string")).alias("gene"))


@register(f"WITH {_MEMBERS} SELECT DISTINCT t.target, m.gene FROM (SELECT DISTINCT target FROM m) t JOIN m ON m.target <> t.target")
def complement_sets(spark, sf):
    return N.complement_sets(_members(spark, sf))


@register(f"WITH {_MEMBERS} SELECT target AS module, count(*) AS n FROM m WHERE gene LIKE '1-URGENT%' GROUP BY 1 HAVING count(*) >= 3")
def term_list(spark, sf):
    sets = _members(spark, sf)
    return N.term_list(sets.select(F.col("target").alias("module"), "gene"), sets.filter("gene LIKE '1-URGENT%'").select("gene"), 3)


@register("WITH l AS (SELECT l_partkey AS gene, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) SELECT gene, n AS partners FROM l WHERE n >= 2 AND gene IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def single_gene_sets(spark, sf):
    """One target set per gene; genes without a set, or that no module has, are left out."""
    sets = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.count_distinct("l_suppkey").alias("partners")).filter("partners >= 2")
    return sets.join(table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("gene")), "gene", "left_semi")


@register("SELECT p_partkey, round(-log10(q), 6) + 0.0 AS nlq, round(-ln(q), 6) + 0.0 AS nlq_natural FROM (SELECT p_partkey, CASE WHEN p_size > 1 THEN p_size / 50 END AS q FROM part)")
def negative_logs(spark, sf):
    q = F.when(F.col("p_size") > 1, F.col("p_size") / 50)
    return rounded(table(spark, sf, "part").select("p_partkey", N.negative_log(q).alias("nlq"), N.negative_log(q, True).alias("nlq_natural")), "nlq", "nlq_natural")


@register("WITH c AS (SELECT n_chars, count_if(quality = 1) AS pos, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), w AS (SELECT pos, sum(pos) OVER v / sum(n) OVER v AS precision FROM c WINDOW v AS (ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(pos * precision) / sum(pos), 6) AS area, round((SELECT sum(pos) / sum(n) FROM c), 6) AS positive_share FROM w")
def precision_recall_area(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return rounded(N.average_precision(rows, "n_chars", F.col("quality") == 1), "area", "positive_share")


@register("WITH d AS (SELECT gene, count(*) AS n FROM (SELECT DISTINCT l_partkey AS gene, l_suppkey FROM lineitem) GROUP BY 1) SELECT t AS size, round(avg((n <= t)::INT), 6) AS share FROM d, (VALUES (10), (25), (30)) v(t) GROUP BY 1")
def neighbourhood_sizes(spark, sf):
    """Share of genes whose neighbourhood has at most so many partners."""
    n = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n"))
    grid = spark.createDataFrame([(10,), (25,), (30,)], "size int")
    return rounded(R.ecdf_at(n, "n", grid, "size").select("size", F.col("share_le").alias("share")), "share")


_SPACES = "e AS (SELECT s AS space, vec_id % 2 AS species, label AS region, i AS gene, avg(embedding[i + 16 * s]::DOUBLE) AS value FROM embeddings, range(0, 4) x(s), range(1, 17) g(i) GROUP BY ALL), c AS (SELECT h.space, h.region AS a, m.region AS b, corr(h.value, m.value) AS r FROM e h JOIN e m ON h.space = m.space AND h.gene = m.gene WHERE h.species = 0 AND m.species = 1 GROUP BY ALL)"


def _spaces(spark, sf):
    """Latent spaces of 16 genes each: mean values per space, species and region."""
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 2).alias("species"), F.col("label").alias("region"), F.posexplode("embedding").alias("at", "value"))
    return e.groupBy(F.floor(F.col("at") / 16).alias("space"), "species", "region", (F.col("at") % 16).alias("gene")).agg(F.avg(F.col("value").cast("double")).alias("value"))


def _space_similarity(spark, sf):
    e = _spaces(spark, sf)
    human, mouse = (e.filter(F.col("species") == s).select("space", F.col("region").alias(a), "gene", F.col("value").alias(v)) for s, a, v in ((0, "a", "x"), (1, "b", "y")))
    return human.join(mouse, ["space", "gene"]).groupBy("space", "a", "b").agg(S.METRICS["correlation"](F.col("x"), F.col("y")).alias("r"))


@register(f"WITH {_SPACES} SELECT space, a, b, round(r, 6) AS r FROM c")
def similarity_by_space(spark, sf):
    return rounded(_space_similarity(spark, sf), "r")


@register(f"WITH {_SPACES} SELECT a, b, round(avg(r), 6) AS r FROM c GROUP BY ALL")
def region_similarity(spark, sf):
    """Similarity of each human region to each mouse region, averaged over latent spaces."""
    return rounded(_space_similarity(spark, sf).groupBy("a", "b").agg(F.avg("r").alias("r")), "r")


_SAMPLES = "s AS (SELECT vec_id, label, round((embedding[1]::DOUBLE + 1) / 0.5)::INT AS i, embedding FROM embeddings)"


@register(f"WITH {_SAMPLES} SELECT (i % 3)::INT AS mask, g AS gene, round(avg(embedding[g]::DOUBLE), 6) AS value FROM s, range(1, 65) x(g) GROUP BY ALL")
def sample_signatures(spark, sf):
    """Samples are located in the voxels of a mask by their coordinate; expression is averaged per mask value and gene."""
    voxel = F.round((F.element_at("embedding", 1).cast("double") + 1) / 0.5).cast("int")
    samples = table(spark, sf, "embeddings").select((voxel % 3).alias("mask"), F.posexplode("embedding").alias("g", "v"))
    return rounded(samples.groupBy("mask", (F.col("g").cast("long") + 1).alias("gene")).agg(F.avg(F.col("v").cast("double")).alias("value")), "value")


_TREE = "SELECT 'world' AS node, NULL AS parent UNION ALL SELECT r_name, 'world' FROM region UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"


def _tree(spark, sf):
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    top = spark.createDataFrame([("world", None)], "node string, parent string")
    return top.unionByName(r.select(F.col("r_name").alias("node"), F.lit("world").alias("parent"))).unionByName(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("parent")))


@register("WITH s AS (SELECT c_custkey AS sample, CASE WHEN c_nationkey < 20 THEN r_name END AS node FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT sample, node, CASE WHEN node IS NULL THEN 0 ELSE min(sample) OVER (PARTITION BY node) END AS label FROM s")
def reduced_atlas(spark, sf):
    """Samples of leaves move up to the leaves of the tree pruned below regions; unmatched ones get label 0."""
    samples = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("sample"), F.when(F.col("c_nationkey") < 20, F.col("n_name")).otherwise("unknown").alias("node"), F.col("c_custkey").alias("label"))
    return H.reduced_labels(samples, _tree(spark, sf), table(spark, sf, "region").select(F.col("r_name").alias("node")))


@register("SELECT r_name AS region, (o_orderkey % 4) AS gene, round(avg(o_totalprice), 4) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY ALL")
def label_expression(spark, sf):
    """Expression by atlas region: rows of leaves go to their region, regions that are dropped take theirs with them."""
    kept = table(spark, sf, "region").filter("r_name <> 'ASIA'").select(F.col("r_name").alias("ancestor"))
    up = H.closure(_tree(spark, sf)).join(kept, "ancestor", "left_semi").select(F.col("node").alias("leaf"), F.col("ancestor").alias("region"))
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(rows.join(up, F.col("n_name") == F.col("leaf")).groupBy("region", (F.col("o_orderkey") % 4).alias("gene")).agg(F.avg("o_totalprice").alias("value")), "value", places=4)


@register()
def voxel_significance(spark, sf):
    """Per voxel the one-sample t, its two-sided p with n degrees of freedom, and -log10 of the adjusted p."""
    t = V.one_sample_t(voxels(spark, sf)).withColumn("p", 2 * (1 - pt(F.abs("t"), F.col("n").cast("double"))))
    q = R.bh_over_all(t, "p", "q")
    return rounded(q.withColumn("nlq", N.negative_log(F.col("q"))), "mean", "t", "p", "q", "nlq", places=4)


def _norm_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("at"), F.col("l_quantity").alias("x"), F.col("l_linestatus").alias("sex"), (F.col("l_returnflag") == "N").alias("ctrl"), (F.col("l_suppkey") % 3).alias("batch"), F.col("l_extendedprice").alias("value"))


@register()
def normative_spline(spark, sf):
    """z against natural splines of three degrees of freedom, sex and batch."""
    return rounded(Z.spline_z(_norm_rows(spark, sf), "ctrl", "at", "x", "sex", ["F", "O"], 3, "batch").select("l_orderkey", "l_linenumber", "z"), "z", places=4)


@register()
def control_cross_validation(spark, sf):
    """z of the controls that each of five seeds holds out, by models of its other controls."""
    done = Z.cross_validated_z(_norm_rows(spark, sf), "ctrl", "l_orderkey", "at", "x", "sex", ["F", "O"], 5, batch="batch")
    return rounded(done.select("seed", "l_orderkey", "l_linenumber", "z"), "z", places=4)


@register()
def normative_grid(spark, sf):
    """The fitted curves over a grid of ages for either sex."""
    grid = [(float(a), s) for a in range(5, 31, 5) for s in ("F", "O")]
    return rounded(Z.normative_curves(_norm_rows(spark, sf), grid, "ctrl", "at", "x", "sex", ["F", "O"], 3), "expected", places=3)


@register()
def principal_scores(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    mean, scale, loadings, _ = M.principal_components(rows, "embedding", 2)
    out = M.projected(rows, "embedding", mean, scale, loadings)
    return rounded(out.select("vec_id", F.col("scores")[0].alias("first"), F.col("scores")[1].alias("second")), "first", "second", places=4)


@register()
def discriminant_scores(spark, sf):
    """Signed distance from the cut between images of even and odd labels."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).alias("odd"))
    weights, cut = M.linear_discriminant(rows, "embedding", "odd")
    dot = F.aggregate(F.zip_with("embedding", F.array(*map(F.lit, weights.tolist())), lambda x, w: x.cast("double") * w), F.lit(0.0), lambda s, x: s + x)
    return rounded(rows.select("vec_id", "odd", (dot - cut).alias("score")), "score", places=3)


@register()
def least_squares_scores(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).alias("odd"))
    mean, scale, rotations = M.partial_least_squares(rows, "embedding", "odd", 2)
    out = M.projected(rows, "embedding", mean, scale, rotations)
    return rounded(out.select("vec_id", F.col("scores")[0].alias("first"), F.col("scores")[1].alias("second")), "first", "second", places=4)


@register("SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def csv_round_trip(spark, sf):
    """Written as CSV with a header, read with a schema."""
    path = X.scratch(spark, "csv")
    X.to_csv(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"), path)
    return X.csv(spark, path, "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double")


@register("SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment FROM customer")
def text_csv_round_trip(spark, sf):
    """Read without a schema, all columns are text."""
    path = X.scratch(spark, "csv")
    X.to_csv(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), path)
    return X.csv(spark, path)


@register("SELECT p_brand AS module, 'g' || p_size AS gene FROM part GROUP BY ALL")
def gene_set_round_trip(spark, sf):
    """Gene sets written as lines of id, title and genes, and read into members."""
    path, sets = X.scratch(spark, "gmt"), table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set(F.concat(F.lit("g"), F.col("p_size").cast("string"))).alias("g"))
    X.to_text(sets.select(F.concat_ws("\t", "p_brand", F.lit("a brand"), F.concat_ws("\t", "g")).alias("line")), "line", path)
    return X.members(X.gene_sets(spark, path))


@register(f"SELECT node, parent FROM ({_TREE}) t")
def tree_round_trip(spark, sf):
    """A nested JSON tree, built, written and flattened."""
    leaves = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("id"), F.col("n_name").alias("name"))).alias("children"))
    regions = table(spark, sf, "region").join(leaves, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.struct(F.col("r_name").alias("id"), F.col("r_name").alias("name"), "children").alias("r"))
    path = X.scratch(spark, "tree")
    whole = regions.agg(F.to_json(F.struct(F.lit("world").alias("id"), F.lit("world").alias("name"), F.collect_list("r").alias("children"))).alias("doc"))
    X.to_text(whole, "doc", path)
    return X.tree_json(spark, f"{path}/part-*").select("node", "parent")


@register("SELECT l_linenumber AS number, count(*) AS n FROM lineitem GROUP BY 1")
def numbered_files(spark, sf):
    """A folder of files that hold a number in their names, read in one scan."""
    path = X.scratch(spark, "numbered")
    table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("run")).write.option("header", True).partitionBy("run").csv(path)
    rows = spark.read.option("header", True).schema("l_orderkey long").csv(path).select("l_orderkey", F.regexp_extract("_metadata.file_path", "run=([0-9]+)", 1).cast("int").alias("number"))
    return rows.groupBy("number").agg(F.count("*").alias("n"))


@register("SELECT n_nationkey AS label, (n_nationkey * 1.5)::DOUBLE AS x FROM nation")
def tag_round_trip(spark, sf):
    """Points as tag lines, and their parts by pattern."""
    path = X.scratch(spark, "tags")
    X.to_tags(table(spark, sf, "nation").select((F.col("n_nationkey") * 1.5).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"), F.col("n_nationkey").alias("label")), path)
    line = r'^ (\S+) \S+ \S+ "([0-9]+)"$'
    return spark.read.text(path).select(F.regexp_extract("value", line, 2).cast("int").alias("label"), F.regexp_extract("value", line, 1).cast("double").alias("x"))
