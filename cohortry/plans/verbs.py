"""Relational verbs over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.operators import relational as R
from cohortry.plans.fixtures import Register, rounded, table

register = Register()


@register("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS band, c_nationkey AS site FROM customer WHERE c_acctbal BETWEEN -500 AND 8000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def select_filter_case(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    band = F.when(F.col("c_acctbal") < 0, "low").when(F.col("c_acctbal") < 5000, "mid").otherwise("high")
    return c.filter(F.col("c_acctbal").between(-500, 8000) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("id"), band.alias("band"), F.col("c_nationkey").alias("site"))


@register("SELECT c_custkey, CASE WHEN c_nationkey NOT IN (7, 13) THEN c_nationkey END AS c_nationkey FROM customer")
def sentinels(spark, sf):
    return R.sentinels_to_null(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], [7, 13])


@register("SELECT event_id, TRY_CAST(CASE WHEN value < 20 THEN '<20' ELSE CAST(floor(value)::BIGINT AS VARCHAR) END AS DOUBLE) AS score FROM events")
def censored_values(spark, sf):
    text = F.when(F.col("value") < 20, "<20").otherwise(F.floor("value").cast("string"))
    return R.censored_to_number(table(spark, sf, "events").select("event_id", text.alias("score")), ["score"])


@register("SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN source END, CASE WHEN n_chars > 500 THEN lang END, 'none') AS origin FROM documents")
def coalesced(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.when(F.col("lang") == "en", F.col("source")), F.when(F.col("n_chars") > 500, F.col("lang")), F.lit("none")).alias("origin"))


@register("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def complete_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return R.complete_cases(d, ["quality", "toxic"]).select("doc_id", "lang", "quality", "toxic")


@register("SELECT c_custkey, coalesce(m.value, c_mktsegment) AS segment FROM customer LEFT JOIN (VALUES ('BUILDING', 'B'), ('MACHINERY', 'M')) m(code, value) ON c_mktsegment = m.code")
def recode(spark, sf):
    codes = spark.createDataFrame([("BUILDING", "B"), ("MACHINERY", "M")], "code string, value string")
    return R.recoded(table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), "segment", codes, "code", "value")


@register("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 3")
def having_count(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n")).filter("n > 3")


@register("SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count_if(p_size > 25) >= 2)")
def filter_by_group_count(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    good = p.groupBy("p_brand").agg(F.count_if(F.col("p_size") > 25).alias("n")).filter("n >= 2")
    return p.join(good, "p_brand", "left_semi").select("p_partkey", "p_brand")


@register("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_totalprice = m")
def group_maximum(spark, sf):
    return R.group_maxima(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice")


@register("SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def inner_joins(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@register("SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def left_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@register("SELECT coalesce(c.k, s.k) AS k, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k")
def full_join(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "k", "full_outer")


@register("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").filter("quality = 1"), "doc_id", "left_semi")


@register("SELECT n_nationkey, r_regionkey FROM nation, region WHERE NOT EXISTS (SELECT 1 FROM customer, nation m WHERE c_nationkey = nation.n_nationkey AND m.n_nationkey = c_nationkey AND m.n_regionkey = region.r_regionkey)")
def anti_join_two_keys(spark, sf):
    grid = table(spark, sf, "nation").select("n_nationkey").join(F.broadcast(table(spark, sf, "region").select("r_regionkey")))
    have = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    return grid.join(have, ["n_nationkey", "r_regionkey"], "left_anti")


@register("SELECT n_nationkey AS nation, s AS status, coalesce(n, 0) AS n FROM nation CROSS JOIN (VALUES ('F'), ('O'), ('P')) v(s) LEFT JOIN (SELECT c_nationkey, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) ON c_nationkey = n_nationkey AND o_orderstatus = s")
def counts_on_grid(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    grid = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.explode(F.array(*map(F.lit, "FOP"))).alias("status"))
    return R.on_grid(o, grid, ["nation", "status"], {"n": 0})


@register("SELECT a.p_size AS a, b.p_size AS b, a.n AS n_a, b.n AS n_b FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1) a JOIN (SELECT p_size, count(*) AS n FROM part GROUP BY 1) b ON abs(a.p_size - b.p_size) <= 2")
def band(spark, sf):
    sizes = table(spark, sf, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    return R.band_join(sizes.select(F.col("p_size").alias("a"), F.col("n").alias("n_a")), sizes.select(F.col("p_size").alias("b"), F.col("n").alias("n_b")), "a", "b", 2)


@register("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def distinct_pairs(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("a")).join(n.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("b")), "r").filter("a < b").select("a", "b")


@register("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) o ON o_custkey = c_custkey AND rn = 1")
def first_match_lookup(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return R.first_match(table(spark, sf, "customer").select("c_custkey"), o, "c_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_totalprice"])


@register("SELECT c.n_regionkey, c.kind, c.n, s.m FROM (SELECT n_regionkey, CASE WHEN n_regionkey <> 2 THEN 'x' END AS kind, count(*) AS n FROM nation GROUP BY ALL) c JOIN (SELECT n_regionkey, CASE WHEN n_regionkey <> 2 THEN 'x' END AS kind, max(n_nationkey) AS m FROM nation GROUP BY ALL) s ON c.n_regionkey IS NOT DISTINCT FROM s.n_regionkey AND c.kind IS NOT DISTINCT FROM s.kind")
def natural_null_join(spark, sf):
    n = table(spark, sf, "nation").withColumn("kind", F.when(F.col("n_regionkey") != 2, "x"))
    return R.natural_join(n.groupBy("n_regionkey", "kind").agg(F.count("*").alias("n")), n.groupBy("n_regionkey", "kind").agg(F.max("n_nationkey").alias("m")))


@register("SELECT DISTINCT a.l_suppkey AS supplier, b.l_suppkey AS other FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) b ON a.l_partkey = b.l_partkey")
def bridge_join(spark, sf):
    pairs = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return R.bridged_pairs(pairs, "l_partkey", "l_suppkey").select(F.col("a").alias("supplier"), F.col("b").alias("other"))


@register("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 4) AS mean_price, round(stddev_samp(l_discount), 6) AS sd_discount, min(l_tax) AS min_tax, max(l_tax) AS max_tax, count_if(l_discount > 0.05) AS n_discounted, bool_or(l_quantity > 49) AS any_large FROM lineitem GROUP BY ALL")
def grouped_summary(spark, sf):
    agg = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("mean_price"), F.stddev_samp("l_discount").alias("sd_discount"), F.min("l_tax").alias("min_tax"), F.max("l_tax").alias("max_tax"), F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"), F.bool_or(F.col("l_quantity") > 49).alias("any_large"))
    return rounded(rounded(rounded(agg, "quantity", places=2), "mean_price", places=4), "sd_discount")


@register("SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.025), 6) AS low, round(median(c_acctbal), 6) AS mid, round(quantile_cont(c_acctbal, 0.975), 6) AS high FROM customer GROUP BY 1")
def quantiles(spark, sf):
    p = [F.percentile("c_acctbal", q).alias(n) for n, q in (("low", 0.025), ("mid", 0.5), ("high", 0.975))]
    return rounded(table(spark, sf, "customer").groupBy("c_mktsegment").agg(*p), "low", "mid", "high")


@register("SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted FROM lineitem GROUP BY 1")
def weighted_mean(spark, sf):
    w = F.try_divide(F.sum(F.col("l_extendedprice") * F.col("l_quantity")), F.sum("l_quantity"))
    return rounded(table(spark, sf, "lineitem").groupBy("l_suppkey").agg(w.alias("weighted")), "weighted", places=4)


@register("SELECT o_orderstatus, count_if(o_orderpriority = '1-URGENT') AS urgent, count_if(o_orderpriority = '5-LOW') AS low, count_if(o_orderpriority NOT IN ('1-URGENT', '5-LOW')) AS rest FROM orders GROUP BY 1")
def contingency(spark, sf):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("rest")
    return table(spark, sf, "orders").withColumn("kind", kind).groupBy("o_orderstatus").pivot("kind", ["urgent", "low", "rest"]).count().fillna(0)


@register("SELECT o_orderstatus, o_orderpriority, n, round(n / sum(n) OVER (), 6) AS of_all, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS of_status FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)")
def proportions(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    out = n.join(F.broadcast(total)).withColumns({"of_all": F.col("n") / F.col("t"), "of_status": F.col("n") / F.sum("n").over(Window.partitionBy("o_orderstatus"))})
    return rounded(out.drop("t"), "of_all", "of_status")


@register("SELECT t AS threshold, round(avg((o_totalprice <= t)::INT), 6) AS share_le, round(avg((o_totalprice >= t)::INT), 6) AS share_ge FROM orders, (VALUES (50000.0), (100000.0), (200000.0)) v(t) GROUP BY 1")
def ecdf(spark, sf):
    grid = spark.createDataFrame([(50000.0,), (100000.0,), (200000.0,)], "threshold double")
    return rounded(R.ecdf_at(table(spark, sf, "orders"), "o_totalprice", grid, "threshold"), "share_le", "share_ge")


@register("SELECT CASE WHEN p_size > 0 AND p_size <= 10 THEN 0 WHEN p_size > 10 AND p_size <= 25 THEN 1 WHEN p_size > 25 AND p_size <= 50 THEN 2 END::INT AS bin, count(*) AS n FROM part GROUP BY 1")
def binned_counts(spark, sf):
    return table(spark, sf, "part").groupBy(R.binned(F.col("p_size"), [0, 10, 25, 50]).alias("bin")).agg(F.count("*").alias("n"))


@register("SELECT DISTINCT l_partkey, l_returnflag FROM lineitem")
def distinct_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", "l_returnflag").distinct()


@register("SELECT p_partkey, round(p_retailprice / max(p_retailprice) OVER w, 6) AS of_max, round((p_retailprice - min(p_retailprice) OVER w) / nullif(max(p_retailprice) OVER w - min(p_retailprice) OVER w, 0), 6) AS scaled, round((p_retailprice - avg(p_retailprice) OVER w) / nullif(stddev_samp(p_retailprice) OVER w, 0), 6) AS z FROM part WINDOW w AS (PARTITION BY p_brand)")
def normalised(spark, sf):
    w = Window.partitionBy("p_brand")
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice", F.col("p_retailprice").alias("z"))
    low, high = F.min("p_retailprice").over(w), F.max("p_retailprice").over(w)
    out = R.zscored(p, ["z"], ["p_brand"]).withColumns({"of_max": F.col("p_retailprice") / high, "scaled": F.try_divide(F.col("p_retailprice") - low, high - low)})
    return rounded(out.select("p_partkey", "of_max", "scaled", "z"), "of_max", "scaled", "z")


@register("SELECT c_nationkey, c_custkey, round(least(1.0, min(raw) OVER (PARTITION BY c_nationkey ORDER BY p DESC, c_custkey DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM (SELECT *, p * count(*) OVER (PARTITION BY c_nationkey) / row_number() OVER (PARTITION BY c_nationkey ORDER BY p, c_custkey) AS raw FROM (SELECT c_nationkey, c_custkey, (abs(c_acctbal) % 1000) / 1000 AS p FROM customer))")
def bh_per_group(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", ((F.abs("c_acctbal") % 1000) / 1000).alias("p"))
    return rounded(R.bh_adjusted(c, "p", ["c_nationkey"], "q", ["c_custkey"]).drop("p"), "q", places=9)


@register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= (SELECT min(o_totalprice) FROM (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 25))")
def top_rows(spark, sf):
    return R.top_with_ties(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice"), 25)


@register("SELECT p_brand, p_partkey, p_size FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part) WHERE r <= 3")
def top_per_group(spark, sf):
    return R.top_with_ties(table(spark, sf, "part").select("p_brand", "p_partkey", "p_size"), F.col("p_size"), 3, ["p_brand"])


@register("SELECT u.user_id, e.ts, e.v AS value FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT * FROM (SELECT user_id, ts, CASE WHEN event_type = 'purchase' THEN value END AS v, max(ts) OVER (PARTITION BY user_id) AS m FROM events WHERE event_type = 'purchase') WHERE ts = m) e USING (user_id)")
def latest_visit(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"))
    return R.latest_nonempty(e, "user_id", "ts", ["value"])


@register("""WITH l AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY ALL), u AS (SELECT DISTINCT user_id FROM events), t AS (SELECT event_type, count(*) AS have, row_number() OVER (ORDER BY count(*) DESC, event_type) AS r FROM l GROUP BY 1),
f AS (SELECT user_id, min(CASE WHEN v IS NULL THEN r END) AS first FROM u CROSS JOIN t LEFT JOIN l USING (user_id, event_type) GROUP BY 1)
SELECT r::INT AS n_variables, (SELECT count(*) FROM f WHERE first IS NULL OR first > r) AS n_complete FROM t""")
def complete_case_curve(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    types = e.select("event_type").distinct()
    long = e.select("user_id").distinct().join(F.broadcast(types)).join(e, ["user_id", "event_type"], "left")
    return R.completeness_curve(long, "user_id", "event_type", "v")


@register("SELECT vec_id AS image, nk, (label % nk)::INT AS k FROM embeddings, (VALUES (2), (5), (10)) v(nk)")
def wide_to_long(spark, sf):
    from cohortry.plans.fixtures import clusters

    return clusters(spark, sf)


@register("SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view, max(value) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def long_to_wide(spark, sf):
    kinds = ["click", "view", "purchase"]
    return table(spark, sf, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.max("value"))


@register("SELECT p_partkey, p_brand || '-' || p_size AS id, split_part(p_type, ' ', 1) AS first, split_part(p_type, ' ', -1) AS last, lpad(p_partkey::VARCHAR, 8, '0') AS code, upper(p_name[1]) || lower(p_name[2:3]) AS title, right(p_name, 3) AS tail FROM part")
def unite_separate(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.concat_ws("-", "p_brand", "p_size").alias("id"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("first"), F.split_part("p_type", F.lit(" "), F.lit(-1)).alias("last"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("code"), F.concat(F.upper(F.substring("p_name", 1, 1)), F.lower(F.substring("p_name", 2, 2))).alias("title"), F.right("p_name", F.lit(3)).alias("tail"))


@register(r"SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '/([0-9]+)', 1) AS number, regexp_matches(url, '[.]html') AS html, regexp_replace(url, '[0-9]', '', 'g') AS bare, starts_with(url, 'https') AS secure FROM pages")
def path_parts(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(u, "://([^/?#]*)", 1).alias("host"), F.regexp_extract(u, "/([0-9]+)", 1).alias("number"), u.rlike("[.]html").alias("html"), F.regexp_replace(u, "[0-9]", "").alias("bare"), u.startswith("https").alias("secure"))


@register("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def json_field(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@register("SELECT 'customer' AS origin, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier")
def tagged_union(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@register("SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'either', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def set_operations(spark, sf):
    a, b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = (("both", a.intersect(b)), ("either", a.union(b).distinct()), ("only", a.subtract(b)))
    frames = [x.select(F.lit(name).alias("kind"), "k") for name, x in parts]
    return frames[0].union(frames[1]).union(frames[2])


@register("SELECT DISTINCT x AS key FROM (SELECT l_partkey AS x FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem)")
def flattened_columns(spark, sf):
    return table(spark, sf, "lineitem").select(F.explode(F.array("l_partkey", "l_suppkey")).alias("key")).distinct()


@register("SELECT l_orderkey, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1")
def list_lengths(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.size(F.collect_set("l_partkey")).cast("long").alias("n_parts"))


@register("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth, year(o_orderdate) AS y, round(log10(o_totalprice), 6) AS l10, round(sqrt(o_totalprice), 6) AS root, floor(o_totalprice / 1000)::BIGINT AS thousands FROM orders")
def ranks_and_math(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    p = F.col("o_totalprice")
    out = table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).alias("nth"), F.year("o_orderdate").alias("y"), F.log10(p).alias("l10"), F.sqrt(p).alias("root"), F.floor(p / 1000).alias("thousands"))
    return rounded(out, "l10", "root")


@register("WITH m AS (SELECT DISTINCT p_brand AS g, l_suppkey AS i FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT g, count(*) AS n FROM m GROUP BY 1) SELECT x.g AS a, y.g AS b, count(*) AS shared, round(count(*) / (sa.n + sb.n - count(*)), 6) AS jaccard, round(count(*) / least(sa.n, sb.n), 6) AS overlap, round(count(*) / sa.n, 6) AS a_in_b, round(count(*) / sb.n, 6) AS b_in_a FROM m x JOIN m y ON x.i = y.i AND x.g < y.g JOIN s sa ON sa.g = x.g JOIN s sb ON sb.g = y.g GROUP BY x.g, y.g, sa.n, sb.n")
def set_overlap_measures(spark, sf):
    m = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(R.set_overlaps(m, "p_brand", "l_suppkey"), "jaccard", "overlap", "a_in_b", "b_in_a")
