"""Kernel, population and model queries on the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators import ancestry as an
from helixframe.operators import intervals as iv
from helixframe.operators import kernels as k
from helixframe.plans.catalog import Tables, epoch_seconds, query, rounded


def _sites(t: Tables) -> DataFrame:
    """Events of a user as ordered sites: seconds are base pairs, the running count is the map."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hour = (epoch_seconds("ts") / 3600).cast("long")
    dosage = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return t.events.select((F.col("user_id") % 10).alias("sample"), F.floor(hour / 360).alias("contig"), "event_id", epoch_seconds("ts").alias("pos"), hour.alias("hour"), dosage.cast("int").alias("dosage"), "value").withColumn("cm", (F.col("pos") % 10_000_000) / 20_000.0)


@query()
def segment_candidates(t: Tables) -> DataFrame:
    s = _sites(t).withColumn("ibs", F.col("dosage"))
    return k.ibd_segments(s, ["sample", "contig"], window=20, min_cm=1.0, min_sites=5)


@query()
def cnv_segments(t: Tables) -> DataFrame:
    b = _sites(t).groupBy("sample", "contig", F.col("hour").alias("bin")).agg(F.count("*").alias("n"))
    return k.depth_segments(iv.expected_depth_z(b, ["sample", "contig"], "n"), ["sample", "contig"], 1, 1)


@query()
def anchored_clusters(t: Tables) -> DataFrame:
    return k.cluster_positions(_sites(t), ["sample", "contig"], "pos", 36_000, 2)


@query()
def roh_hmm(t: Tables) -> DataFrame:
    s = _sites(t).withColumn("het", F.col("dosage") == 1).withColumn("freq", (F.col("event_id") % 50 + 1) / 60.0)
    return k.roh_segments(s, ["sample", "contig"], 3)


@query()
def archaic_hmm(t: Tables) -> DataFrame:
    b = _sites(t).groupBy("sample", "contig", F.col("hour").alias("window")).agg(F.count("*").alias("n"))
    return k.poisson_segments(b, ["sample", "contig"], (0.4, 2.0))


@query()
def site_match_hmm(t: Tables) -> DataFrame:
    return k.match_segments(_sites(t).withColumn("carried", F.col("hour") % 48 < 4), ["sample", "contig"], 0.9, 3, 100)


@query()
def paint_viterbi(t: Tables) -> DataFrame:
    s = _sites(t).withColumn("freqs", F.array(*((F.col("event_id") % m + 1) / (m + 1.0) for m in (7, 11, 13))))
    return k.paint_segments(s, ["sample", "contig"], 1e-5, 3)


@query()
def admixture_em(t: Tables) -> DataFrame:
    pops = ["a", "b", "c"]
    s = _sites(t).withColumn("freqs", F.array(*((F.col("event_id") % m + 1) / (m + 1.0) for m in (7, 11, 13))))
    return an.admixture_shares(s.select("sample", "dosage", "freqs"), "sample", pops)


@query(
    """WITH d AS (SELECT o_custkey % 50 AS sample, o_orderkey % 400 AS site, CAST(o_orderkey % 4 - 1 AS INTEGER) AS dosage FROM orders), f AS (SELECT p_partkey AS site, pop, ((p_partkey * pop) % 19 + 1) / 21.0 AS p FROM part, (VALUES (3), (5), (7)) v(pop)),
s AS (SELECT sample, pop, count(*) AS sites, sum(ln(CASE WHEN dosage = 0 THEN (1 - p) * (1 - p) WHEN dosage = 1 THEN 2 * p * (1 - p) ELSE p * p END)) AS loglik FROM d JOIN f USING (site) WHERE dosage >= 0 GROUP BY 1, 2), e AS (SELECT *, exp(loglik - max(loglik) OVER (PARTITION BY sample)) AS e FROM s)
SELECT sample, CAST(pop AS VARCHAR) AS pop, sites, floor(loglik * 1000 + 0.5) / 1000 AS loglik, floor(e / sum(e) OVER (PARTITION BY sample) * 10000 + 0.5) / 10000 AS posterior FROM e"""
)
def population_posterior(t: Tables) -> DataFrame:
    d = t.orders.select((F.col("o_custkey") % 50).alias("sample"), (F.col("o_orderkey") % 400).alias("site"), (F.col("o_orderkey") % 4 - 1).cast("int").alias("dosage"))
    f = t.part.select(F.col("p_partkey").alias("site"), F.explode(F.array(*map(F.lit, (3, 5, 7)))).alias("pop")).withColumn("freq", ((F.col("site") * F.col("pop")) % 19 + 1) / 21.0).withColumn("pop", F.col("pop").cast("string"))
    r = an.population_posterior(d, f, ["site"])
    return r.select("sample", "pop", "sites", rounded(F.col("loglik"), 3).alias("loglik"), rounded(F.col("posterior")).alias("posterior"))


@query(
    """WITH n AS (SELECT c_mktsegment AS sample, n_name AS pop, r_name AS sp, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3), s AS (SELECT sample, sp, n / sum(n) OVER (PARTITION BY sample) AS share, sum(n) OVER (PARTITION BY sample) AS sites FROM n),
g AS (SELECT sample, sp, sum(share) AS share, max(sites) AS sites FROM s GROUP BY 1, 2)
SELECT sample, sp, floor(share * 10000 + 0.5) / 10000 AS share, CAST(sites AS BIGINT) AS sites, floor(2 * 1.96 * sqrt(greatest(share * (1 - share), 0) / sites) * 10000 + 0.5) / 10000 AS ci_width, CAST(row_number() OVER (PARTITION BY sample ORDER BY floor(share * 1e6 + 0.5) DESC, sp) AS INTEGER) AS place FROM g"""
)
def admixture_rollup(t: Tables) -> DataFrame:
    g = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    n = g.groupBy(F.col("c_mktsegment").alias("sample"), F.col("n_name").alias("pop"), F.col("r_name").alias("sp")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("sample"))
    r = an.roll_up(n.withColumn("total", total).withColumn("x", F.col("n") / F.col("total")), "sample", "sp", "x", F.col("total"))
    return r.select("sample", "sp", rounded(F.col("share")).alias("share"), "sites", rounded(F.col("ci_width")).alias("ci_width"), "place")


@query(
    """WITH s AS (SELECT p_partkey, p_partkey // 100 AS b, (p_partkey % 7) / 7.0 AS fa, (p_partkey % 11) / 11.0 AS fb, (p_partkey % 13) / 13.0 AS fc, (p_size % 17) / 17.0 AS fd FROM part), k AS (SELECT b, sum((fa - fb) * (fc - fd)) AS s, count(*) AS n FROM s GROUP BY 1), t AS (SELECT sum(s) AS S_, sum(n) AS N_ FROM k),
l AS (SELECT (S_ - s) / (N_ - n) AS l, S_ / N_ AS f4 FROM k, t)
SELECT floor(any_value(f4) * 1000000 + 0.5) / 1000000 AS f4, floor(sqrt((count(*) - 1) / count(*) * sum((l - f4) * (l - f4))) * 1000000 + 0.5) / 1000000 AS se, count(*) AS blocks FROM l"""
)
def f4_block_jackknife(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    s = t.part.select((p % 7 / 7.0).alias("fa"), (p % 11 / 11.0).alias("fb"), (p % 13 / 13.0).alias("fc"), (F.col("p_size") % 17 / 17.0).alias("fd"), F.floor(p / 100).alias("b"))
    return an.f4_jackknife(s, "fa", "fb", "fc", "fd", [F.col("b")]).select(rounded(F.col("f4"), 6).alias("f4"), rounded(F.col("se"), 6).alias("se"), "blocks")


@query(
    """WITH n AS (SELECT l_partkey AS site, l_returnflag || l_linestatus AS pop, avg(l_linenumber % 3) / 2 AS freq FROM lineitem GROUP BY 1, 2), a AS (SELECT site, list(freq ORDER BY pop) AS f FROM n GROUP BY 1 HAVING count(*) >= 2),
m AS (SELECT site, list_sum(f) / len(f) AS mean, list_sum(list_transform(f, lambda x: 2 * x * (1 - x))) / len(f) AS within FROM a)
SELECT site, floor(CASE WHEN 2 * mean * (1 - mean) <= 0 THEN 0.0 ELSE (2 * mean * (1 - mean) - within) / (2 * mean * (1 - mean)) END * 1000000 + 0.5) / 1000000 AS fst FROM m ORDER BY fst DESC, site LIMIT 25"""
)
def fst_topk(t: Tables) -> DataFrame:
    d = t.lineitem.select(F.col("l_partkey").alias("site"), F.concat("l_returnflag", "l_linestatus").alias("pop"), (F.col("l_linenumber") % 3).alias("dosage"))
    f = an.panel_frequencies(d, ["site"], "pop").groupBy("site").agg(F.transform(F.sort_array(F.collect_list(F.struct("pop", "freq"))), lambda x: x["freq"]).alias("f")).where(F.size("f") >= 2)
    return f.select("site", rounded(an.fst(F.col("f")), 6).alias("fst")).orderBy(F.desc("fst"), "site").limit(25)


@query("SELECT l_partkey AS site, l_returnflag AS pop, floor(sum(l_linenumber % 4 - 1) / (2 * count(*)) * 10000 + 0.5) / 10000 AS freq, count(*) AS calls FROM lineitem WHERE l_linenumber % 4 - 1 >= 0 GROUP BY 1, 2")
def panel_frequencies(t: Tables) -> DataFrame:
    d = t.lineitem.select(F.col("l_partkey").alias("site"), F.col("l_returnflag").alias("pop"), (F.col("l_linenumber") % 4 - 1).alias("dosage"))
    return an.panel_frequencies(d, ["site"], "pop").withColumn("freq", rounded(F.col("freq")))


_MEANS, _LOADS = [0.01 * i for i in range(8)], [[0.5, -0.5, 0.25, 0.1, 0.0, -0.2, 0.3, 0.4], [0.1, 0.2, -0.3, 0.4, -0.5, 0.6, -0.1, 0.05]]


@query(
    "SELECT vec_id, "
    + ", ".join("floor((" + " + ".join(f"(CAST(embedding[{i + 1}] AS DOUBLE) - {m!r}::DOUBLE) * ({w!r}::DOUBLE)" for i, (m, w) in enumerate(zip(_MEANS, load, strict=True))) + f") * 10000 + 0.5) / 10000 AS pc{k + 1}" for k, load in enumerate(_LOADS))
    + " FROM embeddings"
)
def pca_project(t: Tables) -> DataFrame:
    v = t.embeddings.select("vec_id", F.slice("embedding", 1, len(_MEANS)).alias("v"))
    return an.project(v, "v", _MEANS, _LOADS).select("vec_id", rounded(F.col("pc1")).alias("pc1"), rounded(F.col("pc2")).alias("pc2"))


@query()
def pca_fit(t: Tables) -> DataFrame:
    means, load, var = an.fit_components(t.embeddings.select(F.slice("embedding", 1, 8).alias("v")), "v", 3)
    return t.spark.createDataFrame([(k + 1, float(var[k]), [float(x) for x in load[k]]) for k in range(3)], "component int, variance double, loadings array<double>")


@query(
    """WITH s AS (SELECT c_nationkey, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd FROM customer GROUP BY 1)
SELECT c_custkey, CASE WHEN sd <= 0 THEN NULL ELSE CASE WHEN c_acctbal > m THEN 'above' WHEN c_acctbal < m THEN 'below' ELSE 'mean' END END AS side FROM customer JOIN s USING (c_nationkey)"""
)
def normal_percentile_side(t: Tables) -> DataFrame:
    s = t.customer.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("sd"))
    p = an.normal_percentile(F.col("c_acctbal"), F.col("m"), F.col("sd"), F.lit(500))
    j = t.customer.join(s, "c_nationkey").withColumn("p", p)
    return j.select("c_custkey", F.when(F.col("p") > 50, "above").when(F.col("p") < 50, "below").when(F.col("p").isNotNull(), "mean").alias("side"))


@query(
    "SELECT count(*) AS sites, CAST(sum(dosage) AS BIGINT) AS copies, cls FROM (SELECT o_custkey % 30 AS k, o_orderkey % 3 AS dosage, CASE WHEN p_size % 3 = 0 THEN 'neanderthal' WHEN p_size % 3 = 1 THEN 'denisovan' ELSE 'shared' END AS cls FROM orders JOIN part ON p_partkey = o_orderkey % 2000 + 1) GROUP BY cls"
)
def archaic_copies(t: Tables) -> DataFrame:
    cls = F.when(F.col("p_size") % 3 == 0, "neanderthal").when(F.col("p_size") % 3 == 1, "denisovan").otherwise("shared")
    j = t.orders.join(t.part, F.col("p_partkey") == F.col("o_orderkey") % 2000 + 1)
    return j.groupBy(cls.alias("cls")).agg(F.count("*").alias("sites"), F.sum(F.col("o_orderkey") % 3).alias("copies"))


@query("SELECT l_orderkey, l_partkey, CAST(l_linenumber % 3 AS INTEGER) AS dosage FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 25 AND l_linenumber % 3 <> 0")
def dosage_panel_join(t: Tables) -> DataFrame:
    panel = t.part.where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.where("l_linenumber % 3 <> 0").join(panel, "l_partkey").select("l_orderkey", "l_partkey", (F.col("l_linenumber") % 3).cast("int").alias("dosage"))


@query("SELECT p_partkey, CASE WHEN l.k IS NULL THEN 0 ELSE l.d END AS dosage FROM part LEFT JOIN (SELECT l_partkey AS k, CASE WHEN max(l_linenumber) > 5 THEN NULL ELSE CAST(max(l_linenumber) % 3 AS INTEGER) END AS d FROM lineitem WHERE l_quantity >= 49 AND l_discount > 0.08 GROUP BY 1) l ON l.k = p_partkey WHERE l.k IS NULL OR l.d IS NOT NULL")
def hom_ref_fill(t: Tables) -> DataFrame:
    """Sites without a call of enough depth are taken as the reference's; calls that failed are left out."""
    deep = t.lineitem.where("l_quantity >= 49 and l_discount > 0.08")
    seen = deep.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_linenumber").alias("m"))
    called = seen.select("p_partkey", F.lit(True).alias("present"), F.when(F.col("m") <= 5, (F.col("m") % 3).cast("int")).alias("d"))
    j = t.part.select("p_partkey").join(called, "p_partkey", "left").where("present is null or d is not null")
    return j.select("p_partkey", F.when(F.col("present").isNull(), 0).otherwise(F.col("d")).alias("dosage"))


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 30 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def anti_known(t: Tables) -> DataFrame:
    return t.lineitem.where("l_quantity > 30").select("l_partkey").distinct().join(t.part.where("p_size > 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti")


def _haplotypes(t: Tables) -> DataFrame:
    """Parts as sites of 24 haplotypes from three populations, whose alleles follow the population in stretches."""
    k = F.col("p_partkey")
    alleles = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.pmod(F.xxhash64(k, h % 3), F.lit(2)).cast("int"))
    labels = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.concat(F.lit("P"), (h % 3).cast("string")))
    return t.part.select((k % 2).alias("contig"), (k * 1000).alias("pos"), (k / 20.0).alias("cm"), alleles.alias("alleles"), labels.alias("labels"))


def _panel_dosages(t: Tables) -> DataFrame:
    """Twenty groups of suppliers as samples: one side copies a population for a stretch of sites, the other the next one."""
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    side = lambda shift: F.pmod(F.xxhash64(k, F.pmod(s % 20 + F.floor(k / 60) + shift, F.lit(3)).cast("int")), F.lit(2))
    return t.lineitem.select((s % 20).alias("sample"), (k % 2).alias("contig"), (k * 1000).alias("pos"), (side(0) + side(1)).cast("int").alias("dosage")).distinct()


@query()
def phase_haplotypes(t: Tables) -> DataFrame:
    return k.phase_samples(_panel_dosages(t), _haplotypes(t), beam=16, donors=8)


@query()
def local_ancestry(t: Tables) -> DataFrame:
    return k.local_ancestry(k.phase_samples(_panel_dosages(t), _haplotypes(t), beam=16, donors=8), _haplotypes(t), 1.0)


@query(
    """WITH d AS (SELECT o_custkey % 50 AS subject, o_orderkey % 3 AS source, o_orderkey % 400 AS site, CAST(o_orderkey % 4 - 1 AS INTEGER) AS dosage FROM orders), f AS (SELECT p_partkey AS site, pop, ((p_partkey * pop) % 19 + 1) / 21.0 AS p FROM part, (VALUES (3), (5), (7)) v(pop)),
s AS (SELECT subject, source, pop, floor(sum(ln(CASE WHEN dosage = 0 THEN (1 - p) * (1 - p) WHEN dosage = 1 THEN 2 * p * (1 - p) ELSE p * p END)) * 1000000 + 0.5) AS ll FROM d JOIN f USING (site) WHERE dosage >= 0 GROUP BY 1, 2, 3), b AS (SELECT subject, source, arg_max(CAST(pop AS VARCHAR), (ll, CAST(pop AS VARCHAR))) AS pop FROM s GROUP BY 1, 2)
SELECT subject, count(*) AS sources, count(DISTINCT pop) = 1 AS stable, min(pop) AS pop FROM b GROUP BY 1"""
)
def ancestry_stability(t: Tables) -> DataFrame:
    """Whether all sources of a subject give one population."""
    d = t.orders.select(F.struct((F.col("o_custkey") % 50).alias("subject"), (F.col("o_orderkey") % 3).alias("source")).alias("sample"), (F.col("o_orderkey") % 400).alias("site"), (F.col("o_orderkey") % 4 - 1).cast("int").alias("dosage"))
    f = t.part.select(F.col("p_partkey").alias("site"), F.explode(F.array(*map(F.lit, (3, 5, 7)))).alias("pop")).withColumn("freq", ((F.col("site") * F.col("pop")) % 19 + 1) / 21.0).withColumn("pop", F.col("pop").cast("string"))
    r = an.population_posterior(d, f, ["site"])
    best = r.groupBy("sample").agg(F.max_by("pop", F.struct(F.floor(F.col("loglik") * 1e6 + 0.5).alias("k"), "pop")).alias("pop"))
    return best.groupBy(F.col("sample.subject").alias("subject")).agg(F.count("*").alias("sources"), (F.count_distinct("pop") == 1).alias("stable"), F.min("pop").alias("pop"))
