"""Consensus, profile, cohort-store and reporting queries on the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators import consensus as cs
from helixframe.operators import relational as rel
from helixframe.plans.catalog import Tables, query, rounded

_W = "CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.8 ELSE 0.5 END * (1 + least(sqrt(l_quantity) / 10, 1.0)) * least(floor(l_discount * 100 + 0.5) * 6 / 60.0, 1.0) * CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.9 END * least(greatest(l_tax * 10, 0.1), 1.0)"
_VOTE = f"""WITH o AS (SELECT l_partkey AS variant, l_returnflag AS value, {_W} AS weight FROM lineitem), w AS (SELECT variant, value, CAST(floor(sum(weight) * 1000000 + 0.5) AS BIGINT) AS w, count(*) AS n FROM o GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY w DESC, n DESC, value) AS r, sum(w) OVER (PARTITION BY variant) AS total, sum(n) OVER (PARTITION BY variant) AS obs, count(*) OVER (PARTITION BY variant) AS vals FROM w),
v AS (SELECT variant, value, w / 1000000.0 AS weight, CASE WHEN total = 0 THEN 0.0 ELSE w / total END AS share, CAST(obs AS BIGINT) AS n_obs, vals AS n_values FROM r WHERE r = 1),
s AS (SELECT *, CASE WHEN n_obs = 0 THEN 'NoCoverage' WHEN 1 - share > 0.3 THEN 'Conflict' WHEN value = 'R' AND variant % 3 <> 0 THEN 'Novel' WHEN n_obs = 1 THEN 'SingleSource' WHEN share >= 0.7 THEN 'Confirmed' ELSE 'Pending' END AS status FROM v)"""


def _votes(t: Tables) -> DataFrame:
    method = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 0.8).otherwise(0.5)
    w = cs.observation_weight(method, F.col("l_quantity"), F.floor(F.col("l_discount") * 100 + 0.5) * 6, F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.9), F.col("l_tax") * 10)
    v = cs.vote(t.lineitem.select(F.col("l_partkey").alias("variant"), F.col("l_returnflag").alias("value"), w.alias("weight")), ["variant"], "value", "weight")
    return v.withColumn("status", cs.status(F.col("share"), F.col("n_obs"), F.col("value") == "R", F.col("variant") % 3 == 0))


@query(_VOTE + " SELECT variant, value, floor(weight * 1000 + 0.5) / 1000 AS weight, floor(share * 1000 + 0.5) / 1000 AS share, n_obs, n_values, status FROM s")
def consensus_weighted(t: Tables) -> DataFrame:
    return _votes(t).withColumn("weight", rounded(F.col("weight"), 3)).withColumn("share", rounded(F.col("share"), 3))


@query(
    _VOTE
    + """ SELECT variant % 10 AS sample, count(*) AS total, count(*) FILTER (status = 'Conflict') AS conflict, count(*) FILTER (status = 'Novel') AS novel, count(*) FILTER (status = 'SingleSource') AS singlesource,
 count(*) FILTER (status = 'Pending') AS pending, count(*) FILTER (status = 'Confirmed') AS confirmed, count(*) FILTER (status = 'NoCoverage') AS nocoverage,
 floor(least(greatest((count(*) FILTER (status = 'Confirmed') + 0.7 * count(*) FILTER (status = 'Novel') - 0.5 * count(*) FILTER (status = 'Conflict')) / count(*), 0), 1) * 10000 + 0.5) / 10000 AS confidence FROM s GROUP BY 1"""
)
def consensus_profile(t: Tables) -> DataFrame:
    p = cs.profile(_votes(t).withColumn("sample", F.col("variant") % 10), ["sample"])
    return p.withColumn("confidence", rounded(F.col("confidence")))


@query(_VOTE + " SELECT variant, status, row_number() OVER (ORDER BY CASE status WHEN 'Conflict' THEN 0 WHEN 'Novel' THEN 1 WHEN 'Pending' THEN 2 WHEN 'SingleSource' THEN 3 WHEN 'Confirmed' THEN 4 ELSE 5 END, variant) AS place FROM s")
def status_order(t: Tables) -> DataFrame:
    """Places over all variants: ranked inside each status, after the counts of the statuses before it."""
    v = _votes(t).select("variant", "status", cs.status_rank().alias("r"))
    sizes = v.groupBy("r").agg(F.count("*").alias("n"))
    before = sizes.select("r", (F.sum("n").over(Window.orderBy("r")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("r").orderBy("variant"))
    return v.withColumn("own", own).join(F.broadcast(before), "r").select("variant", "status", (F.col("before") + F.col("own")).alias("place"))


@query(
    """WITH o AS (SELECT o_custkey AS site, CAST(o_orderkey % 4 AS INTEGER) AS dosage, 1 + least(sqrt(o_totalprice / 1000) / 10, 1.0) AS weight FROM orders),
w AS (SELECT site, dosage, CAST(floor(sum(weight) * 1000000 + 0.5) AS BIGINT) AS w, count(*) AS n FROM o WHERE dosage <= 2 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY w DESC, n DESC, dosage) AS r, sum(w) OVER (PARTITION BY site) AS total, sum(n) OVER (PARTITION BY site) AS obs FROM w)
SELECT site, dosage AS value, floor(w / total * 1000 + 0.5) / 1000 AS share, CAST(obs AS BIGINT) AS n_obs FROM r WHERE r = 1"""
)
def dosage_consensus(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_custkey").alias("site"), (F.col("o_orderkey") % 4).cast("int").alias("dosage"), (1 + F.least(F.sqrt(F.col("o_totalprice") / 1000) / 10, F.lit(1.0))).alias("weight"))
    return cs.dosage_consensus(o, ["site"], "dosage", "weight").select("site", "value", rounded(F.col("share"), 3).alias("share"), "n_obs")


@query(
    """WITH w AS (SELECT o_custkey AS subject, o_orderpriority AS value, CAST(sum(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END) AS BIGINT) AS w FROM orders GROUP BY 1, 2)
SELECT subject, value, w AS weight FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY w DESC, value DESC) AS r FROM w) WHERE r = 1"""
)
def pooled_vote(t: Tables) -> DataFrame:
    w = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    return cs.pooled_vote(t.orders.select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("value"), "o_orderstatus"), ["subject"], "value", w)


@query(
    """WITH o AS (SELECT o_custkey AS subject, o_orderpriority AS value, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS r FROM orders), m AS (SELECT *, max(r) OVER (PARTITION BY subject) AS m FROM o),
b AS (SELECT *, max(value) FILTER (r = m) OVER (PARTITION BY subject) AS v FROM m), c AS (SELECT *, count(*) FILTER (r < m AND value <> v) OVER (PARTITION BY subject) AS warnings FROM b)
SELECT DISTINCT subject, value, warnings FROM c WHERE r = m AND value = v"""
)
def provenance_precedence(t: Tables) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    return cs.precedence(t.orders.select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("value"), "o_orderstatus"), ["subject"], rank)


@query(
    """WITH a AS (SELECT o_custkey AS subject, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 10 ELSE 6 END) AS DOUBLE) / (10 * count(*)) AS c, count(*) FILTER (o_orderpriority <> '1-URGENT') AS sites, count(*) FILTER (o_orderstatus = 'P') AS d, count(*) FILTER (o_orderpriority = '2-HIGH') AS m FROM orders GROUP BY 1)
SELECT subject, CASE WHEN sites > 0 AND c >= 0.95 THEN 'VerifiedSame' WHEN sites > 0 AND c >= 0.85 THEN 'LikelySame' WHEN sites > 0 AND c >= 0.65 THEN 'Uncertain' WHEN sites > 0 AND c >= 0.5 THEN 'LikelyDifferent' WHEN sites > 0 THEN 'VerifiedDifferent' WHEN m > 0 AND d = 0 THEN 'LikelySame' ELSE 'Uncertain' END AS band,
 CASE WHEN sites > 0 AND m > 0 THEN 'SNP concordance + Y-STR' WHEN sites > 0 THEN 'SNP concordance' WHEN m > 0 THEN 'Y-STR only' ELSE 'no shared data' END AS method FROM a"""
)
def identity_bands(t: Tables) -> DataFrame:
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    c = F.sum(F.when(F.col("o_orderstatus") == "F", 10).otherwise(6)) / (10 * F.count("*"))
    a = t.orders.groupBy(F.col("o_custkey").alias("subject")).agg(c.alias("c"), F.count_if(F.col("o_orderpriority") != "1-URGENT").alias("sites"), is_("o_orderstatus", "P").alias("d"), is_("o_orderpriority", "2-HIGH").alias("m"))
    return a.select("subject", cs.identity_band(F.col("c"), F.col("sites"), F.col("d"), F.col("m")).alias("band"), cs.identity_method(F.col("c"), F.col("sites"), F.col("m")).alias("method"))


def _markers(t: Tables) -> DataFrame:
    return t.lineitem.select((F.col("l_suppkey") % 200).alias("subject"), (F.col("l_partkey") % 30).alias("marker"), F.col("l_shipdate").alias("at"), F.floor("l_quantity").cast("int").alias("repeats"), F.col("l_returnflag").alias("provider"))


_MARK = "WITH m AS (SELECT l_suppkey % 200 AS subject, l_partkey % 30 AS marker, CAST(floor(l_quantity) AS INTEGER) AS repeats, l_returnflag AS provider FROM lineitem)"


@query(
    _MARK
    + """, n AS (SELECT subject, marker, repeats, count(*) AS n FROM m GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY subject, marker ORDER BY n DESC, repeats) AS r, count(*) OVER (PARTITION BY subject, marker) AS kinds, sum(n) OVER (PARTITION BY subject, marker) AS total FROM n)
SELECT subject, marker, repeats AS value, n, CAST(total AS BIGINT) AS total, kinds > 1 AS conflict FROM r WHERE r = 1"""
)
def marker_consensus(t: Tables) -> DataFrame:
    return cs.marker_consensus(_markers(t), ["subject", "marker"], "repeats")


@query(_MARK + " SELECT subject, marker, count(DISTINCT provider) AS providers, count(DISTINCT repeats % 3) AS kinds, CASE WHEN count(DISTINCT repeats % 3) = 1 THEN 'agree' ELSE 'conflict' END AS verdict FROM m GROUP BY 1, 2 HAVING count(DISTINCT provider) >= 2")
def marker_compare(t: Tables) -> DataFrame:
    return cs.provider_comparison(_markers(t).withColumn("v", F.col("repeats") % 3), ["subject", "marker"], "provider", "v")


@query(
    _MARK
    + """, x AS (SELECT marker, [repeats % 5, repeats % 3] AS v FROM m), n AS (SELECT marker, v, count(*) AS n, row_number() OVER (PARTITION BY marker ORDER BY count(*) DESC, v) AS r FROM x GROUP BY 1, 2)
SELECT marker, min(v) AS low, max(v) AS high, max(v) FILTER (r = 1) AS mode FROM n GROUP BY 1"""
)
def marker_stats(t: Tables) -> DataFrame:
    return cs.tuple_stats(_markers(t).withColumn("v", F.array(F.col("repeats") % 5, F.col("repeats") % 3)), ["marker"], "v")


@query(
    """WITH c AS (SELECT n_regionkey AS region, c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, region, floor((rank() OVER (PARTITION BY region ORDER BY c_acctbal) - 1) * 100.0 / count(c_acctbal) OVER (PARTITION BY region) * 10000 + 0.5) / 10000 AS percentile FROM c"""
)
def percentile_in_group(t: Tables) -> DataFrame:
    c = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"), "c_custkey", "c_acctbal")
    return cs.share_below(c, "region", "c_acctbal").select("c_custkey", "region", rounded(F.col("percentile")).alias("percentile"))


@query(
    """WITH a AS (SELECT n_name AS subject, count(*) FILTER (c_mktsegment = 'BUILDING') AS x, count(*) FILTER (c_mktsegment <> 'BUILDING') AS y FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
r AS (SELECT *, CASE WHEN y = 0 THEN 0.0 ELSE 4.0 * x / y END AS ratio FROM a)
SELECT subject, x, y, floor(ratio * 10000 + 0.5) / 10000 AS ratio, CASE WHEN x + y < 5 THEN 'unknown' WHEN ratio <= 0.65 THEN 'male' WHEN ratio >= 0.85 THEN 'female' ELSE 'unknown' END AS sex,
 CASE WHEN x + y < 5 THEN 'low' WHEN ratio <= 0.55 OR ratio >= 0.95 THEN 'high' WHEN ratio <= 0.65 OR ratio >= 0.85 THEN 'medium' ELSE 'low' END AS confidence FROM r"""
)
def sex_ratio(t: Tables) -> DataFrame:
    from helixframe.functions.bands import sex_call, sex_confidence

    c = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    a = c.groupBy(F.col("n_name").alias("subject")).agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("x"), F.count_if(F.col("c_mktsegment") != "BUILDING").alias("y"))
    r = a.withColumn("ratio", F.when(F.col("y") == 0, 0.0).otherwise(4.0 * F.col("x") / F.col("y")))
    n = F.col("x") + F.col("y")
    return r.select("subject", "x", "y", rounded(F.col("ratio")).alias("ratio"), sex_call(F.col("ratio"), n).alias("sex"), sex_confidence(F.col("ratio"), n).alias("confidence"))


@query(
    """WITH a AS (SELECT o_custkey AS subject, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END) / 40000.0 AS a, sum(CASE WHEN o_orderstatus = 'O' THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END) / 30000.0 AS y, sum(CASE WHEN o_orderstatus = 'P' THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END) / 5000.0 AS m FROM orders GROUP BY 1),
b AS (SELECT *, a > 1 AND subject % 7 <> 0 AS seen FROM a), w AS (SELECT *, CASE WHEN subject % 4 = 2 OR subject % 9 = 0 THEN 'WGS_HIFI' WHEN subject % 4 = 3 THEN 'WGS_NANOPORE' ELSE 'WGS' END AS whole FROM b)
SELECT subject, CASE WHEN subject % 31 = 0 THEN 'BIG_Y_700' WHEN subject % 13 = 0 THEN CASE WHEN subject % 4 > 0 THEN whole END
 WHEN y > 1 AND (NOT seen OR a <= 0 OR y > 5 * a) THEN CASE subject % 5 WHEN 1 THEN 'Y_ELITE' WHEN 2 THEN 'Y_PRIME' ELSE 'TARGETED_Y' END
 WHEN m > 10 AND NOT seen AND y <= 1 THEN 'MT_FULL_SEQUENCE' WHEN seen AND y <= 1 AND a > 50 THEN 'WES' WHEN seen AND a < 5 THEN 'WGS_LOW_PASS' ELSE whole END AS test_type FROM w"""
)
def test_type_infer(t: Tables) -> DataFrame:
    from helixframe.functions.bands import test_type

    s = F.col("subject")
    whole = lambda status: F.sum(F.when(F.col("o_orderstatus") == status, F.floor("o_totalprice")).otherwise(0))
    a = t.orders.groupBy(F.col("o_custkey").alias("subject")).agg((whole("F") / 40000.0).alias("a"), (whole("O") / 30000.0).alias("y"), (whole("P") / 5000.0).alias("m"))
    known = F.when(s % 13 != 0, F.col("a"))
    platform = F.when(s % 4 == 1, "ILLUMINA").when(s % 4 == 2, "PacBio").when(s % 4 == 3, "ont")
    vendor = F.when(s % 5 == 0, "FamilyTreeDNA").when(s % 5 == 1, "Full Genomes").when(s % 5 == 2, "YSEQ")
    kind = test_type(known, F.col("y"), F.col("m"), s % 7 != 0, platform, vendor, F.when(s % 9 == 0, 15000).otherwise(150), F.when(s % 31 == 0, "BIG_Y_700"))
    return a.select("subject", kind.alias("test_type"))


@query(
    """WITH g AS (SELECT c_nationkey AS chip, CASE c_mktsegment WHEN 'BUILDING' THEN '--' WHEN 'MACHINERY' THEN 'AG' WHEN 'FURNITURE' THEN 'A' ELSE 'CC' END AS gt FROM customer)
SELECT chip, count(*) AS possible, count(*) FILTER (gt <> '--') AS called, floor(count(*) FILTER (gt = '--') / count(*) * 10000 + 0.5) / 10000 AS no_call_rate,
 CASE WHEN count(*) FILTER (length(gt) = 2 AND gt <> '--') = 0 THEN 0.0 ELSE floor(count(*) FILTER (length(gt) = 2 AND gt <> '--' AND substr(gt, 1, 1) <> substr(gt, 2, 1)) / count(*) FILTER (length(gt) = 2 AND gt <> '--') * 10000 + 0.5) / 10000 END AS het_rate FROM g GROUP BY 1"""
)
def chip_summary(t: Tables) -> DataFrame:
    from helixframe.functions.genotype import chip_rates

    gt = F.when(F.col("c_mktsegment") == "BUILDING", "--").when(F.col("c_mktsegment") == "MACHINERY", "AG").when(F.col("c_mktsegment") == "FURNITURE", "A").otherwise("CC")
    s = chip_rates(t.customer.select(F.col("c_nationkey").alias("chip"), gt.alias("gt")), ["chip"], "gt")
    return s.withColumn("no_call_rate", rounded(F.col("no_call_rate"))).withColumn("het_rate", rounded(F.col("het_rate")))


@query(
    """WITH p AS (SELECT o_custkey AS subject, list_sort(list(DISTINCT o_orderpriority)) AS markers FROM orders GROUP BY 1), t(tier, tier_markers) AS (VALUES (1, ['1-URGENT', '2-HIGH']), (2, ['1-URGENT', '2-HIGH', '3-MEDIUM']), (3, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])),
j AS (SELECT subject, tier, len(list_intersect(markers, tier_markers)) / len(tier_markers) AS overlap, len(tier_markers) AS size FROM p CROSS JOIN t), k AS (SELECT *, CASE WHEN overlap >= 0.9 THEN 2 WHEN overlap >= 0.8 THEN 1 ELSE 0 END AS ok FROM j)
SELECT subject, CASE WHEN ok > 0 THEN tier END AS tier, floor(overlap * 1000 + 0.5) / 1000 AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ok DESC, size DESC) AS r FROM k) WHERE r = 1"""
)
def panel_tier(t: Tables) -> DataFrame:
    p = t.orders.groupBy(F.col("o_custkey").alias("subject")).agg(F.collect_set("o_orderpriority").alias("markers"))
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    tiers = t.spark.createDataFrame([(1, names[:2]), (2, names[:3]), (3, names)], "tier int, tier_markers array<string>")
    return cs.tier_membership(p, tiers, ["subject"]).withColumn("overlap", rounded(F.col("overlap"), 3))


@query(
    """WITH a AS (SELECT c_nationkey AS panel, count(*) FILTER (c_acctbal > 0 AND c_custkey % 2 = 0) AS m, count(*) FILTER (c_acctbal > 0 AND c_custkey % 2 = 1) AS l, count(*) FILTER (c_acctbal <= 0 AND c_custkey % 2 = 0) AS r FROM customer GROUP BY 1),
p AS (SELECT panel, CASE WHEN m + l = 0 THEN 1.0 ELSE m / (m + l) END AS p, CASE WHEN m + r = 0 THEN 1.0 ELSE m / (m + r) END AS r FROM a)
SELECT panel, floor(p * 10000 + 0.5) / 10000 AS "precision", floor(r * 10000 + 0.5) / 10000 AS recall, floor(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END * 10000 + 0.5) / 10000 AS f1 FROM p"""
)
def precision_recall_f1(t: Tables) -> DataFrame:
    pos, true = F.col("c_acctbal") > 0, F.col("c_custkey") % 2 == 0
    a = t.customer.groupBy(F.col("c_nationkey").alias("panel")).agg(F.count_if(pos & true).alias("m"), F.count_if(pos & ~true).alias("l"), F.count_if(~pos & true).alias("r"))
    p, r, f = cs.precision_recall(F.col("m"), F.col("l"), F.col("r"))
    return a.select("panel", rounded(p).alias("precision"), rounded(r).alias("recall"), rounded(f).alias("f1"))


# ---- store queries


@query(
    """WITH a AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(a.k, b.k) AS k, a.v AS left_value, b.v AS right_value, CASE WHEN b.v IS NULL THEN 'only_left' WHEN a.v IS NULL THEN 'only_right' WHEN a.v = b.v THEN 'match' ELSE 'differ' END AS state FROM a FULL JOIN b ON a.k = b.k"""
)
def full_outer_concordance(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return rel.full_outer_concordance(c.where("k % 3 <> 0"), c.where("k % 2 = 0").withColumn("v", F.when(F.col("k") % 5 == 0, "BUILDING").otherwise(F.col("v"))), ["k"], "v")


@query("SELECT c_custkey FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def truth_intersect_subtract(t: Tables) -> DataFrame:
    o = t.orders
    return t.customer.where("c_acctbal > 0").select("c_custkey").intersect(o.where("o_orderstatus = 'F'").select("o_custkey")).subtract(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query(
    """WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN lower(n_name) || '_alias' ELSE n_name END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey), a AS (SELECT upper(n_name) || '_ALIAS' AS alias, n_name AS canonical FROM nation)
SELECT c_custkey, coalesce(canonical, r.name) AS canonical, n_regionkey FROM r LEFT JOIN a ON upper(r.name) = upper(alias) LEFT JOIN nation n ON n.n_name = coalesce(canonical, r.name)"""
)
def alias_resolve(t: Tables) -> DataFrame:
    n = t.nation
    r = t.customer.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lower("n_name"), F.lit("_alias"))).otherwise(F.col("n_name")).alias("name"))
    aliases = n.select(F.concat(F.upper("n_name"), F.lit("_ALIAS")).alias("alias"), F.col("n_name").alias("canonical"))
    return rel.resolve_alias(r, aliases, n.select(F.col("n_name").alias("name"), "n_regionkey")).select("c_custkey", "canonical", "n_regionkey")


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM orders o JOIN lineitem l ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R' AND l_quantity > 40)")
def exists_not_exists(t: Tables) -> DataFrame:
    bad = t.orders.join(t.lineitem.where("l_returnflag = 'R' and l_quantity > 40"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey")
    c = t.customer.select("c_custkey", "c_name")
    return c.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_semi").join(bad, F.col("o_custkey") == F.col("c_custkey"), "left_anti")


@query("SELECT o_custkey AS project, count(DISTINCT o_orderkey) AS total, count(DISTINCT o_orderkey) FILTER (l_returnflag = 'R') AS analysed, CASE WHEN count(DISTINCT o_orderkey) = count(DISTINCT o_orderkey) FILTER (l_returnflag = 'R') THEN 'Complete' ELSE 'Pending' END AS status FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def census_conditional_distinct(t: Tables) -> DataFrame:
    j = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    a = j.groupBy("o_orderkey", "o_custkey").agg(F.max(F.col("l_returnflag") == "R").alias("r")).groupBy(F.col("o_custkey").alias("project")).agg(F.count("*").alias("total"), F.count_if("r").alias("analysed"))
    return a.withColumn("status", F.when(F.col("total") == F.col("analysed"), "Complete").otherwise("Pending"))


@query("SELECT n_name AS project, count(k) AS members FROM nation LEFT JOIN (SELECT c_nationkey AS n, c_custkey AS k FROM customer WHERE c_acctbal > 5000 UNION SELECT s_nationkey, s_suppkey FROM supplier) m ON m.n = n_nationkey GROUP BY 1")
def membership_union(t: Tables) -> DataFrame:
    m = t.customer.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("n"), F.col("c_custkey").alias("k")).union(t.supplier.select("s_nationkey", "s_suppkey")).distinct()
    return t.nation.join(m, F.col("n") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("project")).agg(F.count("k").alias("members"))


@query("SELECT (SELECT count(*) FROM customer) AS subjects, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_runs, (SELECT count(DISTINCT user_id) FROM events) AS users")
def scalar_counts(t: Tables) -> DataFrame:
    a = t.customer.agg(F.count("*").alias("subjects"))
    b = t.orders.where("o_orderstatus = 'O'").agg(F.count("*").alias("open_runs"))
    return a.join(b).join(t.events.agg(F.count_distinct("user_id").alias("users")))


@query("SELECT conv_id, turn, role, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS r FROM conversations) WHERE r = 1")
def latest_row(t: Tables) -> DataFrame:
    return rel.latest(t.conversations, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")]).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


@query("WITH seen AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT c.conv_id, count(*) FILTER (turn > coalesce(last, -1) AND role <> 'assistant') AS unread, max(turn) AS last_turn FROM conversations c LEFT JOIN seen s ON s.conv_id = c.conv_id GROUP BY 1")
def unread_count(t: Tables) -> DataFrame:
    c = t.conversations
    seen = c.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    return c.join(seen, "conv_id", "left").groupBy("conv_id").agg(F.count_if((F.col("turn") > F.coalesce("last", F.lit(-1))) & (F.col("role") != "assistant")).alias("unread"), F.max("turn").alias("last_turn"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def best_by_tuple(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderpriority", "o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND ts <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts, event_id LIMIT 20")
def due_queue(t: Tables) -> DataFrame:
    e = t.events.withColumn("status", F.when(F.col("event_type") == "purchase", "PENDING").otherwise("DONE"))
    return rel.due_queue(e, "status", F.col("ts"), F.expr("timestamp '2024-01-20 00:00:00'"), 20, ["ts", "event_id"]).select("event_id", "user_id")


@query("SELECT c_custkey, CASE WHEN o.k IS NULL THEN c_mktsegment ELSE o.v END AS value FROM customer LEFT JOIN (SELECT o_custkey AS k, max(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON o.k = c_custkey")
def upsert_rows(t: Tables) -> DataFrame:
    stored = t.customer.select("c_custkey", F.col("c_mktsegment").alias("value"))
    new = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("value")).join(stored, "c_custkey", "left_semi")
    return rel.upsert(stored, new, ["c_custkey"])


@query("SELECT c_custkey, c_mktsegment AS value FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 2 <> 0 AND c_custkey % 3 = 0")
def insert_ignore(t: Tables) -> DataFrame:
    c = t.customer
    return rel.insert_ignore(c.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_mktsegment").alias("value")), c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("value")), ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3)")
def cascade_delete(t: Tables) -> DataFrame:
    gone = t.customer.where("c_nationkey = 3").select("c_custkey")
    lines = t.lineitem.select("l_orderkey", "l_linenumber")
    return rel.cascade_delete(t.customer, [(t.orders, "o_orderkey", "o_custkey"), (lines, "l_orderkey", "l_orderkey")], gone, "c_custkey")[2]


@query(
    """WITH s AS (SELECT DISTINCT l_suppkey % 40 AS g, l_partkey % 500 AS i FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT g, count(*) AS n FROM s GROUP BY 1), b AS (SELECT x.g AS a, y.g AS b, count(*) AS shared FROM s x JOIN s y ON x.i = y.i AND x.g < y.g GROUP BY 1, 2)
SELECT a, b, shared, na.n - shared AS only_a, nb.n - shared AS only_b FROM b JOIN n na ON na.g = a JOIN n nb ON nb.g = b"""
)
def shared_private_sizes(t: Tables) -> DataFrame:
    return rel.symmetric_sizes(t.lineitem.where("l_returnflag = 'R'").select((F.col("l_suppkey") % 40).alias("g"), (F.col("l_partkey") % 500).alias("i")), "g", "i")


@query(
    """WITH x AS (SELECT coalesce(l.k, r.k) AS k, l.v AS lv, r.v AS rv, CASE WHEN coalesce(l.k, r.k) % 7 = 0 THEN NULL ELSE coalesce(l.k, r.k) % 3 END AS sv FROM (SELECT c_custkey AS k, c_custkey % 3 AS v FROM customer WHERE c_custkey % 4 <> 0) l FULL JOIN (SELECT c_custkey AS k, c_custkey % 4 AS v FROM customer WHERE c_custkey % 5 <> 0) r ON l.k = r.k)
SELECT k, CASE WHEN lv IS NULL THEN 'AdoptRemote' WHEN rv IS NULL OR (lv IS DISTINCT FROM sv AND rv IS NOT DISTINCT FROM sv) THEN 'RePush' WHEN rv IS DISTINCT FROM sv AND lv IS DISTINCT FROM sv AND lv <> rv THEN 'Conflict' WHEN rv IS DISTINCT FROM sv AND lv <> rv THEN 'ApplyRemote' ELSE 'InSync' END AS action FROM x"""
)
def sync_reconcile(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("k"))
    x = c.where("k % 4 <> 0").withColumn("lv", F.col("k") % 3).join(c.where("k % 5 <> 0").withColumn("rv", F.col("k") % 4), "k", "full_outer").withColumn("sv", F.when(F.col("k") % 7 != 0, F.col("k") % 3))
    return x.select("k", rel.sync_action(F.col("lv"), F.col("rv"), F.col("sv")).alias("action"))


@query("SELECT event_id, CAST(least(60 * pow(2.0, event_id % 9), 3600) AS BIGINT) AS wait FROM events WHERE event_type = 'error'")
def retry_backoff(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'error'").select("event_id", rel.backoff(F.col("event_id") % 9).alias("wait"))


@query("SELECT r_name, n_name, c_mktsegment, count(*) AS n, CAST(grouping(r_name) AS INTEGER) AS g1, CAST(grouping(n_name) AS INTEGER) AS g2, CAST(grouping(c_mktsegment) AS INTEGER) AS g3 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name), (r_name, n_name), (c_mktsegment), ())")
def grouping_sets(t: Tables) -> DataFrame:
    _geo(t).createOrReplaceTempView("geo_rows")
    return t.spark.sql("SELECT r_name, n_name, c_mktsegment, count(*) AS n, CAST(grouping(r_name) AS INT) AS g1, CAST(grouping(n_name) AS INT) AS g2, CAST(grouping(c_mktsegment) AS INT) AS g3 FROM geo_rows GROUP BY GROUPING SETS ((r_name), (r_name, n_name), (c_mktsegment), ())")


def _geo(t: Tables) -> DataFrame:
    return t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))


@query("SELECT r_name, n_name, count(*) AS n, CAST(sum(CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_super_population(t: Tables) -> DataFrame:
    return _geo(t).rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("c_acctbal") * 100 + 0.5)).cast("long").alias("cents"))


@query("SELECT r_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, c_mktsegment)")
def cube_counts(t: Tables) -> DataFrame:
    return _geo(t).cube("r_name", "c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT k, count(*) AS n, floor(avg(value) * 1000 + 0.5) / 1000 AS mean FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events) GROUP BY 1")
def json_payload(t: Tables) -> DataFrame:
    e = t.events.select(F.from_json("props", "k long")["k"].alias("k"), "value")
    return e.groupBy("k").agg(F.count("*").alias("n"), rounded(F.avg("value"), 3).alias("mean"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies, sha256(text) AS checksum FROM documents GROUP BY 3")
def checksum_dedup(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("checksum")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
