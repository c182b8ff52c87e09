"""Depth, callable-state and call queries on the standard tables.

Stand-ins: a line item is a covered base; contig is return flag and line status, position the part, base quality the
quantity, mapping quality the discount in hundredths, flags the line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators import calls, pileup
from helixframe.plans.catalog import Tables, query, rounded


def observations(t: Tables) -> DataFrame:
    line = pileup.primary_reads(t.lineitem.withColumn("flags", F.col("l_linenumber")), mask=0x4)
    return line.select(F.concat("l_returnflag", "l_linestatus").alias("contig"), F.col("l_partkey").alias("pos"), F.col("l_quantity").cast("int").alias("baseq"), F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("mapq"), "l_orderkey", "l_suppkey")


def depths(t: Tables) -> DataFrame:
    return pileup.position_depths(observations(t), min_baseq=5, min_mapq=1)


_OBS = """obs AS (SELECT l_returnflag || l_linestatus AS contig, l_partkey AS pos, CAST(floor(l_quantity) AS INTEGER) AS baseq,
  CAST(floor(l_discount * 100 + 0.5) AS INTEGER) AS mapq, l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber & 4 = 0)"""
_DEPTHS = (
    "WITH "
    + _OBS
    + """, depths AS (SELECT contig, pos, count(*) AS raw_depth, count(*) FILTER (mapq >= 1 AND baseq >= 5) AS depth,
  sum(CASE WHEN mapq >= 1 AND baseq >= 5 THEN baseq ELSE 0 END) AS baseq_sum,
  sum(CASE WHEN mapq >= 1 AND baseq >= 5 THEN mapq ELSE 0 END) AS mapq_sum,
  count(*) FILTER (mapq <= 1) AS low_mapq, count(*) FILTER (mapq < 1) AS excluded_mapq,
  count(*) FILTER (mapq >= 1 AND baseq < 5) AS excluded_baseq FROM obs GROUP BY 1, 2)"""
)
_HIST = _DEPTHS + ", hist AS (SELECT contig, least(depth, 255) AS bin, count(*) AS n FROM depths GROUP BY 1, 2)"
_MED = """, med AS (SELECT contig, min(bin) AS median FROM (SELECT contig, bin, sum(n) OVER (PARTITION BY contig ORDER BY bin) AS run,
  floor(sum(n) OVER (PARTITION BY contig) / 2) AS half FROM hist) WHERE run >= half GROUP BY 1)"""
_STATE = """CASE WHEN raw_depth = 0 THEN 'NO_COVERAGE' WHEN low_mapq / raw_depth > 0.25 THEN 'POOR_MAPPING_QUALITY'
  WHEN depth < 2 THEN 'LOW_COVERAGE' WHEN depth > 12 THEN 'EXCESSIVE_COVERAGE' ELSE 'CALLABLE' END"""


@query(
    _DEPTHS
    + """ SELECT contig, CAST(sum(depth) AS BIGINT) AS bases, count(*) FILTER (depth > 0) AS covered,
  floor(sum(depth) / count(*) FILTER (depth > 0) * 10000 + 0.5) / 10000 AS mean_depth,
  floor(sum(baseq_sum) / sum(depth) * 10000 + 0.5) / 10000 AS mean_baseq,
  floor(sum(mapq_sum) / sum(depth) * 10000 + 0.5) / 10000 AS mean_mapq FROM depths GROUP BY 1"""
)
def cov_contig_stats(t: Tables) -> DataFrame:
    s = pileup.contig_stats(depths(t))
    return s.select("contig", "bases", "covered", *(rounded(F.col(c)).alias(c) for c in ("mean_depth", "mean_baseq", "mean_mapq")))


@query(_DEPTHS + " SELECT contig, floor(sum(excluded_mapq) / sum(raw_depth) * 10000 + 0.5) / 10000 AS by_mapq, floor(sum(excluded_baseq) / sum(raw_depth) * 10000 + 0.5) / 10000 AS by_baseq FROM depths GROUP BY 1")
def cov_excluded_share(t: Tables) -> DataFrame:
    return pileup.excluded_share(depths(t)).select("contig", rounded(F.col("by_mapq")).alias("by_mapq"), rounded(F.col("by_baseq")).alias("by_baseq"))


@query(_HIST + " SELECT contig, CAST(bin AS BIGINT) AS bin, n FROM hist")
def cov_histogram(t: Tables) -> DataFrame:
    return pileup.depth_histogram(depths(t), ["contig"]).select("contig", F.col("bin").cast("long").alias("bin"), "n")


@query(
    _HIST
    + " SELECT contig, "
    + ", ".join(f"floor(sum(CASE WHEN bin >= {k} THEN n ELSE 0 END) / sum(n) * 10000 + 0.5) / 10000 AS at_least_{k}" for k in (1, 5, 10, 15, 20))
    + " FROM hist GROUP BY 1"
)
def cov_fraction_at_least(t: Tables) -> DataFrame:
    f = pileup.fraction_at_least(pileup.depth_histogram(depths(t), ["contig"]), ["contig"], [1, 5, 10, 15, 20])
    return f.select("contig", *(rounded(F.col(c)).alias(c) for c in f.columns[1:]))


@query(
    _HIST
    + _MED
    + """, dev AS (SELECT contig, abs(bin - median) AS dev, sum(n) AS n FROM hist JOIN med USING (contig) GROUP BY 1, 2)
SELECT m.contig, CAST(median AS BIGINT) AS median, CAST(mad AS BIGINT) AS mad FROM med m JOIN (SELECT contig, min(dev) AS mad FROM (SELECT contig, dev, sum(n) OVER (PARTITION BY contig ORDER BY dev) AS run,
  floor(sum(n) OVER (PARTITION BY contig) / 2) AS half FROM dev) WHERE run >= half GROUP BY 1) d USING (contig)"""
)
def cov_median_mad(t: Tables) -> DataFrame:
    m = pileup.histogram_mad(pileup.depth_histogram(depths(t), ["contig"]), ["contig"])
    return m.select("contig", F.col("median").cast("long").alias("median"), F.col("mad").cast("long").alias("mad"))


@query(
    _HIST
    + """ SELECT contig, floor(sum(bin * n) / sum(n) * 10000 + 0.5) / 10000 AS mean,
  floor(sqrt(greatest(sum(bin * bin * n) / sum(n) - (sum(bin * n) / sum(n)) * (sum(bin * n) / sum(n)), 0)) * 10000 + 0.5) / 10000 AS sd FROM hist GROUP BY 1"""
)
def cov_mean_sd(t: Tables) -> DataFrame:
    m = pileup.mean_and_sd(pileup.depth_histogram(depths(t), ["contig"]), ["contig"])
    return m.select("contig", rounded(F.col("mean")).alias("mean"), rounded(F.col("sd")).alias("sd"))


def states(t: Tables) -> DataFrame:
    return depths(t).select("contig", "pos", pileup.callable_state(2, 0.25, 12).alias("state"))


@query(_DEPTHS + f", st AS (SELECT contig, {_STATE} AS state FROM depths) SELECT contig, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s.lower()}" for s in pileup.STATES) + " FROM st GROUP BY 1")
def cov_callable_states(t: Tables) -> DataFrame:
    return pileup.state_counts(states(t))


@query(
    _DEPTHS
    + f""", st AS (SELECT contig, pos, {_STATE} AS state FROM depths), isles AS (SELECT contig, pos, pos - row_number() OVER (PARTITION BY contig ORDER BY pos) AS isle FROM st WHERE state = 'CALLABLE')
SELECT contig, min(pos) AS start, max(pos) AS "end", count(*) AS length FROM isles GROUP BY contig, isle HAVING count(*) >= 3"""
)
def cov_callable_intervals(t: Tables) -> DataFrame:
    return pileup.state_intervals(states(t), min_run=3)


def reads(t: Tables) -> DataFrame:
    """A line item as a read: its order is the pair, the customer's segment the mate's contig."""
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("mate_contig"), F.pmod("o_custkey", F.lit(5000)).alias("mate_pos"))
    line = t.lineitem.join(o, "l_orderkey")
    flags = F.col("l_linenumber") + F.when(F.col("l_returnflag") == "R", 0x10).otherwise(0) + F.when(F.col("l_linestatus") == "O", 0x20).otherwise(0) + F.when(F.col("l_quantity") >= 25, 0x40).otherwise(0)
    return line.select(flags.alias("flags"), F.when(F.col("l_suppkey") % 2 == 0, F.col("mate_contig")).otherwise(F.lit("1-URGENT")).alias("contig"), "mate_contig", F.col("l_partkey").alias("pos"), "mate_pos", F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("mapq"), (F.col("l_partkey") - F.col("mate_pos")).alias("tlen"))


_READS = """WITH reads AS (SELECT l_linenumber + CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 32 ELSE 0 END + CASE WHEN l_quantity >= 25 THEN 64 ELSE 0 END AS flags,
  CASE WHEN l_suppkey % 2 = 0 THEN o_orderpriority ELSE '1-URGENT' END AS contig, o_orderpriority AS mate_contig, l_partkey AS pos, o_custkey % 5000 AS mate_pos,
  CAST(floor(l_discount * 100 + 0.5) AS INTEGER) AS mapq, l_partkey - o_custkey % 5000 AS tlen FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


@query(
    _READS
    + """ SELECT count(*) AS total, count(*) FILTER (flags & 512 = 0) AS passing, count(*) FILTER (flags & 4 = 0) AS aligned, count(*) FILTER (flags & 1 <> 0) AS paired,
  count(*) FILTER (flags & 2 <> 0) AS proper, count(*) FILTER (flags & 1 <> 0 AND flags & 4 = 0 AND contig <> mate_contig) AS chimeric,
  floor(avg(mapq) FILTER (flags & 4 = 0 AND mapq <> 255) * 10000 + 0.5) / 10000 AS mean_mapq FROM reads"""
)
def read_metrics(t: Tables) -> DataFrame:
    return pileup.read_metrics(reads(t)).withColumn("mean_mapq", rounded(F.col("mean_mapq")))


@query(
    _READS
    + """, k AS (SELECT CASE WHEN (flags & 16 <> 0) = (flags & 32 <> 0) THEN 'TANDEM' WHEN CASE WHEN pos <= mate_pos THEN flags & 16 = 0 ELSE flags & 32 = 0 END THEN 'FR' ELSE 'RF' END AS orientation, count(*) AS n
  FROM reads WHERE contig = mate_contig GROUP BY 1) SELECT orientation, n FROM k ORDER BY n DESC, CASE orientation WHEN 'FR' THEN 0 WHEN 'RF' THEN 1 ELSE 2 END LIMIT 1"""
)
def pair_orientation(t: Tables) -> DataFrame:
    return pileup.pair_orientation(reads(t))


@query(_READS + " SELECT abs(tlen) AS insert_size, count(*) AS n FROM reads WHERE flags & 66 = 66 AND abs(tlen) > 0 AND abs(tlen) < 10000 GROUP BY 1")
def insert_sizes(t: Tables) -> DataFrame:
    return pileup.insert_sizes(reads(t))


@query("SELECT floor(sum(l_quantity * l_linenumber) / sum(l_linenumber) * 10000 + 0.5) / 10000 AS mean_depth FROM lineitem")
def weighted_mean_depth(t: Tables) -> DataFrame:
    return pileup.weighted_mean_depth(t.lineitem, "l_quantity", "l_linenumber").select(rounded(F.col("mean_depth")).alias("mean_depth"))


_TWO = """WITH n AS (SELECT user_id, event_type AS base, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, base) AS k, sum(n) OVER (PARTITION BY user_id) AS depth FROM n),
two AS (SELECT user_id, CAST(max(depth) AS BIGINT) AS depth, max(base) FILTER (k = 1) AS top, max(n) FILTER (k = 1) AS top_n, max(base) FILTER (k = 2) AS second, coalesce(max(n) FILTER (k = 2), 0) AS second_n FROM r GROUP BY 1)"""


def _two(t: Tables) -> DataFrame:
    return calls.top_two(calls.base_tally(t.events, ["user_id"], "event_type"), ["user_id"])


@query(
    _TWO
    + """ SELECT user_id, depth, top, top_n, second, second_n, CASE WHEN depth >= 4 AND top_n >= 0.4 * depth AND NOT (second_n >= 2 AND second_n > 0.3 * depth) THEN top END AS call,
  (second_n >= 2 AND second_n > 0.3 * depth) AS paralog FROM two"""
)
def base_tally_consensus(t: Tables) -> DataFrame:
    return calls.haploid_call(_two(t), min_share=0.4, paralog_share=0.3)


@query(_TWO + " SELECT user_id, depth, top, second, floor(second_n / depth * 10000 + 0.5) / 10000 AS minor_share FROM two WHERE depth >= 6 AND second_n >= 3 AND second_n / depth >= 0.25")
def het_top_two(t: Tables) -> DataFrame:
    return calls.heteroplasmy(_two(t), 6, 3, 0.25).select("user_id", "depth", "top", "second", rounded(F.col("minor_share")).alias("minor_share"))


@query(
    """WITH sites AS (SELECT DISTINCT c_custkey AS user_id, 'view' AS ref, 'click' AS alt FROM customer),
n AS (SELECT user_id, event_type AS base, count(*) AS n FROM events GROUP BY 1, 2),
j AS (SELECT s.user_id, ref, alt, CAST(sum(CASE WHEN base = ref THEN n ELSE 0 END) AS BIGINT) AS ref_n, CAST(sum(CASE WHEN base = alt THEN n ELSE 0 END) AS BIGINT) AS alt_n FROM sites s LEFT JOIN n ON n.user_id = s.user_id GROUP BY 1, 2, 3)
SELECT user_id, ref, alt, ref_n, alt_n, CASE WHEN ref_n + alt_n = 0 THEN 'NoCall' WHEN alt_n > ref_n THEN 'Alternate' WHEN ref_n > alt_n THEN 'Reference' ELSE 'NoCall' END AS state,
  CASE WHEN ref_n + alt_n = 0 THEN 0.0 ELSE floor(alt_n / (ref_n + alt_n) * 10000 + 0.5) / 10000 END AS af FROM j"""
)
def force_call_sites(t: Tables) -> DataFrame:
    sites = t.customer.select(F.col("c_custkey").alias("user_id"), F.lit("view").alias("ref"), F.lit("click").alias("alt")).distinct()
    return calls.force_calls(sites, calls.base_tally(t.events, ["user_id"], "event_type").drop("depth"), ["user_id"]).withColumn("af", rounded(F.col("af")))


_LIKE = """WITH l AS (SELECT contig, count(*) AS depth, count(*) FILTER (mapq >= 5) AS alt_depth,
  sum(log10(greatest(CASE WHEN mapq >= 5 THEN e / 3 ELSE 1 - e END, 1e-300))) AS l0, sum(log10(greatest((1 - e + e / 3) / 2, 1e-300))) AS l1, sum(log10(greatest(CASE WHEN mapq >= 5 THEN 1 - e ELSE e / 3 END, 1e-300))) AS l2
  FROM (SELECT l_partkey AS contig, CAST(floor(l_discount * 100 + 0.5) AS INTEGER) AS mapq, pow(10.0, -l_quantity / 10.0) AS e FROM lineitem) GROUP BY 1)"""


@query(
    _LIKE
    + """, p AS (SELECT *, CAST(least(floor(-10 * (l0 - greatest(l0, l1, l2)) + 0.5), 255) AS INTEGER) AS p0, CAST(least(floor(-10 * (l1 - greatest(l0, l1, l2)) + 0.5), 255) AS INTEGER) AS p1, CAST(least(floor(-10 * (l2 - greatest(l0, l1, l2)) + 0.5), 255) AS INTEGER) AS p2 FROM l)
SELECT contig AS site, depth, alt_depth, p0, p1, p2, CASE WHEN p0 = 0 THEN 0 WHEN p1 = 0 THEN 1 ELSE 2 END AS dosage, least(list_sort([p0, p1, p2])[2], 99) AS gq FROM p"""
)
def genotype_likelihood(t: Tables) -> DataFrame:
    obs = t.lineitem.select(F.col("l_partkey").alias("site"), F.floor(F.col("l_discount") * 100 + 0.5).alias("mapq"), F.col("l_quantity").alias("q"))
    g = calls.genotypes(calls.genotype_likelihoods(obs, ["site"], F.col("mapq") >= 5, calls.error_rate(F.col("q"))))
    return g.select("site", "depth", "alt_depth", *(F.col("pl")[k].alias(f"p{k}") for k in range(3)), "dosage", "gq")


@query(
    """WITH o AS (SELECT user_id, event_type, 0.05 AS e FROM events), a AS (SELECT DISTINCT user_id, event_type FROM o),
p AS (SELECT x.user_id, x.event_type AS a, y.event_type AS b FROM a x JOIN a y ON x.user_id = y.user_id AND x.event_type <= y.event_type)
SELECT o.user_id, a, b, floor(sum(log10((CASE WHEN event_type = a THEN 1 - e ELSE e / 3 END + CASE WHEN event_type = b THEN 1 - e ELSE e / 3 END) / 2)) * 10000 + 0.5) / 10000 AS loglik FROM o JOIN p USING (user_id) GROUP BY 1, 2, 3"""
)
def multiallelic_genotypes(t: Tables) -> DataFrame:
    g = calls.allele_pairs(t.events.select("user_id", "event_type"), ["user_id"], "event_type", F.lit(0.05))
    return g.withColumn("loglik", rounded(F.col("loglik")))


@query(
    """WITH c AS (SELECT l_partkey AS site, l_returnflag AS alt, l_linenumber % 3 AS dosage, CAST(l_quantity AS INTEGER) AS depth FROM lineitem),
w AS (SELECT site, alt, dosage, sum(1 + least(sqrt(depth) / 10, 1.0)) AS w, count(*) AS runs FROM c WHERE depth >= 10 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY site, alt ORDER BY floor(w * 1000000 + 0.5) DESC, dosage) AS k FROM w)
SELECT site, alt, max(dosage) FILTER (k = 1) AS dosage, floor(max(w) * 10000 + 0.5) / 10000 AS weight, CAST(sum(runs) AS BIGINT) AS runs FROM r GROUP BY 1, 2 HAVING max(dosage) FILTER (k = 1) > 0"""
)
def site_reconcile(t: Tables) -> DataFrame:
    c = t.lineitem.select(F.col("l_partkey").alias("site"), F.col("l_returnflag").alias("alt"), (F.col("l_linenumber") % 3).alias("dosage"), F.col("l_quantity").cast("int").alias("depth"))
    return calls.reconcile_runs(c, ["site", "alt"], 10).withColumn("weight", rounded(F.col("weight")))
