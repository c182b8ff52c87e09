"""Genealogy exports, liftover and panels, late and retried streams on the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.ancestry import genetic_map
from helixframe.plans.catalog import Tables, query, rounded
from helixframe.session import scratch_path
from helixframe.sources import genealogy as ge
from helixframe.streaming import events as st


def _letter(x):
    return F.substring(F.lit("ACGT"), (x % 4 + 1).cast("int"), F.lit(1))


@query("SELECT 'chrY' AS contig, p_partkey AS pos, substr('ACGT', CAST(p_partkey % 4 + 1 AS BIGINT), 1) AS ref, substr('ACGT', CAST(p_size % 4 + 1 AS BIGINT), 1) AS alt, CASE WHEN p_partkey % 5 > 0 THEN 'M' || p_partkey END AS name, '1' AS genotype FROM part WHERE p_partkey % 7 > 0 AND p_partkey % 11 > 0")
def big_y_variants(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    rows = t.part.select(F.when(k % 5 > 0, F.concat(F.lit("M"), k.cast("string"))).otherwise("").alias("SNP_Name"), F.when(k % 7 == 0, "x").otherwise(k.cast("string")).alias("Position"), F.lit("Yes").alias("On_Haplotree"), F.lower(_letter(k)).alias("Ancestral"), F.when(k % 11 == 0, "del").otherwise(_letter(F.col("p_size"))).alias("Derived"))
    return ge.big_y_variants(rows)


@query("SELECT 'K' || c_custkey AS kit, CASE WHEN c_custkey % 6 > 0 THEN c_name END AS name, CASE WHEN c_custkey % 4 > 0 THEN 'a > b' END AS access, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS shares FROM customer WHERE c_custkey % 10 > 0")
def group_members(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    kit = F.when(k % 20 == 0, "MIN").when(k % 10 == 0, "000001").otherwise(F.concat(F.lit("K"), k.cast("string")))
    return ge.members(t.customer.select(kit.alias("Kit Number"), F.when(k % 6 > 0, F.col("c_name")).otherwise("-").alias("Name"), F.when(k % 4 > 0, "a &gt; b").otherwise(" ").alias("Access Granted"), F.when(k % 3 == 0, "yes").when(k % 3 == 1, "No").otherwise("").alias("Publicly Share DNA Results")))


@query(
    """SELECT 'K' || c_custkey AS kit, CASE WHEN c_custkey % 2 = 0 THEN 'R > M269' END AS sub_group, CASE WHEN c_custkey % 3 > 0 THEN 'Ireland' END AS country, CASE c_custkey % 4 WHEN 0 THEN 'John Kane' WHEN 1 THEN 'Bob d''Arcy' WHEN 2 THEN 'Ann Lee' END AS ancestor, CASE c_custkey % 4 WHEN 0 THEN 1770 WHEN 2 THEN 1801 END AS born, CASE c_custkey % 4 WHEN 0 THEN 1835 WHEN 1 THEN 1900 END AS died,
 CASE WHEN c_custkey % 5 > 0 THEN 'Cork' END AS place, CASE WHEN c_custkey % 5 > 0 THEN 51.5::DOUBLE END AS latitude, CASE WHEN c_custkey % 5 > 0 THEN -8.25::DOUBLE END AS longitude FROM customer"""
)
def group_ancestors(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, "John Kane, b. abt 1770 Cork, d. 1835").when(k % 4 == 1, "Bob d&#39;Arcy d. 1900").when(k % 4 == 2, "Ann Lee b. 1801").otherwise("-")
    rows = t.customer.select(F.concat(F.lit("K"), k.cast("string")).alias("Kit Number"), F.when(k % 2 == 0, "R &gt; M269").otherwise("none").alias("Sub Group"), F.when(k % 3 > 0, "Ireland").otherwise("Unknown Origin").alias("Country"), name.alias("Paternal Ancestor Name"), F.when(k % 5 > 0, "Cork").otherwise("No Location Saved").alias("Map Location"), F.when(k % 5 > 0, "51.5").otherwise("0").alias("Latitude"), F.when(k % 5 > 0, "-8.25").otherwise("0.0").alias("Longitude"))
    return ge.ancestors(rows)


@query(
    """SELECT 'K' || c_custkey AS kit, 'DYS393' AS marker, CAST(12 + c_custkey % 3 AS VARCHAR) AS value FROM customer WHERE c_custkey % 4 > 0 UNION ALL SELECT 'K' || c_custkey, 'DYS385', '11-' || (13 + c_custkey % 4) FROM customer WHERE c_custkey % 5 > 0"""
)
def group_markers(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    rows = t.customer.select(F.concat(F.lit("K"), k.cast("string")).alias("Kit Number"), F.col("c_name").alias("Name"), F.when(k % 4 > 0, (12 + k % 3).cast("string")).otherwise("-").alias("DYS393"), F.when(k % 5 > 0, F.concat(F.lit("11-"), (13 + k % 4).cast("string"))).otherwise("").alias("DYS385"), F.lit("0").alias("DYS19"))
    return ge.overview_markers(rows)


def _dictionary(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 2 == 0, "M").otherwise("m"), F.floor(k / 2).cast("string"))
    fields = [name, F.when(k % 3 == 0, "hs1").otherwise("GRCh38"), F.lit("chrY"), F.when(k % 13 == 0, "?").otherwise((k * 10).cast("string")), F.when(k % 5 == 0, "").otherwise("-"), F.lower(_letter(k)), _letter(k + 1)]
    head = t.spark.createDataFrame([("name\tbuild\tchrom\tposition\tstrand\tancestral\tderived", -1)], "value string, seq long")
    return ge.snp_dictionary(t.part.select(F.concat_ws("\t", *fields).alias("value"), k.alias("seq")).union(head))


_DICT = """WITH l AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'M' ELSE 'm' END || (p_partkey // 2) AS n, CASE WHEN p_partkey % 3 = 0 THEN 'hs1' ELSE 'GRCh38' END AS build FROM part WHERE p_partkey % 13 > 0),
d AS (SELECT lower(n) AS key, first_value(n) OVER (PARTITION BY lower(n) ORDER BY k) AS name, build, k * 10 AS pos, CASE WHEN k % 5 = 0 THEN '+' ELSE '-' END AS strand, substr('ACGT', CAST(k % 4 + 1 AS BIGINT), 1) AS ancestral, substr('ACGT', CAST((k + 1) % 4 + 1 AS BIGINT), 1) AS derived, row_number() OVER (PARTITION BY lower(n), build ORDER BY k) AS r FROM l), dic AS (SELECT * EXCLUDE (r) FROM d WHERE r = 1)"""


@query(_DICT + " SELECT key, name, build, 'chrY' AS contig, pos, strand, ancestral, derived FROM dic")
def snp_dictionary(t: Tables) -> DataFrame:
    return _dictionary(t)


@query(_DICT + ", a AS (SELECT 'pf' || p_partkey AS alias, 'm' || p_partkey AS key FROM part WHERE 'm' || p_partkey IN (SELECT key FROM dic)) SELECT c_custkey, dic.name AS canonical, pos FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'm' || (c_custkey % 90) ELSE coalesce((SELECT key FROM a WHERE alias = 'pf' || (c_custkey % 90)), 'pf' || (c_custkey % 90)) END AS key FROM customer) q LEFT JOIN dic ON dic.key = q.key AND build = 'GRCh38'")
def snp_resolution(t: Tables) -> DataFrame:
    d, k = _dictionary(t), F.col("p_partkey")
    lines = t.part.select(F.concat(F.lit("PF"), k.cast("string"), F.lit("\tM"), k.cast("string")).alias("value"), k.alias("seq"))
    c = F.col("c_custkey")
    names = t.customer.select("c_custkey", F.concat(F.when(c % 2 == 0, " M").otherwise("pf"), (c % 90).cast("string")).alias("name"))
    return ge.resolve_snps(names, d, ge.snp_aliases(lines, d), "GRCh38").select("c_custkey", "canonical", "pos")


@query(_DICT + " SELECT pos, min(name) AS name FROM dic WHERE build = 'hs1' GROUP BY 1")
def names_at_positions(t: Tables) -> DataFrame:
    return ge.names_at_positions(_dictionary(t), "hs1")


_GT = ("0/1", "1|2", "0/0", "./.", "1", "2/2")


@query(
    """WITH v AS (SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN NULL ELSE p_partkey % 7 - 1 END AS g, p_size FROM part), c AS (SELECT k, p_size, g, CASE WHEN g IS NULL THEN 1 WHEN g IN (0, 1, 4) THEN 1 WHEN g = 5 THEN 2 END AS a FROM v)
SELECT 'Y' AS contig, k AS pos, 'A' AS ref, CASE a WHEN 1 THEN 'G' ELSE 'T' END AS alt, CASE WHEN k % 2 = 0 THEN 'rs' || k END AS rsid, CASE g WHEN 0 THEN '0/1' WHEN 1 THEN '1|2' WHEN 4 THEN '1' WHEN 5 THEN '2/2' END AS genotype, CASE WHEN k % 3 > 0 THEN 50.5::DOUBLE END AS qual, CASE WHEN k % 4 = 0 THEN 'LowQual' END AS filter, CASE WHEN g IS NOT NULL AND k % 5 > 0 THEN p_size END AS dp, CAST(NULL AS INTEGER) AS gq, CASE WHEN g IS NOT NULL THEN 1 END AS ad_ref, CASE WHEN g IS NOT NULL THEN CASE a WHEN 1 THEN 2 ELSE 3 END END AS ad_alt FROM c WHERE a IS NOT NULL"""
)
def subject_snps(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    gt = F.get(F.array(*map(F.lit, _GT)), (k % 7 - 1).cast("int"))
    sample = F.concat_ws(":", gt, F.lit("1,2,3"), F.when(k % 5 > 0, F.col("p_size").cast("string")).otherwise("."))
    site = [F.lit("chrY"), k.cast("string"), F.when(k % 2 == 0, F.concat(F.lit("rs"), k.cast("string"))).otherwise("."), F.lit("a"), F.lit("G,T"), F.when(k % 3 > 0, "50.5").otherwise("."), F.when(k % 4 == 0, "LowQual").when(k % 4 == 1, "pass").otherwise("."), F.lit(".")]
    line = F.when(k % 7 == 0, F.concat_ws("\t", *site)).otherwise(F.concat_ws("\t", *site, F.lit("GT:AD:DP"), sample))
    return ge.subject_snps(t.part.select(line.alias("value")))


@query("SELECT DISTINCT CAST(p_partkey % 3 AS VARCHAR) AS contig, p_size AS pos, 'A' AS ref, alt FROM part, (VALUES ('G'), ('T')) v(alt) WHERE alt = 'G' OR p_partkey % 2 = 0")
def truth_keys(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), (k % 3).cast("string")), F.col("p_size").cast("string"), F.lit("."), F.lit("a"), F.when(k % 2 == 0, "g,T,CC").otherwise("G"), F.lit("."))
    return ge.truth_keys(t.part.select(line.alias("value"))).select("contig", F.col("pos").cast("int").alias("pos"), "ref", "alt")


# ---- liftover, panels and builders


@query("SELECT 't' || CAST(k AS VARCHAR) AS contig, CASE WHEN s = 'p' THEN 1000000 + st ELSE 3000000 - (st + len) END AS start, CASE WHEN s = 'p' THEN 1000000 + st + len ELSE 3000000 - st END AS \"end\", p_partkey AS locus FROM (SELECT p_partkey, p_partkey % 5 AS k, CASE WHEN p_partkey % 2 = 0 THEN 'p' ELSE 'm' END AS s, CASE WHEN p_partkey % 9 = 0 THEN 999990 ELSE p_partkey * 3 END AS st, p_size AS len FROM part) WHERE st + len <= 1000000")
def interval_lift(t: Tables) -> DataFrame:
    from helixframe.sources import variants

    p = F.col("p_partkey")
    start = F.when(p % 9 == 0, F.lit(999_990)).otherwise(p * 3).cast("long")
    rows = t.part.select(F.concat((p % 5).cast("string"), F.when(p % 2 == 0, "p").otherwise("m")).alias("contig"), start.alias("start"), (start + F.col("p_size")).alias("end"), p.alias("locus"))
    blocks = [(f"{k}{s}", 0, 1_000_000, f"t{k}", 1_000_000 if s == "p" else 2_000_000, "+" if s == "p" else "-") for k in range(5) for s in "pm"]
    return variants.lift_intervals(rows, t.spark.createDataFrame(blocks, "contig string, start long, end long, t_contig string, t_start long, strand string"))


@query("SELECT o_orderkey, 'rs' || p_partkey AS rsid, p_partkey * 10 AS panel_pos FROM orders JOIN part ON p_partkey * 7 = o_orderkey AND p_partkey % 3 > 0")
def panel_rekey(t: Tables) -> DataFrame:
    from helixframe.sources import variants

    p = F.col("p_partkey")
    locus = F.when(p % 3 > 0, F.struct(F.lit("1").alias("contig"), (p * 7).alias("pos")))
    panel = t.part.select(F.concat(F.lit("rs"), p.cast("string")).alias("rsid"), F.lit("1").alias("contig"), (p * 10).alias("pos"), locus.alias("grch38"))
    sites = t.orders.select("o_orderkey", F.lit("1").alias("contig"), F.col("o_orderkey").alias("pos"))
    return variants.rekey(sites, panel, "grch38").select("o_orderkey", "rsid", "panel_pos")


@query("WITH a AS (SELECT l_partkey AS site, count(*) FILTER (l_linenumber <> 3) AS c FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS site, count(*) FILTER (l_linenumber <> 2) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT a.site, a.c + b.c AS called, floor((a.c + b.c) / 24 * 10000 + 0.5) / 10000 AS call_rate FROM a JOIN b ON a.site = b.site WHERE (a.c + b.c) / 24 >= 0.5")
def common_sites(t: Tables) -> DataFrame:
    from helixframe.sources import variants

    m = lambda flag, none: t.lineitem.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("site"), F.when(F.col("l_linenumber") == none, -1).otherwise(1).alias("dosage"))
    return variants.common_sites([m("A", 3), m("R", 2)], ["site"], [12, 12], 0.5).withColumn("call_rate", rounded(F.col("call_rate")))


_BANDS = "b AS (SELECT p_brand AS chrom, p_size * 20000 AS s, (p_size + 1) * 20000 AS e, 'q' || p_size AS band, p_size BETWEEN 20 AND 23 AS acen FROM (SELECT DISTINCT p_brand, p_size FROM part)), c AS (SELECT chrom, max(e) AS len, min(s) FILTER (acen) AS cs, max(e) FILTER (acen) AS ce FROM b GROUP BY 1)"


@query(f"WITH {_BANDS}, p AS (SELECT p_partkey, p_brand AS chrom, p_partkey * 977 % 1020000 AS z FROM part) SELECT p_partkey, coalesce(z >= cs AND z < ce, false) AS in_centromere, z < 10000 OR z >= len - 10000 AS in_telomere, band FROM p JOIN c ON c.chrom = p.chrom LEFT JOIN b ON b.chrom = p.chrom AND z >= s AND z < e")
def region_annotation(t: Tables) -> DataFrame:
    from helixframe.operators import intervals as iv

    b = t.part.select(F.col("p_brand").alias("chrom"), "p_size").distinct()
    bands = b.select("chrom", (F.col("p_size") * 20_000).alias("start"), ((F.col("p_size") + 1) * 20_000).alias("end"), F.concat(F.lit("q"), F.col("p_size").cast("string")).alias("band"), F.col("p_size").between(20, 23).alias("acen"))
    pts = t.part.select("p_partkey", F.col("p_brand").alias("chrom"), (F.col("p_partkey") * 977 % 1_020_000 + 1).alias("pos"))
    return iv.annotate_bands(pts, bands, "chrom").select("p_partkey", "in_centromere", "in_telomere", "band")


@query(
    """WITH x AS (SELECT o_custkey AS sample, o_orderkey * 37 % 20000 AS s, o_orderkey * 37 % 20000 + 500 AS e, o_orderkey % 2 AS side FROM orders), i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY sample, side ORDER BY s, e) AS k FROM (SELECT *, max(e) OVER (PARTITION BY sample, side ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x)),
m AS (SELECT sample, side, min(s) AS s, max(e) AS e FROM i GROUP BY sample, side, k), z AS (SELECT sample, CAST(sum(CASE WHEN side = 0 THEN e - s + 1 ELSE 0 END) AS BIGINT) AS called, CAST(sum(CASE WHEN side = 1 THEN e - s + 1 ELSE 0 END) AS BIGINT) AS truth FROM m GROUP BY 1),
o AS (SELECT a.sample, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s) + 1) AS BIGINT) AS shared FROM m a JOIN m b ON a.sample = b.sample AND a.side = 0 AND b.side = 1 AND a.s <= b.e AND b.s <= a.e GROUP BY 1)
SELECT z.sample, called, truth, coalesce(shared, 0) AS shared, CASE WHEN truth > 0 THEN floor(coalesce(shared, 0) / truth * 10000 + 0.5) / 10000 END AS sensitivity, CASE WHEN called > 0 THEN floor(coalesce(shared, 0) / called * 10000 + 0.5) / 10000 END AS "precision" FROM z LEFT JOIN o ON o.sample = z.sample"""
)
def segment_overlap_score(t: Tables) -> DataFrame:
    from helixframe.operators import intervals as iv

    o = F.col("o_orderkey")
    x = t.orders.select(F.col("o_custkey").alias("sample"), (o * 37 % 20_000).alias("start"), (o * 37 % 20_000 + 500).alias("end"), (o % 2).alias("side"))
    s = iv.base_overlap(x.where("side = 0").drop("side"), x.where("side = 1").drop("side"), ["sample"], 1024)
    return s.withColumn("sensitivity", rounded(F.col("sensitivity"))).withColumn("precision", rounded(F.col("precision")))


@query(
    """WITH f AS (SELECT p_partkey AS site, p_partkey % 41 / 100.0 AS afr, p_size / 50.0 AS other, p_partkey % 5 AS d FROM part) SELECT site, CASE WHEN d IN (0, 1) THEN 'Neanderthal' WHEN d = 2 THEN 'Denisovan' ELSE 'SharedArchaic' END AS class FROM f WHERE afr <= 0.05 AND other >= 0.2 AND d < 4"""
)
def archaic_panel_build(t: Tables) -> DataFrame:
    """Sites rare in the outgroup, common elsewhere and carried by some archaic genome, with their class."""
    from helixframe.functions.rules import diagnostic_class

    k = F.col("p_partkey")
    d = k % 5
    none = F.lit(None).cast("int")
    calls = F.when(d < 2, F.array(F.lit(2), none, F.lit(1), F.lit(0))).when(d == 2, F.array(F.lit(0), none, none, F.lit(1))).when(d == 3, F.array(F.lit(1), F.lit(0), none, F.lit(2))).otherwise(F.array(F.lit(0), F.lit(0), none, F.lit(0)))
    f = t.part.select(k.alias("site"), (k % 41 / 100.0).alias("afr"), (F.col("p_size") / 50.0).alias("other"), calls.alias("calls"))
    carried = F.exists("calls", lambda c: F.coalesce(c > 0, F.lit(False)))
    return f.where((F.col("afr") <= 0.05) & (F.col("other") >= 0.2) & carried).select("site", diagnostic_class(F.col("calls")).alias("class"))


@query("WITH r AS (SELECT p_brand AS chrom, p_size * 1000 AS pos, min(p_partkey % 300) AS raw FROM part GROUP BY 1, 2) SELECT chrom, pos, max(raw) OVER (PARTITION BY chrom ORDER BY pos) AS cm, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS place FROM r")
def genetic_map_build(t: Tables) -> DataFrame:
    """One row a position in order, centimorgans never falling."""
    points = t.part.select(F.col("p_brand").alias("chrom"), (F.col("p_size") * 1000).alias("pos"), (F.col("p_partkey") % 300).alias("cm"))
    return genetic_map(points, "chrom", "pos", "cm")


@query("SELECT p_brand AS asset, count(*) AS rows, sha256(string_agg(p_partkey || ':' || p_size, ',' ORDER BY p_partkey)) AS checksum FROM part GROUP BY 1")
def panel_manifest(t: Tables) -> DataFrame:
    rows = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_size"))), lambda r: F.concat_ws(":", r["p_partkey"].cast("string"), r["p_size"].cast("string")))
    return t.part.groupBy(F.col("p_brand").alias("asset")).agg(F.count("*").alias("rows"), F.sha2(F.array_join(rows, ",").cast("binary"), 256).alias("checksum"))


# ---- streams


def _dealt(t: Tables, remainders: list[tuple[int, ...]]) -> DataFrame:
    """The events as a stream of files, dealt by their number modulo 4."""
    folder = scratch_path(t.spark, "late")
    for k, own in enumerate(remainders):
        t.events.where((F.col("event_id") % 4).isin(*own)).coalesce(1).write.parquet(f"{folder}/{k}")
    return st.folders_stream(t.spark, [f"{folder}/{k}" for k in range(len(remainders))])


@query(
    """WITH wm AS (SELECT max(ts) - INTERVAL 3 DAY AS w FROM events WHERE event_id % 4 IN (1, 2)), k AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS b, event_id % 4 = 0 AS late FROM events) SELECT CAST(epoch(b) AS BIGINT) AS start, count(*) AS n FROM k, wm WHERE NOT late OR b + INTERVAL 1 DAY > w GROUP BY 1"""
)
def stream_late(t: Tables) -> DataFrame:
    """Rows that come after the front has passed their window are dropped, the others still count.

    A batch drops by the front that the batch before it went by: here that of the first file decides for the third.
    """
    s = _dealt(t, [(1, 2), (3,), (0,)])
    counts = s.withWatermark("ts", "3 days").groupBy(F.window("ts", "1 day").alias("window")).agg(F.count("*").alias("n"))
    out = st.drain_updates(t.spark, counts, ["window"], "stream-late")
    return out.select(F.unix_timestamp("window.start").alias("start"), "n")


@query(
    """WITH wm AS (SELECT max(ts) - INTERVAL 1 DAY AS w FROM events), e AS (SELECT ts, value, unnest([0, 6, 12, 18]) AS back FROM events), k AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours(CAST(back AS BIGINT)) AS b, value FROM e)
SELECT CAST(epoch(b) AS BIGINT) AS start, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM k, wm WHERE b + INTERVAL 1 DAY <= w GROUP BY 1"""
)
def stream_sliding(t: Tables) -> DataFrame:
    """Sliding windows in append mode: each is emitted once, when the front has passed its end."""
    s = st.sliding(st.event_stream(t.spark, f"{t.sf_dir}/events.parquet"), "1 day", "6 hours", "1 day")
    out = st.drain(t.spark, s, "append", "stream-sliding")
    return out.select(F.unix_timestamp("window.start").alias("start"), "n", rounded(F.col("total"), 2).alias("total"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'FAILED' ELSE 'SENT' END AS status, CAST(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 1 + event_id % 3 END AS INTEGER) AS attempts FROM events WHERE event_type = 'purchase'")
def stream_retry(t: Tables) -> DataFrame:
    """An outbox whose rows need up to three attempts; those that never can are failed at once."""
    s = st.event_stream(t.spark, f"{t.sf_dir}/events.parquet").where("event_type = 'purchase'").select("event_id")
    can, enough = F.col("event_id") % 5 > 0, F.col("attempts") >= F.col("event_id") % 3
    outcome = F.when(~can, "permanent").when(enough, "ok").otherwise("transient")
    return st.deliver_with_retries(s, scratch_path(t.spark, "retries"), "event_id", outcome).select("event_id", "status", F.col("attempts").cast("int").alias("attempts"))
