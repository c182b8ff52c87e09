"""Queries of sources on a common panel: items are sites, sold lines are calls, clients and vendors are sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.genotype import complement
from helixframe.operators import panels
from helixframe.plans.catalog import Tables, query, rounded

# ---- the panel: one site an item, its locus in two builds; the second lacks items of some sizes


def _items(t: Tables) -> DataFrame:
    return t.items.where("item_id is not null").groupBy(F.col("item_id").alias("site")).agg(F.max("size").alias("size"))


def _base(k: Column) -> Column:
    return F.substring(F.lit("ACGT"), (k % 4 + 1).cast("int"), F.lit(1))


def _panel(t: Tables) -> DataFrame:
    s = F.col("site")
    return _items(t).select("site", _base(s).alias("ref"), _base(s + 1 + s % 3).alias("alt"), (s % 22 + 1).cast("string").alias("contig"), (s * 1000).alias("pos"))


def _loci(t: Tables) -> DataFrame:
    number, pos = (F.col("site") % 22 + 1).cast("string"), F.col("site") * 1000
    first = _items(t).select("site", F.lit("first").alias("build"), number.alias("contig"), (pos + 37).alias("pos"))
    return first.union(_items(t).where("size is null or size % 10 <> 0").select("site", F.lit("second"), F.concat(F.lit("chr"), number), pos))


# ---- calls: a line is a client's call of its item, most like the calls of the client's master record


def _clients(t: Tables) -> DataFrame:
    return t.clients.where("client_id is not null").groupBy("client_id").agg(F.min("master_id").alias("master_id"), F.min("source").alias("kind"))


def _calls(t: Tables) -> DataFrame:
    sold = t.sales.where("client_id is not null").select("sale_id", "client_id").distinct()
    lines = t.sale_lines.where("item_id is not null").select("sale_id", "item_id", "vendor_id", "quantity", "flag")
    j = lines.join(sold, "sale_id").join(_clients(t), "client_id")
    i, q = F.col("item_id"), F.col("quantity")
    d = (i + F.coalesce("master_id", "client_id") * (i % 5) + F.when(q % 11 == 0, 1).otherwise(0)) % 3
    pair = panels.pair_of_dosage(F.when(q.isNotNull(), d), _base(i), _base(i + 1 + i % 3))
    third = F.when((F.col("flag") == "swapped") & (q % 7 == 0), _base(i + 2))
    strand = lambda a: F.when(F.col("vendor_id") % 2 == 1, complement(a)).otherwise(a)
    second = F.col("kind") == "crm"
    return j.withColumn("_p", pair).select(
        F.col("client_id").alias("source"),
        F.when(second, "second").otherwise("first").alias("build"),
        F.concat(F.when(second, "").otherwise("Chr"), (i % 22 + 1).cast("string")).alias("contig"),
        F.when(second, i * 1000).otherwise(i * 1000 + 37).alias("pos"),
        strand(F.coalesce(third, F.col("_p.a1"))).alias("a1"),
        strand(F.col("_p.a2")).alias("a2"),
    )


def _classified(t: Tables) -> DataFrame:
    return panels.classify_calls(_calls(t), _panel(t), _loci(t))


_CALLS = """WITH i AS (SELECT item_id AS site, max(size) AS size FROM items WHERE item_id IS NOT NULL GROUP BY 1), c AS (SELECT client_id, min(master_id) AS master_id, min(source) AS kind FROM clients WHERE client_id IS NOT NULL GROUP BY 1),
l AS (SELECT c.client_id AS source, coalesce(kind = 'crm', false) AS other, item_id AS k, quantity AS q, coalesce(vendor_id % 2 = 1, false) AS minus, coalesce(flag = 'swapped' AND quantity % 7 = 0, false) AS odd,
 (item_id + coalesce(master_id, c.client_id) * (item_id % 5) + CASE WHEN quantity % 11 = 0 THEN 1 ELSE 0 END) % 3 AS d
 FROM sale_lines JOIN (SELECT DISTINCT sale_id, client_id FROM sales WHERE client_id IS NOT NULL) USING (sale_id) JOIN c USING (client_id) WHERE item_id IS NOT NULL),
s AS (SELECT l.*, site, substr('ACGT', k % 4 + 1, 1) AS ref, substr('ACGT', (k + 1 + k % 3) % 4 + 1, 1) AS alt, substr('ACGT', (k + 2) % 4 + 1, 1) AS third
 FROM l LEFT JOIN i ON site = k AND (NOT other OR size IS NULL OR size % 10 <> 0)),
p AS (SELECT source, site, q, ref, alt, minus, CASE WHEN odd THEN third WHEN d >= 2 THEN alt ELSE ref END AS b1, CASE WHEN d >= 1 THEN alt ELSE ref END AS b2 FROM s),
r AS (SELECT source, site, q, ref, alt, CASE WHEN minus THEN translate(b1, 'ACGT', 'TGCA') ELSE b1 END AS a1, CASE WHEN minus THEN translate(b2, 'ACGT', 'TGCA') ELSE b2 END AS a2 FROM p),
w AS (SELECT source, site, q, translate(ref, 'ACGT', 'TGCA') = alt AS same_either, CASE WHEN a1 IN (ref, alt) AND a2 IN (ref, alt) THEN CAST(a1 = alt AS INTEGER) + CAST(a2 = alt AS INTEGER)
 WHEN translate(a1, 'ACGT', 'TGCA') IN (ref, alt) AND translate(a2, 'ACGT', 'TGCA') IN (ref, alt) THEN CAST(translate(a1, 'ACGT', 'TGCA') = alt AS INTEGER) + CAST(translate(a2, 'ACGT', 'TGCA') = alt AS INTEGER) END AS copies FROM r),
o AS (SELECT source, site, copies, CASE WHEN site IS NULL THEN 'off_panel' WHEN q IS NULL THEN 'no_call' WHEN same_either THEN 'palindromic' WHEN copies IS NULL THEN 'mismatched' ELSE 'resolved' END AS outcome FROM w),
g AS (SELECT source, site, min(copies) AS dosage, max(copies) AS most FROM o WHERE outcome = 'resolved' GROUP BY 1, 2)"""


@query(
    _CALLS
    + """, n AS (SELECT source, count(*) FILTER (outcome = 'off_panel') AS off_panel, count(*) FILTER (outcome = 'no_call') AS no_call, count(*) FILTER (outcome = 'palindromic') AS palindromic, count(*) FILTER (outcome = 'mismatched') AS mismatched, count(*) FILTER (outcome = 'resolved') AS resolved FROM o GROUP BY 1),
m AS (SELECT source, count(*) FILTER (dosage = most) AS sites, count(*) FILTER (dosage < most) AS conflicting FROM g GROUP BY 1)
SELECT n.*, coalesce(sites, 0) AS sites, coalesce(conflicting, 0) AS conflicting, CASE WHEN resolved = 0 THEN 'check the build' ELSE 'imported' END AS verdict FROM n LEFT JOIN m USING (source)"""
)
def callset_outcomes(t: Tables) -> DataFrame:
    """What became of each client's calls on the panel."""
    return panels.import_outcomes(_classified(t))


@query(_CALLS + " SELECT source, site, CAST(dosage AS INTEGER) AS dosage FROM g WHERE dosage = most")
def callset_dosages(t: Tables) -> DataFrame:
    """Each client's genotypes on the panel, from calls of either build and strand."""
    return panels.genotypes(_classified(t))


# ---- identity: a client against its master record


def _masters(t: Tables) -> DataFrame:
    return _clients(t).select(F.col("client_id").alias("a"), F.col("master_id").alias("b"))


def _client_markers(t: Tables) -> DataFrame:
    c = _clients(t).select("client_id", F.coalesce("master_id", "client_id").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    k, s = F.col("k"), F.col("client_id")
    value = (F.col("m") * (k + 3) + k * k) % 11 + 9 + F.when((s * 31 + k * 17) % 37 == 0, 1).otherwise(0)
    name = F.concat(F.when(s % 2 == 0, "DYS").otherwise("dys"), k.cast("string"))
    return c.where((s % 4 != 3) & ((s + k) % 9 != 0)).select(F.col("client_id").alias("source"), name.alias("marker"), value.cast("string").alias("value"))


@query(
    _CALLS
    + """, v AS (SELECT client_id AS source, k, (m * (k + 3) + k * k) % 11 + 9 + CASE WHEN (client_id * 31 + k * 17) % 37 = 0 THEN 1 ELSE 0 END AS v FROM (SELECT client_id, coalesce(master_id, client_id) AS m, unnest(range(12)) AS k FROM c) WHERE client_id % 4 <> 3 AND (client_id + k) % 9 <> 0),
pr AS (SELECT client_id AS a, master_id AS b FROM c WHERE client_id <> master_id),
x AS (SELECT a, b, count(*) AS sites, count(*) FILTER (ga.dosage = gb.dosage) AS matched FROM pr JOIN g ga ON ga.source = a AND ga.dosage = ga.most JOIN g gb ON gb.source = b AND gb.site = ga.site AND gb.dosage = gb.most GROUP BY 1, 2),
y AS (SELECT a, b, count(*) AS markers, count(*) FILTER (va.v <> vb.v) AS differing FROM pr JOIN v va ON va.source = a JOIN v vb ON vb.source = b AND vb.k = va.k GROUP BY 1, 2),
z AS (SELECT a, b, coalesce(sites, 0) AS sites, coalesce(matched, 0) AS matched, coalesce(markers, 0) AS markers, coalesce(differing, 0) AS differing, matched / sites AS f FROM pr LEFT JOIN x USING (a, b) LEFT JOIN y USING (a, b))
SELECT a, b, sites, matched, markers, differing, floor(f * 10000 + 0.5) / 10000 AS concordance,
 CASE WHEN f >= 0.95 THEN 'VerifiedSame' WHEN f >= 0.85 THEN 'LikelySame' WHEN f >= 0.65 THEN 'Uncertain' WHEN f >= 0.5 THEN 'LikelyDifferent' WHEN f IS NOT NULL THEN 'VerifiedDifferent' WHEN markers > 0 AND differing = 0 THEN 'LikelySame' ELSE 'Uncertain' END AS band,
 CASE WHEN sites > 0 AND markers > 0 THEN 'SNP concordance + Y-STR' WHEN sites > 0 THEN 'SNP concordance' WHEN markers > 0 THEN 'Y-STR only' ELSE 'no shared data' END AS method FROM z"""
)
def identity_checks(t: Tables) -> DataFrame:
    """Whether a client and its master record are one, by what both bought and by markers."""
    out = panels.verify_identity(_masters(t), panels.genotypes(_classified(t)), _client_markers(t))
    return out.withColumn("concordance", rounded(F.col("concordance")))


# ---- segments: vendors of one nation, each against the one before it; they agree on some stretches of items


@query()
def source_relationships(t: Tables) -> DataFrame:
    """Lengths of what two vendors of a nation share along the panel, and the relationship that suggests."""
    v = t.vendors.where("vendor_id is not null").groupBy("vendor_id").agg(F.min("nation_id").alias("nation_id"))
    pairs = v.select(F.lag("vendor_id").over(Window.partitionBy("nation_id").orderBy("vendor_id")).alias("a"), F.col("vendor_id").alias("b"))
    panel = _items(t).select("site", (F.col("site") % 4).alias("contig"), F.col("site").alias("pos"))
    sold = t.sale_lines.where("item_id is not null and quantity is not null").groupBy("vendor_id", "item_id").agg(F.max("quantity").alias("q"))
    i, n = F.col("item_id"), F.coalesce("nation_id", F.lit(0))
    alike = (F.floor(i / 600) + F.col("vendor_id")) % 3 < 2
    g = sold.join(v, "vendor_id").select(F.col("vendor_id").alias("source"), i.alias("site"), F.when(alike, (i * 7 + n) % 3).otherwise(F.col("q") % 3).cast("int").alias("dosage"))
    ends = F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit(0.0).alias("cm")), F.struct(F.col("most").alias("pos"), F.lit(1000.0).alias("cm")))
    curve = panel.groupBy("contig").agg(F.max("pos").alias("most")).select("contig", F.explode(ends).alias("m")).select("contig", "m.*")
    found = panels.shared_segments(pairs, g, panel, curve, window=8, min_sites=8)
    out = panels.compare_sources(pairs, found)
    return out.select("a", "b", "segments", rounded(F.col("total_cm"), 2).alias("total_cm"), rounded(F.col("longest_cm"), 2).alias("longest_cm"), "relationship")
