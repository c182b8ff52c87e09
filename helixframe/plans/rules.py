"""Rules of names, identifiers, builds, markers, alleles, gates and phrases on the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import rules as r
from helixframe.plans.catalog import Tables, query, rounded


def _map(values: dict) -> str:
    return "CASE m " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " ELSE NULL END"


_L = "substr('ACGTN', CAST({} % 5 + 1 AS BIGINT), 1)"


@query(f"""WITH x AS (SELECT p_partkey, {_L.format('p_partkey')} AS ref, CASE WHEN p_partkey % 7 = 0 THEN 'AC' ELSE {_L.format('(p_partkey // 5)')} END AS alt, CASE p_partkey % 3 WHEN 0 THEN '.' WHEN 1 THEN '' ELSE 'rs' || p_partkey END AS rs, p_size % 4 AS ad_ref, p_size % 3 AS ad_alt FROM part)
SELECT p_partkey, ref, alt, nullif(nullif(rs, '.'), '') AS rs, CASE WHEN ad_ref + ad_alt > 0 THEN floor(ad_alt / (ad_ref + ad_alt) * 10000 + 0.5) / 10000 END AS af FROM x WHERE length(alt) = 1 AND ref <> 'N' AND alt <> 'N'""")
def snp_calls(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    letter = lambda x: F.substring(F.lit("ACGTN"), (x % 5 + 1).cast("int"), F.lit(1))
    rs = F.when(k % 3 == 0, ".").when(k % 3 == 1, "").otherwise(F.concat(F.lit("rs"), k.cast("string")))
    x = t.part.select("p_partkey", letter(k).alias("ref"), F.when(k % 7 == 0, "AC").otherwise(letter(F.floor(k / 5))).alias("alt"), rs.alias("rs"), (F.col("p_size") % 4).alias("a"), (F.col("p_size") % 3).alias("b"))
    return x.where(r.valid_snp(F.col("ref"), F.col("alt"))).select("p_partkey", "ref", "alt", r.present(F.col("rs")).alias("rs"), rounded(r.allele_fraction(F.col("a"), F.col("b"))).alias("af"))


_STATES = """WITH x AS (SELECT l_orderkey AS o, l_linenumber AS n, substr('ACGTN+-', CAST((l_partkey + l_linenumber) % 7 + 1 AS BIGINT), 1) AS b, substr('ACGT', CAST(l_suppkey % 4 + 1 AS BIGINT), 1) AS a, CASE WHEN l_partkey % 9 = 0 THEN 'GAG' WHEN l_partkey % 10 = 0 THEN '' ELSE substr('ACGT', CAST((l_suppkey + 1 + l_partkey % 3) % 4 + 1 AS BIGINT), 1) END AS d, l_partkey % 6 AS k FROM lineitem),
y AS (SELECT *, translate(b, 'ACGT', 'TGCA') AS c, least(a, substr(d, 1, 1)) || greatest(a, substr(d, 1, 1)) IN ('AT', 'CG') AS amb FROM x)"""


@query(
    _STATES
    + """ SELECT o, n, CASE WHEN b = '+' THEN 'Derived' WHEN b = '-' THEN 'Ancestral' WHEN length(d) <> 1 THEN 'NoCall' WHEN b = d THEN 'Derived' WHEN b = a THEN 'Ancestral' WHEN amb THEN 'NoCall' WHEN c = d THEN 'Derived' WHEN c = a THEN 'Ancestral' ELSE 'NoCall' END AS state,
 CASE WHEN b IN (a, substr(d, 1, 1)) THEN b WHEN NOT amb AND c IN (a, substr(d, 1, 1)) THEN c ELSE b END AS base, CASE WHEN k = 0 THEN '@' || o ELSE 'M' || k END AS key FROM y"""
)
def imputed_states(t: Tables) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    letter = lambda alphabet, x: F.substring(F.lit(alphabet), (x % len(alphabet) + 1).cast("int"), F.lit(1))
    b, a = letter("ACGTN+-", p + F.col("l_linenumber")), letter("ACGT", s)
    d = F.when(p % 9 == 0, "GAG").when(p % 10 == 0, "").otherwise(letter("ACGT", s + 1 + p % 3))
    x = t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), b.alias("b"), a.alias("a"), d.alias("d"), F.when(p % 6 == 0, " ").otherwise(F.concat(F.lit(" m"), (p % 6).cast("string"))).alias("name"))
    return x.select("o", "n", r.impute_state(F.col("b"), F.col("a"), F.col("d")).alias("state"), r.canonical_base(F.col("b"), F.col("a"), F.col("d")).alias("base"), r.group_key(F.col("name"), F.col("o")).alias("key"))


_ARCHAIC = "WITH x AS (SELECT p_partkey AS site, CASE WHEN p_partkey % 4 < 3 THEN p_partkey % 4 END AS c0, CASE WHEN p_size % 4 < 3 THEN p_size % 4 END AS c1, CASE WHEN p_partkey // 4 % 4 < 3 THEN p_partkey // 4 % 4 END AS c2, CASE WHEN p_size // 4 % 4 < 3 THEN p_size // 4 % 4 END AS c3 FROM part), y AS (SELECT *, coalesce(c0 > 0, false) OR coalesce(c1 > 0, false) OR coalesce(c2 > 0, false) AS nh, coalesce(c0 = 0, false) OR coalesce(c1 = 0, false) OR coalesce(c2 = 0, false) AS nn, coalesce(c3 > 0, false) AS dh, coalesce(c3 = 0, false) AS dn FROM x)"


def archaic_calls(t: Tables) -> DataFrame:
    call = lambda x: F.when(x % 4 < 3, (x % 4).cast("int"))
    k, s = F.col("p_partkey"), F.col("p_size")
    return t.part.select(k.alias("site"), F.array(call(k), call(s), call(F.floor(k / 4)), call(F.floor(s / 4))).alias("calls"))


@query(_ARCHAIC + " SELECT site, CASE WHEN nh AND dh THEN 'SharedArchaic' WHEN nh AND dn THEN 'Neanderthal' WHEN dh AND nn THEN 'Denisovan' ELSE 'SharedArchaic' END AS class FROM y")
def diagnostic_classes(t: Tables) -> DataFrame:
    return archaic_calls(t).select("site", r.diagnostic_class(F.col("calls")).alias("class"))


@query(
    """WITH x AS (SELECT o_orderkey AS o, substr('ACGT', CAST(o_orderkey % 4 + 1 AS BIGINT), 1) AS m, substr('ACGT', CAST(o_custkey % 4 + 1 AS BIGINT), 1) AS r, substr('ACGT', CAST((o_custkey + 1 + o_custkey % 3) % 4 + 1 AS BIGINT), 1) AS a, CAST(o_orderkey % 3 AS INTEGER) AS d FROM orders)
SELECT o, CASE WHEN m = a OR m = translate(a, 'ACGT', 'TGCA') THEN d WHEN m = r OR m = translate(r, 'ACGT', 'TGCA') THEN 2 - d END AS dosage, CAST(m = a AS INTEGER) + CAST(r = a AS INTEGER) AS copies FROM x"""
)
def dosage_rekey(t: Tables) -> DataFrame:
    letter = lambda x: F.substring(F.lit("ACGT"), (x % 4 + 1).cast("int"), F.lit(1))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    x = t.orders.select(o.alias("o"), letter(o).alias("m"), letter(c).alias("r"), letter(c + 1 + c % 3).alias("a"), (o % 3).cast("int").alias("d"))
    return x.select("o", r.rekey_dosage(F.col("m"), F.col("r"), F.col("a"), F.col("d"), F.lit(2)).alias("dosage"), r.derived_copies(F.col("m"), F.col("r"), F.col("a")).alias("copies"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND 1 - l_tax >= 0.9 AND l_quantity >= CASE WHEN l_suppkey % 5 = 0 THEN 3 ELSE 10 END")
def publish_gate(t: Tables) -> DataFrame:
    ok = r.publishable(F.when(F.col("l_returnflag") == "N", "Novel").otherwise("Known"), F.when(F.col("l_linestatus") != "O", "PAR"), 1 - F.col("l_tax"), F.col("l_quantity"), F.when(F.col("l_suppkey") % 5 == 0, 15_000).otherwise(150))
    return t.lineitem.where(ok).select("l_orderkey", "l_linenumber")


@query("""WITH c AS (SELECT l_suppkey AS subject, CASE l_linenumber % 4 WHEN 0 THEN 'chrX' WHEN 1 THEN 'chr7' WHEN 2 THEN 'chrY' ELSE 'chrM' END AS contig, sum(CAST(l_quantity AS BIGINT) * CASE WHEN l_linenumber % 4 = 2 AND l_suppkey % 3 = 0 THEN 20 ELSE 1 END) AS reads FROM lineitem GROUP BY 1, 2)
SELECT subject, CAST(sum(CASE WHEN contig = 'chrY' THEN reads ELSE 0 END) AS BIGINT) AS y_reads, CAST(sum(CASE WHEN contig IN ('chrX', 'chr7') THEN reads ELSE 0 END) AS BIGINT) AS other_reads, sum(CASE WHEN contig = 'chrY' THEN reads ELSE 0 END) >= 1000 AND sum(CASE WHEN contig = 'chrY' THEN reads ELSE 0 END) > 8 * sum(CASE WHEN contig IN ('chrX', 'chr7') THEN reads ELSE 0 END) AS y_scoped FROM c GROUP BY 1""")
def y_scoped(t: Tables) -> DataFrame:
    k = F.col("l_linenumber") % 4
    contig = F.when(k == 0, "chrX").when(k == 1, "chr7").when(k == 2, "chrY").otherwise("chrM")
    n = F.sum(F.col("l_quantity").cast("long") * F.when((k == 2) & (F.col("l_suppkey") % 3 == 0), 20).otherwise(1))
    return r.y_scoped(t.lineitem.groupBy(F.col("l_suppkey").alias("subject"), contig.alias("contig")).agg(n.alias("reads")), ["subject"])


@query("WITH s AS (SELECT DISTINCT l_suppkey % 10 AS profile, l_orderkey AS position FROM lineitem WHERE l_suppkey % 10 < 5 OR l_linenumber = 1), n AS (SELECT profile, count(*) AS n FROM s GROUP BY 1) SELECT s.profile, position FROM s JOIN n ON n.profile = s.profile WHERE n <= 500 OR position % 16 = 0")
def exchange_decimate(t: Tables) -> DataFrame:
    s = t.lineitem.where("l_suppkey % 10 < 5 or l_linenumber = 1").select((F.col("l_suppkey") % 10).alias("profile"), F.col("l_orderkey").alias("position")).distinct()
    return r.decimate(s, ["profile"], budget=500)


@query("SELECT p_partkey, p_partkey % 19 / 19.0 AS f1, p_partkey % 7 / 7.0 AS f2 FROM part WHERE true QUALIFY (row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1) % 3 = 0")
def panel_subset_thin(t: Tables) -> DataFrame:
    panel = t.part.withColumn("freqs", F.array(*((F.col("p_partkey") % m / float(m)) for m in (7, 11, 19))))
    kept = r.thin_sites(r.panel_subset(panel, ["a", "b", "c"], ["c", "unknown", "a"]), ["p_size"], "p_partkey", 3)
    return kept.select("p_partkey", F.col("freqs")[0].alias("f1"), F.col("freqs")[1].alias("f2"))


@query("SELECT l_suppkey AS hap, l_partkey AS site FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def haplotype_drop(t: Tables) -> DataFrame:
    return r.without_haplotypes(t.lineitem.select(F.col("l_suppkey").alias("hap"), F.col("l_partkey").alias("site")), t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("hap")))


@query(
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'IGSR:HG' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') WHEN 1 THEN 'HGDP:HGDP_' || c_custkey WHEN 2 THEN 'IGSR:NA' || (c_custkey + 100000) || ',BIOSAMPLE:SAMN' || c_custkey WHEN 3 THEN 'ENA:ERS' || c_custkey WHEN 4 THEN 'SRA:srs' || c_custkey ELSE '' END AS ids,
 c_custkey % 3 = 0 AS public FROM customer"""
)
def catalog_ids(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    s = k.cast("string")
    name = F.when(k % 6 == 0, F.concat(F.lit(" HG"), F.lpad(s, 5, "0"))).when(k % 6 == 1, F.concat(F.lit("HGDP_"), s)).when(k % 6 == 2, F.concat(F.lit("NA"), (k + 100_000).cast("string"))).when(k % 6 == 5, "HG002").otherwise("Ale22")
    accession = F.when(k % 6 == 2, F.concat(F.lit("SAMN"), s)).when(k % 6 == 3, F.concat(F.lit("ERS"), s)).when(k % 6 == 4, F.concat(F.lit("srs"), s)).otherwise("Ale22")
    return t.customer.select("c_custkey", F.array_join(r.catalog_ids(name, accession), ",").alias("ids"), r.is_public(F.when(k % 3 == 0, "HGDP").otherwise("FTDNA")).alias("public"))


#: Names and what is left of them.
_NAMES = (
    ("Thomas Michael Kane", "Kane"), ("Kane", "Kane"), ("Pieter van der Berg", "van der Berg"), ("Juan de la Cruz", "de la Cruz"), ("Patrick O'Brien Jr.", "O'Brien"), ("Kane, Thomas", "Kane"),
    ("William Macaulay ~1770 of Balnicol", "Macaulay"), ("Michael OConnell b1854 d1928 St Louis", "OConnell"), ("John Smith III", "Smith"), ("Ann&nbsp;Lee born in York", "Lee"), ("--", None), ("", None), ("1850", None),
)


@query("SELECT c_custkey, CASE c_custkey % 13 " + " ".join(f"WHEN {k} THEN " + ("NULL" if b is None else "'" + b.replace("'", "''") + "'") for k, (_, b) in enumerate(_NAMES)) + " END AS surname FROM customer")
def surnames(t: Tables) -> DataFrame:
    dealt = F.array(*(F.lit(a) for a, _ in _NAMES))
    return t.customer.select("c_custkey", r.surname(F.get(dealt, (F.col("c_custkey") % len(_NAMES)).cast("int"))).alias("surname"))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'ftdna' WHEN 1 THEN 'ftdna' WHEN 2 THEN 'fgc' WHEN 3 THEN 'nebula' WHEN 4 THEN 'fgc' END AS entry FROM customer""")
def lab_lookup(t: Tables) -> DataFrame:
    labs = [(1, "ftdna", "FamilyTreeDNA", ["FTDNA", "Family Tree DNA"]), (2, "fgc", "Full Genomes Corporation", ["Full Genomes"]), (3, "nebula", "Nebula Genomics", ["Nebula"])]
    catalog = t.spark.createDataFrame(labs, "place int, id string, name string, aliases array<string>")
    asked = F.array(*map(F.lit, (" familytreedna ", "Family Tree DNA", "genomes corp", "nebula genomics", "genomes", "elsewhere")))
    x = t.customer.select("c_custkey", F.get(asked, (F.col("c_custkey") % 6).cast("int")).alias("lab"))
    return r.lookup_fuzzy(x, catalog, "lab").select("c_custkey", "entry")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'GRCh38' WHEN 1 THEN 'GRCh37' WHEN 2 THEN 'chm13v2.0' WHEN 3 THEN 'chm13v2.0_maskedY_rCRS' WHEN 4 THEN 'GRCh38' WHEN 5 THEN 'chm13v2.0' END AS build,
 CASE WHEN o_orderkey % 7 IN (0, 4) THEN CASE WHEN p BETWEEN 10001 AND 2781479 OR p BETWEEN 56887903 AND 57217415 THEN 'PAR' WHEN p BETWEEN 26600001 AND 57227415 THEN 'Heterochromatin' END WHEN o_orderkey % 7 = 1 THEN CASE WHEN p BETWEEN 10001 AND 2649520 OR p BETWEEN 59034050 AND 59363566 THEN 'PAR' WHEN p BETWEEN 28800001 AND 59034050 THEN 'Heterochromatin' END
 WHEN o_orderkey % 7 IN (2, 3, 5) THEN CASE WHEN p BETWEEN 1 AND 2458320 OR p BETWEEN 62122809 AND 62460029 THEN 'PAR' WHEN p BETWEEN 26637971 AND 62122809 THEN 'Heterochromatin' END END AS landmark FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 137) % 63000000 AS BIGINT) AS p FROM orders)"""
)
def build_landmarks(t: Tables) -> DataFrame:
    names = F.array(*map(F.lit, ("hg38", "b37", "HS1", "chm13v2.0_maskedY_rCRS", "GRCh38.p14", "T2T", "mm10")))
    x = t.orders.select("o_orderkey", F.get(names, (F.col("o_orderkey") % 7).cast("int")).alias("b"), (F.floor(F.col("o_totalprice") * 137) % 63_000_000).alias("p"))
    return x.select("o_orderkey", r.canonical_build(F.col("b")).alias("build"), r.y_landmark(F.col("b"), F.col("p")).alias("landmark"))


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 0.5 WHEN 1 THEN 0.4 WHEN 2 THEN 0.3 WHEN 3 THEN 0.3 WHEN 4 THEN 0.25 WHEN 5 THEN 0.1 WHEN 6 THEN 0.1 ELSE 1.0 END::DOUBLE AS weight FROM part")
def region_weights(t: Tables) -> DataFrame:
    names = F.array(*map(F.lit, r.REGION_WEIGHTS))
    return t.part.select("p_partkey", r.region_modifier(F.get(names, (F.col("p_partkey") % 8).cast("int"))).alias("weight"))


_LOCI = ("DYS19/DYS394", "DYS385_1", "DYS389II.1", "DYS456", "DYS714", "DYS390", "DYS999", "Y-GATA-H4")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS c, l_partkey % 8 AS k, l_suppkey % 2 = 0 AS g38 FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN 'DYS19' WHEN 1 THEN 'DYS385' WHEN 2 THEN 'DYS389II' WHEN 3 THEN 'DYS456' WHEN 4 THEN 'DYS714' WHEN 5 THEN 'DYS390' WHEN 6 THEN 'DYS999' ELSE 'Y-GATA-H4' END AS marker, c + CASE WHEN k = 0 THEN -1 WHEN k = 3 AND NOT g38 THEN 1 WHEN k = 4 AND g38 THEN 1 ELSE 0 END AS value,
 CASE WHEN k IN (1, 2, 7) THEN 'Excluded' WHEN k = 6 THEN 'Uncalibrated' WHEN k = 5 OR (k = 3 AND g38) OR (k = 4 AND NOT g38) THEN 'Reliable' ELSE 'ConventionOffset' END AS status FROM x""")
def marker_convention(t: Tables) -> DataFrame:
    locus = F.get(F.array(*map(F.lit, _LOCI)), (F.col("l_partkey") % 8).cast("int"))
    value, status = r.marker_value(locus, F.col("l_quantity").cast("int"), F.when(F.col("l_suppkey") % 2 == 0, "GRCh38").otherwise("chm13v2.0"))
    return t.lineitem.select("l_orderkey", "l_linenumber", r.marker_name(locus).alias("marker"), value.alias("value"), status.alias("status"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'AFR' WHEN 1 THEN 'EUR' WHEN 2 THEN 'EUR' WHEN 3 THEN 'WHG' WHEN 4 THEN 'OCE' END AS super, CASE p_partkey % 6 WHEN 0 THEN 'African' WHEN 1 THEN 'European' WHEN 2 THEN 'European' WHEN 3 THEN 'Western Hunter-Gatherer' WHEN 4 THEN 'Oceanian' END AS name FROM part")
def population_rollup(t: Tables) -> DataFrame:
    code = F.get(F.array(*map(F.lit, ("YRI", "EUR", "TSI", "WHG", "OCE", "XXX"))), (F.col("p_partkey") % 6).cast("int"))
    return t.part.select("p_partkey", r.population_super(code).alias("super"), r.population_name(r.population_super(code)).alias("name"))


@query(
    """WITH a AS (SELECT o_custkey AS subject, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') / count(*) AS c, bool_or(o_orderstatus = 'P') AS x, avg(CAST(floor(o_totalprice) AS BIGINT)) / 10000 AS depth, CASE o_custkey % 5 WHEN 0 THEN 'BIG_Y_700' WHEN 1 THEN 'WGS' WHEN 2 THEN 'FTDNA Big Y results' WHEN 3 THEN 'full mtDNA' ELSE 'other' END AS test FROM orders GROUP BY 1)
SELECT subject, CASE WHEN x THEN 'conflict' ELSE (CASE WHEN c >= 0.9 THEN 'strong' WHEN c >= 0.6 THEN 'good' ELSE 'tentative' END) || CASE WHEN n <= 1 THEN ' single' ELSE ' multiple' END END AS confidence,
 CASE WHEN subject % 5 IN (0, 2, 3) THEN CASE WHEN depth >= 10 THEN 'high' WHEN depth >= 3 THEN 'good' ELSE 'targeted shallow' END ELSE CASE WHEN depth >= 25 THEN 'high' WHEN depth >= 10 THEN 'good' WHEN depth >= 4 THEN 'shallow' ELSE 'very shallow' END END AS quality,
 CASE WHEN subject % 5 IN (0, 2, 3) THEN depth >= 3 ELSE depth >= 10 END AS enough, CASE subject % 5 WHEN 0 THEN 'YChromosome' WHEN 1 THEN 'WholeGenome' WHEN 2 THEN 'YChromosome' WHEN 3 THEN 'MtDna' END AS target FROM a"""
)
def subject_phrases(t: Tables) -> DataFrame:
    s = F.col("subject")
    a = t.orders.groupBy(F.col("o_custkey").alias("subject")).agg(F.count("*").alias("n"), (F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("c"), F.max(F.col("o_orderstatus") == "P").alias("x"), (F.avg(F.floor("o_totalprice")) / 10000).alias("depth"))
    test = F.get(F.array(*map(F.lit, ("BIG_Y_700", "WGS", "FTDNA Big Y results", "full mtDNA", "other"))), (s % 5).cast("int"))
    a = a.withColumn("target", r.test_target(test))
    phrase, enough = r.depth_phrase(F.col("depth"), F.coalesce("target", F.lit("WholeGenome")))
    return a.select("subject", r.confidence_phrase(F.col("c"), F.col("n"), F.col("x")).alias("confidence"), phrase.alias("quality"), enough.alias("enough"), "target")


@query(
    """WITH n AS (SELECT c_nationkey AS subject, c_mktsegment AS name, count(*) AS n FROM customer WHERE c_nationkey % 5 > 0 OR c_mktsegment = 'BUILDING' GROUP BY 1, 2), s AS (SELECT subject, name, n * 100.0 / sum(n) OVER (PARTITION BY subject) AS share, row_number() OVER (PARTITION BY subject ORDER BY n DESC, name DESC) AS r FROM n),
p AS (SELECT a.subject, a.name AS n1, a.share AS s1, b.name AS n2, b.share AS s2 FROM s a LEFT JOIN s b ON a.subject = b.subject AND b.r = 2 WHERE a.r = 1)
SELECT subject, CASE WHEN s1 >= 85 THEN 'predominantly ' || n1 WHEN s1 >= 55 AND s2 >= 10 THEN 'mostly ' || n1 || ' with ' || n2 WHEN s1 >= 55 OR n2 IS NULL THEN 'mostly ' || n1 ELSE 'mix of ' || n1 || ' and ' || n2 END AS phrase, CASE WHEN s1 < 25 THEN 'fewer' WHEN s1 > 75 THEN 'more' ELSE 'typical' END AS archaic FROM p"""
)
def ancestry_phrases(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    n = t.customer.where("c_nationkey % 5 > 0 or c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("subject"), F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("n"))
    s = n.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("subject")))
    g = s.groupBy("subject").agg(F.collect_list(F.struct("share", "name")).alias("shares"), F.max("share").alias("top"))
    return g.select("subject", r.ancestry_phrase(F.col("shares")).alias("phrase"), r.archaic_phrase(F.col("top")).alias("archaic"))


@query(
    """WITH a AS (SELECT l_suppkey AS run, count(*) FILTER (l_returnflag = 'N') AS novel, sum(CAST(l_quantity AS BIGINT) * 10000) AS bases FROM lineitem GROUP BY 1)
SELECT run, CASE WHEN novel >= 50 THEN 'elevated private-Y count (' || novel || ' novel in unique sequence)' END AS banner, CASE WHEN run % 2 = 0 AND run % 3 > 0 THEN CASE WHEN bases > 10000000 THEN 'BIG_Y_700' ELSE 'BIG_Y_500' END WHEN run % 2 = 0 THEN 'TARGETED_Y' ELSE 'WGS' END AS test_type FROM a"""
)
def private_y_quality(t: Tables) -> DataFrame:
    k = F.col("run")
    a = t.lineitem.groupBy(F.col("l_suppkey").alias("run")).agg(F.count_if(F.col("l_returnflag") == "N").alias("novel"), F.sum(F.col("l_quantity").cast("long") * 10_000).alias("bases"))
    test = F.when(k % 2 == 0, "TARGETED_Y").otherwise("WGS")
    return a.select("run", r.private_y_banner(F.col("novel")).alias("banner"), r.big_y_generation(test, F.when(k % 3 > 0, "FTDNA").otherwise("YSEQ"), F.col("bases")).alias("test_type"))


_FOUND = (("x.G.VCF.gz", "Variant"), ("coverage.txt", "Coverage"), ("stats.txt", "Stats"), ("a.dragstr.model", "DragstrModel"), ("a.CRAM", "Alignment"), ("a.bam.bai", "Index"), ("readme", "Other"))


@query("SELECT page_id, CASE page_id % 7 " + " ".join(f"WHEN {k} THEN '{c}'" for k, (_, c) in enumerate(_FOUND)) + " END AS class FROM pages")
def sidecar_classes(t: Tables) -> DataFrame:
    names = F.array(*(F.lit(n) for n, _ in _FOUND))
    return t.pages.select("page_id", r.sidecar_class(F.get(names, (F.col("page_id") % 7).cast("int"))).alias("class"))


@query("SELECT event_id, floor(value * 100 + 0.5) / 100 AS cm, floor(epoch(TIMESTAMP '2025-01-01 00:00:00' - date_trunc('second', ts)) / 86400.0 * 1000 + 0.5) / 1000 AS days FROM events")
def rounded_ages(t: Tables) -> DataFrame:
    days = F.expr("timestampdiff(SECOND, cast(date_trunc('second', ts) as timestamp_ntz), timestamp_ntz'2025-01-01 00:00:00')") / 86_400.0
    return t.events.select("event_id", r.round_cm(F.col("value")).alias("cm"), rounded(days, 3).alias("days"))
