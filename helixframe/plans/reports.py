"""Reports and store rules on the standard tables: customers are subjects, orders alignments, nations projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import rules
from helixframe.operators import reports as rp
from helixframe.plans.catalog import Tables, query, rounded
from helixframe.session import scratch_path

_ART = "art AS (SELECT o_custkey AS subject, l_orderkey AS alignment, CASE l_linenumber % 3 WHEN 0 THEN 'coverage' WHEN 1 THEN 'sex' ELSE 'read_metrics' END AS kind, CASE WHEN l_linenumber <= 4 THEN '1' ELSE '0' END AS version, CASE WHEN l_suppkey % 2 = 0 THEN 'full' ELSE 'partial' END AS completeness, l_partkey AS payload, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def _artifacts(t: Tables) -> DataFrame:
    k = F.col("l_linenumber") % 3
    kind = F.when(k == 0, "coverage").when(k == 1, "sex").otherwise("read_metrics")
    j = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(F.col("o_custkey").alias("subject"), F.col("l_orderkey").alias("alignment"), kind.alias("kind"), F.when(F.col("l_linenumber") <= 4, "1").otherwise("0").alias("version"), F.when(F.col("l_suppkey") % 2 == 0, "full").otherwise("partial").alias("completeness"), F.col("l_partkey").alias("payload"), "l_linenumber")


@query(
    f"""WITH {_ART}, a AS (SELECT subject, alignment, kind, version, max(completeness) AS completeness, max(payload) AS payload FROM art GROUP BY 1, 2, 3, 4), f AS (SELECT *, row_number() OVER (PARTITION BY subject, kind ORDER BY alignment) AS r FROM a WHERE version = '1'),
p AS (SELECT subject, max(alignment) FILTER (kind = 'coverage') AS ca, max(payload) FILTER (kind = 'coverage') AS coverage, max(completeness) FILTER (kind = 'coverage') AS cc, max(payload) FILTER (kind = 'sex') AS sex, max(payload) FILTER (kind = 'read_metrics') AS read_metrics FROM f WHERE r = 1 GROUP BY 1), n AS (SELECT o_custkey AS subject, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1)
SELECT c_custkey AS subject, c_nationkey AS project, coalesce(n, 0) AS alignments, coalesce(ca, first) AS primary_alignment, coverage, sex, read_metrics, coalesce(cc = 'partial', false) AS partial, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS terminal FROM customer LEFT JOIN n ON n.subject = c_custkey LEFT JOIN p ON p.subject = c_custkey"""
)
def project_report(t: Tables) -> DataFrame:
    a = _artifacts(t).groupBy("subject", "alignment", "kind", "version").agg(F.max("completeness").alias("completeness"), F.max("payload").alias("payload"))
    members = t.customer.select(F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("project"))
    al = t.orders.select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("alignment"))
    ends = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("terminal"))
    r = rp.project_report(members, al, a, ends, {"coverage": "1", "sex": "1", "read_metrics": "1"})
    return r.select("subject", "project", "alignments", "primary_alignment", *(F.col(f"{k}.payload").alias(k) for k in ("coverage", "sex", "read_metrics")), "partial", "terminal")


@query(
    """WITH r AS (SELECT o_custkey AS subject, CASE WHEN o_orderstatus = 'F' THEN 'Y' ELSE 'Mt' END AS dna, max(o_orderpriority) AS h FROM orders GROUP BY 1, 2), x AS (SELECT DISTINCT o_custkey AS subject, CASE WHEN o_orderstatus = 'F' THEN 'Y' ELSE 'Mt' END AS dna FROM orders WHERE o_orderpriority = '1-URGENT'),
l AS (SELECT c_custkey AS subject, 'Y' AS dna, c_mktsegment AS l FROM customer WHERE c_custkey % 2 = 0), o AS (SELECT c_custkey AS subject, 'Mt' AS dna, 'H' || c_nationkey AS o FROM customer WHERE c_custkey % 7 = 0), k AS (SELECT subject, dna FROM r UNION SELECT subject, dna FROM l WHERE (subject, dna) NOT IN (SELECT subject, dna FROM x) UNION SELECT subject, dna FROM o)
SELECT k.subject, k.dna, coalesce(o, CASE WHEN x.subject IS NULL THEN l END, h) AS terminal FROM k LEFT JOIN r USING (subject, dna) LEFT JOIN l USING (subject, dna) LEFT JOIN o USING (subject, dna) LEFT JOIN x USING (subject, dna)"""
)
def subject_terminals(t: Tables) -> DataFrame:
    dna = F.when(F.col("o_orderstatus") == "F", "Y").otherwise("Mt")
    o = t.orders.select(F.col("o_custkey").alias("subject"), dna.alias("dna"), "o_orderpriority")
    c = F.col("c_custkey")
    labels = t.customer.where("c_custkey % 2 = 0").select(c.alias("subject"), F.lit("Y").alias("dna"), F.col("c_mktsegment").alias("label"))
    over = t.customer.where("c_custkey % 7 = 0").select(c.alias("subject"), F.lit("Mt").alias("dna"), F.concat(F.lit("H"), F.col("c_nationkey").cast("string")).alias("haplogroup"))
    return rp.subject_terminals(o.groupBy("subject", "dna").agg(F.max("o_orderpriority").alias("haplogroup")), labels, over, o.where("o_orderpriority = '1-URGENT'"), True)


_MATCH = """WITH p AS (SELECT s_suppkey AS subject, s_name AS name, ['root', r_name, n_name] AS lineage FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey), s AS (SELECT DISTINCT l_suppkey AS subject, l_partkey % 400 AS snp FROM lineitem WHERE l_suppkey % 4 > 0 AND l_returnflag = 'R'), m AS (SELECT l_suppkey AS subject, 'D' || (l_partkey % 25) AS marker, CAST(max(l_quantity) AS INTEGER) % 4 AS value FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY 1, 2),
z AS (SELECT subject, count(*) AS n FROM s GROUP BY 1), sh AS (SELECT a.subject AS query, b.subject, count(*) AS shared FROM s a JOIN s b ON a.snp = b.snp AND a.subject <> b.subject GROUP BY 1, 2), st AS (SELECT a.subject AS query, b.subject, count(*) AS compared, count(*) FILTER (a.value <> b.value) AS distance FROM m a JOIN m b ON a.marker = b.marker AND a.subject <> b.subject GROUP BY 1, 2),
j AS (SELECT coalesce(sh.query, st.query) AS query, coalesce(sh.subject, st.subject) AS subject, coalesce(shared, 0) AS sh, compared, distance FROM sh FULL JOIN st ON sh.query = st.query AND sh.subject = st.subject),
k AS (SELECT j.*, x.n AS mine, y.n AS theirs, x.n IS NOT NULL AND y.n IS NOT NULL AS snp, a.lineage AS la, b.lineage AS lb, b.name FROM j LEFT JOIN z x ON x.subject = query LEFT JOIN z y ON y.subject = j.subject JOIN p a ON a.subject = query JOIN p b ON b.subject = j.subject WHERE query % 100 = 1)"""


@query(
    _MATCH
    + """, f AS (SELECT query, subject, CASE WHEN snp THEN sh ELSE 0 END AS shared, distance, compared, CASE WHEN snp THEN CASE WHEN la[3] = lb[3] THEN la[3] WHEN la[2] = lb[2] THEN la[2] ELSE 'root' END END AS divergence, CASE WHEN snp THEN (mine - sh + theirs - sh) / 2 * 83.0 END AS snp_years, distance / (2 * compared * 0.0025) * 32 AS str_years, CASE WHEN snp AND compared IS NOT NULL THEN 'SnpStr' WHEN snp THEN 'Snp' ELSE 'Str' END AS signal, name FROM k)
SELECT query, subject, shared, distance, compared, divergence, floor(snp_years * 100 + 0.5) / 100 AS snp_years, floor(str_years * 100 + 0.5) / 100 AS str_years, signal, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY CASE WHEN signal = 'Str' THEN 1 ELSE 0 END, shared DESC, coalesce(distance, 1099511627776), name, subject) AS INTEGER) AS place FROM f) WHERE place <= 200"""
)
def y_matches(t: Tables) -> DataFrame:
    """Matches of the suppliers whose number leaves 1 modulo 100, against all: a stated set of queries."""
    n = F.broadcast(t.nation.join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey")))
    p = t.supplier.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("subject"), F.col("s_name").alias("name"), F.array(F.lit("root"), "r_name", "n_name").alias("lineage"))
    s = t.lineitem.where("l_suppkey % 4 > 0 and l_returnflag = 'R'").select(F.col("l_suppkey").alias("subject"), (F.col("l_partkey") % 400).alias("snp")).distinct()
    m = t.lineitem.where("l_suppkey % 3 > 0").groupBy(F.col("l_suppkey").alias("subject"), F.concat(F.lit("D"), (F.col("l_partkey") % 25).cast("string")).alias("marker")).agg((F.max("l_quantity").cast("int") % 4).alias("value"))
    got = rp.ranked_matches(p.where("subject % 100 = 1"), p, s, m)
    return got.withColumn("snp_years", rounded(F.col("snp_years"), 2)).withColumn("str_years", rounded(F.col("str_years"), 2))


_CHART = """WITH v AS (SELECT l_suppkey AS subject, l_partkey % 12 AS marker, max(CAST(l_quantity AS BIGINT)) AS value FROM lineitem GROUP BY 1, 2), g AS (SELECT s_suppkey AS subject, CASE WHEN s_suppkey % 5 > 0 THEN n_name END AS h FROM supplier JOIN nation ON n_nationkey = s_nationkey), o AS (SELECT n_name AS h, n_nationkey * 7 % 25 AS rank, n_regionkey AS depth FROM nation WHERE n_nationkey % 6 > 0),
n AS (SELECT h, marker, value, count(*) AS n FROM v JOIN g USING (subject) GROUP BY 1, 2, 3), s AS (SELECT h, marker, min(value) AS low, max(value) AS high, arg_max(value, (n, -value)) AS mode, CAST(sum(n) AS BIGINT) AS members FROM n GROUP BY 1, 2),
pl AS (SELECT h, rank, depth, CAST(row_number() OVER (ORDER BY CASE WHEN h IS NULL THEN 0 WHEN rank IS NOT NULL THEN 1 ELSE 2 END, rank NULLS FIRST, h) AS INTEGER) AS place FROM (SELECT DISTINCT h FROM g) LEFT JOIN o USING (h))"""


def _chart(t: Tables):
    v = t.lineitem.groupBy(F.col("l_suppkey").alias("subject"), (F.col("l_partkey") % 12).alias("marker")).agg(F.max(F.col("l_quantity").cast("long")).alias("value"))
    g = t.supplier.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("subject"), F.when(F.col("s_suppkey") % 5 > 0, F.col("n_name")).alias("haplogroup"))
    o = t.nation.where("n_nationkey % 6 > 0").select(F.col("n_name").alias("haplogroup"), (F.col("n_nationkey") * 7 % 25).alias("rank"), F.col("n_regionkey").alias("depth"))
    return v, g, rp.marker_chart(v, g, o)


@query(_CHART + " SELECT s.h AS haplogroup, place, coalesce(depth, 0) AS depth, marker, low, high, mode, members FROM s JOIN pl ON pl.h IS NOT DISTINCT FROM s.h")
def marker_chart(t: Tables) -> DataFrame:
    return _chart(t)[2]


@query(_CHART + " SELECT v.subject, v.marker, CASE WHEN value < mode THEN 'Below' WHEN value > mode THEN 'Above' END AS deviation FROM v JOIN g USING (subject) JOIN s ON s.h IS NOT DISTINCT FROM g.h AND s.marker = v.marker")
def marker_deviations(t: Tables) -> DataFrame:
    v, g, chart = _chart(t)
    return rp.deviations(v, chart, g)


@query(
    f"""WITH {_ART} SELECT 'private-y' AS chore, count(*) FILTER (o_orderkey NOT IN (SELECT alignment FROM art WHERE kind = 'coverage' AND version = '1')) AS due, count(*) AS total FROM orders
UNION ALL SELECT 'stale-tree', count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW') OR c_mktsegment = 'MACHINERY'), count(*) FROM customer"""
)
def maintenance_survey(t: Tables) -> DataFrame:
    al = t.orders.select(F.col("o_orderkey").alias("alignment"))
    done = _artifacts(t).where("kind = 'coverage' and version = '1'")
    subjects = t.customer.select(F.col("c_custkey").alias("subject"))
    calls = t.orders.select(F.col("o_custkey").alias("subject"), F.when(F.col("o_orderpriority") == "5-LOW", "old").otherwise("new").alias("tree"))
    consensus = t.customer.select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("label"))
    nodes = t.customer.where("c_mktsegment <> 'MACHINERY'").select(F.lower("c_mktsegment").alias("name")).distinct()
    stale = rp.stale_placements(calls, consensus, nodes, "new")
    return rp.maintenance_survey({"private-y": (al, done, "alignment"), "stale-tree": (subjects, subjects.join(stale, "subject", "left_anti"), "subject")})


@query("SELECT c_custkey AS subject FROM customer WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment < 'F')")
def off_tree_subjects(t: Tables) -> DataFrame:
    consensus = t.customer.select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("label"))
    nodes = t.customer.where("c_custkey % 2 = 0 and c_mktsegment < 'F'").select(F.col("c_mktsegment").alias("name"))
    return rp.off_tree_subjects(consensus, nodes)


@query(
    """SELECT c_custkey AS subject, c_name AS ancestor FROM customer c WHERE (c_custkey % 4 = 0 OR EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND l_returnflag = 'A')) AND NOT (c_custkey % 3 = 0 AND c_acctbal < 5000)"""
)
def publishable_ancestors(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    ancestors = t.customer.select(c.alias("subject"), F.col("c_name").alias("ancestor"))
    runs = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("run"))
    members = t.customer.where("c_custkey % 3 = 0").select(c.alias("subject"), F.when(F.col("c_acctbal") >= 5000, True).alias("shares"))
    return rp.publishable_ancestors(ancestors, t.customer.where("c_custkey % 4 = 0").select(c.alias("subject")), runs, t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("run")), members)


@query("SELECT o_orderkey AS request, o_orderstatus AS status, o_orderpriority = '1-URGENT' AS attested, cm AS result_cm FROM orders LEFT JOIN (SELECT l_orderkey, max(l_partkey) AS cm FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r ON r.l_orderkey = o_orderkey")
def matching_ledger(t: Tables) -> DataFrame:
    requests = t.orders.select(F.col("o_orderkey").alias("request"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate")).alias("attested_at"))
    results = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("request")).agg(F.max("l_partkey").alias("total_cm"))
    return rp.ledger(requests, results).select("request", "status", "attested", "result_cm")


@query(
    """WITH a AS (SELECT o_custkey AS subject, o_orderkey AS alignment, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 1 END AS b, floor(o_totalprice / 20000) AS d, o_orderkey % 3 > 0 AS f, o_orderkey % 4 = 0 AS x FROM orders)
SELECT subject, alignment FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY b DESC, d DESC, f DESC, x DESC, alignment) AS r FROM a) WHERE r = 1"""
)
def default_alignment(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    label = F.when(p == "1-URGENT", "WGS").when(p == "2-HIGH", "BIG_Y_700").when(p == "3-MEDIUM", "WES").when(p == "5-LOW", "mtFull results").otherwise("unknown")
    o = F.col("o_orderkey")
    a = t.orders.select(F.col("o_custkey").alias("subject"), o.alias("alignment"), rp.breadth_rank(rules.test_target(label)).alias("breadth"), F.floor(F.col("o_totalprice") / 20000).alias("depth"), (o % 3 > 0).alias("has_file"), (o % 4 == 0).alias("derived"))
    return rp.default_alignment(a, ["subject"])


@query(
    """WITH r AS (SELECT o_custkey AS subject, o_orderkey % 9 AS source, CAST(floor(o_totalprice) AS BIGINT) AS snps, o_orderpriority AS top, CASE WHEN o_orderstatus = 'P' THEN 'FINE_ADMIXTURE' ELSE 'ADMIXTURE' END AS method FROM orders)
SELECT subject, source, snps, top FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY source = 0 DESC, snps DESC, source DESC) AS r FROM r WHERE method = 'ADMIXTURE') WHERE r = 1"""
)
def donor_ancestry(t: Tables) -> DataFrame:
    r = t.orders.select(F.col("o_custkey").alias("subject"), (F.col("o_orderkey") % 9).alias("source"), F.floor("o_totalprice").alias("snps"), F.col("o_orderpriority").alias("top"), F.when(F.col("o_orderstatus") == "P", "FINE_ADMIXTURE").otherwise("ADMIXTURE").alias("method"))
    return rp.donor_ancestry(r, ["subject"])


@query(
    """WITH a AS (SELECT c_nationkey AS project, CASE o_orderkey % 6 WHEN 0 THEN 'GRCh38' WHEN 1 THEN 'GRCh38' WHEN 2 THEN 'GRCh37' WHEN 3 THEN 'chm13v2.0' WHEN 4 THEN 'chm13v2.0' END AS build FROM orders JOIN customer ON c_custkey = o_custkey), n AS (SELECT project, build, count(*) AS n FROM a WHERE build IS NOT NULL GROUP BY 1, 2)
SELECT project, arg_max(build, (n, build)) AS build, CAST(sum(n) AS BIGINT) AS votes FROM n GROUP BY 1"""
)
def build_vote(t: Tables) -> DataFrame:
    name = F.get(F.array(*map(F.lit, ("hg38", "GRCh38", "b37", "hs1", "T2T", "mm10"))), (F.col("o_orderkey") % 6).cast("int"))
    a = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("project"), rules.canonical_build(name).alias("build"))
    return rp.build_vote(a, ["project"])


@query("WITH c AS (SELECT l_suppkey AS subject, l_partkey % 100 AS pos, l_orderkey AS alignment, CAST(max(l_quantity) AS BIGINT) AS depth, max(l_returnflag) AS alt FROM lineitem GROUP BY 1, 2, 3) SELECT subject, pos, alignment, depth, alt FROM (SELECT *, row_number() OVER (PARTITION BY subject, pos ORDER BY depth DESC, alignment) AS r FROM c) WHERE r = 1")
def donor_private_variants(t: Tables) -> DataFrame:
    c = t.lineitem.groupBy(F.col("l_suppkey").alias("subject"), (F.col("l_partkey") % 100).alias("pos"), F.col("l_orderkey").alias("alignment")).agg(F.max("l_quantity").cast("long").alias("depth"), F.max("l_returnflag").alias("alt"))
    return rp.donor_private(c, ["subject"])


@query(
    """WITH o AS (SELECT l_suppkey AS subject, l_orderkey * 10000000000 + CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS seq, CASE WHEN l_partkey % 3 = 0 THEN ' ' ELSE 'm' || (l_partkey % 40) END AS name, l_partkey AS pos, l_returnflag AS source, l_linestatus AS base, substr('ACGT', CAST(l_orderkey % 4 + 1 AS BIGINT), 1) AS anc, substr('ACGT', CAST((l_orderkey + 1) % 4 + 1 AS BIGINT), 1) AS der FROM lineitem),
g AS (SELECT *, CASE WHEN trim(name) = '' THEN '@' || pos ELSE upper(trim(name)) END AS grp FROM o)
SELECT subject, grp AS "group", arg_min(name, (trim(name) = '', seq)) AS name, arg_min(pos, (trim(name) = '', seq)) AS pos, arg_min(anc, (trim(name) = '', seq)) AS ancestral, arg_min(der, (trim(name) = '', seq)) AS derived, string_agg(source || ':' || base, ',' ORDER BY seq, source, base) AS sources FROM g GROUP BY 1, 2"""
)
def observed_profile(t: Tables) -> DataFrame:
    letter = lambda x: F.substring(F.lit("ACGT"), (x % 4 + 1).cast("int"), F.lit(1))
    p, o = F.col("l_partkey"), F.col("l_orderkey")
    obs = t.lineitem.select(F.col("l_suppkey").alias("subject"), (o * 10_000_000_000 + F.col("l_linenumber").cast("long") * 1_000_000_000 + p * 1000 + F.col("l_suppkey") % 1000).alias("seq"), F.when(p % 3 == 0, " ").otherwise(F.concat(F.lit("m"), (p % 40).cast("string"))).alias("name"), p.alias("pos"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("base"), letter(o).alias("ancestral"), letter(o + 1).alias("derived"))
    return rp.observed_profile(obs, ["subject"]).withColumn("sources", F.array_join("sources", ","))


@query(
    """WITH m AS (SELECT o_custkey AS subject, o_orderkey % 16569 + 1 AS pos, (o_orderkey % 16569 + 1) || 'A>G' AS note FROM orders), f AS (SELECT subject, count(*) AS total, count(*) FILTER (pos BETWEEN 16024 AND 16383) AS hvr1, count(*) FILTER (pos BETWEEN 57 AND 372) AS hvr2, count(*) FILTER (pos NOT BETWEEN 16024 AND 16383 AND pos NOT BETWEEN 57 AND 372) AS coding, array_to_string(list(note ORDER BY pos, note)[1:5], ',') AS examples FROM m GROUP BY 1),
s AS (SELECT o_custkey AS subject, max(o_orderstatus) AS sex FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1) SELECT c_custkey AS subject, sex, total, hvr1, hvr2, coding, examples FROM customer LEFT JOIN f ON f.subject = c_custkey LEFT JOIN s ON s.subject = c_custkey"""
)
def fact_sheets(t: Tables) -> DataFrame:
    pos = F.col("o_orderkey") % 16569 + 1
    m = t.orders.select(F.col("o_custkey").alias("subject"), pos.alias("pos"), F.concat(pos.cast("string"), F.lit("A>G")).alias("note"))
    sex = t.orders.where("o_orderstatus <> 'O'").groupBy(F.col("o_custkey").alias("subject")).agg(F.max("o_orderstatus").alias("sex"))
    s = rp.fact_sheet(t.customer.select(F.col("c_custkey").alias("subject")), {"mt": rp.mt_regions(m, ["subject"]), "who": sex})
    return s.select("subject", "who.sex", "mt.*")


@query(
    f"""WITH {_ART}, st AS (SELECT alignment, kind, max(payload) AS payload, max(completeness) AS completeness FROM art WHERE l_linenumber <= 3 GROUP BY 1, 2), nw AS (SELECT alignment, kind, max(payload) AS payload, max(completeness) AS completeness FROM art WHERE l_linenumber > 3 GROUP BY 1, 2),
u AS (SELECT *, 0 AS n FROM st UNION ALL SELECT *, 1 FROM nw) SELECT alignment, kind, payload, completeness FROM (SELECT *, row_number() OVER (PARTITION BY alignment, kind ORDER BY CASE completeness WHEN 'full' THEN 2 ELSE 1 END DESC, n DESC) AS r FROM u) WHERE r = 1"""
)
def keep_fuller_artifact(t: Tables) -> DataFrame:
    g = lambda d: d.groupBy("alignment", "kind").agg(F.max("payload").alias("payload"), F.max("completeness").alias("completeness"))
    a = _artifacts(t)
    return rp.keep_fuller(g(a.where("l_linenumber <= 3")), g(a.where("l_linenumber > 3")), ["alignment", "kind"])


_MERGE = "WITH m AS (SELECT o_orderkey AS secondary, min(p) AS p FROM (SELECT o_custkey, o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS p FROM orders WHERE o_orderstatus = 'F') WHERE p <> o_orderkey GROUP BY 1)"


def _merged(t: Tables):
    o = t.orders.select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("run"), "o_orderstatus")
    al = t.lineitem.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("alignment"))
    first = o.where("o_orderstatus = 'F'").groupBy("subject").agg(F.min("run").alias("primary"))
    wanted = o.where("o_orderstatus = 'F'").select("subject", F.col("run").alias("secondary")).join(first, "subject")
    bad = wanted.select((F.col("subject") + 1).alias("subject"), "primary", "secondary")
    return rp.merge_runs(o.select("subject", "run"), al, wanted.select("subject", "primary", "secondary").union(bad))


@query(_MERGE + " SELECT coalesce(p, l_orderkey) AS run, l_linenumber AS alignment FROM lineitem LEFT JOIN m ON m.secondary = l_orderkey")
def merge_runs(t: Tables) -> DataFrame:
    return _merged(t)[1]


@query(_MERGE + " SELECT o_custkey AS subject, o_orderkey AS run FROM orders WHERE o_orderkey NOT IN (SELECT secondary FROM m)")
def merge_runs_left(t: Tables) -> DataFrame:
    return _merged(t)[0]


_FILL = "WITH r AS (SELECT o_orderkey AS run, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS read_type, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS bases FROM orders), g AS (SELECT l_orderkey AS run, l_linenumber AS o, max(l_returnflag) FILTER (l_returnflag <> 'N') AS rt, max(l_partkey) FILTER (l_partkey % 2 = 0) AS b FROM lineitem GROUP BY 1, 2), f AS (SELECT run, arg_min(rt, o) FILTER (rt IS NOT NULL) AS rt, arg_min(b, o) FILTER (b IS NOT NULL) AS b FROM g GROUP BY 1)"


def _filled(t: Tables):
    r = t.orders.select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("read_type"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("bases"))
    f = t.lineitem.groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("order")).agg(F.max(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))).alias("read_type"), F.max(F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey"))).alias("bases"))
    return rp.backfill(r, f, ["run"], ["read_type", "bases"])


@query(_FILL + " SELECT r.run, coalesce(read_type, rt) AS read_type, coalesce(bases, b) AS bases FROM r LEFT JOIN f ON f.run = r.run")
def profile_backfill(t: Tables) -> DataFrame:
    return _filled(t)[0]


@query(_FILL + " SELECT count(*) AS examined, count(*) FILTER (read_type IS NULL AND rt IS NOT NULL) AS read_type_filled, count(*) FILTER (bases IS NULL AND b IS NOT NULL) AS bases_filled FROM r LEFT JOIN f ON f.run = r.run")
def profile_backfill_counts(t: Tables) -> DataFrame:
    return _filled(t)[1]


@query("SELECT user_id, event_id, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM events) WHERE place <= 5")
def recent_history(t: Tables) -> DataFrame:
    return rp.recent(t.events, ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id", "place")


@query("SELECT user_id, value FROM (SELECT user_id, CASE WHEN event_type <> 'error' THEN event_type END AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND value IS NOT NULL")
def current_overrides(t: Tables) -> DataFrame:
    log = t.events.select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"))
    return rp.current_overrides(log, ["user_id"], "event_id")


@query("SELECT conv_id, turn, 100 + conv_id % 7 + row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS seq FROM conversations")
def sequence_allocation(t: Tables) -> DataFrame:
    c = t.conversations
    return rp.allocate_sequence(c, c.select("conv_id").distinct().withColumn("next_seq", 100 + F.col("conv_id") % 7), "conv_id", ["turn", "role", "text"]).select("conv_id", "turn", "seq")


@query("SELECT c.conv_id, coalesce(max(turn) FILTER (role = 'assistant'), c.conv_id % 3) AS last_read FROM conversations c GROUP BY c.conv_id")
def last_read_marks(t: Tables) -> DataFrame:
    m = t.conversations.select("conv_id", F.col("turn").alias("seq"), F.when(F.col("role") == "assistant", "partner").otherwise("me").alias("sender"))
    return rp.last_read(m.select("conv_id").distinct().withColumn("last_read", F.col("conv_id") % 3), m, "conv_id")


_CAT = """WITH f AS (SELECT DISTINCT o_custkey AS subject, 'N' || o_orderkey % 3 AS namespace, CASE WHEN o_orderkey % 5 = 0 THEN 'S' || (o_custkey // 2) ELSE 'V' || o_custkey END AS value FROM orders), s AS (SELECT c_custkey AS subject, 'N1' AS namespace, 'V' || c_custkey AS value FROM customer WHERE c_custkey % 2 = 0),
k AS (SELECT namespace, value, count(DISTINCT subject) AS n FROM (SELECT * FROM f UNION SELECT * FROM s) GROUP BY 1, 2), m AS (SELECT * FROM f EXCEPT SELECT * FROM s), a AS (SELECT m.* FROM m JOIN k ON k.namespace = m.namespace AND k.value = m.value WHERE n = 1)"""


def _catalogue(t: Tables):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    f = t.orders.select(c.alias("subject"), F.concat(F.lit("N"), (o % 3).cast("string")).alias("namespace"), F.when(o % 5 == 0, F.concat(F.lit("S"), F.floor(c / 2).cast("string"))).otherwise(F.concat(F.lit("V"), c.cast("string"))).alias("value"))
    s = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("subject"), F.lit("N1").alias("namespace"), F.concat(F.lit("V"), F.col("c_custkey").cast("string")).alias("value"))
    return rp.catalogue_backfill(t.customer.select(F.col("c_custkey").alias("subject")), f, s)


@query(_CAT + " SELECT subject, namespace, value FROM a")
def catalogue_backfill(t: Tables) -> DataFrame:
    return _catalogue(t)[0].select("subject", "namespace", "value")


@query(_CAT + " SELECT (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM m) AS missing, (SELECT count(*) FROM a) AS added, (SELECT count(*) FROM m) - (SELECT count(*) FROM a) AS conflicts")
def catalogue_backfill_counts(t: Tables) -> DataFrame:
    return _catalogue(t)[1]


@query(
    """WITH s AS (SELECT o_custkey AS kit, o_orderkey AS subject, (o_orderkey % 10) / 10.0 AS score FROM orders), b AS (SELECT kit, subject FROM (SELECT *, row_number() OVER (PARTITION BY kit ORDER BY score DESC, subject) AS r FROM s WHERE score >= 0.6) WHERE r = 1)
SELECT c_custkey AS kit, CASE WHEN c_custkey % 3 = 0 THEN 'Exact' WHEN b.subject IS NOT NULL THEN 'Fuzzy' ELSE 'Create' END AS action, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 7 ELSE b.subject END AS subject FROM customer LEFT JOIN b ON b.kit = c_custkey"""
)
def import_plan(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    subjects = t.customer.where("c_custkey % 3 = 0").select(c.alias("external"), (c * 7).alias("subject"))
    scores = t.orders.select(F.col("o_custkey").alias("kit"), F.col("o_orderkey").alias("subject"), (F.col("o_orderkey") % 10 / 10.0).alias("score"))
    return rp.import_plan(t.customer.select(c.alias("kit")), subjects, scores)


@query(f"WITH {_ART} SELECT o_orderkey AS sample, kind FROM orders, (VALUES ('coverage'), ('sex')) k(kind) WHERE (o_orderkey, kind) NOT IN (SELECT alignment, kind FROM art WHERE version = '1')")
def due_analyses(t: Tables) -> DataFrame:
    a = _artifacts(t).select(F.col("alignment").alias("sample"), "kind", "version")
    return rp.due_analyses(t.orders.select(F.col("o_orderkey").alias("sample")), a, {"coverage": "1", "sex": "1"})


@query("SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def missing_files(t: Tables) -> DataFrame:
    files = t.pages.select("page_id", F.col("url").alias("path"))
    return rp.missing_files(files, files.where("page_id % 3 = 0")).select("page_id")


@query(
    """WITH s AS (SELECT DISTINCT l_suppkey % 30 AS family, l_linenumber AS name, l_partkey % 9 AS item FROM lineitem WHERE l_partkey % 9 < l_linenumber OR l_suppkey % 30 > 20), z AS (SELECT family, name, count(*) AS n FROM s GROUP BY 1, 2), x AS (SELECT a.family, a.name AS a, b.name AS b, count(*) AS c FROM s a JOIN s b ON a.family = b.family AND a.item = b.item AND a.name < b.name GROUP BY 1, 2, 3),
k AS (SELECT x.family, count(*) AS crossing FROM x JOIN z p ON p.family = x.family AND p.name = a JOIN z q ON q.family = x.family AND q.name = b WHERE c < p.n AND c < q.n GROUP BY 1) SELECT f.family, coalesce(crossing, 0) AS crossing, crossing IS NULL AS laminar FROM (SELECT DISTINCT family FROM s) f LEFT JOIN k ON k.family = f.family"""
)
def laminar_families(t: Tables) -> DataFrame:
    s = t.lineitem.where("l_partkey % 9 < l_linenumber or l_suppkey % 30 > 20").select((F.col("l_suppkey") % 30).alias("family"), F.col("l_linenumber").alias("name"), (F.col("l_partkey") % 9).alias("item"))
    return rp.laminar_family(s, "family", "name", "item")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'changed' ELSE c_mktsegment END AS value FROM customer WHERE c_custkey % 7 > 0 UNION ALL SELECT -1, 'new'")
def entity_store(t: Tables) -> DataFrame:
    """Rows created, created again, changed and deleted in a table of versions."""
    e = rp.Entities(t.spark, scratch_path(t.spark, "entities"), "c_custkey long, value string", "c_custkey")
    c = t.customer
    e.create(c.select("c_custkey", F.col("c_mktsegment").alias("value")))
    e.create(c.select("c_custkey", F.lit("ignored").alias("value")).union(t.spark.createDataFrame([(-1, "new")], "c_custkey long, value string")))
    e.upsert(c.where("c_custkey % 5 = 0").select("c_custkey", F.lit("changed").alias("value")))
    return e.delete(c.where("c_custkey % 7 = 0").select("c_custkey"))
