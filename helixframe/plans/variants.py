"""Variants without a site list, archaic markers and deep ancestry on the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators import archaic as ar
from helixframe.operators import denovo as dn
from helixframe.plans.catalog import Tables, query, rounded


def _letter(x):
    return F.substring(F.lit("ACGT"), (x % 4 + 1).cast("int"), F.lit(1))


_SQL_LETTER = "substr('ACGT', CAST(({}) % 4 + 1 AS BIGINT), 1)"
_TALLY = f"""WITH obs AS (SELECT l_linestatus AS contig, l_partkey AS pos, CASE WHEN l_linenumber % 6 = 0 AND l_partkey % 3 = 0 THEN {_SQL_LETTER.format('l_partkey + 1 + l_suppkey % 2')} WHEN l_partkey % 7 = 0 AND l_suppkey % 2 = 0 THEN {_SQL_LETTER.format('l_partkey + 2')} ELSE {_SQL_LETTER.format('l_partkey')} END AS base, CAST(l_quantity AS INTEGER) AS baseq FROM lineitem),
tally AS (SELECT contig, pos, base, count(*) AS n FROM obs GROUP BY 1, 2, 3), ref AS (SELECT contig, p_partkey AS pos, CASE WHEN p_partkey % 17 = 0 THEN 'N' WHEN p_partkey % 5 = 0 THEN {_SQL_LETTER.format('p_partkey + 1')} ELSE {_SQL_LETTER.format('p_partkey')} END AS ref FROM part, (VALUES ('F'), ('O')) v(contig))"""


def _observed(t: Tables) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    base = F.when((F.col("l_linenumber") % 6 == 0) & (p % 3 == 0), _letter(p + 1 + s % 2)).when((p % 7 == 0) & (s % 2 == 0), _letter(p + 2)).otherwise(_letter(p))
    return t.lineitem.select(F.col("l_linestatus").alias("contig"), p.alias("pos"), base.alias("base"), F.col("l_quantity").cast("int").alias("baseq"))


def _tally(t: Tables) -> DataFrame:
    return _observed(t).groupBy("contig", "pos", "base").agg(F.count("*").alias("n"))


def _reference(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    ref = F.when(p % 17 == 0, "N").when(p % 5 == 0, _letter(p + 1)).otherwise(_letter(p))
    return t.part.select(F.explode(F.array(F.lit("F"), F.lit("O"))).alias("contig"), p.alias("pos"), ref.alias("ref"))


_HAPLOID = (
    _TALLY
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY n DESC, base) AS k, CAST(sum(n) OVER (PARTITION BY contig, pos) AS BIGINT) AS depth FROM tally),
two AS (SELECT contig, pos, max(depth) AS depth, max(base) FILTER (k = 1) AS top, max(n) FILTER (k = 1) AS n1, coalesce(max(n) FILTER (k = 2), 0) AS n2 FROM r GROUP BY 1, 2),
calls AS (SELECT t.contig, t.pos, ref, top AS alt, depth, n1 AS alt_depth, floor(n1 / depth * 10000 + 0.5) / 10000 AS af FROM two t JOIN ref USING (contig, pos) WHERE depth >= 4 AND n1 >= 0.5 * depth AND NOT (n2 >= 2 AND n2 > 0.2 * depth) AND ref <> 'N' AND top <> ref)"""
)


@query(_HAPLOID + " SELECT * FROM calls")
def denovo_haploid(t: Tables) -> DataFrame:
    return dn.haploid_variants(_tally(t), _reference(t)).withColumn("af", rounded(F.col("af")))


@query(_HAPLOID + " SELECT * FROM calls WHERE contig = 'O' AND pos BETWEEN 50 AND 150")
def denovo_region(t: Tables) -> DataFrame:
    """Calls of one stretch: the region is the feature."""
    return dn.in_region(dn.haploid_variants(_tally(t), _reference(t)).withColumn("af", rounded(F.col("af"))), "O", 50, 150)


@query(
    _TALLY
    + """, j AS (SELECT t.contig, t.pos, ref, base, n, CAST(sum(n) OVER (PARTITION BY t.contig, t.pos) AS BIGINT) AS depth FROM tally t JOIN ref USING (contig, pos) WHERE ref <> 'N'), s AS (SELECT contig, pos, ref, depth, coalesce(max(n) FILTER (base = ref), 0) AS r FROM j WHERE depth >= 4 GROUP BY 1, 2, 3, 4),
a AS (SELECT contig, pos, 0 AS k, ref AS base, r AS n FROM s UNION ALL SELECT contig, pos, row_number() OVER (PARTITION BY contig, pos ORDER BY n DESC, base), base, n FROM j WHERE base <> ref AND n >= 2 AND depth >= 4),
u AS (SELECT contig, pos, CAST(sum(n) AS BIGINT) AS used, max(k) AS top FROM a GROUP BY 1, 2 HAVING max(k) > 0 AND sum(n) >= 4),
p AS (SELECT u.contig, u.pos, x.k AS i, y.k AS j, CASE WHEN x.k = y.k THEN x.n * log10(1 - 0.001) + (used - x.n) * log10(0.001::DOUBLE / 3) ELSE (x.n + y.n) * log10((1 - 0.001::DOUBLE) / 2 + 0.001::DOUBLE / 6) + (used - x.n - y.n) * log10(0.001::DOUBLE / 3) END AS ll FROM u JOIN a x ON x.contig = u.contig AND x.pos = u.pos JOIN a y ON y.contig = u.contig AND y.pos = u.pos AND x.k <= y.k),
l AS (SELECT *, CAST(least(floor(-10 * (ll - max(ll) OVER (PARTITION BY contig, pos)) + 0.5), 255) AS INTEGER) AS pl FROM p), g AS (SELECT contig, pos, arg_min(i, (j, i)) FILTER (pl = 0) AS i, arg_min(j, (j, i)) FILTER (pl = 0) AS j, least(list_sort(list(pl))[2], 99) AS gq FROM l GROUP BY 1, 2)
SELECT g.contig, g.pos, ref, (SELECT string_agg(base, ',' ORDER BY k) FROM a WHERE a.contig = g.contig AND a.pos = g.pos AND k > 0) AS alt, i || '/' || j AS gt, CAST(i > 0 AS INTEGER) + CAST(j > 0 AS INTEGER) AS dosage, gq, depth, r AS ref_depth, used - r AS alt_depth FROM g JOIN u USING (contig, pos) JOIN s USING (contig, pos) WHERE j > 0"""
)
def denovo_diploid(t: Tables) -> DataFrame:
    return dn.diploid_variants(_tally(t), _reference(t))


_CIG = "SELECT l_orderkey * 10000000000 + CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS read, l_returnflag AS contig, l_partkey AS pos, 5 + CAST(l_quantity AS BIGINT) % 7 AS lead, 1 + l_suppkey % 3 AS len, CASE WHEN l_linenumber % 2 = 0 THEN 'I' ELSE 'D' END AS kind FROM lineitem"


def _reads(t: Tables) -> DataFrame:
    lead, n = 5 + F.col("l_quantity").cast("long") % 7, 1 + F.col("l_suppkey") % 3
    kind = F.when(F.col("l_linenumber") % 2 == 0, "I").otherwise("D")
    cigar = F.concat(lead.cast("string"), F.lit("M"), n.cast("string"), kind, F.lit("6M"))
    return t.lineitem.select((F.col("l_orderkey").cast("long") * 10_000_000_000 + F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("read"), F.col("l_returnflag").alias("contig"), F.col("l_partkey").alias("pos"), cigar.alias("cigar"), F.lit("ACGTTGCAACGTTGCAACGTTGCA").alias("seq"))


@query(f"SELECT read, contig, pos + lead AS anchor, kind, CAST(len AS INTEGER) AS length, CASE WHEN kind = 'I' THEN substr('ACGTTGCAACGTTGCAACGTTGCA', lead + 1, len) END AS bases FROM ({_CIG})")
def indel_events(t: Tables) -> DataFrame:
    return dn.indel_events(_reads(t)).select("read", "contig", "anchor", "kind", "length", "bases")


@query(
    f"""WITH x AS ({_CIG}), e AS (SELECT contig, pos + lead AS pos, count(*) AS reads FROM x GROUP BY 1, 2), w AS (SELECT contig, greatest(pos - 3, 1) AS s, pos + 3 AS e FROM e WHERE reads >= 8 AND pos % 40 = 0),
b AS (SELECT *, max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w), i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY s, e) AS isle FROM b)
SELECT contig, min(s) AS start, max(e) AS "end" FROM i GROUP BY contig, isle"""
)
def active_windows(t: Tables) -> DataFrame:
    e = dn.indel_events(_reads(t)).groupBy("contig", F.col("anchor").alias("pos")).agg(F.count("*").alias("reads"))
    return dn.active_windows(e.where("pos % 40 = 0"), 8, 3)


@query(
    f"""WITH x AS (SELECT * REPLACE ('k' || (read // 10000000000) % 500 AS contig) FROM ({_CIG})), ev AS (SELECT read, contig, pos + lead AS anchor, kind, len, CASE WHEN kind = 'I' THEN substr('ACGTTGCAACGTTGCAACGTTGCA', lead + 1, len) END AS bases, pos AS s, pos + lead + CASE WHEN kind = 'D' THEN len ELSE 0 END + 5 AS e FROM x),
tg AS (SELECT 'k' || c AS contig, p_partkey AS pos, p_partkey + 1 AS anchor, 'D' AS kind, 1 + p_size % 3 AS len FROM part, range(500) v(c)),
j AS (SELECT tg.contig, tg.pos, ev.anchor = tg.anchor AND ev.kind = 'D' AND ev.len = tg.len AS hit, ev.anchor = tg.anchor AS here, ev.e >= tg.pos + tg.len AS reach FROM tg JOIN ev ON ev.contig = tg.contig AND tg.pos BETWEEN ev.s AND ev.e),
g AS (SELECT contig, pos, count(*) FILTER (hit) AS matched, count(*) FILTER (NOT here AND reach) AS spanning FROM j GROUP BY 1, 2) SELECT * FROM g WHERE matched + spanning >= 1 AND matched > spanning AND matched >= 0.5 * (matched + spanning)"""
)
def indel_confirm(t: Tables) -> DataFrame:
    ev = dn.indel_events(_reads(t).withColumn("contig", F.concat(F.lit("k"), (F.expr("read div 10000000000") % 500).cast("string"))))
    spans = ev.select("read", "contig", F.col("pos").alias("start"), (F.col("anchor") + F.when(F.col("kind") == "D", F.col("length")).otherwise(0) + 5).alias("end"))
    # A part is a target on each of 500 contigs; those with an event at their anchor alone can be confirmed, so sites meet
    # parts before contigs are named: not every part is written out 500 times.
    p, sites = F.col("p_partkey"), ev.where("kind = 'D'").select("contig", F.col("anchor").alias("anchor")).distinct()
    targets = sites.join(t.part, p + 1 == F.col("anchor")).select("contig", p.alias("pos"), "anchor", F.lit("D").alias("kind"), (1 + F.col("p_size") % 3).alias("length"), F.lit(None).cast("string").alias("bases"))
    return dn.confirm_indels(targets, spans, ev.select("read", "contig", "anchor", "kind", "length", "bases"), 1)


@query(
    """WITH r AS (SELECT l_linenumber + CASE WHEN l_returnflag = 'R' THEN 256 ELSE 0 END AS flags, CAST(l_quantity AS BIGINT) AS length, l_partkey * 100 - l_suppkey AS tlen, l_orderkey, l_linenumber FROM lineitem), f AS (SELECT * FROM r WHERE flags & 4 = 0 AND flags & 256 = 0 AND flags & 2048 = 0 AND length > 0 ORDER BY l_orderkey, l_linenumber LIMIT 50000)
SELECT count(*) AS reads, floor(avg(length) * 10000 + 0.5) / 10000 AS read_length, floor(coalesce(avg(abs(tlen)) FILTER (flags & 2 <> 0 AND abs(tlen) > 0 AND abs(tlen) < 100000), avg(length)) * 10000 + 0.5) / 10000 AS fragment_length FROM f"""
)
def molecule_lengths(t: Tables) -> DataFrame:
    flags = F.col("l_linenumber") + F.when(F.col("l_returnflag") == "R", 256).otherwise(0)
    r = t.lineitem.select(flags.alias("flags"), F.col("l_quantity").cast("long").alias("length"), (F.col("l_partkey") * 100 - F.col("l_suppkey")).alias("tlen"), "l_orderkey", "l_linenumber")
    m = dn.molecule_lengths(r, ["l_orderkey", "l_linenumber"])
    return m.select("reads", rounded(F.col("read_length")).alias("read_length"), rounded(F.col("fragment_length")).alias("fragment_length"))


@query(
    _TALLY
    + f""", pn AS (SELECT contig, p_partkey AS pos, {_SQL_LETTER.format('p_partkey')} AS ref, {_SQL_LETTER.format('p_partkey + 2')} AS alt FROM part, (VALUES ('F'), ('O'), ('X')) v(contig)), o AS (SELECT p.contig, p.pos, base = alt AS a, CASE WHEN base = ref THEN 1 - e ELSE e / 3 END AS pr, CASE WHEN base = alt THEN 1 - e ELSE e / 3 END AS pa FROM pn p JOIN (SELECT *, pow(10.0, -baseq / 10.0) AS e FROM obs) x ON x.contig = p.contig AND x.pos = p.pos),
l AS (SELECT contig, pos, count(*) AS depth, count(*) FILTER (a) AS alt_depth, sum(log10(greatest(pr, 1e-300))) AS l0, sum(log10(greatest((pr + pa) / 2, 1e-300))) AS l1, sum(log10(greatest(pa, 1e-300))) AS l2 FROM o GROUP BY 1, 2),
q AS (SELECT *, [CAST(least(floor(-10 * (l0 - greatest(l0, l1, l2)) + 0.5), 255) AS INTEGER), CAST(least(floor(-10 * (l1 - greatest(l0, l1, l2)) + 0.5), 255) AS INTEGER), CAST(least(floor(-10 * (l2 - greatest(l0, l1, l2)) + 0.5), 255) AS INTEGER)] AS pl FROM l)
SELECT p.contig, p.pos, CASE WHEN depth >= 4 THEN CASE WHEN pl[1] = 0 THEN 0 WHEN pl[2] = 0 THEN 1 ELSE 2 END ELSE -1 END AS dosage, CASE WHEN depth >= 4 THEN least(list_sort(pl)[2], 99) ELSE 0 END AS gq, coalesce(depth, 0) AS depth, coalesce(alt_depth, 0) AS alt_depth FROM pn p LEFT JOIN q ON q.contig = p.contig AND q.pos = p.pos"""
)
def panel_genotypes(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    panel = t.part.select(F.explode(F.array(*map(F.lit, "FOX"))).alias("contig"), p.alias("pos"), _letter(p).alias("ref"), _letter(p + 2).alias("alt"))
    return dn.panel_genotypes(panel, _observed(t))


@query(
    """WITH c AS (SELECT l_suppkey % 20 AS subject, l_linenumber AS run, l_returnflag AS contig, l_partkey % 50 AS pos, 'G' AS alt, max(CAST(l_orderkey % 3 AS INTEGER)) AS dosage, max(CAST(l_quantity AS INTEGER)) AS depth FROM lineitem GROUP BY 1, 2, 3, 4),
s AS (SELECT DISTINCT subject, contig, pos, alt FROM c), r AS (SELECT DISTINCT subject, run FROM c), f AS (SELECT s.subject, s.contig, s.pos, s.alt, coalesce(dosage, 0) AS dosage, coalesce(depth, 0) AS depth FROM s JOIN r ON r.subject = s.subject LEFT JOIN c ON c.subject = s.subject AND c.run = r.run AND c.contig = s.contig AND c.pos = s.pos),
w AS (SELECT subject, contig, pos, alt, dosage, sum(1 + least(sqrt(depth) / 10, 1.0)) AS w, count(*) AS runs FROM f WHERE depth >= 2 GROUP BY 1, 2, 3, 4, 5), k AS (SELECT *, row_number() OVER (PARTITION BY subject, contig, pos ORDER BY floor(w * 1000000 + 0.5) DESC, dosage) AS k FROM w)
SELECT subject, contig, pos, alt, max(dosage) FILTER (k = 1) AS dosage, floor(max(w) * 10000 + 0.5) / 10000 AS weight, CAST(sum(runs) AS BIGINT) AS runs FROM k GROUP BY 1, 2, 3, 4 HAVING max(dosage) FILTER (k = 1) > 0"""
)
def consensus_variants(t: Tables) -> DataFrame:
    c = t.lineitem.groupBy((F.col("l_suppkey") % 20).alias("subject"), F.col("l_linenumber").alias("run"), F.col("l_returnflag").alias("contig"), (F.col("l_partkey") % 50).alias("pos"), F.lit("G").alias("alt")).agg(F.max((F.col("l_orderkey") % 3).cast("int")).alias("dosage"), F.max(F.col("l_quantity").cast("int")).alias("depth"))
    return dn.consensus_calls(c).withColumn("weight", rounded(F.col("weight")))


# ---- archaic markers

_PANEL = f"""panel AS (SELECT 'c' || p_partkey % 3 AS contig, p_partkey * 100 AS pos, {_SQL_LETTER.format('p_partkey')} AS derived, CASE p_size % 3 WHEN 0 THEN 'Neanderthal' WHEN 1 THEN 'Denisovan' ELSE 'SharedArchaic' END AS class, CASE WHEN p_partkey % 4 < 3 THEN p_partkey % 4 END AS g0, CASE WHEN p_size % 4 < 3 THEN p_size % 4 END AS g1, CASE WHEN p_partkey // 4 % 4 < 3 THEN p_partkey // 4 % 4 END AS g2, CASE WHEN p_size // 4 % 4 < 3 THEN p_size // 4 % 4 END AS g3 FROM part),
calls AS (SELECT l_suppkey AS sample, 'c' || l_partkey % 3 AS contig, l_partkey * 100 AS pos, CASE WHEN l_partkey % 4 = 0 THEN {_SQL_LETTER.format('l_partkey + 1')} ELSE {_SQL_LETTER.format('l_partkey')} END AS alt, {_SQL_LETTER.format('l_partkey + 2 + l_partkey % 2 * 2')} AS ref, max(l_linenumber % 3) AS dosage FROM lineitem GROUP BY 1, 2, 3, 4, 5),
seg AS (SELECT o_orderkey AS segment, o_custkey % 10 + 1 AS sample, 'c' || o_orderkey % 3 AS contig, (o_orderkey * 37) % 15000 AS s, (o_orderkey * 37) % 15000 + 3000 AS e FROM orders)"""


def _panel(t: Tables) -> DataFrame:
    p, z = F.col("p_partkey"), F.col("p_size")
    call = lambda x: F.when(x % 4 < 3, (x % 4).cast("int"))
    kind = F.when(z % 3 == 0, "Neanderthal").when(z % 3 == 1, "Denisovan").otherwise("SharedArchaic")
    return t.part.select(F.concat(F.lit("c"), (p % 3).cast("string")).alias("contig"), (p * 100).alias("pos"), _letter(p).alias("derived"), kind.alias("class"), F.array(call(p), call(z), call(F.floor(p / 4)), call(F.floor(z / 4))).alias("calls"))


def _archaic_calls(t: Tables) -> DataFrame:
    p = F.col("l_partkey")
    alt = F.when(p % 4 == 0, _letter(p + 1)).otherwise(_letter(p))
    return t.lineitem.groupBy(F.col("l_suppkey").alias("sample"), F.concat(F.lit("c"), (p % 3).cast("string")).alias("contig"), (p * 100).alias("pos"), alt.alias("alt"), _letter(p + 2 + p % 2 * 2).alias("ref")).agg(F.max(F.col("l_linenumber") % 3).alias("dosage"))


def _segments(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    return t.orders.select(o.alias("segment"), (F.col("o_custkey") % 10 + 1).alias("sample"), F.concat(F.lit("c"), (o % 3).cast("string")).alias("contig"), (o * 37 % 15000).alias("start"), (o * 37 % 15000 + 3000).alias("end"))


@query(f"WITH {_PANEL} SELECT sample, p.contig, p.pos, dosage > 0 AND alt = derived AS carries FROM panel p JOIN calls c ON c.contig = p.contig AND c.pos = p.pos")
def carried_panel_sites(t: Tables) -> DataFrame:
    return ar.carried_sites(_panel(t), _archaic_calls(t), ["sample"])


@query(f"WITH {_PANEL}, n AS (SELECT class, count(*) AS sites FROM panel GROUP BY 1), g AS (SELECT sample, class, CAST(sum(dosage) AS BIGINT) AS copies, count(*) AS called FROM panel p JOIN calls c ON c.contig = p.contig AND c.pos = p.pos GROUP BY 1, 2) SELECT sample, g.class, copies, called, floor(called / sites * 10000 + 0.5) / 10000 AS call_rate FROM g JOIN n ON n.class = g.class")
def archaic_call_rates(t: Tables) -> DataFrame:
    return ar.marker_counts(_panel(t), _archaic_calls(t), ["sample"]).withColumn("call_rate", rounded(F.col("call_rate")))


@query(
    f"""WITH {_PANEL}, g AS (SELECT contig, pos, unnest([0, 1, 2, 3]) AS genome, unnest([g0, g1, g2, g3]) AS n FROM panel), j AS (SELECT segment, genome, count(*) AS sites, count(*) FILTER (c.alt = p.derived AND c.dosage > 0) AS hits FROM seg JOIN g ON g.contig = seg.contig AND g.pos BETWEEN s AND e AND n > 0 JOIN panel p ON p.contig = g.contig AND p.pos = g.pos LEFT JOIN calls c ON c.sample = seg.sample AND c.contig = g.contig AND c.pos = g.pos GROUP BY 1, 2),
b AS (SELECT segment, max(hits / sites) AS c FROM j WHERE sites >= 3 GROUP BY 1) SELECT seg.segment, floor(c * 10000 + 0.5) / 10000 AS concordance, c IS NULL OR c >= 0.7 AS kept FROM seg LEFT JOIN b ON b.segment = seg.segment"""
)
def segment_concordance(t: Tables) -> DataFrame:
    carried = ar.carried_sites(_panel(t), _archaic_calls(t), ["sample"])
    return ar.segment_concordance(_segments(t), _panel(t), carried, 2048).withColumn("concordance", rounded(F.col("concordance")))


@query(
    f"""WITH {_PANEL}, j AS (SELECT seg.segment, class, coalesce((alt = derived AND dosage >= 1) OR (ref = derived AND dosage <= 1), false) AS ok FROM seg JOIN panel p ON p.contig = seg.contig AND pos BETWEEN s AND e AND class <> 'SharedArchaic' LEFT JOIN calls c ON c.sample = seg.sample AND c.contig = p.contig AND c.pos = p.pos),
g AS (SELECT segment, count(*) FILTER (class = 'Neanderthal' AND ok) AS n, count(*) FILTER (class = 'Denisovan' AND ok) AS d, count(*) FILTER (class = 'Neanderthal') AS ns, count(*) FILTER (class = 'Denisovan') AS ds FROM j GROUP BY 1),
h AS (SELECT seg.segment, coalesce(n, 0) AS n, coalesce(d, 0) AS d, CASE WHEN ns > 0 THEN n / (ns * 0.043::DOUBLE) ELSE 0.0 END AS en, CASE WHEN ds > 0 THEN d / (ds * 0.039::DOUBLE) ELSE 0.0 END AS ed FROM seg LEFT JOIN g ON g.segment = seg.segment)
SELECT segment, n AS neanderthal, d AS denisovan, CASE WHEN n >= 10 AND en >= ed * 2 THEN 'Neanderthal' WHEN d >= 10 AND ed >= en * 2 THEN 'Denisovan' ELSE 'Unknown' END AS source FROM h"""
)
def segment_attribution(t: Tables) -> DataFrame:
    return ar.attribute_segments(_segments(t), _panel(t).drop("calls"), _archaic_calls(t), 2048)


@query("WITH w AS (SELECT 'c' || p_partkey % 3 AS contig, p_partkey AS w, p_size * 30 AS callable FROM part) SELECT o_orderkey, floor(least(coalesce(callable / 1000, 0), 1) * 10000 + 0.5) / 10000 AS share FROM (SELECT o_orderkey, 'c' || o_orderkey % 4 AS contig, o_orderkey * 91 % 300000 AS pos FROM orders) o LEFT JOIN w ON w.contig = o.contig AND w.w = o.pos // 1000")
def callable_window_share(t: Tables) -> DataFrame:
    o, p = F.col("o_orderkey"), F.col("p_partkey")
    w = t.part.select(F.concat(F.lit("c"), (p % 3).cast("string")).alias("contig"), p.alias("window"), (F.col("p_size") * 30).alias("callable"))
    pts = t.orders.select("o_orderkey", F.concat(F.lit("c"), (o % 4).cast("string")).alias("contig"), (o * 91 % 300_000).alias("pos"))
    return ar.callable_fraction(pts, w, 1000).select("o_orderkey", rounded(F.col("callable_share")).alias("share"))


@query("SELECT floor(sum(p_size * 30) / 1e6 * 10000 + 0.5) / 10000 AS callable_mb FROM part")
def callable_megabases(t: Tables) -> DataFrame:
    return ar.callable_megabases(t.part.select((F.col("p_size") * 30).alias("callable"))).select(rounded(F.col("callable_mb")).alias("callable_mb"))


@query(
    """WITH g AS (SELECT l_suppkey AS sample, count(*) AS sites, CAST(sum(l_linenumber % 3) AS BIGINT) AS copies, sum(2 * f) AS mean, sum(2 * f * (1 - f)) AS var FROM (SELECT *, ((l_partkey * 7) % 19 + 1) / 21.0::DOUBLE AS f FROM lineitem) GROUP BY 1),
i AS (SELECT *, sites / 2000 AS d FROM g), k AS (SELECT *, greatest(CASE WHEN d <= 0.1 THEN 1.5 WHEN d <= 0.5 THEN 1.5 + (ln(d) - ln(0.1::DOUBLE)) / (ln(0.5::DOUBLE) - ln(0.1::DOUBLE)) * 1.0 WHEN d <= 1 THEN 2.5 + (ln(d) - ln(0.5::DOUBLE)) / (0 - ln(0.5::DOUBLE)) * 1.5 ELSE 4.0 END, 1) * var AS v FROM i),
z AS (SELECT *, (copies - mean) / sqrt(v) AS z FROM k), x AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2)) AS t FROM z), c AS (SELECT *, 50 * (1 + CASE WHEN z < 0 THEN -1 ELSE 1 END * (1 - ((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-x * x))) AS p FROM x)
SELECT sample, sites, copies, CASE WHEN sites >= 200 THEN floor(least(greatest(p, 0), 100) * 1000 + 0.5) / 1000 END AS percentile FROM c"""
)
def archaic_percentile(t: Tables) -> DataFrame:
    called = t.lineitem.select(F.col("l_suppkey").alias("sample"), (F.col("l_linenumber") % 3).alias("copies"), ((F.col("l_partkey") * 7 % 19 + 1) / 21.0).alias("freq"))
    return ar.count_percentile(called, ["sample"], 2000, [(0.1, 1.5), (0.5, 2.5), (1.0, 4.0)]).withColumn("percentile", rounded(F.col("percentile"), 3))


@query(
    """WITH r AS (SELECT o_custkey AS sample, CAST(floor(o_totalprice / 12500) AS DOUBLE) AS mb FROM orders), g AS (SELECT sample, count(*) AS runs, sum(mb) AS total_mb, max(mb) AS longest_mb, count(*) FILTER (mb < 5) AS n_short, count(*) FILTER (mb >= 5 AND mb < 15) AS n_medium, count(*) FILTER (mb >= 15) AS n_long, sum(CASE WHEN mb < 5 THEN mb ELSE 0 END) AS short_mb, sum(CASE WHEN mb >= 5 AND mb < 15 THEN mb ELSE 0 END) AS medium_mb, sum(CASE WHEN mb >= 15 THEN mb ELSE 0 END) AS long_mb FROM r GROUP BY 1)
SELECT * EXCLUDE (f), floor(f * 10000 + 0.5) / 10000 AS f_roh, CASE WHEN f < 0.02 THEN 'Outbred' WHEN total_mb > 0 AND long_mb / total_mb > 0.5 THEN 'RecentConsanguinity' WHEN total_mb > 0 AND short_mb / total_mb > 0.5 THEN 'Endogamy' ELSE 'Mixed' END AS pattern FROM (SELECT *, total_mb / 1500 AS f FROM g)"""
)
def roh_summary(t: Tables) -> DataFrame:
    runs = t.orders.select(F.col("o_custkey").alias("sample"), F.floor(F.col("o_totalprice") / 12500).cast("double").alias("mb"))
    return ar.roh_summary(runs, ["sample"], F.lit(1500.0)).withColumn("f_roh", rounded(F.col("f_roh")))


@query(
    """WITH r AS (SELECT l_suppkey AS sample, l_linenumber % 4 - 1 AS g, 0.5 * least(greatest((l_partkey % 7) / 6.0::DOUBLE, 0.001), 0.999) + 0.3 * least(greatest((l_partkey % 11) / 10.0::DOUBLE, 0.001), 0.999) + 0.2 * least(greatest((l_partkey % 13) / 12.0::DOUBLE, 0.001), 0.999) AS f FROM lineitem),
d AS (SELECT sample, count(*) AS sites, avg((g - 2 * f) * (g - 2 * f) / (2 * f * (1 - f))) AS d FROM r WHERE g >= 0 GROUP BY 1) SELECT sample, sites, floor(d * 1000 + 0.5) / 1000 AS dispersion, sample % 100 >= 50 AND sites >= 500 AND d <= 4 AS shown FROM d"""
)
def mixture_dispersion(t: Tables) -> DataFrame:
    p = F.col("l_partkey")
    freqs = F.array(p % 7 / 6.0, p % 11 / 10.0, p % 13 / 12.0)
    rows = t.lineitem.select(F.col("l_suppkey").alias("sample"), (F.col("l_linenumber") % 4 - 1).alias("dosage"), freqs.alias("freqs"), F.array(*map(F.lit, (0.5, 0.3, 0.2))).alias("weights"))
    d = ar.dispersion(rows, ["sample"])
    return d.select("sample", "sites", rounded(F.col("dispersion"), 3).alias("dispersion"), ar.deep_gate(F.col("sites"), F.col("dispersion"), F.col("sample") % 100).alias("shown"))


_SUPERS = [("YRI", "AFR"), ("LWK", "AFR"), ("TSI", "EUR"), ("FIN", "EUR"), ("CEU", "EUR")]


@query(
    f"""WITH {_PANEL}, al AS (SELECT l_suppkey AS sample, l_linenumber % 2 AS side, 'c' || l_partkey % 3 AS contig, l_partkey * 100 AS pos, max(CAST(l_orderkey % 2 AS INTEGER)) AS allele FROM lineitem GROUP BY 1, 2, 3, 4), sg AS (SELECT *, segment % 2 AS side, CASE WHEN segment % 3 = 0 THEN 'AFR' ELSE 'EUR' END AS population FROM seg),
pops(k, fine, population) AS (VALUES (0, 'YRI', 'AFR'), (1, 'LWK', 'AFR'), (2, 'TSI', 'EUR'), (3, 'FIN', 'EUR'), (4, 'CEU', 'EUR')), j AS (SELECT segment, fine, k, allele, least(greatest((p.pos // 100 * (k + 3) % 17) / 16.0::DOUBLE, 0.0001), 0.9999) AS f FROM sg JOIN panel p ON p.contig = sg.contig AND p.pos BETWEEN s AND e JOIN al ON al.sample = sg.sample AND al.side = sg.side AND al.contig = p.contig AND al.pos = p.pos JOIN pops ON pops.population = sg.population),
l AS (SELECT segment, fine, k, sum(ln(CASE WHEN allele = 1 THEN f ELSE 1 - f END)) AS ll, count(*) AS n FROM j GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER w AS r, lead(ll) OVER w AS nx FROM l WINDOW w AS (PARTITION BY segment ORDER BY ll DESC, k))
SELECT sg.segment, fine FROM sg LEFT JOIN (SELECT segment, fine FROM r WHERE r = 1 AND n >= 4 AND (nx IS NULL OR (ll - nx) / n >= 0.02)) b ON b.segment = sg.segment"""
)
def fine_populations(t: Tables) -> DataFrame:
    p = F.col("l_partkey")
    alleles = t.lineitem.groupBy(F.col("l_suppkey").alias("sample"), (F.col("l_linenumber") % 2).cast("long").alias("side"), F.concat(F.lit("c"), (p % 3).cast("string")).alias("contig"), (p * 100).alias("pos")).agg(F.max((F.col("l_orderkey") % 2).cast("int")).alias("allele"))
    seg = _segments(t).withColumn("side", F.col("segment") % 2).withColumn("population", F.when(F.col("segment") % 3 == 0, "AFR").otherwise("EUR"))
    panel = _panel(t).select("contig", "pos", F.array(*((F.floor(F.col("pos") / 100) * (k + 3) % 17) / 16.0 for k in range(5))).alias("freqs"))
    return ar.fine_populations(seg, alleles, panel, _SUPERS, 2048, 4)


@query(
    """WITH j AS (SELECT l_suppkey AS sample, l_orderkey AS pos, max(l_linenumber) % 2 AS s0, max(l_partkey) % 2 AS s1, CAST(max(l_quantity) AS BIGINT) % 3 AS d FROM lineitem GROUP BY 1, 2), g AS (SELECT sample, count(*) AS informative, count(*) FILTER (CASE WHEN sample % 2 = 0 THEN s0 = d / 2 OR pos % 10 > 1 ELSE s0 = d / 2 END) AS m0 FROM j WHERE s0 <> s1 AND d <> 1 GROUP BY 1)
SELECT sample, informative, CASE WHEN informative >= 50 AND greatest(m0, informative - m0) / informative >= 0.75 THEN CASE WHEN m0 * 2 >= informative THEN 0 ELSE 1 END END AS side FROM g"""
)
def parent_sides(t: Tables) -> DataFrame:
    j = t.lineitem.groupBy(F.col("l_suppkey").alias("sample"), F.col("l_orderkey").alias("pos")).agg((F.max("l_linenumber") % 2).alias("s0"), (F.max("l_partkey") % 2).alias("s1"), (F.max("l_quantity").cast("long") % 3).alias("d"))
    like = (F.col("sample") % 2 == 0) & (F.col("pos") % 10 > 1) & (F.col("d") != 1)
    dosage = F.when(like, F.col("s0") * 2).otherwise(F.col("d"))
    phased = j.select("sample", F.lit("1").alias("contig"), "pos", F.col("s0").cast("long").alias("side0"), F.col("s1").cast("long").alias("side1"))
    return ar.anchor_sides(phased, j.select("sample", F.lit("1").alias("contig"), "pos", dosage.cast("long").alias("dosage")), ["sample"])


@query()
def deep_ancestry(t: Tables) -> DataFrame:
    p = F.col("l_partkey")
    freqs = F.array(*((p * (k + 3) % (19 + k) + 1) / (21.0 + k) for k in range(7)))
    rows = t.lineitem.select(F.col("l_suppkey").alias("sample"), F.col("l_returnflag").alias("contig"), (p * 100_000).alias("pos"), ((p * 3 % 19 + F.col("l_linenumber")) % 3).alias("dosage"), freqs.alias("freqs"))
    fit = ar.fit_mixtures(rows, "sample", [0, 1, 2], [3, 4, 5, 6])
    return fit.withColumn("weights", F.transform("weights", lambda w: rounded(w, 6))).withColumn("errors", F.transform("errors", lambda w: rounded(w, 6))).withColumn("chi2", rounded(F.col("chi2"), 4)).withColumn("p", rounded(F.col("p"), 4))
