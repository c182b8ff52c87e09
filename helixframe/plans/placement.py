"""Placement, descent, block and reconciliation queries on a tree of regions, nations and 25 lines a nation.

Samples are customers; their orders are calls at loci of their own path, with some of other branches, some read on
the other strand, some ancestral and some unreadable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.genotype import complement
from helixframe.operators import placement as pl
from helixframe.operators import tree
from helixframe.plans.catalog import Tables, query, rounded
from helixframe.session import materialize

_TREE = """WITH RECURSIVE nodes AS (SELECT CAST(1 AS BIGINT) AS node, CAST(NULL AS BIGINT) AS parent, 'root' AS name UNION ALL SELECT 10 + r_regionkey, 1, r_name FROM region UNION ALL SELECT 100 + n_nationkey, 10 + n_regionkey, n_name FROM nation
 UNION ALL SELECT 1000 + n_nationkey * 25 + b, 100 + n_nationkey, n_name || '-' || b FROM nation, range(25) x(b)),
closed AS (SELECT node, node AS ancestor, CAST(0 AS INTEGER) AS steps FROM nodes UNION ALL SELECT c.node, n.parent, c.steps + 1 FROM closed c JOIN nodes n ON n.node = c.ancestor WHERE n.parent IS NOT NULL),
loci AS (SELECT node, 'S' || (node * 10 + k) AS name, node * 10 + k AS pos, substr('ACGT', CAST((node + k) % 4 + 1 AS BIGINT), 1) AS ancestral,
 CASE WHEN k = 2 AND node % 5 = 0 THEN substr('ACGT', CAST((node + k) % 4 + 1 AS BIGINT), 1) || 'GG' ELSE substr('ACGT', CAST((node + k + 1 + node % 3) % 4 + 1 AS BIGINT), 1) END AS derived FROM nodes, range(3) x(k) WHERE node > 1)"""
_CALLS = (
    _TREE
    + """, hits AS (SELECT o_custkey AS sample, o_orderkey AS o, (CASE o_orderkey % 5 WHEN 0 THEN 10 + n_regionkey WHEN 3 THEN 1000 + n_nationkey * 25 + o_custkey % 25 WHEN 4 THEN 100 + o_orderkey % 25 ELSE 100 + n_nationkey END) * 10 + (o_orderkey // 5) % 3 AS pos FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
calls AS (SELECT sample, h.pos, min(CASE WHEN length(derived) > 1 THEN CASE WHEN o % 11 = 0 THEN '-' ELSE '+' END WHEN o % 11 = 0 THEN ancestral WHEN o % 11 = 1 THEN translate(derived, 'ACGT', 'TGCA') WHEN o % 11 = 2 THEN 'N' ELSE derived END) AS base FROM hits h JOIN loci l ON l.pos = h.pos GROUP BY 1, 2),
st AS (SELECT sample, node, name, l.pos, ancestral, derived, base, CASE WHEN length(derived) > 1 THEN CASE base WHEN '+' THEN 'Derived' WHEN '-' THEN 'Ancestral' ELSE 'NoCall' END WHEN base = derived THEN 'Derived' WHEN base = ancestral THEN 'Ancestral'
 WHEN least(ancestral, derived) || greatest(ancestral, derived) IN ('AT', 'CG') THEN 'NoCall' WHEN translate(base, 'ACGT', 'TGCA') = derived THEN 'Derived' WHEN translate(base, 'ACGT', 'TGCA') = ancestral THEN 'Ancestral' ELSE 'NoCall' END AS state FROM calls c JOIN loci l ON l.pos = c.pos),
cnt AS (SELECT sample, node, count(*) FILTER (state = 'Derived') AS d, count(*) FILTER (state = 'Ancestral') AS a, count(*) FILTER (length(derived) > 1 AND state <> 'NoCall') AS indels FROM st GROUP BY 1, 2)"""
)
_RANKED = (
    _CALLS
    + """, tot AS (SELECT sample, count(*) FILTER (state = 'Derived') AS found FROM st GROUP BY 1), touched AS (SELECT sample, node FROM cnt UNION SELECT DISTINCT sample, 1 FROM cnt),
up AS (SELECT t.sample, t.node, c.ancestor, c.steps, coalesce(d, 0) AS d, coalesce(a, 0) AS a, coalesce(indels, 0) AS indels FROM touched t JOIN closed c ON c.node = t.node LEFT JOIN cnt o ON o.sample = t.sample AND o.node = c.ancestor),
bel AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY sample, node ORDER BY steps ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM up),
sums AS (SELECT sample, node, CAST(sum(d) AS BIGINT) AS matched, CAST(sum(indels) AS BIGINT) AS indels, bool_or(a > d AND (d = 0 OR below < 4)) AS refused, max(steps) AS depth, list(ancestor ORDER BY steps DESC) AS path FROM bel GROUP BY 1, 2),
ex AS (SELECT c.node, count(l.pos) AS e FROM closed c LEFT JOIN loci l ON l.node = c.ancestor AND length(l.derived) = 1 GROUP BY 1),
rk AS (SELECT s.sample, s.node, depth, path, matched, e + indels AS expected, found, CASE WHEN e + indels > 0 AND found > 0 THEN CAST(0.5 AS DOUBLE) * (matched / (e + indels) + matched / found) ELSE 0.0 END AS score, NOT refused AS admissible FROM sums s JOIN ex ON ex.node = s.node JOIN tot ON tot.sample = s.sample),
ent AS (SELECT c.sample, n.parent, c.node, row_number() OVER (PARTITION BY c.sample, n.parent ORDER BY d DESC, c.node) AS r FROM cnt c JOIN nodes n ON n.node = c.node WHERE a <= d AND d >= 2)"""
)


def _down(order: str) -> str:
    return f""", best AS (SELECT sample, node, admissible FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY {order} score DESC, depth, path) AS r FROM rk) WHERE r = 1),
walk AS (SELECT sample, node AS start, node, 0 AS k FROM best UNION ALL SELECT w.sample, w.start, x.node, k + 1 FROM walk w JOIN ent x ON x.sample = w.sample AND x.parent = w.node WHERE x.r = 1),
ends AS (SELECT sample, start, arg_max(node, k) AS terminal FROM walk GROUP BY 1, 2)"""


_STRICT = _RANKED + _down("admissible DESC,")
_ROBUST = (
    _RANKED
    + _down("")
    + """, lit AS (SELECT sample, node AS ancestor, sum(v) AS v, bool_or(v > 0) AS own FROM (SELECT sample, node, CASE WHEN base = substr(derived, 1, 1) THEN 1 ELSE -1 END AS v FROM st) GROUP BY 1, 2),
bal AS (SELECT e.sample, e.start, e.terminal, c.ancestor, c.steps, own, sum(coalesce(v, 0)) OVER (PARTITION BY e.sample ORDER BY c.steps DESC) AS balance FROM ends e JOIN closed c ON c.node = e.terminal LEFT JOIN lit l ON l.sample = e.sample AND l.ancestor = c.ancestor),
kept AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY balance DESC, CASE WHEN own THEN -steps ELSE steps - 1000000 END DESC) AS r FROM bal)"""
)


class _Forest:
    """The tree, its loci and the calls of the customers."""

    def __init__(self, t: Tables):
        one = t.spark.createDataFrame([(1, None, "root")], "node long, parent long, name string")
        r = t.region.select((F.col("r_regionkey") + 10).cast("long"), F.lit(1).cast("long"), "r_name")
        nation = t.nation.select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("g"), "n_name")
        n = nation.select(F.col("n") + 100, F.col("g") + 10, "n_name")
        line = nation.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(24)))).select(F.col("n") * 25 + F.col("b") + 1000, F.col("n") + 100, F.concat_ws("-", "n_name", F.col("b").cast("string")))
        self.nodes = one.union(r).union(n).union(line)
        self.nodes = materialize(self.nodes.coalesce(1), "nodes")
        self.closed = materialize(tree.closure(self.nodes, depth_hint=3).coalesce(1), "closure")
        letter = lambda k: F.substring(F.lit("ACGT"), (k % 4 + 1).cast("int"), F.lit(1))
        x = self.nodes.where("node > 1").select("node", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
        anc = letter(F.col("node") + F.col("k"))
        der = F.when((F.col("k") == 2) & (F.col("node") % 5 == 0), F.concat(anc, F.lit("GG"))).otherwise(letter(F.col("node") + F.col("k") + 1 + F.col("node") % 3))
        pos = F.col("node") * 10 + F.col("k")
        self.loci = x.select("node", F.concat(F.lit("S"), pos.cast("string")).alias("name"), pos.alias("pos"), anc.alias("ancestral"), der.alias("derived"))
        j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n"))
        o = F.col("o_orderkey")
        node = F.when(o % 5 == 0, F.col("g") + 10).when(o % 5 == 3, F.col("n") * 25 + F.col("o_custkey") % 25 + 1000).when(o % 5 == 4, o % 25 + 100).otherwise(F.col("n") + 100)
        hits = j.select(F.col("o_custkey").alias("sample"), o.alias("o"), (node * 10 + F.floor(o / 5) % 3).alias("pos")).join(F.broadcast(self.loci), "pos")
        indel = F.when(F.col("o") % 11 == 0, "-").otherwise("+")
        snp = F.when(F.col("o") % 11 == 0, F.col("ancestral")).when(F.col("o") % 11 == 1, complement(F.col("derived"))).when(F.col("o") % 11 == 2, "N").otherwise(F.col("derived"))
        self.calls = hits.groupBy("sample", "pos").agg(F.min(F.when(F.length("derived") > 1, indel).otherwise(snp)).alias("base"))
        self.calls = materialize(self.calls, "calls")
        self.loci = materialize(self.loci.coalesce(1), "loci")
        self.found = materialize(pl.states(self.loci, self.calls), "states")


@query(_CALLS + " SELECT sample, node, pos, state FROM st")
def locus_states(t: Tables) -> DataFrame:
    return _Forest(t).found.select("sample", "node", "pos", "state")


@query(_CALLS + " SELECT sample, node, d AS derived, a AS ancestral, 3 - d - a AS no_call FROM cnt")
def node_call_counts(t: Tables) -> DataFrame:
    f = _Forest(t)
    return pl.node_counts(f.found, f.loci)


@query(_RANKED + " SELECT sample, node, depth, matched, expected, found, floor(score * 1000000 + 0.5) / 1000000 AS score, admissible FROM rk")
def path_scores(t: Tables) -> DataFrame:
    f = _Forest(t)
    r = pl.rank_paths(f.nodes, f.closed, f.loci, f.found)
    return r.select("sample", "node", "depth", "matched", "expected", "found", rounded(F.col("score"), 6).alias("score"), "admissible")


@query(_STRICT + " SELECT e.sample, start, CASE WHEN admissible THEN terminal ELSE start END AS terminal FROM ends e JOIN best b ON b.sample = e.sample")
def placement_strict(t: Tables) -> DataFrame:
    f = _Forest(t)
    return pl.place(f.nodes, f.closed, f.loci, f.calls)


@query(_ROBUST + " SELECT sample, start, ancestor AS terminal FROM kept WHERE r = 1")
def placement_robust(t: Tables) -> DataFrame:
    f = _Forest(t)
    return pl.place_robust(f.nodes, f.closed, f.loci, f.calls)


@query(
    _RANKED
    + """, walk AS (SELECT sample, node AS start, node, 0 AS k FROM (SELECT DISTINCT sample, 1::BIGINT AS node FROM cnt) UNION ALL SELECT w.sample, w.start, x.node, k + 1 FROM walk w JOIN ent x ON x.sample = w.sample AND x.parent = w.node WHERE x.r = 1)
SELECT sample, start AS node, arg_max(node, k) AS terminal FROM walk GROUP BY 1, 2"""
)
def greedy_descent(t: Tables) -> DataFrame:
    f = _Forest(t)
    return pl.deepen(f.nodes, pl.node_counts(f.found, f.loci), f.found.select("sample", F.lit(1).cast("long").alias("node")).distinct())


@query(
    _STRICT
    + """, fin AS (SELECT e.sample, CASE WHEN admissible THEN terminal ELSE start END AS terminal FROM ends e JOIN best b ON b.sample = e.sample)
SELECT f.sample, f.terminal, c.steps AS up, l.node, l.name, l.pos, coalesce(state, 'NoCall') AS state FROM fin f JOIN closed c ON c.node = f.terminal JOIN loci l ON l.node = c.ancestor LEFT JOIN st s ON s.sample = f.sample AND s.pos = l.pos"""
)
def descent_report(t: Tables) -> DataFrame:
    f = _Forest(t)
    return pl.lineage_evidence(f.closed, f.loci, f.found, pl.place(f.nodes, f.closed, f.loci, f.calls))


@query(
    _STRICT
    + """, fin AS (SELECT e.sample, CASE WHEN admissible THEN terminal ELSE start END AS terminal FROM ends e JOIN best b ON b.sample = e.sample)
SELECT f.sample, f.terminal, n.node AS child, count(*) FILTER (state = 'Derived') AS derived, count(*) FILTER (state = 'Ancestral') AS ancestral, count(*) FILTER (coalesce(state, 'NoCall') = 'NoCall') AS no_call
FROM fin f JOIN nodes n ON n.parent = f.terminal JOIN loci l ON l.node = n.node LEFT JOIN st s ON s.sample = f.sample AND s.pos = l.pos GROUP BY 1, 2, 3"""
)
def child_evidence(t: Tables) -> DataFrame:
    f = _Forest(t)
    return pl.child_evidence(f.nodes, f.loci, f.found, pl.place(f.nodes, f.closed, f.loci, f.calls))


@query(
    _CALLS
    + """, p AS (SELECT c.node, max(steps) AS depth, list({'name': n.name, 'id': n.node} ORDER BY steps DESC) AS path FROM closed c JOIN nodes n ON n.node = c.ancestor GROUP BY 1), o AS (SELECT node, depth, CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS place FROM p), one AS (SELECT min(sample) AS sample FROM calls)
SELECT place, n.name AS node, coalesce(u.name, '') AS parent, l.name, l.pos, coalesce(state, 'NoCall') AS state FROM o JOIN nodes n ON n.node = o.node LEFT JOIN nodes u ON u.node = n.parent JOIN loci l ON l.node = o.node LEFT JOIN (SELECT st.* FROM st JOIN one ON one.sample = st.sample) s ON s.pos = l.pos"""
)
def branch_report(t: Tables) -> DataFrame:
    """The whole tree's report for the first sample."""
    f = _Forest(t)
    first = f.calls.agg(F.min("sample")).first()[0]
    return pl.subtree_report(f.nodes, f.loci, f.found, 1, first)


@query(
    _TREE
    + """, p AS (SELECT c.node, max(steps) AS depth, list({'name': n.name, 'id': n.node} ORDER BY steps DESC) AS path FROM closed c JOIN nodes n ON n.node = c.ancestor GROUP BY 1)
SELECT node, depth, CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS place FROM p"""
)
def tree_preorder(t: Tables) -> DataFrame:
    f = _Forest(t)
    return pl.preorder(f.nodes)


@query(_TREE + ", r AS (SELECT name, CASE WHEN node % 4 = 0 THEN derived ELSE ancestral END AS ra, CASE WHEN node % 4 = 0 THEN ancestral ELSE derived END AS rd FROM loci WHERE node % 3 = 0) SELECT node, l.name, pos, CASE WHEN ra = derived THEN derived ELSE ancestral END AS ancestral, CASE WHEN ra = derived THEN ancestral ELSE derived END AS derived, coalesce(ra = derived, false) AS turned FROM loci l LEFT JOIN r ON r.name = l.name")
def polarity_normalize(t: Tables) -> DataFrame:
    f = _Forest(t)
    swap = F.col("node") % 4 == 0
    ref = f.loci.where("node % 3 = 0").select("name", F.when(swap, F.col("derived")).otherwise(F.col("ancestral")).alias("ancestral"), F.when(swap, F.col("ancestral")).otherwise(F.col("derived")).alias("derived"))
    return pl.normalize_polarity(f.loci, ref)


@query(_TREE + ", l2 AS (SELECT 'M' || (pos % 700) AS name, node, pos, ancestral, derived FROM loci) SELECT upper(name) AS name, arg_min(ancestral, (node, pos)) AS ancestral, arg_min(derived, (node, pos)) AS derived FROM l2 GROUP BY 1")
def polarity_map(t: Tables) -> DataFrame:
    f = _Forest(t)
    return pl.polarity_map(f.loci.withColumn("name", F.concat(F.lit("m"), (F.col("pos") % 700).cast("string"))))


@query(_TREE + " SELECT pos % 900 AS pos, arg_min(n.name, n.node) AS node_name FROM loci l JOIN nodes n ON n.node = l.node GROUP BY 1")
def name_at_position(t: Tables) -> DataFrame:
    f = _Forest(t)
    return pl.name_at_position(f.nodes, f.loci.withColumn("pos", F.col("pos") % 900))


@query(_TREE + ", q AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN 's' || ((1000 + s_nationkey * 25) * 10 + s_suppkey % 3) ELSE 'nowhere' END AS q FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT s_suppkey, coalesce((SELECT min(node) FROM nodes WHERE upper(name) = upper(q)), (SELECT min(node) FROM loci WHERE upper(name) = upper(q))) AS node FROM q")
def find_nodes(t: Tables) -> DataFrame:
    f = _Forest(t)
    k = F.col("s_suppkey") % 3
    s = t.supplier.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("s_nationkey"))
    q = F.when(k == 0, F.lower("n_name")).when(k == 1, F.concat(F.lit("s"), ((F.col("s_nationkey") * 25 + 1000) * 10 + k).cast("string"))).otherwise("nowhere")
    return pl.find_nodes(f.nodes, f.loci, s.select("s_suppkey", q.alias("query"))).select("s_suppkey", "node")


_RUNS = """WITH p AS (SELECT o_custkey AS sample, o_orderkey AS source, (o_orderkey % 97) / 97.0 AS score, ['root', r_name, n_name, n_name || '-' || (o_custkey % 5)] AS whole, o_orderkey % 4 + 1 AS n, o_orderstatus AS st, 'X' || (o_orderkey % 2) AS other FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
c AS (SELECT sample, source, CAST(score AS DOUBLE) AS score, CASE WHEN st = 'P' THEN list_append(whole[1:3], other) ELSE whole[1:n] END AS lineage FROM p),
l AS (SELECT *, first_value(lineage) OVER (PARTITION BY sample ORDER BY len(lineage) DESC, lineage DESC) AS longest FROM c), o AS (SELECT *, longest[1:len(lineage)] = lineage AS ok FROM l),
g AS (SELECT sample, bool_and(ok) AS ok, arg_max(lineage, (score, source)) AS b, max(score) AS top, min(lineage) AS lo, max(lineage) AS hi, max(len(lineage)) AS deepest, count(*) AS runs, avg(score) AS mean, list(len(lineage)) AS sizes FROM o GROUP BY 1),
s AS (SELECT *, CASE WHEN lo[1] IS DISTINCT FROM hi[1] THEN 0 WHEN lo[2] IS DISTINCT FROM hi[2] OR len(lo) < 2 THEN 1 WHEN lo[3] IS DISTINCT FROM hi[3] OR len(lo) < 3 THEN 2 WHEN lo[4] IS DISTINCT FROM hi[4] OR len(lo) < 4 THEN 3 ELSE 4 END AS n FROM g)"""


@query(
    _RUNS
    + """ SELECT sample, CASE WHEN ok THEN b[len(b)] WHEN n = 0 THEN 'root' ELSE lo[n] END AS haplogroup, CAST(CASE WHEN ok THEN len(b) ELSE n END AS INTEGER) AS nodes, CASE WHEN ok THEN 'Compatible' WHEN n <= 1 THEN 'Incompatible' WHEN n / deepest >= 0.66 THEN 'MinorDivergence' ELSE 'MajorDivergence' END AS compatibility,
 floor(CASE WHEN ok THEN top ELSE mean END * 10000 + 0.5) / 10000 AS confidence, runs, CAST(CASE WHEN ok THEN (SELECT count(*) FROM unnest(sizes) u(x) WHERE x > len(b)) ELSE 0 END AS INTEGER) AS tentative FROM s"""
)
def haplogroup_reconcile(t: Tables) -> DataFrame:
    n = F.broadcast(t.nation.join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey")))
    j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    whole = F.array(F.lit("root"), "r_name", "n_name", F.concat_ws("-", "n_name", (F.col("o_custkey") % 5).cast("string")))
    other = F.concat(F.slice(whole, 1, 3), F.array(F.concat(F.lit("X"), (F.col("o_orderkey") % 2).cast("string"))))
    lineage = F.when(F.col("o_orderstatus") == "P", other).otherwise(F.slice(whole, F.lit(1), (F.col("o_orderkey") % 4 + 1).cast("int")))
    c = j.select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("source"), ((F.col("o_orderkey") % 97) / 97.0).alias("score"), lineage.alias("lineage")).withColumn("haplogroup", F.element_at("lineage", -1))
    return pl.reconcile_calls(c, ["sample"]).withColumn("confidence", rounded(F.col("confidence")))


_PRIVATE = "WITH c AS (SELECT DISTINCT c_nationkey + 100 AS block, c_custkey AS member, CASE WHEN o_orderkey % 17 = 0 THEN (o_orderkey % 40) * 2500 ELSE (c_nationkey + 100) * 1000000 + (o_orderkey % 40) * 2500 + CASE WHEN o_orderkey % 8 = 1 THEN 2000 ELSE 0 END END AS pos FROM orders JOIN customer ON c_custkey = o_custkey)"


def _private(t: Tables) -> DataFrame:
    o, b = F.col("o_orderkey"), F.col("c_nationkey").cast("long") + 100
    pos = F.when(o % 17 == 0, o % 40 * 2500).otherwise(b * 1_000_000 + o % 40 * 2500 + F.when(o % 8 == 1, 2000).otherwise(0))
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(b.alias("block"), F.col("c_custkey").alias("member"), pos.alias("pos")).distinct()


@query(
    _PRIVATE
    + """, d AS (SELECT count(DISTINCT member) AS donors FROM c), common AS (SELECT pos FROM c, d GROUP BY pos, donors HAVING donors >= 20 AND count(DISTINCT member) > ceil(donors * 0.25)), s AS (SELECT block, pos, count(*) AS n, string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) AS carriers FROM c GROUP BY 1, 2 HAVING count(*) >= 2),
b AS (SELECT pos, count(*) AS blocks FROM s GROUP BY 1), near AS (SELECT pos FROM (SELECT pos, pos - lag(pos) OVER (ORDER BY pos) AS l, lead(pos) OVER (ORDER BY pos) - pos AS r FROM b) WHERE l <= 1000 OR r <= 1000)
SELECT CAST(block AS BIGINT) AS block, pos, carriers FROM s WHERE pos NOT IN (SELECT pos FROM common UNION SELECT pos FROM near UNION SELECT pos FROM b WHERE blocks > 1)"""
)
def candidate_positions(t: Tables) -> DataFrame:
    return pl.candidate_positions(_private(t)).withColumn("carriers", F.array_join("carriers", ","))


@query()
def candidate_branches(t: Tables) -> DataFrame:
    return pl.candidate_branches(_private(t))


@query(
    _TREE
    + """, m AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 100 + c_nationkey ELSE 1000 + c_nationkey * 25 + c_custkey % 25 END AS node FROM customer WHERE c_acctbal > 9000), kept AS (SELECT DISTINCT ancestor AS node FROM closed JOIN m ON m.node = closed.node),
ch AS (SELECT parent, count(*) AS kids, min(node) AS lone FROM nodes WHERE node IN (SELECT node FROM kept) AND parent IS NOT NULL GROUP BY 1), thin AS (SELECT k.node, n.parent, n.name, lone FROM kept k JOIN nodes n ON n.node = k.node JOIN ch ON ch.parent = k.node WHERE kids = 1 AND k.node NOT IN (SELECT node FROM m)),
runs AS (SELECT node AS head, parent, node, lone, [name] AS names FROM thin WHERE parent IS NULL OR parent NOT IN (SELECT node FROM thin) UNION ALL SELECT r.head, r.parent, x.node, x.lone, list_append(r.names, x.name) FROM runs r JOIN thin x ON x.node = r.lone),
whole AS (SELECT head, parent, lone AS target, names FROM runs r WHERE lone NOT IN (SELECT node FROM thin) AND len(names) >= 2), gone AS (SELECT t.node FROM thin t JOIN whole w ON list_contains(w.names, t.name))
SELECT k.node, CASE WHEN w.target IS NOT NULL THEN w.parent ELSE n.parent END AS parent, coalesce(array_to_string(names, '>'), '') AS collapsed FROM kept k JOIN nodes n ON n.node = k.node LEFT JOIN whole w ON w.target = k.node WHERE k.node NOT IN (SELECT node FROM gone)"""
)
def block_tree(t: Tables) -> DataFrame:
    f = _Forest(t)
    node = F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey") * 25 + F.col("c_custkey") % 25 + 1000)
    m = t.customer.where("c_acctbal > 9000").select(node.cast("long").alias("node")).distinct()
    kept = materialize(f.nodes.join(tree.induced_subtree(f.closed, m), "node", "left_semi"), "blocks")
    return pl.collapse_unary(kept, m).withColumn("collapsed", F.array_join("collapsed", ">"))
