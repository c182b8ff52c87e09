"""Interval, island, tree, distance and segment queries on the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators import intervals as iv
from helixframe.operators import match, tree
from helixframe.plans.catalog import Tables, epoch_seconds, query, rounded

_SPANS = "SELECT o_custkey AS subject, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS s, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + 30 + o_orderkey % 60 AS INTEGER) AS e, o_orderkey FROM orders"


def _spans(t: Tables) -> DataFrame:
    s = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    return t.orders.select(F.col("o_custkey").alias("subject"), s.alias("s"), (s + 30 + F.col("o_orderkey") % 60).cast("int").alias("e"), "o_orderkey")


@query(
    f"""WITH x AS ({_SPANS}), b AS (SELECT *, max(e) OVER (PARTITION BY subject ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM b)
SELECT subject, min(s) AS s, max(e) AS e, count(*) AS parts FROM i GROUP BY subject, isle"""
)
def interval_merge(t: Tables) -> DataFrame:
    return iv.merge_intervals(_spans(t), ["subject"], "s", "e")


@query(
    f"""WITH x AS ({_SPANS}), b AS (SELECT *, max(e) OVER (PARTITION BY subject ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM b), m AS (SELECT subject, min(s) AS s, max(e) AS e FROM i GROUP BY subject, isle)
SELECT subject, CAST(sum(e - s) AS BIGINT) AS covered FROM m GROUP BY 1"""
)
def covered_length(t: Tables) -> DataFrame:
    return iv.covered_length(iv.merge_intervals(_spans(t), ["subject"], "s", "e"), ["subject"], "s", "e")


@query(
    f"""WITH x AS (SELECT subject, s, e, 1.0 + o_orderkey % 5 AS w, CAST(o_orderkey % 11 AS DOUBLE) AS v FROM ({_SPANS})), b AS (SELECT *, max(e) OVER (PARTITION BY subject ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s - before > 45 THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM b)
SELECT subject, min(s) AS s, max(e) AS e, CAST(sum(w) AS DOUBLE) AS w, floor(sum(v * w) / sum(w) * 10000 + 0.5) / 10000 AS v FROM i GROUP BY subject, isle"""
)
def nearby_merge(t: Tables) -> DataFrame:
    x = _spans(t).select("subject", "s", "e", (1.0 + F.col("o_orderkey") % 5).alias("w"), (F.col("o_orderkey") % 11).cast("double").alias("v"))
    return iv.merge_nearby(x, ["subject"], "s", "e", 45, "w", ["v"]).withColumn("v", rounded(F.col("v")))


_REG = """reg(class, pri, lo, hi) AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'Heterochromatin' WHEN 1 THEN 'Amplicon' WHEN 2 THEN 'Palindrome' ELSE 'PAR' END, p_partkey % 4, p_partkey * 40, p_partkey * 40 + p_size * 3 FROM part)"""


def _regions(t: Tables) -> DataFrame:
    p = F.col("p_partkey") % 4
    name = F.when(p == 0, "Heterochromatin").when(p == 1, "Amplicon").when(p == 2, "Palindrome").otherwise("PAR")
    return t.part.select(F.lit(1).alias("k"), name.alias("class"), p.alias("pri"), (F.col("p_partkey") * 40).alias("lo"), (F.col("p_partkey") * 40 + F.col("p_size") * 3).alias("hi"))


def _points(t: Tables) -> DataFrame:
    return t.orders.select(F.lit(1).alias("k"), "o_orderkey", F.floor(F.col("o_totalprice") / 10).cast("long").alias("pos"))


@query(f"WITH {_REG}, pts AS (SELECT o_orderkey, CAST(floor(o_totalprice / 10) AS BIGINT) AS pos FROM orders) SELECT o_orderkey, pos, arg_min(class, pri) AS class, count(*) AS hits FROM pts JOIN reg ON pos BETWEEN lo AND hi GROUP BY 1, 2")
def range_annotate(t: Tables) -> DataFrame:
    j = iv.point_in_interval(_points(t), _regions(t), ["k"], "pos", "lo", "hi", 128)
    return j.groupBy("o_orderkey", "pos").agg(F.min_by("class", "pri").alias("class"), F.count("*").alias("hits"))


@query(f"WITH {_REG} SELECT o_orderkey, CAST(floor(o_totalprice / 10) AS BIGINT) AS pos FROM orders WHERE EXISTS (SELECT 1 FROM reg WHERE floor(o_totalprice / 10) BETWEEN lo AND hi AND pri = 0)")
def region_mask(t: Tables) -> DataFrame:
    return iv.point_in_interval(_points(t), _regions(t).where("pri = 0"), ["k"], "pos", "lo", "hi", 128, "left_semi").drop("k")


@query(f"WITH x AS ({_SPANS}) SELECT a.subject, a.o_orderkey AS a_o_orderkey, b.o_orderkey AS b_o_orderkey, least(a.e, b.e) - greatest(a.s, b.s) + 1 AS overlap FROM x a JOIN x b ON a.subject = b.subject AND a.s <= b.e AND b.s <= a.e AND a.o_orderkey < b.o_orderkey")
def interval_overlap_pairs(t: Tables) -> DataFrame:
    x = _spans(t)
    j = iv.overlapping_pairs(x, x, ["subject"], "s", "e", 90).where("a_o_orderkey < b_o_orderkey")
    return j.select("subject", "a_o_orderkey", "b_o_orderkey", iv.overlap_length(F.col("a_s"), F.col("a_e"), F.col("b_s"), F.col("b_e")).alias("overlap"))


@query(
    """WITH c AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS x, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), m AS (SELECT user_id, x, CAST(min(r) AS DOUBLE) AS y FROM c WHERE event_id % 3 = 0 GROUP BY 1, 2), p AS (SELECT user_id, event_id, x FROM c WHERE event_id % 3 = 1),
n AS (SELECT *, lead(x) OVER (PARTITION BY user_id ORDER BY x) AS nx, lead(y) OVER (PARTITION BY user_id ORDER BY x) AS ny FROM m),
lo AS (SELECT p.user_id, p.event_id, p.x, l.x AS lx, l.y AS ly FROM p ASOF LEFT JOIN m l ON p.user_id = l.user_id AND p.x >= l.x), b AS (SELECT lo.*, h.x AS hx, h.y AS hy FROM lo ASOF LEFT JOIN m h ON lo.user_id = h.user_id AND lo.x <= h.x),
f AS (SELECT user_id, arg_min(x, x) AS fx, arg_min(y, x) AS fy, arg_min(nx, x) AS fnx, arg_min(ny, x) AS fny, arg_max(x, x) AS gx, arg_max(y, x) AS gy, arg_max(nx, x) AS gnx, arg_max(ny, x) AS gny FROM n WHERE nx IS NOT NULL GROUP BY 1)
SELECT b.user_id, event_id, floor((CASE WHEN lx IS NOT NULL AND hx IS NOT NULL THEN CASE WHEN lx = hx THEN ly ELSE ly + (b.x - lx) * (hy - ly) / (hx - lx) END WHEN fx IS NULL THEN coalesce(ly, hy) WHEN lx IS NULL THEN fy + (b.x - fx) * (fny - fy) / (fnx - fx) ELSE gy + (b.x - gx) * (gny - gy) / (gnx - gx) END) * 1000 + 0.5) / 1000 AS cm
FROM b LEFT JOIN f USING (user_id) WHERE lx IS NOT NULL OR hx IS NOT NULL"""
)
def asof_interpolate(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    c = t.events.select("user_id", epoch_seconds("ts").alias("x"), "event_id", F.row_number().over(w).alias("r"))
    curve = c.where("event_id % 3 = 0").groupBy("user_id", "x").agg(F.min("r").cast("double").alias("y"))
    got = iv.interpolate(c.where("event_id % 3 = 1").select("user_id", "event_id", "x"), curve, ["user_id"], "x", "x", "y", "cm")
    return got.where("cm is not null").select("user_id", "event_id", rounded(F.col("cm"), 3).alias("cm"))


@query("SELECT user_id, event_id, floor(avg(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) * 10000 + 0.5) / 10000 AS share FROM (SELECT *, CASE event_type WHEN 'view' THEN 1.0::DOUBLE WHEN 'click' THEN 0.5 ELSE 0 END AS s FROM events)")
def ibs_window(t: Tables) -> DataFrame:
    s = F.when(F.col("event_type") == "view", 1.0).when(F.col("event_type") == "click", 0.5).otherwise(0.0)
    return iv.sliding_share(t.events.withColumn("s", s), ["user_id"], ["ts", "event_id"], "s", 5, 5, "share").select("user_id", "event_id", rounded(F.col("share")).alias("share"))


@query(
    """WITH b AS (SELECT event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2), e AS (SELECT *, avg(n) OVER (PARTITION BY event_type) AS expected FROM b)
SELECT event_type, bin, n, floor((n - expected) / sqrt(greatest(expected, 1.0)) * 10000 + 0.5) / 10000 AS z FROM e"""
)
def depth_zscore(t: Tables) -> DataFrame:
    b = t.events.groupBy("event_type", F.floor(epoch_seconds("ts") / 86400).alias("bin")).agg(F.count("*").alias("n"))
    return iv.expected_depth_z(b, ["event_type"], "n").select("event_type", "bin", "n", rounded(F.col("z")).alias("z"))


@query("WITH x AS (SELECT c_nationkey, c_custkey, c_custkey - lag(c_custkey) OVER w AS l, lead(c_custkey) OVER w - c_custkey AS r FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)) SELECT c_nationkey, c_custkey FROM x WHERE (l IS NULL OR l > 10) AND (r IS NULL OR r > 10)")
def neighbour_filter(t: Tables) -> DataFrame:
    return iv.isolated(t.customer.select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey", 10)


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_returnflag, l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber) > 1 AS duplicate FROM lineitem")
def dup_mark(t: Tables) -> DataFrame:
    return iv.first_of_signature(t.lineitem, ["l_partkey", "l_returnflag", "l_linestatus"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "duplicate")


# ---- trees: region -> nation -> customer, ids offset by level


def _edges(t: Tables) -> DataFrame:
    r = t.region.select(F.col("r_regionkey").cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.col("r_name").alias("name"))
    n = t.nation.select((F.col("n_nationkey") + 1000).cast("long"), F.col("n_regionkey").cast("long"), "n_name")
    c = t.customer.select(F.col("c_custkey") + 100000, (F.col("c_nationkey") + 1000).cast("long"), "c_name")
    return r.union(n).union(c)


_TREE = """WITH RECURSIVE edges AS (SELECT CAST(r_regionkey AS BIGINT) AS node, CAST(NULL AS BIGINT) AS parent, r_name AS name FROM region UNION ALL SELECT n_nationkey + 1000, n_regionkey, n_name FROM nation UNION ALL SELECT c_custkey + 100000, c_nationkey + 1000, c_name FROM customer),
closed AS (SELECT node, node AS ancestor, 0 AS steps FROM edges UNION ALL SELECT c.node, e.parent, c.steps + 1 FROM closed c JOIN edges e ON e.node = c.ancestor WHERE e.parent IS NOT NULL)"""


def _closed(t: Tables) -> DataFrame:
    return tree.closure(_edges(t), depth_hint=2)


@query(_TREE + " SELECT node, ancestor, steps FROM closed")
def tree_closure(t: Tables) -> DataFrame:
    return _closed(t)


@query(_TREE + " SELECT c.node, CAST(max(steps) AS INTEGER) AS depth, string_agg(e.name, '>' ORDER BY steps DESC) AS path FROM closed c JOIN edges e ON e.node = c.ancestor GROUP BY 1")
def tree_path(t: Tables) -> DataFrame:
    e = _edges(t)
    return tree.paths(_closed(t), e.select("node", "name")).withColumn("path", F.array_join("path", ">"))


@query(_TREE + ", m AS (SELECT o_custkey + 100000 AS node, count(*) AS n FROM orders GROUP BY 1) SELECT ancestor, CAST(sum(n) AS BIGINT) AS members, CAST(sum(CASE WHEN steps = 0 THEN n ELSE 0 END) AS BIGINT) AS direct FROM closed JOIN m USING (node) GROUP BY 1")
def tree_rollup(t: Tables) -> DataFrame:
    return tree.roll_up(_closed(t), t.orders.select((F.col("o_custkey") + 100000).alias("node")))


@query(_TREE + " SELECT DISTINCT ancestor AS node FROM closed WHERE node IN (SELECT c_custkey + 100000 FROM customer WHERE c_acctbal > 9000)")
def induced_subtree(t: Tables) -> DataFrame:
    return tree.induced_subtree(_closed(t), t.customer.where("c_acctbal > 9000").select((F.col("c_custkey") + 100000).alias("node")))


@query(
    _TREE
    + """, def AS (SELECT node, (node * 7) % 97 AS pos FROM edges UNION SELECT node, (node * 13 + 5) % 97 FROM edges), onpath AS (SELECT DISTINCT c.node, d.pos FROM closed c JOIN def d ON d.node = c.ancestor),
x AS (SELECT node, count(*) AS expected FROM onpath GROUP BY 1), calls AS (SELECT DISTINCT o_custkey AS sample, o_orderkey % 97 AS pos FROM orders), rel AS (SELECT * FROM calls WHERE pos IN (SELECT pos FROM def)), f AS (SELECT sample, count(*) AS found FROM rel GROUP BY 1),
m AS (SELECT sample, node, count(*) AS matched FROM rel JOIN onpath USING (pos) GROUP BY 1, 2), s AS (SELECT sample, node, matched, (matched / expected + matched / found) / 2 AS score FROM m JOIN x USING (node) JOIN f USING (sample))
SELECT sample, node, matched, floor(score * 10000 + 0.5) / 10000 AS score FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY floor(score * 1e9 + 0.5) DESC, matched DESC, node) AS r FROM s) WHERE r = 1"""
)
def tree_score(t: Tables) -> DataFrame:
    e = _edges(t)
    d = e.select("node", (F.col("node") * 7 % 97).alias("pos")).union(e.select("node", ((F.col("node") * 13 + 5) % 97).alias("pos"))).distinct()
    s = tree.placement_scores(_closed(t), d, t.orders.select(F.col("o_custkey").alias("sample"), (F.col("o_orderkey") % 97).alias("pos")), best=True)
    return tree.best_nodes(s).select("sample", "node", "matched", rounded(F.col("score")).alias("score"))


@query(
    """WITH s AS (SELECT o_custkey AS sample, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS depth, o_orderstatus <> 'F' AS derived FROM orders), b AS (SELECT *, CAST(sum(CASE WHEN derived THEN 1 ELSE -1 END) OVER (PARTITION BY sample ORDER BY depth) AS BIGINT) AS balance FROM s)
SELECT sample, node, CAST(depth AS INTEGER) AS depth, balance FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY balance DESC, CASE WHEN derived THEN depth ELSE -depth END DESC) AS r FROM b) WHERE r = 1"""
)
def support_backoff(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    s = t.orders.select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("node"), F.row_number().over(w).alias("depth"), (F.col("o_orderstatus") != "F").alias("derived"))
    return tree.supported_terminal(s)


@query(
    _TREE
    + """, ev AS (SELECT e.node, count(o_orderkey) FILTER (o_orderstatus = 'F') AS derived, count(o_orderkey) FILTER (o_orderstatus <> 'F') AS ancestral FROM edges e LEFT JOIN orders ON o_custkey + 100000 = e.node OR (e.node < 100000 AND o_custkey = e.node) GROUP BY 1),
b AS (SELECT ancestor AS node, CAST(sum(derived) AS BIGINT) AS below FROM closed JOIN ev USING (node) WHERE steps > 0 GROUP BY 1)
SELECT ev.node, derived, ancestral, coalesce(below, 0) AS below, (ancestral <= derived OR (derived >= 1 AND coalesce(below, 0) >= 4)) AS passable FROM ev LEFT JOIN b USING (node)"""
)
def tree_admissible(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderstatus")
    hit = o.select((F.col("o_custkey") + 100000).alias("node"), "o_orderstatus").union(o.where("o_custkey < 100000").select(F.col("o_custkey").alias("node"), "o_orderstatus"))
    n = hit.groupBy("node").agg(F.count_if(F.col("o_orderstatus") == "F").alias("derived"), F.count_if(F.col("o_orderstatus") != "F").alias("ancestral"))
    ev = _edges(t).select("node").join(n, "node", "left").na.fill(0)
    return tree.admissible(_closed(t), ev)


@query(
    """WITH p AS (SELECT p_partkey, string_split(p_type, ' ') AS path, p_brand FROM part), b AS (SELECT p_brand, min(path) AS lo, max(path) AS hi, count(*) AS paths FROM p GROUP BY 1)
SELECT p_brand, paths, array_to_string(CASE WHEN lo[1] <> hi[1] THEN [] WHEN len(lo) < 2 OR len(hi) < 2 OR lo[2] <> hi[2] THEN lo[1:1] WHEN len(lo) < 3 OR len(hi) < 3 OR lo[3] <> hi[3] THEN lo[1:2] ELSE lo[1:3] END, ' ') AS shared FROM b"""
)
def lineage_prefix(t: Tables) -> DataFrame:
    p = t.part.select("p_brand", F.split("p_type", " ").alias("path"))
    return tree.shared_lineage(p, ["p_brand"], "path").withColumn("shared", F.array_join("shared", " "))


_PROFILE = "WITH p AS (SELECT l_suppkey AS s, l_partkey % 25 AS m, CAST(max(l_quantity) AS INTEGER) % 4 AS v FROM lineitem GROUP BY 1, 2), d AS (SELECT a.s AS a, b.s AS b, count(*) AS compared, count(*) FILTER (a.v <> b.v) AS differing FROM p a JOIN p b ON a.m = b.m AND a.s < b.s GROUP BY 1, 2)"


def _profiles(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 25).alias("m")).agg((F.max("l_quantity").cast("int") % 4).alias("v"))


@query(_PROFILE + " SELECT a, b, compared, differing, floor(differing / (2 * compared * 0.0025) * 32 * 100 + 0.5) / 100 AS years FROM d")
def pairwise_distance(t: Tables) -> DataFrame:
    return match.pair_distances(_profiles(t), "s", "m", "v").withColumn("years", rounded(match.str_tmrca(F.col("differing"), F.col("compared")), 2))


@query(_PROFILE + ", u AS (SELECT a, b, compared, differing FROM d UNION ALL SELECT b, a, compared, differing FROM d) SELECT a, b, compared, differing, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY differing / compared, compared DESC, b) AS place FROM u) WHERE place <= 3")
def nearest_members(t: Tables) -> DataFrame:
    return match.nearest_of_all(_profiles(t), "s", "m", "v", 3)


@query(
    _PROFILE.replace("WITH p", "WITH RECURSIVE p")
    + """, e AS (SELECT a, b FROM d WHERE differing * 10 <= compared * 6 UNION SELECT b, a FROM d WHERE differing * 10 <= compared * 6), r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT node, min(root) AS root FROM r GROUP BY 1"""
)
def cluster_components(t: Tables) -> DataFrame:
    return tree.connected_components(match.linked_pairs(_profiles(t), "s", "m", "v", 6))


@query(
    """WITH s AS (SELECT o_custkey AS pair, CAST(floor(o_totalprice / 4000 + 0.5) AS BIGINT) AS cm FROM orders), g AS (SELECT pair, CAST(sum(cm) AS BIGINT) AS total_cm, count(*) AS segments, max(cm) AS longest_cm FROM s GROUP BY 1)
SELECT *, CASE WHEN total_cm >= 3400 THEN 'ParentChild' WHEN total_cm >= 2550 THEN 'FullSibling' WHEN total_cm >= 1700 THEN 'Grandparent' WHEN total_cm >= 1200 THEN 'AuntUncle' WHEN total_cm >= 680 THEN 'FirstCousin' WHEN total_cm >= 400 THEN 'FirstCousinOnceRemoved' WHEN total_cm >= 200 THEN 'SecondCousin' WHEN total_cm >= 90 THEN 'SecondCousinOnceRemoved' WHEN total_cm >= 50 THEN 'ThirdCousin' WHEN total_cm >= 25 THEN 'FourthCousin' WHEN total_cm >= 10 THEN 'FifthCousin' WHEN total_cm >= 7 THEN 'Distant' ELSE 'Unknown' END AS relationship FROM g"""
)
def match_summary(t: Tables) -> DataFrame:
    return match.match_summary(t.orders.select(F.col("o_custkey").alias("pair"), F.floor(F.col("o_totalprice") / 4000 + 0.5).alias("cm")), ["pair"])


@query(
    """WITH a AS (SELECT c_custkey, c_nationkey, c_mktsegment, CAST(floor(c_acctbal) AS BIGINT) AS b FROM customer)
SELECT x.c_custkey AS a, y.c_custkey AS b, floor((CASE WHEN x.c_mktsegment = y.c_mktsegment THEN 0.6 ELSE 0.0 END + CASE WHEN abs(x.b - y.b) % 80 >= 67 AND abs(x.b - y.b) % 3 <= 1 THEN 0.8 WHEN abs(x.b - y.b) % 80 >= 37 AND abs(x.b - y.b) % 3 = 0 THEN 0.7 ELSE 0.0 END) * 1000 + 0.5) / 1000 AS score
FROM a x JOIN a y ON x.c_nationkey = y.c_nationkey AND x.c_custkey < y.c_custkey"""
)
def fuzzy_kit_match(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", F.floor("c_acctbal").alias("n"))
    j = match.pairs_in_groups(c, "c_nationkey", "c_custkey")
    d = F.abs(F.col("x.n") - F.col("y.n"))
    return j.select(F.col("x.c_custkey").alias("a"), F.col("y.c_custkey").alias("b"), rounded(match.fuzzy_score(F.col("x.c_mktsegment") == F.col("y.c_mktsegment"), d % 80, d % 3, F.lit(0.0)), 3).alias("score"))
