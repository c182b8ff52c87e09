"""Placement of samples on a lineage tree: locus states, scores, guarded choice, descent and reports.

Tables: ``nodes`` (node, parent, name; roots have no parent), ``loci`` (node, name, pos, ancestral, derived),
``calls`` (sample, pos, base). A call meets only the loci at its position, and only nodes that a call touches are
scored: a node without calls never ranks above the nearest touched node over it, which has the same matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.genotype import complement, palindromic
from helixframe.operators.nested import nested_sets, within
from helixframe.operators.scan import numbered
from helixframe.session import materialize

#: Call of an insertion or deletion that is carried, and of one that isn't: fixed values.
INDEL_DERIVED, INDEL_ANCESTRAL = "+", "-"
#: Derived calls below a contradicted node that redeem it, and those that a child needs to be entered: fixed values.
REDEEM_DERIVED, ENTER_DERIVED = 4, 2


def is_snp(ancestral: Column, derived: Column) -> Column:
    return (F.length(derived) == 1) & (F.length(F.coalesce(ancestral, F.lit(""))) <= 1)


def locus_state(ancestral: Column, derived: Column, base: Column) -> Column:
    """Derived, Ancestral or NoCall; a base of the other strand counts unless the pair reads the same on both."""
    a, d, b = F.upper(F.coalesce(ancestral, F.lit(""))), F.upper(derived), F.upper(base)
    other = complement(b)
    flips = ~palindromic(a, d)
    snp = F.when(b == d, "Derived").when(b == a, "Ancestral").when(flips & (other == d), "Derived").when(flips & (other == a), "Ancestral")
    indel = F.when(base == INDEL_DERIVED, "Derived").when(base == INDEL_ANCESTRAL, "Ancestral")
    known = F.length(F.coalesce(derived, F.lit(""))) > 0
    return F.coalesce(F.when(known & is_snp(ancestral, derived), snp).when(known, indel), F.lit("NoCall"))


def states(loci: DataFrame, calls: DataFrame) -> DataFrame:
    """Every call at every locus of its position, with its state."""
    return calls.join(loci, "pos").withColumn("state", locus_state(F.col("ancestral"), F.col("derived"), F.col("base")))


def node_counts(found: DataFrame, loci: DataFrame) -> DataFrame:
    """(sample, node, derived, ancestral, no_call) of touched nodes; loci without a call count as no call."""
    sized = loci.where(F.length(F.coalesce("derived", F.lit(""))) > 0).groupBy("node").agg(F.count("*").alias("loci"))
    n = found.groupBy("sample", "node").agg(F.count_if(F.col("state") == "Derived").alias("derived"), F.count_if(F.col("state") == "Ancestral").alias("ancestral"))
    return n.join(sized, "node").select("sample", "node", "derived", "ancestral", (F.col("loci") - F.col("derived") - F.col("ancestral")).alias("no_call"))


def _expected(closed: DataFrame, loci: DataFrame) -> DataFrame:
    """Positions of single-base loci from the root down to each node; indels count only where a sample has them."""
    own = loci.where(is_snp(F.col("ancestral"), F.col("derived"))).select(F.col("node").alias("ancestor"), "pos")
    counted = closed.join(own, "ancestor").groupBy("node").agg(F.count_distinct("pos").alias("expected"))
    return closed.select("node").distinct().join(counted, "node", "left").na.fill(0, ["expected"])


def rank_paths(nodes: DataFrame, closed: DataFrame, loci: DataFrame, found: DataFrame) -> DataFrame:
    """(sample, node, depth, order, matched, expected, found, score, admissible) of touched nodes and the roots.

    ``order`` is the path of ids, so that ties go to the node nearer the root, then to the first in pre-order.
    A path is refused if it passes a contradicted node without derived calls, or with too few derived calls below.
    """
    one = found.groupBy("sample", "node", "pos").agg(F.first("ancestral").alias("ancestral"), F.first("derived").alias("derived"), F.max(F.when(F.col("state") == "Derived", 2).when(F.col("state") == "Ancestral", 1).otherwise(0)).alias("s"))
    indel = ~is_snp(F.col("ancestral"), F.col("derived"))
    own = one.groupBy("sample", "node").agg(F.count_if(F.col("s") == 2).alias("d"), F.count_if(F.col("s") == 1).alias("a"), F.count_if(indel & (F.col("s") > 0)).alias("indels"))
    total = one.where("s = 2").groupBy("sample").agg(F.count_distinct("pos").alias("found"))
    roots = nodes.where(F.col("parent").isNull()).select("node")
    touched = own.select("sample", "node").union(own.select("sample").distinct().join(F.broadcast(roots))).distinct()
    # Each candidate meets the touched nodes over it: as many rows as calls times the depth of the tree.
    up = touched.join(closed, "node").join(own.withColumnRenamed("node", "ancestor"), ["sample", "ancestor"], "left").na.fill(0, ["d", "a", "indels"])
    below = F.coalesce(F.sum("d").over(Window.partitionBy("sample", "node").orderBy("steps").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    refused = (F.col("a") > F.col("d")) & ((F.col("d") == 0) | (below < REDEEM_DERIVED))
    path = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("k"), F.col("ancestor").alias("x")))), lambda s: s["x"])
    sums = up.withColumn("refused", refused).groupBy("sample", "node").agg(F.sum("d").alias("matched"), F.sum("indels").alias("indels"), F.max("refused").alias("refused"), F.max("steps").alias("depth"), path.alias("order"))
    r = sums.join(_expected(closed, loci), "node").join(total, "sample", "left").na.fill(0, ["found"]).withColumn("expected", F.col("expected") + F.col("indels"))
    score = F.when((F.col("expected") > 0) & (F.col("found") > 0), 0.5 * (F.col("matched") / F.col("expected") + F.col("matched") / F.col("found"))).otherwise(0.0)
    return r.withColumn("score", score).select("sample", "node", "depth", "order", "matched", "expected", "found", "score", (~F.col("refused")).alias("admissible"))


def deepen(nodes: DataFrame, counts: DataFrame, starts: DataFrame) -> DataFrame:
    """(sample, node, terminal): from each start down into children that the sample clearly entered.

    Such a child has two derived calls and no more ancestral ones; the most derived wins, then the smaller id. Jumps
    double every round, so a path of length n takes log n joins.
    """
    entered = counts.where((F.col("ancestral") <= F.col("derived")) & (F.col("derived") >= ENTER_DERIVED)).join(nodes.select("node", "parent").where(F.col("parent").isNotNull()), "node")
    best = F.max_by("node", F.struct("derived", (-F.col("node")).alias("k")))
    jump = materialize(entered.groupBy("sample", F.col("parent").alias("node")).agg(best.alias("to")), "descent")
    far = jump
    while True:
        step = far.select("sample", F.col("node").alias("to"), F.col("to").alias("further"))
        far = materialize(far.join(step, ["sample", "to"], "left").select("sample", "node", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "descent")
        if far.where("moved").limit(1).count() == 0:
            break
        far = far.drop("moved")
    return starts.join(far.select("sample", "node", "to"), ["sample", "node"], "left").select("sample", "node", F.coalesce("to", "node").alias("terminal"))


def _best(ranked: DataFrame, guarded: bool) -> DataFrame:
    # Without an admissible path the first in rank is taken as it is.
    first = F.struct((F.col("admissible") if guarded else F.lit(True)).alias("ok"), "score", (-F.col("depth")).alias("up"))
    top = ranked.withColumn("k", first)
    most = top.groupBy("sample").agg(F.max("k").alias("k"))
    return top.join(most, ["sample", "k"]).groupBy("sample").agg(F.min_by("node", "order").alias("node"), F.max("k.ok").alias("ok"))


def place(nodes: DataFrame, closed: DataFrame, loci: DataFrame, calls: DataFrame) -> DataFrame:
    """(sample, start, terminal): the best admissible node, then down into what the sample clearly entered."""
    found = materialize(states(loci, calls), "states")
    top = materialize(_best(rank_paths(nodes, closed, loci, found), True), "top")
    down = deepen(nodes, node_counts(found, loci), top.select("sample", "node"))
    out = top.join(down, ["sample", "node"])
    return out.select("sample", F.col("node").alias("start"), F.when(F.col("ok"), F.col("terminal")).otherwise(F.col("node")).alias("terminal"))


def supported(closed: DataFrame, loci: DataFrame, calls: DataFrame, ends: DataFrame) -> DataFrame:
    """(sample, terminal, kept): the node on each path at which derived calls most exceed all others, literally read.

    Ties go deeper only to a node with a derived call of its own.
    """
    first = lambda c: F.upper(F.substring(c, 1, 1))
    usable = loci.where((F.length("derived") > 0) & (F.length("ancestral") > 0))
    hit = calls.join(usable, "pos").withColumn("v", F.when(F.upper("base") == first("derived"), 1).otherwise(-1))
    own = hit.groupBy("sample", F.col("node").alias("ancestor")).agg(F.sum("v").alias("v"), F.max(F.col("v") > 0).alias("own"))
    up = ends.select("sample", F.col("terminal").alias("node")).join(closed, "node").join(own, ["sample", "ancestor"], "left")
    w = Window.partitionBy("sample", "node").orderBy(F.desc("steps")).rowsBetween(Window.unboundedPreceding, 0)
    up = up.withColumn("balance", F.sum(F.coalesce("v", F.lit(0))).over(w))
    at = F.max_by("ancestor", F.struct("balance", F.when(F.col("own"), -F.col("steps")).otherwise(F.col("steps") - 1_000_000).alias("k")))
    return up.groupBy("sample", F.col("node").alias("terminal")).agg(at.alias("kept"))


def place_robust(nodes: DataFrame, closed: DataFrame, loci: DataFrame, calls: DataFrame) -> DataFrame:
    """(sample, start, terminal) for sparse panels: the best score unguarded, deepened, then backed off to support."""
    found = materialize(states(loci, calls), "states")
    top = materialize(_best(rank_paths(nodes, closed, loci, found), False), "top")
    down = deepen(nodes, node_counts(found, loci), top.select("sample", "node"))
    down = materialize(down, "down")
    kept = supported(closed, loci, calls, down)
    return down.join(kept, ["sample", "terminal"]).select("sample", F.col("node").alias("start"), F.col("kept").alias("terminal"))


def lineage_evidence(closed: DataFrame, loci: DataFrame, found: DataFrame, ends: DataFrame) -> DataFrame:
    """(sample, terminal, depth, node, name, pos, state) of every locus from the root to each sample's terminal."""
    path = ends.select("sample", "terminal").join(closed.select(F.col("node").alias("terminal"), F.col("ancestor").alias("node"), "steps"), "terminal").join(loci, "node")
    said = found.select("sample", "node", "pos", "state")
    return path.join(said, ["sample", "node", "pos"], "left").select("sample", "terminal", F.col("steps").alias("up"), "node", "name", "pos", F.coalesce("state", F.lit("NoCall")).alias("state"))


def child_evidence(nodes: DataFrame, loci: DataFrame, found: DataFrame, ends: DataFrame) -> DataFrame:
    """(sample, terminal, child, derived, ancestral, no_call) of the terminal's children that have loci."""
    kids = ends.select("sample", "terminal").join(nodes.select(F.col("node").alias("child"), F.col("parent").alias("terminal")), "terminal")
    rows = kids.join(loci.select(F.col("node").alias("child"), "pos"), "child").join(found.select("sample", F.col("node").alias("child"), "pos", "state"), ["sample", "child", "pos"], "left")
    is_ = lambda s: F.count_if(F.coalesce(F.col("state"), F.lit("NoCall")) == s)
    return rows.groupBy("sample", "terminal", "child").agg(is_("Derived").alias("derived"), is_("Ancestral").alias("ancestral"), is_("NoCall").alias("no_call"))


def preorder(nodes: DataFrame) -> DataFrame:
    """(node, depth, place): pre-order with children by name, then id; the place counts from 1 over the whole forest."""
    labels = nested_sets(nodes.select("node", "parent", "name"), ["name", "node"])
    return labels.select("node", "depth", (F.col("entry") + 1).cast("int").alias("place"))


def subtree_report(nodes: DataFrame, loci: DataFrame, found: DataFrame, root: int, sample: int, max_depth: int | None = None) -> DataFrame:
    """(place, node, parent, name, pos, state): markers of the subtree in pre-order; ``max_depth`` 0 is the root alone."""
    labels = materialize(nested_sets(nodes.select("node", "parent", "name"), ["name", "node"]), "labels")
    top = labels.where(F.col("node") == root).select(F.col("entry").alias("_from"), F.col("exit").alias("_to"), F.col("depth").alias("_depth"))
    inside = labels.join(F.broadcast(top), within(F.col("entry"), F.col("_from"), F.col("_to")))  # one row
    if max_depth is not None:
        inside = inside.where(F.col("depth") - F.col("_depth") <= max_depth)
    order = numbered(inside.select("node", "entry"), [], ["entry"]).select("node", "place")
    parents = nodes.select(F.col("node").alias("parent"), F.col("name").alias("parent_name"))
    rows = order.join(nodes.select("node", "parent", F.col("name").alias("node_name")), "node").join(parents, "parent", "left").join(loci, "node")
    said = found.where(F.col("sample") == sample).select("node", "pos", "state")
    shown = ("place", F.col("node_name").alias("node"), F.coalesce("parent_name", F.lit("")).alias("parent"), "name", "pos", F.coalesce("state", F.lit("NoCall")).alias("state"))
    return rows.join(said, ["node", "pos"], "left").select(*shown)


def normalize_polarity(loci: DataFrame, reference: DataFrame) -> DataFrame:
    """Loci whose alleles are the reference's the wrong way round, turned; ``reference``: name, ancestral, derived."""
    r = reference.select("name", F.upper("ancestral").alias("ra"), F.upper("derived").alias("rd"))
    j = loci.join(r, "name", "left")
    a, d = F.upper("ancestral"), F.upper("derived")
    turned = F.coalesce((F.col("name") != "") & (a != d) & (a == F.col("rd")) & (d == F.col("ra")), F.lit(False))
    return j.withColumn("turned", turned).select(*(c for c in loci.columns if c not in ("ancestral", "derived")), F.when(turned, F.col("derived")).otherwise(F.col("ancestral")).alias("ancestral"), F.when(turned, F.col("ancestral")).otherwise(F.col("derived")).alias("derived"), "turned")


def polarity_map(loci: DataFrame) -> DataFrame:
    """(name, ancestral, derived): one polarity a name, that of the smallest node; nameless loci are left out."""
    usable = loci.where((F.trim("name") != "") & (F.length("derived") > 0))
    first = F.min_by(F.struct("ancestral", "derived"), F.struct("node", "pos"))
    return usable.groupBy(F.upper(F.trim("name")).alias("name")).agg(first.alias("x")).select("name", "x.*")


def name_at_position(nodes: DataFrame, loci: DataFrame) -> DataFrame:
    """(pos, node_name): one node a position, the smallest id."""
    return loci.join(nodes.select("node", F.col("name").alias("node_name")), "node").groupBy("pos").agg(F.min_by("node_name", "node").alias("node_name"))


def find_nodes(nodes: DataFrame, loci: DataFrame, wanted: DataFrame, query: str = "query") -> DataFrame:
    """``wanted`` with ``node``: by the node's name, else by a marker's, any case, the smallest id."""
    q = wanted.select(query).distinct().withColumn("_q", F.upper(F.trim(query)))
    by_name = nodes.groupBy(F.upper("name").alias("_q")).agg(F.min("node").alias("n1"))
    by_marker = loci.groupBy(F.upper("name").alias("_q")).agg(F.min("node").alias("n2"))
    found = q.join(by_name, "_q", "left").join(by_marker, "_q", "left").select(query, F.coalesce("n1", "n2").alias("node"))
    return wanted.join(found, query)


def reconcile_calls(calls: DataFrame, key: list[str]) -> DataFrame:
    """Consensus of the sources' calls (haplogroup, lineage array, score, source): haplogroup, length, compatibility,
    confidence, runs, tentative.

    Calls on one path from the root give the most confident call, with the deeper ones counted as tentative; the later
    source wins a tie. Calls that diverge give the last node they share, and their mean score.
    """
    w = Window.partitionBy(*key)
    longest = F.max(F.struct(F.size("lineage").alias("n"), F.col("lineage").alias("x"))).over(w)
    c = calls.withColumn("_long", longest).withColumn("_on", F.slice("_long.x", F.lit(1), F.size("lineage")) == F.col("lineage"))
    best = F.max_by(F.struct("haplogroup", "lineage", "score"), F.struct("score", "source"))
    g = c.groupBy(*key).agg(F.min("_on").alias("on_path"), best.alias("b"), F.collect_list(F.size("lineage")).alias("sizes"), F.min("lineage").alias("lo"), F.max("lineage").alias("hi"), F.max("_long.n").alias("deepest"), F.count("*").alias("runs"), F.avg("score").alias("mean"))
    from helixframe.operators.tree import common_prefix

    shared = F.slice("lo", F.lit(1), common_prefix(F.col("lo"), F.col("hi")))
    n = F.size(shared)
    level = F.when(n <= 1, "Incompatible").when(n / F.greatest("deepest", F.lit(1)) >= 0.66, "MinorDivergence").otherwise("MajorDivergence")
    tentative = F.size(F.filter("sizes", lambda s: s > F.size("b.lineage")))
    return g.select(
        *key,
        F.when(F.col("on_path"), F.col("b.haplogroup")).otherwise(F.when(n == 0, "root").otherwise(F.get(shared, n - 1))).alias("haplogroup"),
        F.when(F.col("on_path"), F.size("b.lineage")).otherwise(n).alias("nodes"),
        F.when(F.col("on_path"), "Compatible").otherwise(level).alias("compatibility"),
        F.when(F.col("on_path"), F.col("b.score")).otherwise(F.col("mean")).alias("confidence"),
        "runs",
        F.when(F.col("on_path"), tentative).otherwise(0).alias("tentative"),
    )


def collapse_unary(nodes: DataFrame, members: DataFrame, min_run: int = 2) -> DataFrame:
    """(node, parent, collapsed): chains of nodes without members and with one child fold into the branch below them.

    ``collapsed`` names the folded nodes from the root down. Chains are followed by doubling: a folded node jumps to
    the node below it, and runs shorter than ``min_run`` stay.
    """
    kids = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"), F.min("node").alias("below"))
    own = members.select("node").distinct().withColumn("has", F.lit(True))
    n = nodes.join(kids, "node", "left").join(own, "node", "left")
    thin = n.where((F.col("kids") == 1) & F.col("has").isNull()).select("node", "below", F.col("name"), "parent")
    # (node, end, run): the first node below that isn't thin, and how many thin nodes lie from here to it.
    far = materialize(thin.select("node", F.col("below").alias("end"), F.lit(1).alias("run")), "chains")
    while True:
        step = far.select(F.col("node").alias("end"), F.col("end").alias("further"), F.col("run").alias("more"))
        far = materialize(far.join(step, "end", "left").select("node", F.coalesce("further", "end").alias("end"), (F.col("run") + F.coalesce("more", F.lit(0))).alias("run"), F.col("further").isNotNull().alias("moved")), "chains")
        if far.where("moved").limit(1).count() == 0:
            break
        far = far.drop("moved")
    runs = far.groupBy("end").agg(F.max("run").alias("length")).where(F.col("length") >= min_run)
    folded = far.join(runs, "end").join(thin.select("node", "name", "parent"), "node")
    top = folded.groupBy("end").agg(F.max_by(F.col("parent"), "run").alias("head_parent"), F.transform(F.sort_array(F.collect_list(F.struct((-F.col("run")).alias("k"), "name"))), lambda s: s["name"]).alias("collapsed"))
    kept = nodes.join(folded.select("node"), "node", "left_anti").join(top, F.col("node") == F.col("end"), "left")
    return kept.select("node", F.when(F.col("end").isNotNull(), F.col("head_parent")).otherwise(F.col("parent")).alias("parent"), F.coalesce("collapsed", F.array().cast("array<string>")).alias("collapsed"))


#: Positions closer than this define no separate branches; a share of donors that makes a variant common, and the
#: donors from which that is asked: fixed values.
CLUSTER_BP, COMMON_SHARE, COMMON_DONORS = 1000, 0.25, 20


def candidate_positions(carried: DataFrame) -> DataFrame:
    """(block, pos, carriers) that may define a new branch below a block; ``carried``: block, member, pos.

    Out go positions that two blocks share, those that more than a quarter of many donors carry, and those within
    1 kb of another.
    """
    c = carried.distinct()
    donors = c.agg(F.count_distinct("member").alias("donors"))
    common = c.groupBy("pos").agg(F.count_distinct("member").alias("n")).join(F.broadcast(donors)).where((F.col("donors") >= COMMON_DONORS) & (F.col("n") > F.ceil(F.col("donors") * COMMON_SHARE))).select("pos")
    shared = c.groupBy("block", "pos").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("member")).alias("carriers")).where("n >= 2")
    blocks = shared.groupBy("pos").agg(F.count("*").alias("blocks"))
    # Neighbours are looked up in buckets of the window, so that no sort takes all positions into one task.
    spread = blocks.select("pos", F.floor(F.col("pos") / CLUSTER_BP).alias("bin"))
    other = spread.select(F.col("pos").alias("near"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    clustered = spread.join(other, "bin").where((F.col("pos") != F.col("near")) & (F.abs(F.col("pos") - F.col("near")) <= CLUSTER_BP)).select("pos").distinct()
    again = blocks.where("blocks > 1").select("pos")
    return shared.join(again.union(common).union(clustered).distinct(), "pos", "left_anti").select("block", "pos", "carriers")


def candidate_branches(carried: DataFrame) -> DataFrame:
    """(block, rank, carriers, positions, accepted): groups of members by the variants they share, largest first.

    A group is accepted while each accepted group of its block holds it, lies in it or shares no member with it. The
    groups of one block are few and are chosen in order in one kernel.
    """
    from helixframe.operators.kernels import grouped

    g = candidate_positions(carried).groupBy("block", "carriers").agg(F.sort_array(F.collect_list("pos")).alias("positions"))

    def kernel(b):
        import pandas as pd

        rows = sorted(zip(b["carriers"], b["positions"], strict=True), key=lambda r: (-len(r[0]), -len(r[1]), r[1][0]))
        taken: list[frozenset] = []
        out = []
        for k, (members, positions) in enumerate(rows):
            s = frozenset(members)
            ok = all(len(s & t) in (0, len(s), len(t)) for t in taken)
            if ok:
                taken.append(s)
            out.append((b["block"].iloc[0], k + 1, ",".join(map(str, members)), ",".join(map(str, positions)), ok))
        return pd.DataFrame(out, columns=["block", "rank", "carriers", "positions", "accepted"])

    return grouped(g, ["block"], kernel, "block long, rank long, carriers string, positions string, accepted boolean")
