"""Trees as nested sets: every node's entry and exit number, in place of all pairs of node and ancestor.

A tour goes down into each node and up out of it; each of these arcs knows the next one from the node's first child, next
sibling or parent. Ranking the list of arcs by doubling (an arc's distance, then that of the arc it points to) takes the
logarithm of the tree's size in rounds, each a join of the arcs with themselves, whatever the depth. A subtree is then
the range [entry, exit): roll-ups are differences of running sums, and the depth of the lowest common ancestor is the
least depth in a range, found in a table of ranges of two to the k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.scan import Running, range_blocks, running
from helixframe.session import materialize


def _sorted(rows: DataFrame) -> DataFrame:
    """``rows`` to be joined by sorting: a side that grows with the tree passes the driver in no round, small as its
    packed file may look."""
    return rows.hint("merge")


def _arcs(edges: DataFrame, order: list[str]) -> DataFrame:
    """(node, up, to, to_up, step): each arc with the one after it; none follows a root's last."""
    # The next of some siblings is the first met when their order is run through from its end.
    falling = [F.col(c).desc() for c in order]
    placed = range_blocks(edges.select("node", "parent", *(c for c in order if c != "node")), ["parent"], falling)
    placed = running(placed, ["parent"], falling, [Running("next", F.col("node"), "last", inclusive=False)])
    placed = placed.withColumn("next", F.when(F.col("parent").isNotNull(), F.col("next")))
    first = placed.groupBy("parent").agg(F.min_by("node", F.struct(*order)).alias("child")).where("parent is not null")
    down = placed.select("node").join(_sorted(first.withColumnRenamed("parent", "node")), "node", "left")
    down = down.select("node", F.lit(False).alias("up"), F.coalesce("child", "node").alias("to"), F.col("child").isNull().alias("to_up"), F.lit(1).alias("step"))
    up = placed.select("node", F.lit(True).alias("up"), F.coalesce("next", "parent").alias("to"), F.col("next").isNull().alias("to_up"), F.lit(-1).alias("step"))
    return down.union(up)


def _doubled(arcs: DataFrame) -> DataFrame:
    """``arcs`` that reach as far again."""
    far = arcs.select(F.col("node").alias("to"), F.col("up").alias("to_up"), *(F.col(c).alias(f"{c}2") for c in ("to", "to_up", "step", "downs", "end")))
    moving = arcs.where(F.col("to").isNotNull()).join(_sorted(far), ["to", "to_up"])
    moved = moving.select("node", "up", F.col("to2").alias("to"), F.col("to_up2").alias("to_up"), (F.col("step") + F.col("step2")).alias("step"), (F.col("downs") + F.col("downs2")).alias("downs"), F.col("end2").alias("end"))
    return arcs.where(F.col("to").isNull()).union(moved)


def nested_sets(edges: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(node, root, depth, entry, exit) of a forest; ``edges``: node, parent (null for roots) and the columns of ``order``.

    Siblings come in ``order`` (the node itself, unless given; without ties), trees in that of their roots. Entries count
    from 0 over the whole forest; [entry, exit) are the entries of the node's subtree. A cycle is an error.
    """
    order = order or ["node"]
    edges = materialize(edges.select("node", "parent", *(c for c in order if c != "node")), "edges")
    n = edges.count()
    # ``end`` is the arc that an arc's stretch ends with: its tree's root, when nothing follows.
    arcs = _arcs(edges, order).select("node", "up", "to", "to_up", "step", F.when(F.col("step") > 0, 1).otherwise(0).alias("downs"), F.col("node").alias("end"))
    arcs = materialize(arcs, "arcs")
    reach = 1
    while arcs.where(F.col("to").isNotNull()).limit(1).count():
        if reach > 4 * n:
            raise ValueError("the edges hold a cycle")
        arcs, reach = materialize(_doubled(arcs), "arcs"), reach * 2
    # What is left of the tour after an arc: depth and place from its end, by tree.
    down = lambda x: F.max(F.when(~F.col("up"), x))
    at = arcs.groupBy("node").agg(down(-F.col("step")).alias("depth"), down(F.col("downs")).alias("left"), F.max(F.when(F.col("up"), F.col("downs"))).alias("after"), F.max("end").alias("root"))
    at = materialize(at, "places")
    roots = edges.where(F.col("parent").isNull()).join(_sorted(at.select("node", F.col("left").alias("nodes"))), "node")
    placed = range_blocks(roots.select("node", "nodes", *(c for c in order if c != "node")), [], [F.col(c) for c in order])
    trees = running(placed, [], [F.col(c) for c in order], [Running("upto", F.col("nodes"), "sum")]).select(F.col("node").alias("root"), F.col("upto").cast("long").alias("upto"))
    own = at.join(_sorted(trees), "root")
    return own.select("node", "root", F.col("depth").cast("int").alias("depth"), (F.col("upto") - F.col("left")).alias("entry"), (F.col("upto") - F.col("after")).alias("exit"))


def below(labels: DataFrame, counts: DataFrame, value: str = "n") -> DataFrame:
    """``labels`` with ``own``, the node's value, and ``total``, that of its subtree: one running sum, read twice."""
    rows = labels.join(_sorted(counts.select("node", F.col(value).alias("own"))), "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    rows = materialize(running(range_blocks(rows, [], ["entry"]), [], ["entry"], [Running("upto", F.col("own"), "sum")]).drop("_block"), "upto")
    last = rows.select((F.col("entry") + 1).alias("exit"), F.col("upto").alias("end"))
    return rows.join(_sorted(last), "exit").select("node", "root", "depth", "entry", "exit", "own", (F.col("end") - F.col("upto") + F.col("own")).alias("total"))


def roll_up(labels: DataFrame, members: DataFrame) -> DataFrame:
    """(ancestor, members, direct): members at or below each node that has some; ``members``: one row each, with node."""
    n = members.groupBy("node").agg(F.count("*").alias("n"))
    return below(labels, n).where("total > 0").select(F.col("node").alias("ancestor"), F.col("total").alias("members"), F.col("own").alias("direct"))


def induced(labels: DataFrame, terminals: DataFrame) -> DataFrame:
    """(node, place) of the terminals and all nodes above one, in pre-order from 1."""
    kept = below(labels, terminals.select("node").distinct().withColumn("n", F.lit(1))).where("total > 0")
    return running(range_blocks(kept, [], ["entry"]), [], ["entry"], [Running("place", F.lit(1), "sum")]).select("node", F.col("place").cast("int").alias("place"))


def within(inner: Column, entry: Column, exit_: Column) -> Column:
    """Whether the node entered at ``inner`` lies in the subtree [entry, exit)."""
    return (inner >= entry) & (inner < exit_)


def shared_depth(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b and more) with ``shared``: the depth of the lowest common ancestor, null in different trees.

    Between the entries of two nodes, the least depth is one below the common ancestor, unless one is above the other.
    """
    mine = lambda s: _sorted(labels.select(*(F.col(c).alias(f"{c}_{s}") for c in ("node", "root", "depth", "entry", "exit"))))
    j = pairs.join(mine("x"), F.col("a") == F.col("node_x")).join(mine("y"), F.col("b") == F.col("node_y"))
    lo, hi = F.least("entry_x", "entry_y"), F.greatest("entry_x", "entry_y")
    upper = F.when(F.col("entry_x") <= F.col("entry_y"), F.struct(F.col("depth_x").alias("d"), F.col("exit_x").alias("e")))
    upper = F.coalesce(upper, F.struct(F.col("depth_y").alias("d"), F.col("exit_y").alias("e")))
    j = j.select(*pairs.columns, "root_x", "root_y", lo.alias("_lo"), hi.alias("_hi"), upper["d"].alias("_d"), (hi < upper["e"]).alias("_above"))
    # Ranges of 2^k entries that begin and end where (lo, hi] does cover it.
    j = j.withColumn("_k", F.floor(F.log2((F.col("_hi") - F.col("_lo")).cast("double"))).cast("int"))
    top = j.where("root_x = root_y and not _above").agg(F.max("_k")).first()[0]
    if top is None:
        return j.select(*pairs.columns, F.when(F.col("root_x") == F.col("root_y"), F.col("_d")).cast("int").alias("shared"))
    level = labels.select(F.lit(0).alias("k"), F.col("entry").alias("at"), F.col("depth").alias("least"))
    every = level
    for k in range(top):
        half = 1 << k
        right = level.select((F.col("at") - half).alias("at"), F.col("least").alias("other"))
        level = materialize(level.join(_sorted(right), "at").select(F.lit(k + 1).alias("k"), "at", F.least("least", "other").alias("least")), "ranges")
        every = every.union(level)
    first = every.select(F.col("k").alias("_k"), F.col("at").alias("_from"), F.col("least").alias("_l1"))
    second = every.select(F.col("k").alias("_k"), F.col("at").alias("_to"), F.col("least").alias("_l2"))
    j = j.withColumn("_from", F.col("_lo") + 1).withColumn("_to", F.expr("_hi - shiftleft(1L, _k) + 1"))
    j = j.join(_sorted(first), ["_k", "_from"], "left").join(_sorted(second), ["_k", "_to"], "left")
    shared = F.when(F.col("root_x") != F.col("root_y"), None).when(F.col("_above"), F.col("_d")).otherwise(F.least("_l1", "_l2") - 1)
    return j.select(*pairs.columns, shared.cast("int").alias("shared"))
