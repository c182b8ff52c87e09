"""Lineage trees: closure, paths, placement, roll-up, induced subtrees and components.

The closure is built by doubling: round k knows ancestors up to 2^k steps away, so its number of joins is the
logarithm of the depth. Rounds go on until nothing is new; each is written out, so that plans don't grow.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.session import ensure_importable, materialize

#: Calls of one block of samples, positions of one block of paths, and cells of one batch's tables.
BLOCK_CALLS, BLOCK_PATHS, CELLS = 100_000, 1_000_000, 1 << 20


def closure(edges: DataFrame, node: str = "node", parent: str = "parent", depth_hint: int | None = None) -> DataFrame:
    """(node, ancestor, steps) with each node its own ancestor at 0 steps. ``edges`` has one row a node, roots null.

    ``depth_hint``, where the depth is known, gives one plan without writes. A cycle is an error.
    """
    known = edges.where(F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("steps"))
    if depth_hint is None:
        known = materialize(known, "closure")
    reach, nodes = 1, None
    while depth_hint is None or reach < depth_hint:
        far = known.where(F.col("steps") == reach).select(F.col("node").alias("n2"), F.col("ancestor").alias("mid"))
        up = known.select(F.col("node").alias("mid"), F.col("ancestor").alias("a2"), F.col("steps").alias("s2"))
        more = far.join(up, "mid").select(F.col("n2").alias("node"), F.col("a2").alias("ancestor"), (F.col("s2") + reach).alias("steps"))
        reach *= 2
        if depth_hint is None:
            more = materialize(more, "closure")
            if more.limit(1).count() == 0:
                break
            nodes = edges.count() if nodes is None else nodes
            if reach > 2 * nodes:
                raise ValueError("the edges hold a cycle")
        known = known.union(more)
    self_ = edges.select(F.col(node).alias("node"), F.col(node).alias("ancestor"), F.lit(0).alias("steps"))
    return self_.union(known)


def paths(closed: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """(node, depth, path) from the root down; ``label`` (node, name) shows names instead of ids."""
    rows = closed
    item = F.col("ancestor").cast("string")
    if label is not None:
        rows, item = rows.join(label.select(F.col("node").alias("ancestor"), "name"), "ancestor"), F.col("name")
    g = rows.groupBy("node").agg(F.max("steps").alias("depth"), F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("k"), item.alias("x")))).alias("_s"))
    return g.select("node", "depth", F.transform("_s", lambda s: s["x"]).alias("path"))


def roll_up(closed: DataFrame, members: DataFrame, node: str = "node") -> DataFrame:
    """Members at or below each node; members are counted once a node on their way up."""
    n = members.groupBy(node).agg(F.count("*").alias("_n"))
    return closed.join(n, closed.node == n[node]).groupBy("ancestor").agg(F.sum("_n").alias("members"), F.sum(F.when(F.col("steps") == 0, F.col("_n")).otherwise(0)).alias("direct"))


def induced_subtree(closed: DataFrame, terminals: DataFrame) -> DataFrame:
    """Nodes that are a terminal or above one."""
    return closed.join(terminals.select("node"), "node", "left_semi").select(F.col("ancestor").alias("node")).distinct()


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(items, ends) of a column of lists: those of row k end before ``ends[k + 1]``."""
    return pc.list_flatten(column).to_numpy(), np.concatenate(([0], np.cumsum(pc.list_value_length(column).to_numpy(), dtype=np.int64)))


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``n`` of each."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def _first_of(s: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Of each run of equal ``s``, the first row with the greatest keys."""
    rows = np.arange(len(s))
    for k in keys:
        runs = np.flatnonzero(np.diff(s[rows], prepend=-1))
        rows = rows[k[rows] == np.repeat(np.maximum.reduceat(k[rows], runs), np.diff(runs, append=len(rows)))]
    return rows[np.flatnonzero(np.diff(s[rows], prepend=-1))]


def _candidates(best: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block of samples (sample, _calls) against a block of paths (node, _set, _new), some samples at a time."""

    def meet(mine: pa.Table, paths: pa.Table) -> pa.Table:
        schema = pa.schema([("sample", mine["sample"].type), ("node", paths["node"].type), ("matched", pa.int64()), ("expected", pa.int32()), ("found", pa.int32()), ("score", pa.float64())])
        empty = schema.empty_table()
        if not len(mine) or not len(paths):
            return empty
        paths = paths.take(pc.sort_indices(paths["node"], null_placement="at_start"))
        (held, ends), (own, own_ends), (calls, call_ends) = _lists(paths["_set"]), _lists(paths["_new"]), _lists(mine["_calls"])
        known, held = np.unique(held, return_inverse=True)
        size, found = np.diff(ends), np.diff(call_ends)
        if not len(known):
            return empty
        # Paths by the positions that they bring.
        own = np.searchsorted(known, own)
        by_pos = np.repeat(np.arange(len(paths)), np.diff(own_ends))[np.argsort(own, kind="stable")]
        start = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(known)))))
        code = np.minimum(np.searchsorted(known, calls), len(known) - 1)
        here = known[code] == calls
        of, step, out = np.repeat(np.arange(len(mine)), found), max(1, CELLS // max(len(paths), len(known), len(own))), [empty]
        for lo in range(0, len(mine), step):
            part = slice(call_ends[lo], call_ends[min(lo + step, len(mine))])
            c, x = code[part][here[part]], of[part][here[part]] - lo
            called = np.zeros((step, len(known)), bool)
            called[x, c] = True
            n = start[c + 1] - start[c]
            touched = np.zeros((step, len(paths)), bool)
            touched[np.repeat(x, n), by_pos[_ranges(start[c], n)]] = True
            x, p = np.nonzero(touched)
            if not len(x):
                continue
            matched, to = [], np.cumsum(size[p])
            cuts = np.unique(np.concatenate(([0], np.searchsorted(to, np.arange(4 * CELLS, to[-1], 4 * CELLS)), [len(p)])))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                n = size[p[i:j]]
                hit = called.ravel()[np.repeat(x[i:j] * len(known), n) + held[_ranges(ends[p[i:j]], n)]]
                matched.append(np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64))
            m = np.concatenate(matched)
            score = (m / size[p] + m / found[x + lo]) / 2
            keep = _first_of(x, np.floor(score * 1e9 + 0.5), m) if best else slice(None)
            x, p = x[keep] + lo, p[keep]
            out.append(pa.table([mine["sample"].take(pa.array(x)), paths["node"].take(pa.array(p)), m[keep], size[p].astype(np.int32), found[x].astype(np.int32), score[keep]], schema=schema))
        return pa.concat_tables(out)

    return meet


def placement_scores(closed: DataFrame, defining: DataFrame, calls: DataFrame, best: bool = False) -> DataFrame:
    """Scores of each sample's candidates: the mean of recall and precision of the path's positions.

    ``defining``: node, pos; ``calls``: sample, pos of derived calls. A path's positions are those of all its nodes.
    Only nodes where a call meets a position that no node above has are candidates: below one, until the next, a path
    matches the same calls and expects no fewer positions. Of nodes with equal paths the smallest stands for all.
    So no node that could be ``best_nodes``' first is left out, for paths of up to 20,000 positions (scores are compared
    in billionths), and samples don't meet all nodes below those that they touch.

    Samples and paths are dealt into blocks by hash, and a task takes some pairs of blocks, so that no row is made or
    moved for a candidate. With ``best``, a block of paths gives only the node that ``best_nodes`` would place first.
    """
    spark = closed.sparkSession
    ensure_importable(spark)
    at = defining.select(F.col("node").alias("ancestor"), "pos")
    on_path = closed.join(at, "ancestor").groupBy("node", "pos").agg(F.max("steps").alias("steps"))
    sets = on_path.groupBy("node").agg(F.sort_array(F.collect_set("pos")).alias("_set"), F.array_sort(F.collect_set(F.when(F.col("steps") == 0, F.col("pos")))).alias("_new"))
    # Equal paths differ in where their positions come from; a candidate is one whichever of its nodes brings the call.
    path = sets.groupBy("_set").agg(F.min("node").alias("node"), F.array_distinct(F.flatten(F.collect_set("_new"))).alias("_new"))
    path = materialize(path, "paths")
    relevant = calls.where("sample is not null").select("sample", "pos").join(defining.select("pos").distinct(), "pos", "left_semi")
    mine = materialize(relevant.groupBy("sample").agg(F.collect_set("pos").alias("_calls")), "calls")
    across = max(1, -(-(path.agg(F.sum(F.size("_set"))).first()[0] or 0) // BLOCK_PATHS))
    down = max(1, -(-(mine.agg(F.sum(F.size("_calls"))).first()[0] or 0) // BLOCK_CALLS))
    deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = mine.select("sample", "_calls", deal("sample", down).alias("i"), every(across).alias("j"))
    right = path.select("node", "_set", "_new", every(down).alias("i"), deal("_set", across).alias("j"))
    # So many parts that one holds few pairs of blocks; they are small in bytes, not in work.
    parts = max(1, min(across * down, 4096))
    schema = f"sample {dict(left.dtypes)['sample']}, node {dict(right.dtypes)['node']}, matched long, expected int, found int, score double"
    met = left.repartition(parts, "i", "j").groupBy("i", "j").cogroup(right.repartition(parts, "i", "j").groupBy("i", "j"))
    return met.applyInArrow(_candidates(best), schema)


def best_nodes(scores: DataFrame, n: int = 1) -> DataFrame:
    w = Window.partitionBy("sample").orderBy(F.desc(F.floor(F.col("score") * 1e9 + 0.5)), F.desc("matched"), "node")
    return scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def supported_terminal(steps: DataFrame) -> DataFrame:
    """Where to stop on a path: the greatest running balance of derived (+1) against other (-1) calls.

    ``steps``: sample, depth, node, derived boolean. Ties go deeper if the step itself is derived.
    """
    w = Window.partitionBy("sample").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    r = steps.withColumn("balance", F.sum(F.when(F.col("derived"), 1).otherwise(-1)).over(w))
    best = F.max_by(F.struct("node", "depth", "balance"), F.struct("balance", F.when(F.col("derived"), F.col("depth")).otherwise(-F.col("depth"))))
    return r.groupBy("sample").agg(best.alias("b")).select("sample", "b.*")


def admissible(closed: DataFrame, evidence: DataFrame, min_derived: int = 1, min_below: int = 4) -> DataFrame:
    """Per node: derived, ancestral, derived strictly below, and whether a path may pass through it.

    ``evidence``: node, derived, ancestral counts. A contradicted node needs derived calls of its own and below.
    """
    below = closed.where("steps > 0").join(evidence.select("node", "derived"), "node").groupBy(F.col("ancestor").alias("node")).agg(F.sum("derived").alias("below"))
    e = evidence.join(below, "node", "left").withColumn("below", F.coalesce("below", F.lit(0)))
    return e.withColumn("passable", (F.col("ancestral") <= F.col("derived")) | ((F.col("derived") >= min_derived) & (F.col("below") >= min_below)))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning of two arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")


def shared_lineage(rows: DataFrame, key: list[str], path: str) -> DataFrame:
    """Common beginning of all paths of a group: the least and the greatest path bound all others."""
    g = rows.groupBy(*key).agg(F.min(path).alias("_lo"), F.max(path).alias("_hi"), F.count("*").alias("paths"))
    return g.select(*key, "paths", F.slice("_lo", F.lit(1), common_prefix(F.col("_lo"), F.col("_hi"))).alias("shared"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node reachable over ``edges`` (a, b), by hooking to the least neighbour and jumping.

    Labels are written to the shared folder each round, until a round changes none.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = materialize(both, "edges")
    label = both.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    before, state = None, ()
    while state != before:
        before = state
        near = both.join(label.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("m"))
        step = label.join(near, "node", "left").select("node", F.least("root", "m").alias("root"))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
        label = materialize(step.join(up, "root", "left").select("node", F.least("root", "up").alias("root")), "labels")
        state = label.agg(F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()[0]
    return label
