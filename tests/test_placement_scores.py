"""The best node of each sample, found among candidates alone, against a score of every node."""

import math
import random

import pyarrow as pa
import pytest

from helixframe.operators import tree


@pytest.mark.parametrize("seed", [1, 2])
def test_best_of_candidates_is_best_of_all(spark, seed):
    r = random.Random(seed)
    ids = r.sample(range(1000), 60)
    parent = {ids[0]: None} | {n: ids[r.randrange(k)] for k, n in enumerate(ids) if k}
    own = {n: {r.randrange(40) for _ in range(r.randrange(4))} for n in ids}
    path = {}
    for n in ids:
        path[n] = own[n] | (path[parent[n]] if parent[n] is not None else set())
    assert len({frozenset(p) for p in path.values()}) < len(ids)
    calls = {s: {r.randrange(45) for _ in range(r.randrange(1, 12))} for s in range(80)}
    calls[80], every = {41, 44}, set().union(*own.values())
    want = {}
    for s, c in calls.items():
        c = c & every
        scored = [(-math.floor((len(c & path[n]) / len(path[n]) + len(c & path[n]) / len(c)) / 2 * 1e9 + 0.5), -len(c & path[n]), n) for n in ids if c & path[n]]
        if scored:
            want[s] = (min(scored)[2], -min(scored)[1])
    closed = tree.closure(spark.createDataFrame(list(parent.items()), "node long, parent long"))
    defining = spark.createDataFrame([(n, p) for n, x in own.items() for p in x], "node long, pos int")
    rows = [(s, p) for s, c in calls.items() for p in c] * 2
    best = tree.best_nodes(tree.placement_scores(closed, defining, spark.createDataFrame(rows, "sample long, pos int")))
    assert {x.sample: (x.node, x.matched) for x in best.collect()} == want and len(want) > 60


def _brute(path, calls):
    every, want = set().union(*path.values()), {}
    for s, c in calls.items():
        c = c & every
        scored = [(-math.floor((len(c & p) / len(p) + len(c & p) / len(c)) / 2 * 1e9 + 0.5), -len(c & p), n) for n, p in path.items() if c & p]
        if scored:
            want[s] = (min(scored)[2], -min(scored)[1])
    return want


@pytest.mark.parametrize("ids", ["long", "string"])
def test_blocks_give_one_row_a_sample_and_the_same_best(spark, monkeypatch, ids):
    """No row is made for a candidate: a sample's rows are at most the blocks of paths."""
    monkeypatch.setattr(tree, "BLOCK_CALLS", 60)
    monkeypatch.setattr(tree, "BLOCK_PATHS", 120)
    r = random.Random(7)
    name = str if ids == "string" else int
    parent = {name(0): None} | {name(n): name(r.randrange(n)) for n in range(1, 70)}
    own = {n: {name(r.randrange(30)) for _ in range(r.randrange(4))} for n in parent}
    path = {}
    for n in parent:
        path[n] = own[n] | (path[parent[n]] if parent[n] is not None else set())
    path = {n: p for n, p in path.items() if p}
    calls = {name(s): {name(r.randrange(33)) for _ in range(r.randrange(1, 9))} for s in range(60)} | {name(60): {name(31)}}
    closed = tree.closure(spark.createDataFrame(list(parent.items()), f"node {ids}, parent {ids}"))
    defining = spark.createDataFrame([(n, p) for n, x in own.items() for p in x], f"node {ids}, pos {ids}")
    rows = [(s, p) for s, c in calls.items() for p in c] + [(None, name(1)), (name(1), None)]
    s = tree.placement_scores(closed, defining, spark.createDataFrame(rows, f"sample {ids}, pos {ids}"), best=True)
    want, across = _brute(path, calls), -(-sum(map(len, {frozenset(p) for p in path.values()})) // 120)
    assert {x.sample: (x.node, x.matched) for x in tree.best_nodes(s).collect()} == want and len(want) > 50
    assert across > 1 and len(want) <= s.count() <= across * 61


@pytest.mark.parametrize("none", ["calls", "defining"])
def test_no_calls_or_no_positions_give_no_scores(spark, none):
    closed = tree.closure(spark.createDataFrame([(1, None), (2, 1)], "node long, parent long"))
    defining = spark.createDataFrame([] if none == "defining" else [(1, 5), (2, 6)], "node long, pos int")
    calls = spark.createDataFrame([] if none == "calls" else [(9, 6)], "sample long, pos int")
    assert tree.placement_scores(closed, defining, calls).collect() == []


def test_a_batch_of_few_cells_finds_the_same(monkeypatch):
    """Samples, and the paths that they touch, are taken in slices; each slice is counted alike."""
    r = random.Random(3)
    sets = [sorted(r.sample(range(50), r.randrange(2, 20))) for _ in range(40)]
    paths = pa.table({"node": list(range(40)), "_set": sets, "_new": [x[:2] for x in sets]})
    mine = pa.table({"sample": list(range(30)), "_calls": [r.sample(range(55), r.randrange(1, 12)) for _ in range(30)]})
    whole = [tree._candidates(best)(mine, paths).to_pylist() for best in (False, True)]
    for x in whole[0]:
        c, p = set(mine["_calls"][x["sample"]].as_py()), set(sets[x["node"]])
        assert (x["matched"], x["expected"], x["found"]) == (len(c & p), len(p), len(c))
    assert len(whole[0]) == sum(bool(set(c.as_py()) & set(x[:2])) for c in mine["_calls"] for x in sets)
    for cells in (1, 7, 90, 300):
        monkeypatch.setattr(tree, "CELLS", cells)
        assert [tree._candidates(best)(mine, paths).to_pylist() for best in (False, True)] == whole
