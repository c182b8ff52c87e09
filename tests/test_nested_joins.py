"""Rounds over a tree send none of it through the driver."""

from helixframe.operators import nested


def test_rounds_join_by_sorting(spark):
    arcs = spark.createDataFrame([(1, False, 1, True, 1, 1, 1), (1, True, None, True, -1, 0, 1)], "node long, up boolean, to long, to_up boolean, step int, downs int, end long")
    plan = nested._doubled(arcs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {(r.node, r.up, r.to, r.step) for r in nested._doubled(arcs).collect()} == {(1, False, None, 0), (1, True, None, -1)}
