"""Evidence is clustered once, whatever reads the clusters."""

import random

import pytest

from helixframe.operators import breakpoints, structural


def test_clusters_are_found_once(spark):
    rows = [(k, "chr1", 100 * k, "chr1", 100 * k + 300, False, 400, 30, k % 2 == 0) for k in range(1, 9)]
    pairs = spark.createDataFrame(rows, "id long, contig string, pos long, mate_contig string, mate_pos long, same_strand boolean, insert_size int, mapq int, outlier boolean")
    splits = spark.createDataFrame([("chr1", 450, 20)], "contig string, pos long, mapq int")
    calls = breakpoints.breakpoint_calls(pairs, splits)
    assert "MapInPandas" not in calls._jdf.queryExecution().optimizedPlan().toString()
    assert sum(r.pe + r.sr for r in calls.collect()) <= 9 and calls.count() > 0


@pytest.mark.parametrize("batch", [3, 10_000])
def test_stretches_are_run_over_without_a_call_for_each(spark, batch):
    big = (1 << 53) + 1
    r = random.Random(batch)
    make = lambda n: [(big + k, r.choice("xy"), "DEL", s, s + r.randint(0, 40)) for k in range(n) for s in [r.randint(0, 900)]]
    a, b = make(80), make(80)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        schema = "id long, contig string, kind string, start long, end long"
        merged = structural.merge_evidence(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 64)
        got = sorted(tuple(x) for x in merged.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, used = [], set()
    for i, contig, _, start, end in sorted(a, key=lambda x: (x[3], x[0])):
        near = sorted((y[3], y[0]) for y in b if y[1] == contig and y[0] not in used and y[3] <= end and y[4] >= start)
        if near:
            used.add(near[0][1])
            want.append((i, near[0][1]))
    assert got == sorted(want) and len(want) > 10
    assert "FlatMapGroups" not in merged._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_is_merged_once(spark):
    calls = spark.createDataFrame([("a", "1", "DEL", 100, 300, 3)], "id string, contig string, kind string, start long, end long, pe int")
    depth = spark.createDataFrame([("x", "1", "DEL", 200, 400, 0.4), ("y", "1", "DEL", 350, 400, 0.2)], "id string, contig string, kind string, start long, end long, relative_depth double")
    found = breakpoints.with_depth(calls, depth)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapIn" not in plan and "MapGroupsIn" not in plan
    assert sorted((r.id, r.relative_depth) for r in found.collect()) == [("a", 0.4), ("y", 0.2)]
