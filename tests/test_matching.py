"""Marker index, breakpoint calls, region bins, nested sets, scans and digests against plain versions."""

import itertools
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helixframe.functions import digests
from helixframe.operators import breakpoints, intervals, markers, nested, regions, scan


def key(x):
    return tuple((v is None, v) for v in x)


@pytest.mark.parametrize("least, per_100", [(10, 8), (6, 15), (12, 0)])
def test_near_profiles_lose_none(spark, least, per_100):
    r = random.Random(least)
    base = [[r.randint(9, 14) for _ in range(30)] for _ in range(4)]
    panels = [range(30), range(12), range(5, 25), [k for k in range(30) if k % 3]]
    held = {}
    for s in range(90):
        b, panel = base[s % 4], panels[r.randrange(4)]
        held[s] = {k: b[k] + (r.random() < 0.05) for k in panel if r.random() > 0.03}
    rows = [(s, f"m{k}", str(v)) for s, x in held.items() for k, v in x.items()]
    whose, profiles = markers.profiles(spark.createDataFrame(rows, "subject long, marker string, value string"))
    first = {x.profile: x.profile for x in profiles.collect()}
    want = set()
    for a, b in itertools.combinations(sorted(first), 2):
        both = held[a].keys() & held[b].keys()
        n = sum(held[a][k] != held[b][k] for k in both)
        if min(len(held[a]), len(held[b]), len(both)) >= least and n * 100 <= per_100 * len(both):
            want.add((a, b, len(both), n))
    got = {tuple(x) for x in markers.near_profiles(profiles, least, per_100).collect()}
    assert got == want and (len(want) > 20 or not per_100)
    assert whose.count() == sum(1 for x in held.values() if x)


def test_copies_of_a_profile_meet_without_the_index(spark, monkeypatch):
    monkeypatch.setattr(markers, "BLOCK", 4)
    base = {f"m{k}": "12" for k in range(25)}
    kinds = [base, base | {"m0": "13"}, base | {f"m{k}": "30" for k in range(9)}, {"m0": "12"}]
    held = {s: kinds[s % 4 if s < 40 else 0] for s in range(50)}
    values = spark.createDataFrame([(s, m, v) for s, x in held.items() for m, v in x.items()], "subject long, marker string, value string")
    seen, index = [], markers.near_profiles
    monkeypatch.setattr(markers, "near_profiles", lambda h, *a: (seen.append(h.count()), index(h, *a))[1])
    got = sorted(tuple(x) for x in markers.near_subjects(values).collect())
    big = [s for s in held if len(held[s]) > 1]
    differ = lambda a, b: sum(held[a][m] != held[b][m] for m in base)
    assert got == [(a, b, 25, differ(a, b)) for a, b in itertools.combinations(big, 2) if differ(a, b) <= 2] and seen == [4]


def test_clusters_suggest_the_nearest_placed(spark):
    a = {f"m{k}": "12" for k in range(25)}
    rows = {1: a, 2: a | {"m0": "13"}, 3: a | {"m0": "13", "m1": "14"}, 4: {f"m{k}": "30" for k in range(25)}, 5: {"m1": "12"}, 6: dict(a), 7: a | {"m5": None}}
    values = spark.createDataFrame([(s, m.upper() if s == 2 else m, v) for s, x in rows.items() for m, v in x.items()], "subject long, marker string, value string")
    branches = spark.createDataFrame([(1, "R1"), (3, "R2"), (4, "J")], "subject long, branch string")
    got = {r.subject: r for r in markers.cluster_members(values, branches).collect()}
    assert {s: r.cluster for s, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: None, 6: 1, 7: None}
    assert (got[6].suggested, got[6].gd, got[6].compared) == ("R1", 0, 25) and got[6].confidence == pytest.approx(0.75)
    assert (got[2].suggested, got[2].gd) == ("R1", 1) and got[2].confidence == pytest.approx((0.5 + 0.5 * (1 - 1 / 12)) * 0.75)
    assert got[1].suggested is None and got[4].suggested is None and got[5].suggested is None and got[7].markers == 24


def test_values_are_dealt_by_rows_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(markers, "ROWS", 50)
    ids = spark.range(100).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).coalesce(1)
    values = ids.select(F.col("id").alias("subject"), F.concat(F.lit("m"), F.col("k").cast("string")).alias("marker"), (F.col("id") % 3).cast("string").alias("value"))
    seen, write = [], markers.materialize
    monkeypatch.setattr(markers, "materialize", lambda df, name: (seen.append(df.rdd.getNumPartitions()), write(df, name))[1])
    whose, held = markers.profiles(values)
    assert seen[0] == 10 and sorted((x.profile, len(x.held)) for x in held.collect()) == [(0, 5), (1, 5), (2, 5)]
    assert all(x.subject % 3 == x.profile for x in whose.collect())


def test_cluster_starts_are_anchored(spark):
    r = random.Random(3)
    points = [(c, r.randrange(60_000)) for c in ("1", "2", "3") for _ in range(900)] + [("4", 5), ("4", 505), ("4", 506)]
    df = spark.createDataFrame(points, "contig string, pos long").repartition(7)
    got = {(x.contig, x.pos): x.first for x in breakpoints.cluster_starts(df, ["contig"], "pos", 500).collect()}
    want = {}
    for c in ("1", "2", "3", "4"):
        first = None
        for p in sorted({p for k, p in points if k == c}):
            first = p if first is None or p - first > 500 else first
            want[c, p] = first
    assert got == want


def test_clusters_go_on_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_cluster_starts_are_anchored(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_breakpoint_calls(spark):
    pair = "id long, contig string, pos long, mate_contig string, mate_pos long, same_strand boolean, insert_size long, mapq int, outlier boolean"
    pairs = [(k, "1", 1000 + 10 * k, "1", 9000, False, 400 if k == 0 else 4000, 60, k > 0) for k in range(4)]  # a deletion
    pairs += [(10 + k, "1", 50_000 + k, "1", 52_000, True, 300, 40, False) for k in range(3)]  # an inversion
    pairs += [(20, "2", 700, "5", 90, False, 0, 30, False)]  # across contigs, alone
    pairs += [(30 + k, "3", 100, "3", 100, False, 900 if k == 0 else 100, 10, k > 0) for k in range(2)]  # mates at the place itself
    splits = [("1", 1020, 60), ("1", 1490, 50), ("1", 1501, 20), ("3", 100, 10)]
    got = {(x.contig, x.kind, x.start): x for x in breakpoints.breakpoint_calls(spark.createDataFrame(pairs, pair), spark.createDataFrame(splits, "contig string, pos long, mapq int")).collect()}
    assert set(got) == {("1", "DEL", 1095), ("1", "INV", 50_001), ("2", "BND", 700), ("3", "DUP", 100)}
    d = got["1", "DEL", 1095]  # the last split read lies 501 from the first position
    assert (d.pe, d.sr, d.length, d.end, d.low, d.high, d.genotype, d.filter) == (4, 2, -7905, 9000, -95, 395, "0/1", "PASS")
    assert d.quality == pytest.approx(30 + 0.5 * (5 * 60 + 50) / 6)
    b = got["2", "BND", 700]
    assert (b.mate_contig, b.mate_pos, b.length, b.low, b.high, b.filter) == ("5", 90, 0, -500, 500, "LowSupport")
    assert (got["3", "DUP", 100].length, got["3", "DUP", 100].end) == (500, 600)


def test_calls_take_depth_of_their_kind_once(spark):
    calls = spark.createDataFrame([("a", "1", "DEL", 100, 300, 3), ("b", "1", "DEL", 250, 500, 4), ("c", "2", "DUP", 1, 9, 5)], "id string, contig string, kind string, start long, end long, pe int")
    depth = spark.createDataFrame([("x", "1", "DEL", 200, 400, 0.4), ("y", "1", "DUP", 100, 300, 1.5), ("z", "2", "DUP", 9, 20, 1.6)], "id string, contig string, kind string, start long, end long, relative_depth double")
    got = {r.id: (r.pe, r.relative_depth) for r in breakpoints.with_depth(calls, depth).collect()}
    assert got == {"a": (3, 0.4), "b": (4, None), "c": (5, 1.6), "y": (None, 1.5)}
    s = spark.createDataFrame([(20, 1, 0.75), (5, 5, None)], "pe int, sr int, d double")
    assert [round(x[0], 6) for x in s.select(breakpoints.support_score(F.col("pe"), F.col("sr"), F.col("d"))).collect()] == [0.53, 0.55]


def test_bins_find_every_overlap(spark):
    r = random.Random(9)
    rows = []
    for k in range(600):
        s = r.choice((r.randrange(1, 1 << 20), r.randrange(1, 1 << 27), (r.randrange(1, 2000) << 14) + r.randint(-1, 2)))
        rows.append((k, r.choice("XY"), max(1, s), max(1, s) + r.choice((0, 10, 16_384, 1 << 18, 1 << 24, 1 << 28))))
    rows += [(900, "X", 1, 1 << 30), (901, "Y", (1 << 29) + 5, (1 << 29) + 9)]
    where = [("X", n, lo, lo + size) for n, (lo, size) in enumerate([(1, 0), (16_384, 1), (1 << 17, 1 << 15), (1 << 23, 1 << 26), (5, 1 << 28), ((1 << 29) + 1, 100)])] + [("Y", 9, 1 << 14, 1 << 20), ("Z", 10, 1, 5)]
    df = spark.createDataFrame(rows, "id long, contig string, s long, e long")
    reg = spark.createDataFrame(where, "contig string, region long, lo long, hi long")
    got = Counter((x.region, x.id) for x in regions.rows_in_regions(df, reg, "contig", "s", "e").collect())
    want = Counter((n, i) for c, n, lo, hi in where for i, k, s, e in rows if k == c and s <= hi and e >= lo)
    assert got == want and max(want.values()) == 1
    one = df.withColumn("bin", regions.bin_of(F.col("s"), F.col("e")))
    for c, n, lo, hi in where:
        assert {x.id for x in regions.read_region(one, "contig", "s", "e", (c, lo, hi)).collect()} == {i for m, i in want if m == n}


def plain_labels(parents, order):
    below = defaultdict(list)
    for n in sorted(parents, key=order):
        below[parents[n]].append(n)
    out, at = {}, 0

    def walk(n, root, depth):
        nonlocal at
        entry, at = at, at + 1
        for c in below[n]:
            walk(c, root, depth + 1)
        out[n] = (root, depth, entry, at)

    for n in below[None]:
        walk(n, n, 0)
    return out


@pytest.mark.parametrize("shape", ["random", "chain", "star", "roots"])
def test_nested_sets(spark, shape):
    r = random.Random(5)
    n = 70
    up = {"random": lambda k: None if k < 3 else r.randrange(k), "chain": lambda k: k - 1 if k else None, "star": lambda k: 0 if k else None, "roots": lambda k: None}[shape]
    ids = [k * 7 % 101 for k in range(n)]
    parents = {ids[k]: (None if (p := up(k)) is None else ids[p]) for k in range(n)}
    names = {k: r.choice("abc") for k in parents}
    edges = spark.createDataFrame([(k, p, names[k]) for k, p in parents.items()], "node long, parent long, name string")
    want = plain_labels(parents, lambda k: (names[k], k))
    labels = nested.nested_sets(edges, ["name", "node"])
    got = {x.node: (x.root, x.depth, x.entry, x.exit) for x in labels.collect()}
    assert got == want
    if shape == "random":
        labels = spark.createDataFrame([(k, *v) for k, v in got.items()], labels.schema)
        path = lambda k: [*path(parents[k]), k] if k is not None else []
        pairs = [(r.choice(ids), r.choice(ids)) for _ in range(200)] + [(ids[4], ids[4])]
        shared = {(x.a, x.b): x.shared for x in nested.shared_depth(labels, spark.createDataFrame(sorted(set(pairs)), "a long, b long")).collect()}
        for a, b in pairs:
            same = sum(x == y for x, y in zip(path(a), path(b), strict=False))
            assert shared[a, b] == (same - 1 if same else None), (a, b)
        kept = {x.node: x.place for x in nested.induced(labels, spark.createDataFrame([(k,) for k in ids[50:55]] * 2, "node long")).collect()}
        above = {x for k in ids[50:55] for x in path(k)}
        assert kept == {k: i + 1 for i, k in enumerate(sorted(above, key=lambda k: got[k][2]))}


def test_a_cycle_is_an_error(spark):
    with pytest.raises(ValueError):
        nested.nested_sets(spark.createDataFrame([(1, None), (2, 3), (3, 2)], "node long, parent long")).collect()


def test_running_values_over_blocks(spark):
    r = random.Random(2)
    rows = [(k, r.choice(["hot", "hot", "hot", "x", None]), r.randrange(1000), r.choice([None, r.randrange(-50, 50)])) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, pos long, v long").repartition(5)
    wanted = [scan.Running("s", F.col("v"), "sum"), scan.Running("m", F.col("v"), "max", False), scan.Running("n", F.lit(1), "sum"), scan.Running("l", F.col("v"), "last"), scan.Running("b", F.col("v"), "last", False)]
    want = {}
    for name in {x[1] for x in rows}:
        seen = []
        for i, _, _, v in sorted((x for x in rows if x[1] == name), key=lambda x: (x[2], x[0])):
            old = [x for x in seen if x is not None]
            seen.append(v)
            now = [x for x in seen if x is not None]
            want[i] = (sum(now) if now else None, max(old, default=None), len(seen), now[-1] if now else None, old[-1] if old else None)
    for found in (
        scan.running(df, ["k"], ["pos", "id"], wanted, scan.position_block(F.col("pos"), 64)),
        scan.running(scan.range_blocks(df, ["k"], ["pos", "id"], parts=6), ["k"], ["pos", "id"], wanted),
    ):
        assert {x.id: (x.s, x.m, x.n, x.l, x.b) for x in found.collect()} == want
    falling = scan.running(scan.range_blocks(df, [], [F.col("pos").desc(), F.col("id").desc()], parts=4), [], [F.col("pos").desc(), F.col("id").desc()], [scan.Running("next", F.col("id"), "last", False)])
    order = [x[0] for x in sorted(rows, key=lambda x: (x[2], x[0]))]
    assert {x.id: x.next for x in falling.collect()} == dict(zip(order, [*order[1:], None], strict=True))
    place = {x.id: x.place for x in scan.numbered(df, [], ["pos", "id"], parts=5).collect()}
    assert [k for k, _ in sorted(place.items(), key=lambda x: x[1])] == order and sorted(place.values()) == list(range(1, 501))


@pytest.mark.parametrize("width", [1, 10, 1 << 16])
def test_merged_intervals_over_blocks(spark, width):
    r = random.Random(width)
    rows = [(r.choice("ab"), s, s + r.choice((0, 3, 40))) for s in (r.randrange(900) for _ in range(150))] + [("a", 5, 700), (None, 1, 2), (None, 3, 4), ("c", None, None)]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    want = Counter()
    for k in ("a", "b", None):
        own: list[list[int]] = []
        for s, e in sorted((s, e) for c, s, e in rows if c == k):
            if own and s <= own[-1][1] + 2:
                own[-1][1] = max(own[-1][1], e)
                own[-1][2] += 1
            else:
                own.append([s, e, 1])
        want.update((k, *x) for x in own)
    got = intervals.merge_intervals(df, ["k"], "s", "e", 2, width)
    assert Counter((x.k, x.s, x.e, x.parts) for x in got.collect()) == want


def test_canonical_json_equals_sorted_json(spark):
    text = ["", 'q"\\', "\n\t\r\b\f\x01\x1f", "é😀", "plain", None]
    rows = [(k, (t, [k, None, -k], {"z": k % 2 == 0, "a": None}), [(t, k * 0.25), None]) for k, t in enumerate(text)]
    df = spark.createDataFrame(rows, "z long, a struct<y:string, b:array<long>, m:map<string,boolean>>, l array<struct<t:string, f:double>>")
    got = {x.z: x.j for x in df.select("z", digests.record_json(df).alias("j")).collect()}
    for k, (y, b, m), items in rows:
        number = lambda f: int(f) if f == int(f) else f
        plain = {"z": k, "a": {"y": y, "b": b, "m": m}, "l": [None if x is None else {"t": x[0], "f": number(x[1])} for x in items]}
        assert got[k] == json.dumps(plain, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    turned = df.select("l", "z", "a")
    same = lambda d: [x.d for x in d.select(digests.record_digest(d).alias("d")).orderBy("d").collect()]
    assert same(turned) == same(df)
    assert digests.table_digest(df.repartition(5)).collect() == digests.table_digest(turned.coalesce(1)).collect()
    assert digests.table_digest(df.union(df.limit(1))).first().digest != digests.table_digest(df).first().digest
    assert digests.table_digest(df.limit(0)).first().rows == 0


def test_regions_far_along_meet_few_rows(spark):
    far = 1 << 32
    df = spark.range(4000).select(F.col("id"), F.lit("X").alias("contig"), (F.col("id") * 20_000 + far).alias("s"), (F.col("id") * 20_000 + far + 500).alias("e"))
    reg = spark.range(4000).select(F.lit("X").alias("contig"), F.col("id").alias("region"), (F.col("id") * 20_000 + far + 500).alias("lo"), (F.col("id") * 20_000 + far + 600).alias("hi"))
    assert sorted((r.region, r.id) for r in regions.rows_in_regions(df, reg, "contig", "s", "e").collect()) == [(k, k) for k in range(4000)]
    # Rows that meet a region: those of two windows, not all that lie far along.
    plan = regions.rows_in_regions(df, reg, "contig", "s", "e")
    assert "_bin" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_near_pairs_come_as_runs_in_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    monkeypatch.setattr(markers, "TASK_PAIRS", 10, raising=False)
    n = 120
    each = spark.range(n).select((F.col("id") * 7919 % 100_003).alias("subject"), (F.col("id") % 2).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("k"))
    value = F.when((F.col("k") == 0) & (F.col("kind") == 1), 13).otherwise(12)
    values = each.select("subject", F.concat(F.lit("m"), F.col("k").cast("string")).alias("marker"), value.alias("value"))
    found = markers.near_subjects(values)
    got = [r.a for r in found.collect()]
    assert len(got) == found.where("a < b").distinct().count() == n * (n - 1) // 2
    # A subject is the lower one in a run of its own for each profile that it meets.
    assert sum(x != y for x, y in itertools.pairwise(got)) <= 2 * n
    assert found.rdd.getNumPartitions() > 1000
