"""Calls on a panel and comparisons of sources against plain versions."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helixframe.operators import kernels, panels

CALLS = "source long, build string, contig string, pos long, a1 string, a2 string"
FLIP = dict(zip("ACGT", "TGCA", strict=True))


def plain_dosage(a1, a2, ref, alt):
    for x, y in ((a1, a2), (FLIP[a1], FLIP[a2])):
        if {x, y} <= {ref, alt}:
            return (x == alt) + (y == alt)
    return None


def made(r):
    sites = [(k, *r.sample("ACGT", 2)) for k in range(60)]
    loci = [(k, b, ("chr" if b == "new" else "") + str(k % 3 + 1), k * 10 + (b == "new")) for k, _, _ in sites for b in ("old", "new") if (k, b) != (5, "new")]
    calls = []
    for _ in range(3000):
        k, b = r.randrange(66), r.choice(("old", "new"))
        ref, alt = sites[k][1:] if k < 60 else "AC"
        pair = [r.choice((ref, alt, ref, alt, FLIP[ref], FLIP[alt], r.choice("ACGT"))) for _ in "12"]
        if r.random() < 0.05:
            pair[r.randrange(2)] = r.choice((None, "-", "N"))
        calls.append((r.randrange(40), b, r.choice(("chr", "Chr", "")) + str(k % 3 + 1), k * 10 + (b == "new"), *pair))
    return sites, loci, calls + calls[:50] + [(99, "old", None, 10, "A", "C"), (99, "old", "1", None, "A", "C"), (99, None, "1", 30, "A", "C")]


def test_calls_find_their_sites_and_alleles(spark):
    sites, loci, calls = made(random.Random(1))
    allele = {k: (ref, alt) for k, ref, alt in sites}
    at = {(b, c.removeprefix("chr"), p): k for k, b, c, p in loci}
    outcomes, seen = defaultdict(Counter), defaultdict(set)
    for s, b, c, p, a1, a2 in calls:
        k = at.get((b, (c or "").lower().removeprefix("chr"), p))
        if k is None:
            what = "off_panel"
        elif not (a1 in FLIP and a2 in FLIP):
            what = "no_call"
        elif FLIP[allele[k][0]] == allele[k][1]:
            what = "palindromic"
        else:
            d = plain_dosage(a1, a2, *allele[k])
            what = "mismatched" if d is None else "resolved"
            if d is not None:
                seen[s, k].add(d)
        outcomes[s][what] += 1
    panel = spark.createDataFrame(sites, "site long, ref string, alt string").withColumn("pos", F.lit("clash"))
    df = spark.createDataFrame(calls, CALLS).withColumn("site", F.lit(-1)).repartition(5)
    found = panels.classify_calls(df, panel, spark.createDataFrame(loci, "site long, build string, contig string, pos long"))
    assert {(x.source, x.site): x.dosage for x in panels.genotypes(found).collect()} == {k: min(v) for k, v in seen.items() if len(v) == 1}
    got = {x.source: x for x in panels.import_outcomes(found).collect()}
    assert got.keys() == outcomes.keys() and got[99].verdict == "check the build" and got[99].off_panel == 3
    for s, n in outcomes.items():
        assert {o: got[s][o] for o in panels.OUTCOMES} == {o: n[o] for o in panels.OUTCOMES}
        kinds = [len(v) for (t, _), v in seen.items() if t == s]
        assert (got[s].sites, got[s].conflicting) == (kinds.count(1), len(kinds) - kinds.count(1))
    assert sum(len(v) > 1 for v in seen.values()) > 20
    assert panels.import_outcomes(panels.classify_calls(df.limit(0), panel, spark.createDataFrame(loci, "site long, build string, contig string, pos long"))).count() == 0


def test_dosage_of_another_build_as_alleles(spark):
    rows = spark.createDataFrame([(d, "A", "G") for d in (-1, 0, 1, 2, None)], "d int, r string, a string")
    got = [x.p and (x.p.a1, x.p.a2) for x in rows.select(panels.pair_of_dosage(F.col("d"), F.col("r"), F.col("a")).alias("p")).collect()]
    assert got == [None, ("A", "A"), ("A", "G"), ("G", "G"), None]


def test_identity_of_pairs(spark):
    r = random.Random(2)
    dosages = [(s, k, r.choice((0, 1, 2, -1, None)) if s % 3 else k % 3) for s in range(20) for k in range(80) if r.random() < 0.6]
    markers = [(s, ("dys%d" if s % 2 else "DYS%d") % k, r.choice("ab" if s % 2 else "AB") if s % 4 else None) for s in range(15) for k in range(6)]
    pairs = [(a, r.randrange(24)) for a in range(24) for _ in range(4)] + [(0, 3), (0, 3), (7, None), (None, 7), (3, 0)]
    got = panels.verify_identity(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(dosages, "source long, site long, dosage int"), spark.createDataFrame(markers, "source long, marker string, value string"))
    got = {(x.a, x.b): x for x in got.collect()}
    have, named = {(s, k): d for s, k, d in dosages if d in (0, 1, 2)}, {(s, m.lower()): v.lower() for s, m, v in markers if v}
    want = {(a, b) for a, b in pairs if a is not None and b is not None and a != b}
    assert got.keys() == want
    for (a, b), x in got.items():
        both = [k for s, k in have if s == a and (b, k) in have]
        same = [m for s, m in named if s == a and (b, m) in named]
        assert (x.sites, x.matched) == (len(both), sum(have[a, k] == have[b, k] for k in both))
        assert (x.markers, x.differing) == (len(same), sum(named[a, m] != named[b, m] for m in same))
        assert x.concordance == (pytest.approx(x.matched / x.sites) if x.sites else None)
    assert got[0, 3].band == "VerifiedSame" and got[3, 0].matched == got[0, 3].matched
    assert {x.method for x in got.values()} >= {"SNP concordance", "SNP concordance + Y-STR", "no shared data"}


def test_shared_segments_of_pairs(spark):
    r = random.Random(3)
    panel = [(c * 1000 + k, f"chr{c}", 1 + k * 1000) for c in (1, 2) for k in range(400)]
    base = {s: {site: r.choice((0, 2)) for site, _, _ in panel} for s in range(4)}
    for site in range(1100, 1300):
        base[1][site] = base[0][site]
    dosages = [(s, site, d) for s, x in base.items() for site, d in x.items() if (s + site) % 50]
    curve = [(f"chr{c}", p, p / 10_000) for c in (1, 2) for p in (1, 400_000)]
    pairs = spark.createDataFrame([(0, 1), (2, 3), (1, 2)], "a long, b long")
    found = panels.shared_segments(pairs, spark.createDataFrame(dosages, "source long, site long, dosage int"), spark.createDataFrame(panel, "site long, contig string, pos long"), spark.createDataFrame(curve, "contig string, pos long, cm double"))
    want = []
    for a, b in ((0, 1), (2, 3), (1, 2)):
        for c in ("chr1", "chr2"):
            there = [(p, s) for s, x, p in panel if x == c and (a + s) % 50 and (b + s) % 50]
            ibs = kernels.np.array([2 - abs(base[a][s] - base[b][s]) for _, s in there])
            for i, j, n in kernels.merge_candidates(kernels.ibd_candidates(ibs), kernels.WINDOW):
                cm = round((there[j][0] - there[i][0]) / 10_000, 2)
                if cm >= kernels.MIN_CM and n >= kernels.MIN_SITES:
                    want.append((a, b, c, there[i][0], there[j][0], pytest.approx(cm, abs=0.011), n))
    assert sorted(tuple(x) for x in found.collect()) == sorted(want) and [w[:3] for w in want] == [(0, 1, "chr1")]
    out = {(x.a, x.b): x for x in panels.compare_sources(pairs, found).collect()}
    assert out[0, 1].segments == 1 and out[0, 1].total_cm == out[0, 1].longest_cm >= 17
    assert (out[2, 3].segments, out[2, 3].total_cm, out[2, 3].relationship) == (0, 0.0, "Unknown")


@pytest.mark.parametrize("block", [7, 1000])
def test_all_pairs_in_blocks_equal_a_join(spark, monkeypatch, block):
    import random

    from helixframe.operators import match, tree

    r = random.Random(block)
    rows = [(f"s{s}", m, r.choice([None, 1, 2, 3])) for s in range(40) for m in r.sample(range(12), r.randint(1, 9)) for _ in range(r.choice([1, 1, 2]))]
    p = spark.createDataFrame([*rows, (None, 1, 1), ("s1", None, 1)], "s string, m long, v int")
    real = match.block_pairs
    monkeypatch.setattr(match, "block_pairs", lambda *a, **k: real(*a, **k, block=block))
    x, y = (p.select(F.col("s").alias(i), "m", F.col("v").alias("v" + i)) for i in "ab")
    want = x.join(y, "m").where("a < b").groupBy("a", "b").agg(F.count("*").alias("compared"), F.count_if(F.col("va") != F.col("vb")).alias("differing"))
    rows_of = lambda d: sorted(tuple(z) for z in d.collect())
    got = match.pair_distances(p, "s", "m", "v")
    assert rows_of(got) == rows_of(want) and got.columns == want.columns
    assert rows_of(match.nearest_of_all(p, "s", "m", "v", 3)) == rows_of(match.nearest(want, 3))
    for most in (1, 3, 10):
        links = want.where(f"differing * 10 <= compared * {most}").select("a", "b")
        assert rows_of(tree.connected_components(match.linked_pairs(p, "s", "m", "v", most))) == rows_of(tree.connected_components(links))


@pytest.mark.parametrize("block", [6, 1000])
def test_queries_against_all_equal_a_join(spark, block):
    from helixframe.operators import match

    r = random.Random(block)
    rows = [(s, f"m{m}", r.choice([None, 1, 2])) for s in range(50) for m in r.sample(range(10), r.randint(1, 5))]
    p = spark.createDataFrame(rows, "s long, m string, v int")
    asked = p.withColumn("q", F.when(F.col("s") % 7 == 1, True))
    got = match.block_pairs(asked, "s", "m", "v", match.query_pairs, "query SUBJECT, subject SUBJECT, compared long, differing long", "q", block=block)
    x, y = p.where("s % 7 = 1").select(F.col("s").alias("query"), "m", F.col("v").alias("a")), p.select(F.col("s").alias("subject"), "m", F.col("v").alias("b"))
    want = x.join(y, "m").where("query <> subject").groupBy("query", "subject").agg(F.count("*").alias("compared"), F.count_if(F.col("a") != F.col("b")).alias("differing"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100


def test_targets_without_an_event_meet_no_reads(spark):
    from helixframe.operators import denovo

    targets = spark.range(200).select(F.lit("1").alias("contig"), F.col("id").alias("pos"), (F.col("id") + 1).alias("anchor"), F.lit("D").alias("kind"), F.lit(2).alias("length"), F.lit(None).cast("string").alias("bases"))
    spans = spark.range(6).select(F.col("id").alias("read"), F.lit("1").alias("contig"), F.lit(1).cast("long").alias("start"), F.lit(199).cast("long").alias("end"))
    events = spark.range(6).where("id < 4").select(F.col("id").alias("read"), F.lit("1").alias("contig"), F.lit(51).cast("long").alias("anchor"), F.lit("D").alias("kind"), F.lit(2).alias("length"), F.lit(None).cast("string").alias("bases"))
    got = denovo.confirm_indels(targets, spans, events, 1)
    assert [tuple(r) for r in got.collect()] == [("1", 50, 4, 2)]
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def test_one_nation_is_not_one_task(spark):
    from helixframe.plans import structure

    t = type("T", (), {"customer": spark.range(200).select(F.col("id").alias("c_custkey"), (F.col("id") % 1 + 3).alias("c_nationkey"), F.lit("A").alias("c_mktsegment"), F.col("id").cast("double").alias("c_acctbal"))})()
    got = structure.fuzzy_kit_match(t)
    assert got.count() == got.select("a", "b").distinct().count() == 199 * 100
    assert got.select(F.spark_partition_id()).distinct().count() > 8


def test_files_of_pairs_are_small(spark, tmp_path):
    from helixframe.plans import structure

    t = type("T", (), {"customer": spark.range(1600).select((F.col("id") * 7919 % 100_003).alias("c_custkey"), F.lit(3).cast("long").alias("c_nationkey"), F.lit("A").alias("c_mktsegment"), F.lit(1.0).alias("c_acctbal"))})()
    structure.fuzzy_kit_match(t).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 1600 * 1599 // 2
    assert sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < 1600 * 1599 // 2


@pytest.mark.parametrize("written", [8, 2048])
def test_pairs_of_blocks_equal_a_join(spark, monkeypatch, written):
    from helixframe.operators import match

    monkeypatch.setattr(match, "WRITTEN", written)
    r = random.Random(written)
    rows = [(r.choice([1, 1, 1, 2, None]), r.choice([None, *range(300)]), k) for k in range(400)] + [(9, 5, 1)]
    df = spark.createDataFrame(rows, "g int, s long, v long")
    got = match.pairs_in_groups(df, "g", "s").select("x.s", "x.v", "y.s", "y.v").collect()
    want = [(a[1], a[2], b[1], b[2]) for a, b in itertools.product(rows, rows) if a[0] == b[0] and None not in (a[0], a[1], b[1]) and a[1] < b[1]]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20_000


def test_pairs_of_two_blocks_come_as_runs(spark, monkeypatch):
    from helixframe.operators import match

    real = match.block_pairs
    monkeypatch.setattr(match, "block_pairs", lambda *a, **k: real(*a, **k, block=8))
    rows = spark.range(64).select((F.col("id") * 7919 % 1009).alias("s"), F.lit(1).alias("m"), (F.col("id") % 3).alias("v"))
    got = [r.a for r in match.pair_distances(rows, "s", "m", "v").collect()]
    assert len(got) == 64 * 63 // 2 and sum(x != y for x, y in itertools.pairwise(got)) < 64 * 8
