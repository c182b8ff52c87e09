"""Sequential kernels and fits against plain versions on seeded rows, and their queries against the kernels by group."""

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe import registry
from helixframe.operators import ancestry, archaic, denovo, kernels, placement, structural

SF = "/root/testdata/sf0.01"


def plain_viterbi(start, trans, emit):
    n, k = len(emit), len(start)
    best = [math.log(start[s]) + emit[0][s] for s in range(k)]
    back = []
    for i in range(1, n):
        row = []
        for s in range(k):
            row.append(max(range(k), key=lambda r: (best[r] + math.log(max(trans[i - 1][r][s], 1e-300)), -r)))
        best = [best[row[s]] + math.log(max(trans[i - 1][row[s]][s], 1e-300)) + emit[i][s] for s in range(k)]
        back.append(row)
    out = [max(range(k), key=lambda s: (best[s], -s))]
    for row in reversed(back):
        out.append(row[out[-1]])
    return out[::-1]


def plain_posteriors(start, trans, emit):
    """By enumeration of all paths."""
    from itertools import product

    n, k = len(emit), len(start)
    out, total = np.zeros((n, k)), 0.0
    for path in product(range(k), repeat=n):
        p = start[path[0]] * math.exp(emit[0][path[0]])
        for i in range(1, n):
            p *= trans[i - 1][path[i - 1]][path[i]] * math.exp(emit[i][path[i]])
        total += p
        for i, s in enumerate(path):
            out[i, s] += p
    return out / total


def test_hidden_markov_models():
    rng = np.random.default_rng(4)
    for k in (2, 3):
        for n in (1, 2, 7):
            start = rng.dirichlet(np.ones(k))
            trans = rng.dirichlet(np.ones(k), (max(n - 1, 1), k))
            emit = np.log(rng.random((n, k)))
            assert kernels.viterbi(start, trans[: max(n - 1, 0)] if n > 1 else trans, emit).tolist() == plain_viterbi(start, trans, emit)
            assert np.allclose(kernels.posteriors(start, trans, emit), plain_posteriors(start, trans, emit))


def plain_shared(ibs, window, share, tolerance, least):
    n, out, first, state = len(ibs), [], None, False
    if n < window:
        return []
    bad = sites = 0
    for i in range(n):
        near = ibs[max(0, i - window // 2) : min(n - 1, i + window // 2) + 1]
        fraction = (sum(x == 2 for x in near) + 0.5 * sum(x == 1 for x in near)) / len(near)
        if fraction >= share:
            if not state:
                state, first, bad, sites = True, i, 0, 0
            sites, bad = sites + 1, bad + (ibs[i] == 0)
        elif state:
            if bad / sites <= tolerance or sites < window:
                sites, bad = sites + 1, bad + (ibs[i] == 0)
            else:
                if sites >= least:
                    out.append((first, i - 1, sites))
                state = False
    if state and sites >= least:
        out.append((first, n - 1, sites))
    return out


def test_shared_segments():
    rng = np.random.default_rng(5)
    some = 0
    for _ in range(60):
        ibs = rng.choice(3, 300, p=[0.1, 0.2, 0.7])
        for a in rng.integers(0, 260, 3):
            ibs[a : a + 40] = rng.choice(3, 40, p=[0.6, 0.3, 0.1])
        got = kernels.ibd_candidates(ibs, 20, 0.7, 0.05, 10)
        assert got == plain_shared(ibs.tolist(), 20, 0.7, 0.05, 10)
        some += len(got)
    assert some > 20
    assert kernels.merge_candidates([(0, 9, 10), (15, 20, 6), (50, 60, 11)], 10) == [(0, 20, 22), (50, 60, 11)]


def test_anchored_clusters():
    assert kernels.anchored_clusters(np.array([1, 400, 501, 502, 900, 1003]), 500).tolist() == [0, 0, 0, 1, 1, 2]


def test_poisson_windows():
    n = np.array([0, 1, 0, 3, 4, 0])
    emit = [[c * math.log(r) - r - math.lgamma(c + 1) for r in (0.4, 2.0)] for c in n.tolist()]
    want = plain_posteriors([0.95, 0.05], [[[1 - 0.01, 0.01], [0.05, 0.95]]] * 5, emit)[:, 1]
    assert np.allclose(kernels.poisson_windows(n, (0.4, 2.0)), want)


def test_admixture_climbs_to_a_maximum():
    rng = np.random.default_rng(6)
    p = rng.uniform(0.05, 0.95, (400, 3))
    q = np.array([0.6, 0.3, 0.1])
    x = rng.binomial(2, p @ q)
    got = ancestry.admixture(x, p)

    def loglik(w):
        f = np.clip(p, 0.001, 0.999) @ w
        return (x * np.log(f) + (2 - x) * np.log(1 - f)).sum()

    for _ in range(200):
        other = rng.dirichlet(np.ones(3))
        assert loglik(got) >= loglik(0.99 * got + 0.01 * other) - 1e-6
    assert abs(got - q).max() < 0.15


def test_pca_fit(spark):
    rows = [r.v for r in spark.read.parquet(f"{SF}/embeddings.parquet").select(F.slice("embedding", 1, 8).alias("v")).collect()]
    x = np.array(rows, float)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    got = {r.component: r for r in registry.queries()["pca_fit"](spark, SF).collect()}
    for k in range(3):
        v = vectors[:, -1 - k]
        v = v * np.sign(v[np.abs(v).argmax()])
        assert got[k + 1].variance == pytest.approx(values[-1 - k]) and np.allclose(got[k + 1].loadings, v, atol=1e-6)


def test_greedy_overlaps(spark):
    r = random.Random(7)
    make = lambda n: [(k, r.choice("xy"), "DEL", s, s + r.randint(0, 40)) for k in range(n) for s in [r.randint(0, 900)]]
    a, b = make(60), make(60)
    schema = "id long, contig string, kind string, start long, end long"
    got = {(x.a_id, x.b_id) for x in structural.merge_evidence(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 64).collect()}
    used, want = set(), set()
    pairs = sorted((x[3], x[0], y[3], y[0]) for x in a for y in b if x[1] == y[1] and x[3] <= y[4] and y[3] <= x[4])
    for _, i, _, j in pairs:
        if ("a", i) not in used and ("b", j) not in used:
            used |= {("a", i), ("b", j)}
            want.add((i, j))
    assert got == want and len(want) > 5


def test_candidate_branches(spark):
    r = random.Random(8)
    carried = [(b, 100 * b + m, 1_000_000 * (b + 1) + 5_000 * p) for b in range(3) for p in range(30) for m in r.sample(range(8), r.randint(1, 5))]
    carried += [(b, 100 * b + m, 7) for b in (0, 1) for m in (0, 1)] + [(2, 200 + m, 9_000_000 + d) for m in (0, 1) for d in (0, 900)]
    df = spark.createDataFrame(carried, "block long, member long, pos long")
    got = {(x.block, x.carriers): (x.rank, x.positions, x.accepted) for x in placement.candidate_branches(df).collect()}
    want = {}
    for b in range(3):
        at = defaultdict(set)
        for block, m, p in carried:
            if block == b and p not in (7, 9_000_000, 9_000_900):
                at[p].add(m)
        groups = defaultdict(list)
        for p, ms in at.items():
            if len(ms) > 1:
                groups[tuple(sorted(ms))].append(p)
        taken = []
        for k, (ms, ps) in enumerate(sorted(groups.items(), key=lambda g: (-len(g[0]), -len(g[1]), min(g[1])))):
            ok = all(not set(ms) & t or set(ms) <= t or t <= set(ms) for t in taken)
            if ok:
                taken.append(set(ms))
            want[b, ",".join(map(str, ms))] = (k + 1, ",".join(map(str, sorted(ps))), ok)
    assert got == want and any(not v[2] for v in want.values())


def test_a_position_that_a_quarter_of_many_donors_carry_is_no_branch(spark):
    rows = [(m % 2, m, 10_000 * (m % 2) + 50_000) for m in range(40)] + [(0, m, 90_000) for m in range(0, 26, 2)] + [(0, m, 120_000) for m in (0, 2)]
    got = {x.pos for x in placement.candidate_positions(spark.createDataFrame(rows, "block long, member long, pos long")).collect()}
    assert got == {120_000}


def test_mixture_fit(spark):
    rng = np.random.default_rng(9)
    drift = rng.normal(0, 0.12, (3000, 7))
    base = rng.uniform(0.2, 0.8, 3000)
    drift[:, 3:] += drift[:, [0, 1, 2, 0]] * 0.7
    freqs = np.clip(base[:, None] + drift, 0.01, 0.99)
    q = np.array([0.5, 0.3, 0.2])
    dosage = rng.binomial(2, np.clip(freqs[:, :3] @ q, 0, 1))
    rows = [("s", str(k % 3), int(k // 3 * 100_000), int(d), f.tolist()) for k, (d, f) in enumerate(zip(dosage, freqs, strict=True))] + [("s", "0", 5, -1, freqs[0].tolist())]
    df = spark.createDataFrame(rows, "sample string, contig string, pos long, dosage int, freqs array<double>")
    got = archaic.fit_mixtures(df, "sample", [0, 1, 2], [3, 4, 5, 6]).first()
    assert abs(np.array(got.weights) - q).max() < 0.25 and abs(sum(got.weights) - 1) < 1e-9 and got.sites == 3000 and got.dof == 1
    # The estimates and their covariance by leaving out one block at a time.
    quartets = archaic.quartets([0, 1, 2], [3, 4, 5, 6])
    by = defaultdict(list)
    for _, c, p, d, f in rows[:-1]:
        g = lambda i, d=d, f=f: d / 2 if i < 0 else f[i]
        by[c, p // archaic.BLOCK_BP].append([(g(a) - g(b)) * (g(x) - g(y)) for a, b, x, y in quartets])
    blocks = [np.array(v) for _, v in sorted(by.items())]
    whole = np.concatenate(blocks)
    theta, n, pseudo = whole.mean(0), len(whole), []
    without = [np.concatenate([y for j, y in enumerate(blocks) if j != k]).mean(0) for k in range(len(blocks))]
    h = [n / len(b) for b in blocks]
    centre = len(blocks) * theta - sum((x - 1) / x * w for x, w in zip(h, without, strict=True))
    cov = sum(np.outer(d, d) / (x - 1) for x, d in ((x, x * theta - (x - 1) * w - centre) for x, w in zip(h, without, strict=True))) / len(blocks)
    sums, sizes = np.array([b.sum(0) for b in blocks]), np.array([len(b) for b in blocks], float)
    mine, mycov = archaic.jackknife(sums, sizes)
    assert np.allclose(mine, theta) and np.allclose(mycov, cov)
    # At the weights found, no step nearby lowers the objective under the covariance of the residual there.
    w, k = np.array(got.weights)[1:], 3
    c = np.concatenate(([1.0], -w))
    sigma = sum(c[i] * c[j] * cov[i * k : i * k + k, j * k : j * k + k] for i in range(3) for j in range(3))
    loss = lambda v: (r := theta[:k] - theta[k:].reshape(2, k).T @ v) @ np.linalg.inv(sigma) @ r
    assert loss(w) == pytest.approx(got.chi2, rel=1e-4)
    assert all(loss(w + d) >= loss(w) - 1e-9 for d in rng.normal(0, 0.01, (50, 2)))


def test_phasing_and_local_ancestry_by_contig(spark):
    rng = np.random.default_rng(10)
    panel = rng.integers(0, 2, (12, 80))
    labels = ["A"] * 6 + ["B"] * 6
    one = np.concatenate((panel[0, :40], panel[7, 40:]))
    two = panel[8]
    rows = [(c, int(k * 100), float(k), panel[:, k].tolist(), labels) for c in ("1", "2") for k in range(80)]
    p = spark.createDataFrame(rows, "contig string, pos long, cm double, alleles array<int>, labels array<string>")
    d = spark.createDataFrame([("s", c, int(k * 100), int(one[k] + two[k])) for c in ("1", "2", "9") for k in range(80)] + [("s", "1", 5, 1)], "sample string, contig string, pos long, dosage int")
    got = kernels.phase_samples(d, p, 32, 4)
    side = kernels.phase(one + two, panel, 32, 4)
    for c in ("1", "2"):
        assert [(r.side0, r.side1) for r in got.where(F.col("contig") == c).orderBy("pos").collect()] == [(int(a), int(o + t - a)) for a, o, t in zip(side, one, two, strict=True)]
    assert got.where("contig = '9'").count() == 0
    whole = spark.createDataFrame([("s", "1", int(k * 100), int(one[k]), int(two[k])) for k in range(80)], "sample string, contig string, pos long, side0 int, side1 int")
    found = sorted((r.side, r.start, r.label) for r in kernels.local_ancestry(whole, p, 4.0).collect())
    assert [x for x in found if x[0] == 1] == [(1, 0, "B")]
    a, b = [x for x in found if x[0] == 0]
    assert (a[2], b[2]) == ("A", "B") and abs(b[1] - 4000) <= 500


def test_normalized_indels(spark):
    seq = "ACACACGTTTTG"  # positions 1 to 12
    assert denovo.shift_left(5, "D", 2, None, seq, 1) == (1, None)
    assert denovo.shift_left(11, "D", 1, None, seq, 1) == (8, None)
    assert denovo.shift_left(12, "I", 1, "T", seq, 1) == (8, "T")
    assert denovo.shift_left(7, "I", 2, "AC", seq, 1) == (1, "AC")
    ev = spark.createDataFrame([("r", "1", 11, "D", 1, None), ("r", "1", 7, "I", 2, "AC")], "read string, contig string, anchor long, kind string, length int, bases string")
    blocks = spark.createDataFrame([("1", 1, seq)], "contig string, start long, seq string")
    assert sorted((r.anchor, r.bases or "") for r in denovo.normalize_indels(ev, blocks, 100).collect()) == [(1, "AC"), (8, "")]
    e = spark.createDataFrame([("G", "GAC"), ("GAC", "G"), ("G", "A")], "a string, d string").select(denovo.expected_indel(F.col("a"), F.col("d")).alias("x")).collect()
    assert [(r.x and (r.x.kind, r.x.length, r.x.bases)) for r in e] == [("I", 2, "AC"), ("D", 2, None), None]


def test_realignment_and_rescue(spark):
    ref = "ACGTTGCATGCCAGTACCTA"
    piece = [("r", "1", 101, ref, ref[:8] + ref[10:], [30] * 18)]
    got = denovo.realign(spark.createDataFrame(piece, "read string, contig string, start long, ref string, bases string, quals array<int>")).orderBy("ref_pos").collect()
    assert "".join(x.base for x in got) == ref[:8] + ref[10:] and {x.ref_pos for x in got} >= {101, 120} and len(got) == 18
    alt = ref[:9] + "T" + ref[10:]
    reads = [("1", 110, f"f{k}", alt if k < 5 else ref, [30] * 20) for k in range(6)] + [("1", 110, "f0", alt[:12], [30] * 12), ("1", 110, "junk", "G" * 20, [30] * 20)]
    c = spark.createDataFrame([("1", 110, "T", 101, ref)], "contig string, pos long, alt string, start long, ref string")
    r = denovo.rescue(c, spark.createDataFrame(reads, "contig string, pos long, fragment string, bases string, quals array<int>")).first()
    assert (r.depth, r.alt_depth, r.derived) == (6, 5, True) and r.log_odds > 2


@pytest.mark.parametrize("name", ["segment_candidates", "cnv_segments", "anchored_clusters", "roh_hmm", "archaic_hmm", "site_match_hmm", "paint_viterbi", "admixture_em", "overlap_greedy", "candidate_branches", "deep_ancestry", "phase_haplotypes", "local_ancestry"])
def test_queries_give_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def likeliest(start, trans, emit):
    """Path and per-site posteriors by listing all paths; ``trans`` is one matrix a step, all in plain probabilities."""
    n, k = len(emit), len(start)
    weight = {}
    for path in itertools.product(range(k), repeat=n):
        p = start[path[0]] * emit[0][path[0]]
        for i in range(1, n):
            p *= trans[i - 1][path[i - 1]][path[i]] * emit[i][path[i]]
        weight[path] = p
    best = max(weight, key=weight.get)
    total = sum(weight.values())
    return list(best), [[sum(w for path, w in weight.items() if path[i] == s) / total for s in range(k)] for i in range(n)]


def test_homozygosity_equals_listing_all_paths():
    rng = np.random.default_rng(21)
    for _ in range(5):
        n = 9
        freq, het, cm = rng.uniform(0.05, 0.95, n), rng.random(n) < 0.3, np.cumsum(rng.uniform(0.1, 40, n))
        trans = kernels.switch_matrix(np.diff(cm), 0.02, 2)
        emit = [[2 * f * (1 - f) if h else 1 - 2 * f * (1 - f), 0.002 if h else 0.998] for f, h in zip(freq, het, strict=True)]
        path, post = likeliest([0.9, 0.1], trans, emit)
        states, got = kernels.roh_states(freq, het, cm)
        assert states.tolist() == path and np.allclose(got, [p[1] for p in post])


def test_homozygous_segments_of_a_frame(spark):
    rows = [("s", k * 1000, k * 0.5, 0.5, not 20 <= k < 50) for k in range(70)]
    df = spark.createDataFrame([r for r in rows if r[4] or 20 <= r[1] // 1000 < 50], "sample string, pos long, cm double, freq double, het boolean")
    got = kernels.roh_segments(df, ["sample"], 5).collect()
    assert [(r.start, r.end, r.sites) for r in got] == [(20_000, 49_000, 30)] and got[0].posterior > 0.9


def test_site_matches_equal_listing_all_paths():
    rng = np.random.default_rng(22)
    for _ in range(5):
        n = 9
        carried, pos = rng.random(n) < 0.4, np.cumsum(rng.integers(100, 40_000, n))
        back = min(max(carried.sum() / n, 0.001), 0.5)
        high = min(4.5 * back, 0.999)
        emit = [[q if c else 1 - q for q in (back, high)] for c in carried]
        _, post = likeliest([0.98, 0.02], kernels.switch_matrix(np.diff(pos), 1e-5, 2), emit)
        assert np.allclose(kernels.match_posterior(carried, carried.sum(), n, pos), [p[1] for p in post])


def test_matching_segments_of_a_frame(spark):
    rows = [("s", 1000 * k, 100 <= k < 140 or k % 25 == 0) for k in range(300)]
    got = kernels.match_segments(spark.createDataFrame(rows, "sample string, pos long, carried boolean"), ["sample"], 0.9, 16, 5000).collect()
    assert len(got) == 1 and abs(got[0].start - 100_000) <= 2000 and abs(got[0].end - 139_000) <= 2000 and got[0].carried >= 38


def test_copy_number_segments_by_hand(spark):
    z = [0, 3, 1.5, 1, 2, 2, 0.5, 0, 0, 2.4, 0, -2.6, -1.3, 0, -1.3, -1.3, 0, 0, 0, 9]
    # A seed of 3 grows over one low bin, as two of the next three hold; the tail is cut back to the last that holds.
    assert kernels.cnv_segments(np.array(z)) == [(1, 5, 1), (11, 15, -1), (19, 19, 1)]
    rows = [("s", k, float(x), 10.0 + 5 * x, 10.0) for k, x in enumerate(z)]
    got = kernels.depth_segments(spark.createDataFrame(rows, "sample string, bin long, z double, n double, expected double"), ["sample"], 100, 200).orderBy("start").collect()
    assert [(r.start, r.end, r.kind, r.bins) for r in got] == [(100, 600, "DUP", 5), (1100, 1600, "DEL", 5)]
    assert got[0].mean_z == pytest.approx(np.mean(z[1:6])) and got[0].log2 == pytest.approx(np.mean(np.log2(np.maximum((10 + 5 * np.array(z[1:6])), 0.5) / 10)))


@pytest.mark.parametrize("diploid", [True, False])
def test_painting_equals_listing_all_paths(diploid):
    rng = np.random.default_rng(23)
    n, k = 6, 3
    for _ in range(4):
        freqs, pos = rng.uniform(0.02, 0.98, (n, k)), np.cumsum(rng.integers(1000, 90_000, n)).astype(float)
        states = [(a, b) for a in range(k) for b in range(a, k)] if diploid else [(a,) for a in range(k)]
        dosage = rng.integers(0, 3 if diploid else 2, n)
        emit = []
        for i in range(n):
            row = []
            for s in states:
                f = [freqs[i, a] for a in s]
                two = [(1 - f[0]) * (1 - f[-1]), f[0] * (1 - f[-1]) + f[-1] * (1 - f[0]), f[0] * f[-1]]
                row.append(two[dosage[i]] if diploid else (f[0] if dosage[i] else 1 - f[0]))
            emit.append(row)
        m = len(states)
        path, _ = likeliest([1 / m] * m, kernels.switch_matrix(np.diff(pos), 1e-5, m), emit)
        assert kernels.paint(dosage, freqs, pos, 1e-5, diploid).tolist() == path


def test_switch_matrix_stays_with_the_distance():
    got = kernels.switch_matrix(np.array([0.0, 3.0]), 0.5, 3)
    assert np.allclose(got[0], np.eye(3)) and np.allclose(got.sum(2), 1)
    assert got[1][0][0] == pytest.approx(np.exp(-1.5)) and got[1][0][1] == pytest.approx((1 - np.exp(-1.5)) / 2)


def test_a_side_is_right_beside_the_mean(spark):
    values = [-1e-9, 0.0, 1e-9, 0.003]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    p = [r[0] for r in rows.select(ancestry.normal_percentile(F.col("v"), F.lit(0.0), F.lit(3000.0), F.lit(500))).collect()]
    assert p[0] < 50 and p[1] == 50 and p[2] > 50 and p[3] > 50
    t = type("T", (), {"customer": spark.createDataFrame([(1, 0, 0.0), (2, 0, 6000.0), (3, 0, 3000.001), (4, 0, 2999.999)], "c_custkey long, c_nationkey int, c_acctbal double")})()
    from helixframe.plans import inference

    side = {r.c_custkey: r.side for r in inference.normal_percentile_side(t).collect()}
    assert side == {1: "below", 2: "above", 3: "above", 4: "below"}


def test_a_panel_is_not_gathered(spark):
    sites = spark.range(40).select(F.lit("1").alias("contig"), (F.col("id") * 100).alias("pos"), F.col("id").cast("double").alias("cm"), F.array(*(F.lit(0), F.lit(1)) * 3).alias("alleles"), F.array(*(F.lit("A"), F.lit("B")) * 3).alias("labels"))
    d = spark.range(40).select(F.lit("s").alias("sample"), F.lit("1").alias("contig"), (F.col("id") * 100).alias("pos"), F.lit(1).alias("dosage"))
    phased = kernels.phase_samples(d, sites, 4, 2)
    assert not hasattr(kernels, "sent_panel")
    assert {r.side0 + r.side1 for r in phased.collect()} == {1}


def test_copying_over_blocks_equals_one_block(monkeypatch):
    rng = np.random.default_rng(31)
    panel, labels = rng.integers(0, 2, (8, 53)).astype(np.int8), np.array(list("ABABABCC"))
    hap, cm = rng.integers(0, 2, 53), np.cumsum(rng.uniform(0, 3, 53))
    whole = kernels.copying_posteriors(hap, panel, labels, cm)
    monkeypatch.setattr(kernels, "BLOCK_SITES", 7)
    assert np.array_equal(kernels.copying_posteriors(hap, panel, labels, cm), whole)
    like = np.where(panel == hap, 0.99, 0.01).T
    stay, f, b = np.exp(-0.05 * np.diff(cm)), [like[0] / like[0].sum()], [np.ones(8)]
    for i in range(1, 53):
        x = (stay[i - 1] * f[-1] + (1 - stay[i - 1]) / 8) * like[i]
        f.append(x / x.sum())
    for i in range(51, -1, -1):
        x = like[i + 1] * b[-1]
        b.append(stay[i] * x + (1 - stay[i]) * x.mean())
        b[-1] = b[-1] / b[-1].max()
    p = np.array(f) * np.array(b[::-1])
    want = np.stack([p[:, labels == k].sum(1) * (labels == k).sum() ** -0.25 for k in "ABC"], 1)
    assert np.allclose(whole, want / want.sum(1, keepdims=True))


def test_greedy_overlaps_of_many_list_no_pairs(spark):
    n = 3000
    a = spark.range(n).select("id", F.lit("x").alias("contig"), F.lit("DEL").alias("kind"), F.lit(5).cast("long").alias("start"), F.lit(9).cast("long").alias("end"))
    got = structural.merge_evidence(a, a, 64)
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == [(k, k) for k in range(n)]


def test_kernels_hold_few_bytes_a_site():
    import tracemalloc

    rng = np.random.default_rng(31)
    n = 30_000
    freqs, het, cm = rng.uniform(0, 1, (n, 3)), rng.random(n) < 0.3, np.cumsum(rng.uniform(0.1, 9, n))
    dosage, pos = rng.integers(0, 3, n), np.cumsum(rng.integers(1, 9000, n))
    for run in (lambda: kernels.paint(dosage, freqs, pos, 1e-5), lambda: kernels.roh_states(freqs[:, 0], het, cm), lambda: kernels.match_posterior(het, het.sum(), n, pos)):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 200 * n


def test_blocks_of_sites_change_nothing(monkeypatch):
    rng = np.random.default_rng(32)
    n = 40
    freqs, het, cm = rng.uniform(0, 1, (n, 3)), rng.random(n) < 0.3, np.cumsum(rng.uniform(0.1, 40, n))
    dosage, pos = rng.integers(0, 3, n), np.cumsum(rng.integers(1, 90_000, n))
    run = lambda: [kernels.paint(dosage, freqs, pos, 1e-5), *kernels.roh_states(freqs[:, 0], het, cm), kernels.match_posterior(het, het.sum(), n, pos)]
    whole = run()
    for size in (1, 7, 20):
        monkeypatch.setattr(kernels, "BLOCK_SITES", size)
        assert all(np.array_equal(x, y) for x, y in zip(run(), whole, strict=True))


def test_groups_go_on_over_batches(spark):
    rows = [(s, k * 1000, k * 0.5, 0.5, False) for s in ("a", "b", None) for k in range(40)]
    df = spark.createDataFrame(rows, "sample string, pos long, cm double, freq double, het boolean").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = kernels.roh_segments(df, ["sample"], 5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(((r.sample or "", r.start, r.end, r.sites) for r in got)) == [("", 0, 39_000, 40), ("a", 0, 39_000, 40), ("b", 0, 39_000, 40)]


def test_equal_sites_count_as_often_as_they_come(spark, monkeypatch):
    rows = [(s, d, [0.9, 0.1] if k % 3 else [0.2, 0.7]) for s in (1, 2) for k, d in enumerate([2, 0, 1, 2, -1] * 20)]
    seen, run = [], ancestry.sited
    monkeypatch.setattr(ancestry, "sited", lambda df, *a: (seen.append(df.count()), run(df, *a))[1])
    got = {(r.sample, r.pop): (r.share, r.sites) for r in ancestry.admixture_shares(spark.createDataFrame(rows, "sample int, dosage int, freqs array<double>"), "sample", ["x", "y"]).collect()}
    own = [(d, f) for s, d, f in rows if s == 1 and d >= 0]
    q = ancestry.admixture(np.array([d for d, _ in own], float), np.array([f for _, f in own]))
    assert seen == [12] and len(got) == 4 and all(got[s, p][0] == pytest.approx(q[i], abs=1e-9) and got[s, p][1] == 80 for s in (1, 2) for i, p in enumerate("xy"))


def test_intervals_of_a_full_bin_are_dealt(spark):
    from helixframe.operators import intervals

    points = [(c, p) for c in ("1", "2") for p in range(0, 400, 7)]
    held = [(k, "1" if k % 5 else "2", (k * 13) % 300, (k * 13) % 300 + 40) for k in range(200)]
    got = intervals.point_in_many(spark.createDataFrame(points, "contig string, pos long"), spark.createDataFrame(held, "k long, contig string, start long, end long"), ["contig"], "pos", "start", "end", 100, most=10)
    want = sorted((c, p, k) for c, p in points for k, d, a, b in held if c == d and a <= p <= b)
    assert sorted((r.contig, r.pos, r.k) for r in got.collect()) == want
    assert "_part" in got._jdf.queryExecution().optimizedPlan().toString()


def test_panel_rows_decide_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(denovo, "PANEL_ROWS", 10)
    panel = spark.createDataFrame([("1", p, "A", "C") for p in range(30)], "contig string, pos long, ref string, alt string")
    obs = spark.createDataFrame([("1", p, "C", 30) for p in range(20) for _ in range(5)], "contig string, pos long, base string, baseq int")
    got = denovo.panel_genotypes(panel, obs)
    assert got.rdd.getNumPartitions() == 10
    assert sorted((r.pos, r.dosage, r.depth) for r in got.collect()) == [(p, 2, 5) if p < 20 else (p, -1, 0) for p in range(30)]


def test_a_site_is_a_few_steps_over_arrays(monkeypatch):
    r = np.random.default_rng(5)
    panel = r.integers(0, 2, (10, 90)).astype(np.int8)
    g = (panel[0] + panel[3]).astype(int)
    seen, sort = [], np.sort
    monkeypatch.setattr(np, "sort", lambda *a, **k: (seen.append(1), sort(*a, **k))[1])
    side = kernels.phase(g, panel, 8, 4)
    monkeypatch.undo()
    assert len(seen) <= 90 and set(np.unique(g - side)) <= {0, 1}
    labels, cm = np.array(list("AABBBCCCAA")), np.arange(90) / 7
    both = kernels.copying_posteriors(np.stack([side, g - side]), panel, labels, cm)
    for k, hap in enumerate((side, g - side)):
        assert np.array_equal(both[k], kernels.copying_posteriors(hap, panel, labels, cm))
