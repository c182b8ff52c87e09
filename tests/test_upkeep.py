"""Batched alignment, position-bounded look-back, feeds and sketches against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe import registry
from helixframe.operators import batched
from helixframe.operators.kernels import align_global, pair_hmm
from helixframe.sources import feed, ingest, preflight
from helixframe.streaming import events

SF = "/root/testdata/sf0.001"


def pieces(r, n):
    out = []
    for _ in range(n):
        ref = "".join(r.choice("ACGT") for _ in range(r.randint(1, 40)))
        read = list(ref)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(read) + 1)
            if r.random() < 0.4:
                read[k:k] = r.choice("ACGT")
            elif len(read) > 1:
                del read[min(k, len(read) - 1)]
        out.append(("".join(read) if r.random() > 0.1 else "".join(r.choice("ACGT") for _ in range(r.randint(1, 30))), ref))
    return out


def test_alignments_of_a_batch_equal_single_ones():
    r = random.Random(1)
    pairs = pieces(r, 120)
    scores, pair, query, target = batched.align_batch([a for a, _ in pairs], [b for _, b in pairs])
    for k, (a, b) in enumerate(pairs):
        score, ops = align_global(a, b)
        p, q, want = 0, 0, []
        for op in ops:
            if op == "M":
                want.append((q, p))
            p, q = p + (op != "I"), q + (op != "D")
        own = pair == k
        assert scores[k] == score and list(zip(query[own].tolist(), target[own].tolist(), strict=True)) == want


def test_likelihoods_of_a_batch_equal_single_ones():
    r = random.Random(2)
    pairs = pieces(r, 60)
    quals = [[r.randint(2, 40) for _ in a] for a, _ in pairs]
    got = batched.hmm_batch([a for a, _ in pairs], quals, [b for _, b in pairs])
    assert np.allclose(got, [pair_hmm(a, np.array(q, float), b) for (a, b), q in zip(pairs, quals, strict=True)], atol=1e-9)


def test_batches_are_bounded_in_cells():
    r = np.random.default_rng(3)
    n, m = r.integers(1, 200, 300), r.integers(1, 200, 300)
    n[5] = m[5] = 5000
    parts = list(batched.batches_of_cells(n, m, 100_000))
    assert sorted(np.concatenate(parts).tolist()) == list(range(300)) and len(parts) < 150
    assert all(len(p) == 1 or len(p) * (n[p].max() + 1) * (m[p].max() + 1) <= 100_000 for p in parts)


def test_realigned_reads_equal_single_alignments(spark):
    from helixframe.plans.catalog import Tables
    from helixframe.plans.upkeep import _reads

    want = {}
    for x in _reads(Tables(spark, SF)).collect():
        p, places = x.start, []
        for op in align_global(x.bases, x.ref)[1]:
            if op == "M":
                places.append(p)
            p += op != "I"
        want[x.read] = (len(places), min(places), max(places), sum(places))
    got = {x.read: (x.aligned, x.first, x.last, x.places) for x in registry.queries()["realigned_reads"](spark, SF).collect()}
    assert got == want


def test_rescued_sites_equal_single_likelihoods(spark):
    from helixframe.operators import denovo

    r = random.Random(4)
    ref = "".join(r.choice("ACGT") for _ in range(40))
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    sites = [("1", 100 + k, other[ref[k]], 100, ref) for k in (9, 20, 31)]
    reads = []
    for _, pos, alt, start, _ in sites:
        o = pos - start
        for k in range(7):
            bases = ref[:o] + (alt if k < pos % 5 else ref[o]) + ref[o + 1 :]
            reads.append(("1", pos, f"f{k % 6}", bases[: 40 - k], [20 + k] * (40 - k)))
    reads.append(("1", 109, "x", "T" * 30, [40] * 30))
    want = {}
    for _, pos, alt, start, _ in sites:
        hap = ref[: pos - start] + alt + ref[pos - start + 1 :]
        best = {}
        for _, p, f, b, q in reads:
            if p == pos and (f not in best or (len(b), b) > (len(best[f][0]), best[f][0])):
                best[f] = (b, q)
        odds = [pair_hmm(b, np.array(q, float), h) * np.log(10) for b, q in best.values() for h in (ref, hap)]
        fits = [(x, y) for x, y in zip(odds[::2], odds[1::2], strict=True) if max(x, y) >= -30]
        want[pos] = (len(fits), sum(y > x for x, y in fits), sum(y - x for x, y in fits))
    got = denovo.rescue(spark.createDataFrame(sites, "contig string, pos long, alt string, start long, ref string"), spark.createDataFrame(reads, "contig string, pos long, fragment string, bases string, quals array<int>"))
    for x in got.collect():
        depth, alt, odds = want.pop(x.pos)
        assert (x.depth, x.alt_depth) == (depth, alt) and x.log_odds == pytest.approx(odds) and x.derived == (odds > 2 and alt >= 2)
    assert not want
    assert registry.queries()["haplotype_rescue"](spark, SF).where("derived and alt_depth > 0").count() > 0


def test_look_back_of_a_stream_equals_its_batch_form(spark, tmp_path):
    r = random.Random(6)
    batches = []
    for k in range(6):
        own = [(max(0, 900 * k + r.randrange(900) - r.choice((0, 0, 0, 500, 2500))), r.choice("+-"), k) for _ in range(400)]
        batches.append(spark.createDataFrame(own, "place long, strand string, batch int").coalesce(1))
        batches[-1].write.parquet(f"{tmp_path}/in/{k}")
    s = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = events.drain(spark, events.first_of_place(s, "place", ["place", "strand"], 700), "append", "look-back").collect()
    want = events.first_of_place_in_batches(batches, "place", ["place", "strand"], 700).collect()
    key = lambda x: (x.place, x.strand, x.batch)
    assert sorted(map(key, got)) == sorted(map(key, want))
    whole = {(x.place, x.strand) for b in batches for x in b.collect()}
    assert len(got) < len(whole)  # the bound bites


def test_retries_end_or_say_so(spark, tmp_path):
    rows = spark.createDataFrame([(k,) for k in range(9)], "id long")
    rows.write.parquet(f"{tmp_path}/rows")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/rows")
    ok = events.deliver_with_retries(stream(), f"{tmp_path}/a", "id", F.when(F.col("attempts") >= F.col("id") * 10, "ok").otherwise("transient"))
    assert ok.where("status <> 'SENT'").count() == 0 and ok.agg(F.max("attempts")).first()[0] == 81
    with pytest.raises(RuntimeError):
        events.deliver_with_retries(stream(), f"{tmp_path}/b", "id", F.lit("transient"), most=3)


CHANGES = [(1, 1, 1, "I", "a"), (2, 2, 1, "I", "b"), (3, 1, 3, "U", "c"), (4, 1, 2, "U", "late"), (5, 2, 2, "D", None), (6, 2, 1, "U", "too late"), (7, 3, 1, "I", "x"), (7, 3, 1, "I", "x"), (8, None, 1, "I", "no key")]
DDL = "change_id long, id long, seq long, op string, v string"


def replica(spark, path):
    return feed.Replica(spark, str(path), "id", ["seq", "change_id"], "change_id")


def test_a_feed_is_applied_once_however_it_is_replayed(spark, tmp_path):
    c = spark.createDataFrame(CHANGES, DDL)
    want = [(1, "c"), (3, "x")]
    rows = lambda x: sorted((r.id, r.v) for r in x.rows().collect())
    one = replica(spark, tmp_path / "one")
    assert one.rows() is None and one.head()["version"] == 0
    one.pull(c)
    assert rows(one) == want and one.head()["cursor"] == 8
    assert one.pull(c) == one.head() and one.head()["version"] == 1
    two = replica(spark, tmp_path / "two")
    for end in (2, 2, 4, 6, 5, 8):
        two.pull(c.where(F.col("change_id") <= end))
    assert rows(two) == want and two.head()["version"] == 4
    assert sorted((r.id, r.deleted) for r in two.state().collect()) == [(1, False), (2, True), (3, False)]


def test_of_two_writers_one_is_refused(spark, tmp_path):
    c = spark.createDataFrame(CHANGES, DDL)
    a, b = replica(spark, tmp_path), replica(spark, tmp_path)
    a.pull(c.where("change_id <= 2"))
    base = b.head()
    a.pull(c.where("change_id <= 4"))
    with pytest.raises(feed.Conflict):
        b.pull(c, base)
    assert b.head()["version"] == 2 and b.head()["cursor"] == 4
    b.pull(c)
    assert sorted((r.id, r.v) for r in a.rows().collect()) == [(1, "c"), (3, "x")]


def test_a_writer_lost_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    c = spark.createDataFrame(CHANGES, DDL)
    a = replica(spark, tmp_path)
    a.pull(c.where("change_id <= 2"))
    lost = replica(spark, tmp_path)
    monkeypatch.setattr(lost, "_commit", lambda entry: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        lost.pull(c)
    assert sorted((r.id, r.v) for r in a.rows().collect()) == [(1, "a"), (2, "b")]
    a.pull(c)
    assert a.head()["version"] == 2


def test_sketches_merge_like_the_whole(spark):
    r = random.Random(7)
    rows = [(k % 13, None if k % 50 == 0 else r.gauss(0, 1), r.randrange(4000)) for k in range(20_000)]
    df = spark.createDataFrame(rows, "part int, x double, id int").repartition(6)
    parts = preflight.part_sketches(df, ["part"], ["x"], ["id"])
    got = preflight.merged(parts, [], ["x"], ["id"], (0.1, 0.5, 0.9)).first()
    x = sorted(v for _, v, _ in rows if v is not None)
    assert (got.rows, got.x_nulls, got.x_min, got.x_max, got.id_nulls) == (20_000, 400, x[0], x[-1], 0)
    for share, q in zip((0.1, 0.5, 0.9), got.x_quantiles, strict=True):
        assert abs(np.searchsorted(x, q) / len(x) - share) < 0.01
    assert abs(got.id_distinct - len({i for _, _, i in rows})) < 4000 / 15
    few = preflight.merged(parts.where("part < 3"), [], ["x"], ["id"]).first()
    assert few.rows == sum(p < 3 for p, _, _ in rows)


def test_files_are_ingested_once(spark, tmp_path):
    import os

    folder = tmp_path / "in" / "a"
    folder.mkdir(parents=True)
    chip = "# 23andMe\nrs1234567\t1\t100\tAG\nrs2345678\t2\t200\t--\nbroken line\n"
    (folder / "one_23andme.txt").write_text(chip)
    (folder / "two_23andme.txt").write_text(chip)
    (folder / "none_23andme.txt").write_text("# 23andMe rs1234567 chip\nrs1\tx\ty\tAG\nrs2345678\tx\ty\tAG\nrs3345678\tx\ty\tAG\n")
    (folder / "notes.md").write_text("hello\n")
    store = ingest.Store(spark, str(tmp_path / "store"))
    assert store.rows("chip_data") is None
    name = lambda r: r.path.rsplit("/", 1)[1]
    got = {name(r): (r.outcome, r.rows) for r in store.ingest(str(tmp_path / "in")).collect()}
    assert got == {"one_23andme.txt": ("Imported", 2), "two_23andme.txt": ("Duplicate", 0), "none_23andme.txt": ("Empty", 0), "notes.md": ("Unrecognised", 0)}
    # Bytes that change behind the same size and time aren't looked at: a second run reads nothing.
    kept = os.stat(folder / "one_23andme.txt")
    (folder / "one_23andme.txt").write_text(chip.replace("AG", "CT"))
    os.utime(folder / "one_23andme.txt", ns=(kept.st_atime_ns, kept.st_mtime_ns))
    assert store.ingest(str(tmp_path / "in")).count() == 0 and store.manifest().count() == 4
    (folder / "three_23andme.txt").write_text(chip.replace("100", "150"))
    (folder / "four_23andme.txt").write_text(chip)
    assert {name(r): r.outcome for r in store.ingest(str(tmp_path / "in")).collect()} == {"three_23andme.txt": "Imported", "four_23andme.txt": "Duplicate"}
    rows = store.rows("chip_data")
    assert sorted((name(r), r.rsid, r.pos, r.genotype) for r in rows.collect()) == [("one_23andme.txt", "rs1234567", 100, "AG"), ("one_23andme.txt", "rs2345678", 200, "--"), ("three_23andme.txt", "rs1234567", 150, "AG"), ("three_23andme.txt", "rs2345678", 200, "--")]


def test_a_run_lost_before_its_manifest_is_run_again(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x_23andme.txt").write_text("rs1234567\t1\t100\tAG\nrs1234568\t1\t101\tAG\nrs1234569\t1\t102\tAG\n")
    store = ingest.Store(spark, str(tmp_path / "store"), {"chip_data": lambda lines: (_ for _ in ()).throw(OSError("gone"))})
    with pytest.raises(OSError):
        store.ingest(str(tmp_path / "in"))
    again = ingest.Store(spark, str(tmp_path / "store"))
    assert again.manifest().count() == 0
    assert [r.rows for r in again.ingest(str(tmp_path / "in")).collect()] == [3] and again.rows("chip_data").count() == 3


def test_components_on_a_basis_equal_a_plain_fit(spark):
    from helixframe.operators import components

    r = np.random.default_rng(8)
    n, m, k = 24, 60, 3
    group = np.arange(n) % 3
    freq = r.uniform(0.1, 0.9, (3, m))
    dosage = r.binomial(2, freq[group])
    dosage[r.random((n, m)) < 0.1] = -1
    dosage[:, 7] = -1
    basis = np.arange(n) % 4 > 0
    called = dosage >= 0
    mean = np.array([dosage[basis & called[:, j], j].mean() if (basis & called[:, j]).any() else 0.0 for j in range(m)])
    x = np.where(called, dosage - mean, 0.0)
    u, s, vt = np.linalg.svd(x[basis], full_matrices=False)
    v = vt[:k].T
    v *= np.where(np.take_along_axis(v, np.abs(v).argmax(0)[None], 0)[0] < 0, -1, 1)
    sites = int(called.any(0).sum())
    want = x @ v
    want[~basis] *= (sites / called[~basis].sum(1))[:, None]
    rows = [(j, i, int(dosage[i, j])) for i in range(n) for j in range(m)] + [(3, n, -1), (4, n, None)]
    df = spark.createDataFrame(rows, "site long, sample long, dosage int").repartition(4)
    f = components.fit(df, spark.createDataFrame([(int(i),) for i in np.flatnonzero(basis)], "sample long"), k)
    assert np.allclose(f.values, s[:k] ** 2, rtol=1e-7)
    got = {x.sample: (x.basis, x.pc1, x.pc2, x.pc3) for x in f.coordinates.collect()}
    assert sorted(got) == list(range(n))
    assert np.allclose([got[i][1:] for i in range(n)], want, atol=1e-3) and [got[i][0] for i in range(n)] == basis.tolist()
    load = {x.site: (x.mean, x.v1, x.v2, x.v3) for x in f.sites.collect()}
    assert np.allclose([load[j] for j in sorted(load)], np.column_stack((mean, v))[called.any(0)], atol=1e-4)
    c = {x.group: (x.n, x.mean1, x.var2) for x in components.centroids(f.coordinates, spark.createDataFrame([(int(i), int(group[i])) for i in range(n)], "sample long, group int"), k).collect()}
    for g in range(3):
        assert c[g][0] == (group == g).sum() and c[g][1] == pytest.approx(want[group == g, 0].mean(), abs=1e-3) and c[g][2] == pytest.approx(want[group == g, 1].var(ddof=1), abs=1e-2)


def test_close_components_settle_in_few_rounds(spark, monkeypatch):
    from helixframe.operators import components

    monkeypatch.setattr(components, "SPARE", 5)
    monkeypatch.setattr(components, "ROUNDS", 8)
    r = np.random.default_rng(4)
    n, m = 60, 900  # noise alone: the greatest values lie close together
    x = r.integers(0, 3, (n, m))
    df = spark.createDataFrame([(j, i, int(x[i, j])) for i in range(n) for j in range(m)], "site long, sample long, dosage int").repartition(2)
    f = components.fit(df, spark.createDataFrame([(i,) for i in range(n)], "sample long"), 2)
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(f.values, s[:2] ** 2, rtol=1e-7)
    got = {c.sample: (c.pc1, c.pc2) for c in f.coordinates.collect()}
    assert np.allclose(np.abs([got[i] for i in range(n)]), np.abs(u[:, :2] * s[:2]), atol=1e-3)


@pytest.mark.parametrize("block", [50, 1 << 15])
def test_a_product_is_one_pass_over_blocks(spark, monkeypatch, block):
    from helixframe.operators import components

    monkeypatch.setattr(components, "BLOCK_ENTRIES", block, raising=False)
    monkeypatch.setattr(components, "STRETCH", 7, raising=False)
    r = np.random.default_rng(6)
    n, m = 40, 90
    x = r.binomial(2, r.uniform(0.1, 0.9, (2, m))[np.arange(n) % 2])
    df = spark.createDataFrame([(f"s{j}", f"n{i}", int(x[i, j])) for i in range(n) for j in range(m)], "site string, sample string, dosage int").repartition(3)
    written, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda d, name, *a: (written.append(name), write(d, name, *a))[1])
    f = components.fit(df, spark.createDataFrame([(f"n{i}",) for i in range(n)], "sample string"), 2)
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(f.values, s[:2] ** 2, rtol=1e-7) and len(written) < 12
    got = {c.sample: (c.pc1, c.pc2) for c in f.coordinates.collect()}
    assert np.allclose(np.abs([got[f"n{i}"] for i in range(n)]), np.abs(u[:, :2] * s[:2]), atol=1e-3)


def test_long_factors_stay_tables(spark, monkeypatch):
    from helixframe.operators import components

    monkeypatch.setattr(components, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(components, "SPARE", 3)
    r = np.random.default_rng(7)
    x = r.binomial(2, r.uniform(0.1, 0.9, (2, 40))[np.arange(12) % 2])
    df = spark.createDataFrame([(j, i, int(x[i, j])) for i in range(12) for j in range(40)], "site long, sample long, dosage int").repartition(2)
    f = components.fit(df, spark.createDataFrame([(i,) for i in range(12)], "sample long"), 1)
    assert np.allclose(f.values, np.linalg.svd(x - x.mean(0))[1][:1] ** 2, rtol=1e-7)


def test_tables_of_a_batch_stay_narrow_and_equal_by_any_weights(monkeypatch):
    r = random.Random(6)
    pairs = pieces(r, 40)
    made = []
    empty = np.empty
    monkeypatch.setattr(batched.np, "empty", lambda shape, kind: made.append(np.dtype(kind)) or empty(shape, kind))
    scores, *_ = batched.align_batch([a for a, _ in pairs], [b for _, b in pairs])
    assert made == [np.int16]
    wide, *_ = batched.align_batch([a for a, _ in pairs], [b for _, b in pairs], 2000, -4000, -3000)
    assert made[1:] == [np.int32] and (wide == scores * 1000).all()


def test_a_read_is_one_row_of_places(spark):
    from helixframe.operators import denovo

    rows = [("a", "1", 100, "ACGTACGT", "ACGACGT"), ("b", "1", 200, "AAAA", "AAAA"), ("c", "1", 300, "ACGT", "")]
    got = denovo.align_pieces(spark.createDataFrame(rows, "read string, contig string, start long, ref string, bases string"), ["read"])
    assert {x.read: (x.places, x.queries) for x in got.collect()} == {"a": ([100, 101, 102, 104, 105, 106, 107], [0, 1, 2, 3, 4, 5, 6]), "b": ([200, 201, 202, 203], [0, 1, 2, 3])}


def test_likelihoods_are_summed_in_small_batches():
    assert batched.HMM_CELLS < batched.CELLS


def test_batches_of_several_files_stream_one_after_the_other(spark, tmp_path):
    import glob

    from helixframe.streaming import events as st

    r = random.Random(8)
    rows = [(100 * b + r.randrange(150), b) for b in range(5) for _ in range(40 if b == 2 else 9)]
    df = spark.createDataFrame(rows, "place long, batch long")
    s = st.batches_stream(df, "batch", f"{tmp_path}/in", file_rows=8)
    assert [len(glob.glob(f"{tmp_path}/in/{b}/*.parquet")) for b in range(5)] == [5] * 5
    got = st.drain(spark, st.first_of_place(s, "place", ["place"], 30), "append", "several").collect()
    batches = [df.where(F.col("batch") == b) for b in range(5)]
    want = st.first_of_place_in_batches([x.dropDuplicates(["place"]) for x in batches], "place", ["place"], 30).select("place")
    assert sorted(x.place for x in got) == sorted(x.place for x in want.collect())
