"""Binary alignments, stores and trees read back, and rules against known values."""

import json
import sqlite3
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from helixframe.functions import bands, rules
from helixframe.operators import consensus, placement
from helixframe.sources import alignments, files, genealogy, variants
from helixframe.streaming import events


def bgzf(data: bytes, size: int = 150) -> bytes:
    out = b""
    for k in [*range(0, len(data), size), len(data)]:
        part = data[k : k + size]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def record(name, flags, ref, pos, mapq, ops, mate, mate_pos, tlen, seq, quals, sa=None):
    cigar = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops)
    codes = ["=ACMGRSVTWYHKDBN".index(x) for x in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    raw = bytes(ord(q) - 33 for q in quals) if quals else b"\xff" * len(seq)
    aux = b"NMi" + struct.pack("<i", 1) + b"XBBs" + struct.pack("<ihh", 2, 7, 8) + (b"SAZ" + sa.encode() + b"\0" if sa else b"")
    body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, mapq, 0, len(ops), flags, len(seq), mate, mate_pos - 1, tlen) + name.encode() + b"\0" + cigar + packed + raw + aux
    return struct.pack("<i", len(body)) + body


@pytest.fixture(scope="module")
def bam(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "x.bam")
    text = b"@HD\tVN:1.6\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(n) + 1) + n + b"\0" + struct.pack("<i", 1000) for n in (b"chr1", b"chrY"))
    rows = [record(f"r{k}", 99 if k % 2 else 16, 0 if k < 12 else 1, 10 * k + 1, 60 if k % 3 else 255, [(2, "S"), (4, "M"), (1, "D"), (1, "I")], 0, 5, -7, "ACGTNAC", "ABCDEFG" if k % 4 else "", "chrY,5,+,4M,60,0;" if k == 3 else None) for k in range(20)]
    rows += [record("u", 4, -1, 0, 255, [], -1, 0, 0, "", "")]
    with open(path, "wb") as f:
        f.write(bgzf(head + b"".join(rows)))
    return path


def test_binary_alignments(spark, bam):
    text, contigs, _ = alignments.read_header(bam)
    assert text.startswith("@HD") and contigs == [("chr1", 1000), ("chrY", 1000)]
    whole = alignments.read_bam(spark, bam).collect()
    assert len(whole) == 21
    r = next(x for x in whole if x.name == "r3")
    assert tuple(r) == ("r3", 99, "chr1", 31, None, "2S4M1D1I", "chr1", 5, -7, "ACGTNAC", "ABCDEFG", "chrY,5,+,4M,60,0;")
    u = next(x for x in whole if x.name == "u")
    assert (u.contig, u.pos, u.cigar, u.seq, u.quals, u.mate_contig) == (None, None, None, None, None, None)
    index = alignments.build_index(spark, bam, every=4)
    rows = index.orderBy("place").collect()
    assert [(x.contig, x.pos) for x in rows] == [("chr1", 1), ("chr1", 41), ("chr1", 81), ("chrY", 121), ("chrY", 161), (None, None)]
    parts = alignments.read_bam(spark, bam, index, ["name", "pos", "seq"])
    assert parts.columns == ["name", "pos", "seq"] and sorted(map(str, parts.collect())) == sorted(str(x) for x in alignments.read_bam(spark, bam).select("name", "pos", "seq").collect())
    assert parts.rdd.getNumPartitions() == 6
    got = alignments.read_region(spark, bam, index, "chr1", 35, 85, ["name"]).collect()
    # r3 begins at 31 and covers five bases.
    assert sorted(x.name for x in got) == ["r3", "r4", "r5", "r6", "r7", "r8"]
    assert [x.name for x in alignments.read_region(spark, bam, index, "chr1", 36, 40, ["name"]).collect()] == []
    assert [x.name for x in alignments.read_region(spark, bam, index, "chr1", 85, 90, ["name"]).collect()] == ["r8"]
    assert sorted(x.name for x in variants.region(alignments.read_bam(spark, bam), "chr1", 35, 41).collect()) == ["r3", "r4"]
    assert alignments.read_region(spark, bam, index, "chrX", 1, 9).count() == 0
    assert [x.name for x in alignments.read_unmapped(spark, bam, index).collect()] == ["u"]


def test_not_a_bam(tmp_path):
    (tmp_path / "x").write_bytes(bgzf(b"hello"))
    with pytest.raises(ValueError):
        alignments.read_header(str(tmp_path / "x"))


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER, name TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(k, None if k % 3 == 0 else f"n{k}") for k in range(25)])
    got = genealogy.sqlite_table(spark, path, "t", "id long, name string", stretch=7)
    assert sorted((r.id, r.name) for r in got.collect()) == [(k, None if k % 3 == 0 else f"n{k}") for k in range(25)]
    with pytest.raises(ValueError):
        genealogy.sqlite_table(spark, path, "t; drop", "id long")


def test_nested_tree(spark, tmp_path):
    tree = {"roots": [{"id": 1, "name": "A", "variants": [], "children": [{"id": 2, "name": "B", "variants": [{"canonical_name": "M1", "coordinates": {"hs1": {"position": 5, "ancestral": "G", "derived": "A"}, "GRCh38": {"position": 7, "ancestral": "G", "derived": "A"}}, "link_ancestral": "C", "link_derived": "T"}], "children": []}]}]}
    deep = node = {"id": 100, "name": "n100", "children": []}
    for k in range(101, 1500):
        node["children"] = [{"id": k, "name": f"n{k}", "children": []}]
        node = node["children"][0]
    tree["roots"].append(deep)
    (tmp_path / "tree.json").write_text(json.dumps(tree))
    rows = genealogy.nested_tree(spark, str(tmp_path / "tree.json")).collect()
    assert len(rows) == 1 + 2 + 1400
    assert sorted(tuple(r) for r in rows if r.node == 2) == [(2, 1, "B", "M1", "GRCh38", 7, "C", "T"), (2, 1, "B", "M1", "hs1", 5, "C", "T")]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_known_bands(spark):
    cm = lambda x: bands.relationship(F.lit(x))
    assert one(spark, cm(3500.0), cm(2600.0), cm(700.0), cm(8.0), cm(3.0)) == ("ParentChild", "FullSibling", "FirstCousin", "Distant", "Unknown")
    assert one(spark, *(bands.roh_class(F.lit(x)) for x in (4.9, 5.0, 14.9, 15.0))) == ("short", "medium", "medium", "long")
    none = F.lit(None)
    t = lambda a, y, m, has, p, v, n=None, label=None: bands.test_type(F.lit(a), F.lit(y), F.lit(m), F.lit(has), F.lit(p).cast("string"), F.lit(v).cast("string"), F.lit(n).cast("int"), F.lit(label).cast("string"))
    assert one(spark, t(0.0, 35.0, 0.0, False, "ILLUMINA", "FamilyTreeDNA"), t(0.0, 35.0, 0.0, False, "ILLUMINA", "Full Genomes"), t(0.0, 35.0, 0.0, False, "ILLUMINA", "YSEQ"), t(1.8, 51.0, 0.0, True, "ILLUMINA", None)) == ("TARGETED_Y", "Y_ELITE", "Y_PRIME", "TARGETED_Y")
    assert one(spark, t(0.0, 35.0, 0.0, False, "ILLUMINA", "FamilyTreeDNA", None, "BIG_Y_500"), t(30.0, 15.0, 3000.0, True, "ILLUMINA", None), t(2.0, 1.0, 900.0, True, "ILLUMINA", None), t(30.0, 15.0, 9.0, True, "PACBIO", None)) == ("BIG_Y_500", "WGS", "WGS_LOW_PASS", "WGS_HIFI")
    i = lambda c, n, d=None, m=0: consensus.identity_band(F.lit(c).cast("double"), F.lit(n), F.lit(d).cast("int"), F.lit(m))
    assert one(spark, i(0.97, 100), i(0.88, 100), i(0.7, 100), i(0.55, 100), i(0.2, 100), i(None, 0, 0, 37), i(None, 0, 1, 37), i(None, 0)) == ("VerifiedSame", "LikelySame", "Uncertain", "LikelyDifferent", "VerifiedDifferent", "LikelySame", "Uncertain", "Uncertain")
    assert one(spark, files.health_topic(F.lit("A TUMOUR was found")), files.health_topic(F.lit("my health and diet"))) == (True, False)
    assert none is not None


def test_locus_states(spark):
    s = lambda a, d, b: placement.locus_state(F.lit(a), F.lit(d), F.lit(b).cast("string"))
    assert one(spark, s("G", "A", "a"), s("G", "A", "G"), s("G", "A", "T"), s("G", "A", "C"), s("A", "T", "T"), s("C", "G", "C")) == ("Derived", "Ancestral", "Derived", "Ancestral", "Derived", "Ancestral")
    assert one(spark, s("G", "", "G"), s("G", "GA", "G"), s("G", "GA", "+"), s("G", "GA", "-"), s("A", "T", None), s("A", "C", "N")) == ("NoCall", "NoCall", "Derived", "Ancestral", "NoCall", "NoCall")


def place(spark, nodes, loci, calls):
    from helixframe.operators import tree

    n = spark.createDataFrame(nodes, "node long, parent long, name string")
    l = spark.createDataFrame(loci, "node long, name string, pos long, ancestral string, derived string")
    c = spark.createDataFrame([("s", p, b) for p, b in calls.items()], "sample string, pos long, base string")
    closed = tree.closure(n)
    return placement.place(n, closed, l, c).first(), placement.place_robust(n, closed, l, c).first()


def test_placement(spark):
    nodes = [(1, None, "root"), (2, 1, "A"), (3, 1, "B"), (4, 2, "A1"), (5, 4, "A1a")]
    loci = [(2, "a", 10, "G", "A"), (2, "a2", 11, "G", "A"), (3, "b", 20, "G", "A"), (4, "c", 30, "C", "T"), (4, "c2", 31, "C", "T"), (5, "d", 40, "G", "A"), (5, "d2", 41, "G", "A")]
    strict, robust = place(spark, nodes, loci, {10: "A", 11: "A", 20: "G", 30: "T", 31: "T", 40: "A", 41: "A"})
    assert strict.terminal == robust.terminal == 5
    # Read on the other strand, the same.
    assert place(spark, nodes, loci, {10: "T", 11: "T", 20: "C", 30: "A", 31: "A", 40: "T", 41: "T"})[0].terminal == 5
    # A node that nobody has split: half of its markers are another line's; two derived calls enter it.
    wide = [*loci[:5], *((5, f"e{k}", 50 + k, "G", "A") for k in range(6))]
    assert place(spark, nodes, wide, {10: "A", 11: "A", 30: "T", 31: "T", **{50 + k: "A" if k < 3 else "G" for k in range(6)}})[0].terminal == 5
    # A block below a branch that the sample left can't be reached.
    assert place(spark, nodes, loci, {10: "A", 11: "A", 30: "C", 31: "C", 40: "A", 41: "A"})[0].terminal == 2


def test_collapsed_blocks(spark):
    nodes = spark.createDataFrame([(1, None, "r"), (2, 1, "x"), (3, 2, "y"), (4, 3, "z"), (5, 4, "p"), (6, 4, "q"), (7, 5, "t")], "node long, parent long, name string")
    members = spark.createDataFrame([(1,), (6,), (7,)], "node long")
    got = {r.node: (r.parent, r.collapsed) for r in placement.collapse_unary(nodes, members).collect()}
    assert got == {1: (None, []), 4: (1, ["x", "y"]), 5: (4, []), 6: (4, []), 7: (5, [])}


def test_diagnostic_classes(spark):
    c = lambda *x: rules.diagnostic_class(F.array(*(F.lit(y).cast("int") for y in x)))
    assert one(spark, c(2, 2, None, 0), c(0, None, None, 2), c(2, 0, 0, 1), c(2, None, None, None), c(None, None, None, 2)) == ("Neanderthal", "Denisovan", "SharedArchaic", "SharedArchaic", "SharedArchaic")


def test_a_cycle_is_an_error(spark):
    from helixframe.operators import tree

    with pytest.raises(ValueError):
        tree.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, parent long"))
    chain = spark.createDataFrame([(k, k - 1 if k else None) for k in range(40)], "node long, parent long")
    assert tree.closure(chain).count() == 40 * 41 // 2


def test_outbox_rounds(spark):
    rows = spark.createDataFrame([(1, "PENDING", 0, 0), (2, "PENDING", 1, 50), (3, "PENDING", 0, 0), (4, "SENT", 1, 0), (5, "PENDING", 2, 10)], "id long, status string, attempts int, due long")
    outcome = F.when(F.col("id") == 1, "ok").when(F.col("id") == 3, "permanent").otherwise("transient")
    got = {r.id: (r.status, r.attempts, r.due) for r in events.outbox_round(rows, outcome, 10, "id").collect()}
    assert got == {1: ("SENT", 1, 0), 2: ("PENDING", 1, 50), 3: ("FAILED", 1, 0), 4: ("SENT", 1, 0), 5: ("PENDING", 3, 490)}


def test_chains_reach_as_far_as_the_parts(spark):
    from helixframe.plans import io

    t = type("T", (), {"spark": spark, "part": spark.createDataFrame([(4,), (7,), (1_500_000,), (1_500_001,)], "p_partkey long")})()
    got = sorted((r.contig, r.pos, r.ref, r.alt) for r in io.chain_lift(t).collect())
    assert got == [("t0", 2_500_000, "A", "G"), ("t1", 1_499_999, "T", "C"), ("t2", 2_999_993, "T", "C"), ("t4", 1_000_004, "A", "G")]
