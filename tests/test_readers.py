"""Text readers, kernels and expressions on small frames."""

import numpy as np
from pyspark.sql import functions as F

from helixframe.functions import bands
from helixframe.functions import genotype as gt
from helixframe.operators import ancestry, kernels, match, pileup, structural, tree
from helixframe.sources import files, sinks, tables, variants


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def one(df):
    return [tuple(r) for r in df.collect()]


def test_pileup_of_cigars(spark):
    sam = lines(spark, "@HD\tVN:1.6", "r1\t0\tchr1\t5\t60\t2S3M1D2M1I1M\t*\t0\t0\tACGTACGTA\tIIIIIIIII", "r2\t4\t*\t0\t255\t*\t*\t0\t0\tA\tI")
    reads = variants.sam_reads(sam)
    assert one(variants.unmapped(reads).select("name", "mapq")) == [("r2", None)]
    got = one(pileup.aligned_bases(pileup.primary_reads(reads)).select("ref_pos", "query_index").orderBy("ref_pos"))
    assert got == [(5, 2), (6, 3), (7, 4), (9, 5), (10, 6), (11, 8)]


def test_states_in_order(spark):
    rows = [("c", 1, 0, 0, 0), ("c", 2, 10, 2, 9), ("c", 3, 3, 3, 0), ("c", 4, 9, 9, 0), ("c", 5, 50, 50, 0)]
    df = spark.createDataFrame(rows, "contig string, pos long, raw_depth long, depth long, low_mapq long")
    got = [r[0] for r in df.orderBy("pos").select(pileup.callable_state(4, 0.1, 40)).collect()]
    assert got == ["NO_COVERAGE", "POOR_MAPPING_QUALITY", "LOW_COVERAGE", "CALLABLE", "EXCESSIVE_COVERAGE"]


def test_chip_and_markers(spark):
    chip = lines(spark, "# build 38", "rs1\t1\t100\tAG", "rs2,X,5,A,A", "rs3\tchrY\t7\tT", "rs4\t2\t8\t--", "rsid\tchromosome\tposition\tgenotype")
    rows = tables.chip_rows(chip)
    assert sorted(one(rows)) == [("rs1", "1", 100, "AG"), ("rs2", "X", 5, "AA"), ("rs3", "Y", 7, "T"), ("rs4", "2", 8, "--")]
    assert one(tables.chip_build(chip)) == [("GRCh38",)]
    assert one(tables.chip_haploid(rows).select("rsid", "base")) == [("rs3", "T")]
    wide = lines(spark, "DYS1,DYS2,DYS3,DYS4,DYS5\n12,13-14,,15,16\n")
    assert sorted(one(tables.marker_values(wide))) == [("DYS1", "12"), ("DYS2", "13-14"), ("DYS4", "15"), ("DYS5", "16")]
    long = lines(spark, "marker,value\ndys1,12\nDYS2,\n")
    assert one(tables.marker_values(long)) == [("DYS1", "12")]


def test_locus_groups(spark):
    rows = [(1, 2, "1", "chr1", 9, 10, "snp", "A", "G"), (1, 2, "2", "chr1", 9, 10, "ref", "A", "A"), (2, 2, "all", "chr1", 19, 20, "ref", "C", "C"), (3, 2, "1", "chr1", 29, 30, "snp", "C", "T"), (3, 2, "2", "chr1", 29, 30, "no-call", "C", "?"), (4, 1, "1", "chrY", 4, 5, "snp", "A", "T"), (5, 2, "1", "chr2", 5, 6, "snp", "A", "C"), (5, 2, "2", "chr2", 5, 6, "snp", "A", "T")]
    df = spark.createDataFrame(rows, "locus long, ploidy int, allele string, chromosome string, begin long, end long, kind string, ref string, seq string")
    got = {r.locus: (r.contig, r.pos, r.alt, r.gt) for r in tables.locus_calls(df).collect()}
    assert got == {1: ("1", 10, "G", "0/1"), 3: ("1", 30, "T", "1/."), 4: ("Y", 5, "T", "1"), 5: ("2", 6, "C", "1/2")}


def test_eigenstrat_and_fasta(spark):
    snp = tables.numbered_lines(lines(spark, " rs1 1 0.0 100 A G\n rs2 23 0.0 7 C T\n rs3 2 0 9 A C\n"))
    geno = tables.numbered_lines(lines(spark, "02\n91\n10\n"))
    assert sorted(one(tables.eigenstrat(snp, geno, 1))) == [("1", 100, "A", "A", 0), ("2", 9, "C", "C", 2), ("23", 7, "C", "T", 1)]
    f = tables.fasta(lines(spark, ">m x\nACG\nNT\n>k\nAAA\n"))
    assert sorted(one(f)) == [("k", "AAA", 0), ("m", "ACGNT", 1)]
    a, b = f.where("name = 'm'"), spark.createDataFrame([("r", "ACTNA")], "name string, seq string")
    assert sorted(one(tables.sequence_variants(a, b).select("pos", "ref", "alt"))) == [(3, "T", "G"), (5, "A", "T")]


def test_reports_panels_and_trees(spark):
    rep = lines(spark, "SN\treads mapped:\t90\t# x", "RL\t100\t7", "RL\t100\t3", "RL\t50\t1")
    assert one(tables.stats_numbers(rep)) == [("reads mapped", 90.0)]
    assert sorted(one(tables.stats_histogram(rep, "RL"))) == [(50, 1), (100, 10)]
    panel = tables.named_panel(lines(spark, "prose", "SNPID\tgenotype\tresult", "M1\tA\tpositive", "M2\tC\tnegative", "M3\t-\tno call", "M9\tG\tpositive"))
    d = spark.createDataFrame([("m1", 5, "C", "T"), ("M2", 6, "C", "G")], "name string, pos long, ancestral string, derived string")
    assert dict(one(tables.resolve_panel(panel, d))) == {"derived": 1, "ancestral": 1, "no_call": 1, "unresolved": 1}
    js = '{"allNodes":{"1":{"haplogroupId":1,"name":"root","isRoot":true,"variants":[],"children":[2]},"2":{"haplogroupId":2,"name":"A","isRoot":false,"variants":[{"variant":"M1","position":5,"ancestral":"C","derived":"T"}],"children":[]}}}'
    nodes, var = tables.flat_tree(lines(spark, js))
    assert sorted(one(nodes), key=lambda r: r[0]) == [(1, None, "root"), (2, 1, "A")] and one(var) == [(2, 5, "C", "T", "M1")]
    assert sorted(one(tree.closure(nodes))) == [(1, 1, 0), (2, 1, 1), (2, 2, 0)]
    bands_ = tables.bed(lines(spark, "track x", "chr1\t0\t50\tp1\tgneg", "chr1\t50\t60\tp2\tacen", "chr1\t60\t90\tq1\tacen"))
    assert one(tables.centromeres(bands_)) == [("1", 50, 90)]


def test_vcf_and_fastq_writers(spark, tmp_path):
    calls = spark.createDataFrame([("chr2", 5, "A", "G", "0/1", 40, 9), ("chr1", 7, "C", None, "0/0", None, 3)], "contig string, pos long, ref string, alt string, gt string, gq int, dp int")
    sinks.write_vcf(calls, str(tmp_path))
    back = variants.vcf_records(spark.read.text(f"{tmp_path}/records"))
    assert sorted(one(back.select("contig", "pos", "ref", "alt"))) == [("1", 7, "C", "."), ("2", 5, "A", "G")]
    reads = spark.createDataFrame([("r", 0x41, "ACG", "ABC"), ("r", 0x91, "AAC", "DEF"), ("s", 0x41, "A", "I")], "name string, flags int, seq string, quals string")
    got = one(sinks.fastq_pairs(reads))
    assert got == [("r", "@r\nACG\n+\nABC", "@r\nGTT\n+\nFED")]


def test_types_and_expressions(spark):
    df = spark.createDataFrame([("a.BAM", ""), ("x.g.vcf.gz", "chr1\t5\t.\tA\tG"), ("y.g.vcf", "chrY\t5\t.\tA\tG"), ("p.txt", "rs1\t1\t5\tAA\nrs2\t1\t6\tAG\nrs3\t1\t7\tGG"), ("k.csv", "DYS393,13\nDYS390,24\nDYS19,14"), ("z", "hello")], "name string, head string")
    assert [r[0] for r in df.select(files.file_type(F.col("name"), F.col("head"))).collect()] == ["alignment", "gvcf_call_set", "variants", "chip_data", "str_profile", "unknown"]
    d = spark.createDataFrame([("A", "G", "A", "G"), ("T", "C", "A", "G"), ("C", "C", "A", "G"), ("A", "T", "A", "G")], "a string, b string, r string, v string")
    assert [r[0] for r in d.select(gt.dosage(F.col("a"), F.col("b"), F.col("r"), F.col("v"))).collect()] == [1, 1, 2, None]
    v = spark.createDataFrame([([1, 2], [1, 3]), ([2, 2], [1, 2]), ([0, 9], [1, 2]), ([1, 2], [1, 2])], "v array<int>, m array<int>")
    assert [r[0] for r in v.select(match.deviation(F.col("v"), F.col("m"))).collect()] == ["Below", "Above", "Differs", None]
    assert spark.range(1).select(bands.relationship(F.lit(700.0))).first()[0] == "FirstCousin"
    p = spark.range(1).select(ancestry.normal_cdf(F.lit(1.96))).first()[0]
    assert abs(p - 0.9750021) < 1e-6 and abs(ancestry.chi2_survival(3.841459, 1) - 0.05) < 1e-6


def test_kernels():
    assert kernels.anchored_clusters(np.array([0, 400, 800, 900]), 500).tolist() == [0, 0, 1, 1]
    assert kernels.cnv_segments(np.array([0, 3, 1.5, 0.2, 1.6, 1.7, 0, 0, 0, -3.0])) == [(1, 5, 1), (9, 9, -1)]
    assert kernels.absorb_short([(0, 9, 1), (10, 11, 2), (12, 30, 1)], 5) == [(0, 30, 1)]
    emit = np.log(np.array([[0.9, 0.1]] * 5 + [[0.1, 0.9]] * 5))
    assert kernels.viterbi(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]), emit).tolist() == [0] * 5 + [1] * 5
    assert kernels.align_global("ACGT", "ACT") [1].count("I") == 1
    assert kernels.left_normalize(5, "AA", "A", "CAAA") == (1, "CA", "C")
    a = kernels.pair_hmm("ACGT", np.full(4, 30), "ACGT")
    assert a > kernels.pair_hmm("ACGT", np.full(4, 30), "AGGT") + 1
    q = ancestry.admixture(np.array([2.0, 2, 0, 0] * 20), np.tile(np.array([[0.9, 0.1], [0.9, 0.1], [0.1, 0.9], [0.1, 0.9]]), (20, 1)))
    assert q[0] > 0.95
    assert kernels.laminar([frozenset("abc"), frozenset("ab"), frozenset("cd")]) == [frozenset("abc"), frozenset("ab")]
    panel = np.array([[0, 0, 1, 1], [1, 1, 0, 0]])
    assert kernels.phase(np.array([1, 1, 1, 1]), panel).tolist() in ([0, 0, 1, 1], [1, 1, 0, 0])
    post = kernels.copying_posteriors(np.array([0, 0, 1, 1]), panel, np.array([0, 1]), np.arange(4.0))
    assert (post.argmax(1) == 0).all()


def test_structural(spark):
    obs = spark.createDataFrame([(1, 12)] * 6 + [(1, 11)] + [(2, 9), (2, 9), (2, 9), (2, 14), (2, 14)] + [(3, 9)] * 4, "locus int, o int")
    assert dict((r.locus, r.allele) for r in structural.str_haploid(obs, ["locus"], "o").collect())[1] == 12
    assert {(r.locus, r.a, r.b) for r in structural.str_diploid(obs, ["locus"], "o").collect()} == {(1, 12, 12), (2, 9, 14)}
    reads = spark.createDataFrame([("a", 0x61, "1", 100, "2", 5, 0), ("b", 0x61, "1", 100, "1", 9000, 9000), ("c", 0x41, "1", 100, "1", 400, 400), ("d", 0x61, "1", 100, "1", 400, 400)], "name string, flags int, contig string, pos long, mate_contig string, mate_pos long, tlen int")
    got = {r.name: r.reason for r in structural.discordant(reads, F.lit(400.0), F.lit(50.0)).collect()}
    assert got == {"a": "InterChromosomal", "b": "InsertSizeOutlier", "c": "WrongOrientation"}
