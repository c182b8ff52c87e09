"""Readers of read and variant text: SAM lines, VCF and genome VCF, as frames of typed columns.

Every reader takes a frame with a ``value`` column of lines, as ``spark.read.text`` gives it (gzip and bzip2 are
opened by Spark), so scans stay splittable and column pruning and filters apply to what is parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.genotype import contig_bare
from helixframe.operators.intervals import point_in_interval
from helixframe.operators.regions import overlaps, reference_length


def read_lines(spark, path: str) -> DataFrame:
    return spark.read.text(path)


def sam_reads(lines: DataFrame) -> DataFrame:
    """Alignments of SAM text; unmapped reads have a null contig, quality 255 is unknown."""
    c = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("@") & (F.size(c) >= 11))
    star = lambda k: F.nullif(F.get(c, F.lit(k)), F.lit("*"))
    tag = F.regexp_extract("value", r"\tSA:Z:([^\t]*)", 1)
    return rows.select(
        F.get(c, F.lit(0)).alias("name"), F.get(c, F.lit(1)).cast("int").alias("flags"), star(2).alias("contig"), F.nullif(F.get(c, F.lit(3)).cast("long"), F.lit(0)).alias("pos"), F.nullif(F.get(c, F.lit(4)).cast("int"), F.lit(255)).alias("mapq"), star(5).alias("cigar"),
        F.when(F.get(c, F.lit(6)) == "=", star(2)).otherwise(star(6)).alias("mate_contig"), F.nullif(F.get(c, F.lit(7)).cast("long"), F.lit(0)).alias("mate_pos"), F.get(c, F.lit(8)).cast("int").alias("tlen"), star(9).alias("seq"), star(10).alias("quals"), F.nullif(tag, F.lit("")).alias("sa"),
    )


def region(reads: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    """Reads that overlap a region, also those that begin before it; contig and last position reach the scan."""
    return reads.where((F.col("contig") == contig) & overlaps(F.col("pos"), F.col("pos") + reference_length(F.col("cigar")) - 1, F.lit(start), F.lit(end)))


def unmapped(reads: DataFrame) -> DataFrame:
    return reads.where(F.col("contig").isNull())


def header_probe(lines: DataFrame) -> DataFrame:
    """One row of what a SAM header tells: build, aligner, platform, model, sample."""
    h = lines.where(F.col("value").startswith("@"))
    of = lambda tag, kind: F.max(F.when(F.col("value").startswith(kind), F.nullif(F.regexp_extract("value", rf"\t{tag}:([^\t]*)", 1), F.lit(""))))
    return h.agg(of("AS", "@SQ").alias("assembly"), of("PN", "@PG").alias("aligner"), of("PL", "@RG").alias("platform"), of("PM", "@RG").alias("model"), of("SM", "@RG").alias("sample"))


def library_scan(reads: DataFrame, n: int = 10_000) -> DataFrame:
    """Majority platform, instrument, flow cell and layout of the first n reads."""
    name = F.col("name")
    part = lambda k: F.nullif(F.split(name, ":")[k], F.lit(""))
    long = name.rlike(r"^m\d+.*_\d+_\d+.*/\d+/")
    platform = F.when(long, "PACBIO").when(name.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-"), "NANOPORE").when(F.size(F.split(name, ":")) >= 7, "ILLUMINA").otherwise("UNKNOWN")
    head = reads.limit(n).select(platform.alias("p"), part(0).alias("i"), part(2).alias("f"), F.when(F.col("flags").bitwiseAND(F.lit(1)) != 0, "PAIRED").otherwise("SINGLE").alias("l"))
    return head.agg(F.mode("p", True).alias("platform"), F.mode("i", True).alias("instrument"), F.mode("f", True).alias("flow_cell"), F.mode("l", True).alias("layout"))


def vcf_records(lines: DataFrame) -> DataFrame:
    """Records of VCF text with one sample; the contig is bare, ``end`` comes from END or the reference's length."""
    c = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(c) >= 5))
    end = F.regexp_extract(F.get(c, F.lit(7)), r"(?:^|;)END=(\d+)", 1)
    pos = F.get(c, F.lit(1)).cast("long")
    return rows.select(contig_bare(F.get(c, F.lit(0))).alias("contig"), pos.alias("pos"), F.nullif(F.get(c, F.lit(2)), F.lit(".")).alias("id"), F.upper(F.get(c, F.lit(3))).alias("ref"), F.upper(F.get(c, F.lit(4))).alias("alt"), F.get(c, F.lit(5)).try_cast("double").alias("qual"), F.get(c, F.lit(6)).alias("filter"), F.when(end != "", end.cast("long")).otherwise(pos + F.length(F.get(c, F.lit(3))) - 1).alias("end"), F.get(c, F.lit(8)).alias("format"), F.get(c, F.lit(9)).alias("sample"))


def format_field(key: str, format_: str = "format", sample: str = "sample") -> Column:
    """Value of a FORMAT key, null where the record lacks it."""
    at = F.array_position(F.split(format_, ":"), F.lit(key))
    return F.when(at > 0, F.get(F.split(sample, ":"), at.cast("int") - 1))


def alleles(gt: Column) -> Column:
    """Called allele numbers of a genotype; missing ones go."""
    return F.transform(F.filter(F.split(gt, r"[/|]"), lambda a: a.rlike(r"^\d+$")), lambda a: a.cast("int"))


def allele_base(k: Column, ref: str = "ref", alt: str = "alt") -> Column:
    return F.when(k == 0, F.col(ref)).otherwise(F.get(F.split(alt, ","), k - 1))


def haploid_bases(records: DataFrame, targets: DataFrame, width: int = 4096) -> DataFrame:
    """(contig, pos, base) at target positions: variants give their base, reference blocks the target's ``ref``."""
    gt = alleles(format_field("GT"))
    called = records.withColumn("_a", F.array_distinct(gt)).where(F.size("_a") == 1).withColumn("_k", F.col("_a")[0])
    block = called.where(F.col("alt").isin(".", "<NON_REF>") | (F.col("_k") == 0)).select("contig", F.col("pos").alias("lo"), F.col("end").alias("hi"))
    reference = point_in_interval(targets, block, ["contig"], "pos", "lo", "hi", width, "left_semi").select("contig", "pos", F.col("ref").alias("base"), F.lit(0).alias("_v"))
    snv = called.where("_k > 0").withColumn("base", allele_base(F.col("_k"))).where((F.length("ref") == 1) & F.col("base").isin("A", "C", "G", "T"))
    variant = snv.join(targets.select("contig", "pos"), ["contig", "pos"], "left_semi").select("contig", "pos", "base", F.lit(1).alias("_v"))
    return variant.union(reference).groupBy("contig", "pos").agg(F.max_by("base", F.struct("_v", "base")).alias("base"))


def diploid_calls(records: DataFrame) -> DataFrame:
    """(contig, pos, end, a1, a2, hom_ref): pairs of bases, or blocks that are reference on both."""
    gt = alleles(format_field("GT"))
    r = records.withColumn("_a", gt).where(F.size("_a") == 2)
    both = (F.col("_a")[0] == 0) & (F.col("_a")[1] == 0)
    return r.select("contig", "pos", "end", F.when(~both, allele_base(F.col("_a")[0])).alias("a1"), F.when(~both, allele_base(F.col("_a")[1])).alias("a2"), both.alias("hom_ref"))


def site_evidence(records: DataFrame) -> DataFrame:
    """Depth, allele depths, genotype quality and alternate fraction of each record; missing stays null."""
    ad = F.transform(F.split(format_field("AD"), ","), lambda x: x.try_cast("int"))
    r = records.withColumn("ad", ad).withColumn("dp", F.coalesce(format_field("DP").try_cast("int"), F.aggregate("ad", F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))))).withColumn("gq", format_field("GQ").try_cast("int"))
    return r.withColumn("alt_depth", F.get("ad", F.lit(1))).withColumn("af", F.when(F.col("dp") > 0, F.col("alt_depth") / F.col("dp")))


def derived_snvs(records: DataFrame, min_dp: int = 4, min_gq: int = 20, min_af: float = 0.95) -> DataFrame:
    """Single-base alternate calls that pass; a value that is missing passes its filter."""
    e = site_evidence(records).where((F.length("ref") == 1) & F.col("alt").rlike("^[ACGT](,<NON_REF>)?$") & F.exists(alleles(format_field("GT")), lambda a: a > 0))
    ok = lambda c, least: F.col(c).isNull() | (F.col(c) >= least)
    return e.where(ok("dp", min_dp) & ok("gq", min_gq) & ok("af", min_af)).withColumn("alt", F.substring("alt", 1, 1))


def depth_outliers(calls: DataFrame, times: float = 3.0, least: int = 20) -> DataFrame:
    """Calls at most ``times`` the upper median depth; too few calls aren't judged."""
    h = calls.where(F.col("dp").isNotNull()).groupBy("dp").agg(F.count("*").alias("k"))
    run = F.sum("k").over(Window.orderBy("dp").rowsBetween(Window.unboundedPreceding, 0))  # one row a depth
    h = h.withColumn("_run", run).join(F.broadcast(h.agg(F.sum("k").alias("n"))))
    m = h.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.min(F.when(F.col("_run") > F.floor(F.col("n") / 2), F.col("dp"))).alias("median"))
    return calls.join(F.broadcast(m)).where((F.col("n") < least) | F.col("dp").isNull() | (F.col("dp") <= times * F.col("median"))).drop("n", "median")


def source_build(lines: DataFrame) -> DataFrame:
    """Genome build named by header lines, one row."""
    v = F.lower("value")
    b = F.when(v.rlike("chm13|hs1|t2t"), "CHM13v2").when(v.rlike("grch38|hg38"), "GRCh38").when(v.rlike("grch37|hg19|b37"), "GRCh37")
    return lines.where(F.col("value").startswith("##")).agg(F.first(b, ignorenulls=True).alias("build"))


def lift(points: DataFrame, blocks: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Positions over chain blocks (``contig, start, end, t_contig, t_start, strand``); on the minus strand alleles turn.

    Closed intervals; the reverse block's first position is its target's last. Multi-base records on the minus strand go.
    """
    j = point_in_interval(points, blocks, ["contig"], "pos", "start", "end", width)
    minus = F.col("strand") == "-"
    flip = lambda c: F.when(minus, F.translate(c, "ACGT", "TGCA")).otherwise(F.col(c))
    at = F.when(minus, F.col("t_start") + (F.col("end") - F.col("pos"))).otherwise(F.col("t_start") + (F.col("pos") - F.col("start")))
    single = (F.length("ref") == 1) & (F.length("alt") == 1)
    return j.where(~minus | single).select(F.col("t_contig").alias("contig"), at.alias("pos"), flip("ref").alias("ref"), flip("alt").alias("alt"))


def lift_intervals(rows: DataFrame, blocks: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Closed intervals whose both ends lie in one chain block, on the target; on the minus strand the ends change places.

    ``rows`` keep their other columns; intervals that no block holds whole are left out.
    """
    j = point_in_interval(rows.withColumnRenamed("end", "stop").withColumnRenamed("start", "begin"), blocks, ["contig"], "begin", "start", "end", width).where(F.col("stop") <= F.col("end"))
    minus = F.col("strand") == "-"
    low = F.when(minus, F.col("t_start") + (F.col("end") - F.col("stop"))).otherwise(F.col("t_start") + (F.col("begin") - F.col("start")))
    rest = [c for c in rows.columns if c not in ("contig", "start", "end")]
    return j.select(F.col("t_contig").alias("contig"), low.alias("start"), (low + F.col("stop") - F.col("begin")).alias("end"), *rest)


def lift_records(records: DataFrame, blocks: DataFrame, reference: DataFrame, rank: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Lifted records whose reference base is the target's, in the order of the target's contigs.

    ``reference``: contig, pos, base; ``rank``: contig, rank. Sorting is by range, so it spreads over tasks.
    """
    lifted = lift(records, blocks, width)
    kept = lifted.join(reference, ["contig", "pos"]).where(F.substring(F.upper("ref"), 1, 1) == F.upper("base")).drop("base")
    return kept.join(F.broadcast(rank.limit(100_000)), "contig").orderBy("rank", "pos").drop("rank")


def rekey(sites: DataFrame, panel: DataFrame, build: str) -> DataFrame:
    """Sites of one build with the panel's own locus: ``panel`` has rsid, contig, pos and a struct of loci by build."""
    own = panel.select(F.col(f"{build}.contig").alias("contig"), F.col(f"{build}.pos").alias("pos"), "rsid", F.col("contig").alias("panel_contig"), F.col("pos").alias("panel_pos"))
    return sites.join(own, ["contig", "pos"])


def common_sites(matrices: list[DataFrame], site: list[str], samples: list[int], call_rate: float) -> DataFrame:
    """Sites of all sample matrices (site, dosage) with enough calls over all samples; ``samples``: how many each has."""
    out = None
    for m in matrices:
        calls = m.groupBy(*site).agg(F.count_if(F.col("dosage") >= 0).alias("called"))
        out = calls if out is None else out.join(calls.withColumnRenamed("called", "_more"), site).withColumn("called", F.col("called") + F.col("_more")).drop("_more")
    return out.withColumn("call_rate", F.col("called") / sum(samples)).where(F.col("call_rate") >= call_rate)
