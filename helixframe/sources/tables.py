"""Readers of consumer tables: chips, marker lists, panels, masks, bands, sidecar reports, trees, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.genotype import contig_bare

BASES = ("A", "C", "G", "T")
UNCALLED = ("", "-", "--", "0", "00", ".", "NC")


def cells(lines: DataFrame) -> Column:
    """Fields of a line by tab, or by comma where it has no tab; quotes go."""
    v = F.regexp_replace("value", '"', "")
    return F.transform(F.split(v, F.when(v.contains("\t"), F.lit("\t")).otherwise(F.lit(","))), lambda x: F.trim(x))


def _beside(lines: DataFrame) -> list[str]:
    """Columns that readers pass on: where a line comes from, for one."""
    return [c for c in lines.columns if c != "value"]


def chip_rows(lines: DataFrame) -> DataFrame:
    """(rsid, contig, pos, genotype) of four- or five-column chip text; a missing genotype is ``--``."""
    c = cells(lines)
    r = lines.where(~F.trim("value").startswith("#")).select(*_beside(lines), c.alias("c")).where((F.size("c") >= 4) & F.get("c", F.lit(2)).rlike(r"^\d+$"))
    gt = F.upper(F.when(F.size("c") >= 5, F.concat(F.get("c", F.lit(3)), F.get("c", F.lit(4)))).otherwise(F.get("c", F.lit(3))))
    return r.select(*_beside(lines), F.get("c", F.lit(0)).alias("rsid"), contig_bare(F.get("c", F.lit(1))).alias("contig"), F.get("c", F.lit(2)).cast("long").alias("pos"), F.when(gt.isin(*UNCALLED), "--").otherwise(gt).alias("genotype"))


def chip_haploid(rows: DataFrame) -> DataFrame:
    """Y and mitochondrial calls whose letters all agree."""
    first = F.substring("genotype", 1, 1)
    same = F.translate("genotype", "ACGT", "") == ""
    return rows.where(F.col("contig").isin("Y", "24", "M", "MT", "26") & same & (F.regexp_replace("genotype", first, F.lit("")) == "")).withColumn("base", first)


def chip_autosomal(rows: DataFrame) -> DataFrame:
    """Autosomal calls of exactly two bases."""
    return rows.where(F.col("contig").rlike(r"^([1-9]|1\d|2[0-2])$") & F.col("genotype").rlike("^[ACGT]{2}$")).select("rsid", "contig", "pos", F.substring("genotype", 1, 1).alias("a1"), F.substring("genotype", 2, 1).alias("a2"))


def chip_build(lines: DataFrame) -> DataFrame:
    """Build that comments name, GRCh37 by default."""
    v = F.lower("value")
    b = F.when(v.rlike("build ?38|grch38|hg38"), "GRCh38").when(v.rlike("build ?36|hg18"), "GRCh36").when(v.rlike("build ?37|grch37|hg19"), "GRCh37")
    return lines.where(F.trim("value").startswith("#")).agg(F.coalesce(F.first(b, ignorenulls=True), F.lit("GRCh37")).alias("build"))


def variant_table(lines: DataFrame) -> DataFrame:
    """(contig, pos, ref, alt, rsid, genotype) of positional or headed text; single bases only, ``.`` is missing."""
    c = cells(lines)
    r = lines.where(~F.trim("value").startswith("#")).select(*_beside(lines), c.alias("c")).where((F.size("c") >= 4) & F.get("c", F.lit(1)).rlike(r"^\d+$"))
    clean = lambda k: F.when(~F.get("c", F.lit(k)).isin("", "."), F.get("c", F.lit(k)))
    out = r.select(*_beside(lines), contig_bare(F.get("c", F.lit(0))).alias("contig"), F.get("c", F.lit(1)).cast("long").alias("pos"), F.upper(F.get("c", F.lit(2))).alias("ref"), F.upper(F.get("c", F.lit(3))).alias("alt"), clean(4).alias("rsid"), clean(5).alias("genotype"))
    return out.where(F.col("ref").isin(*BASES) & F.col("alt").isin(*BASES))


def locus_calls(rows: DataFrame) -> DataFrame:
    """At most one SNP call per locus from rows ``locus, ploidy, allele, chromosome, begin, end, kind, ref, seq``.

    Genotypes are 1 (haploid), 1/1, 1/2, 0/1 or 1/. by what the two alleles say.
    """
    one = F.col("kind").isin("snp", "ref", "no-call", "sub") & (F.col("end") - F.col("begin") == 1)
    r = rows.where(one)
    side = lambda k: F.max(F.when(F.col("allele").isin(k, "all"), F.when(F.col("kind") == "snp", F.col("seq")).when(F.col("kind") == "ref", F.col("ref")).otherwise("?")))
    g = r.groupBy("locus").agg(F.min("chromosome").alias("contig"), (F.min("begin") + 1).alias("pos"), F.max("ref").alias("ref"), F.max("ploidy").alias("ploidy"), side("1").alias("a1"), side("2").alias("a2"), F.max(F.col("kind") == "snp").alias("snp"))
    alt1, alt2 = (F.col("a1") != F.col("ref")) & (F.col("a1") != "?"), (F.col("a2") != F.col("ref")) & (F.col("a2") != "?")
    gt = F.when((F.col("ploidy") == 1) & alt1, "1").when(alt1 & alt2 & (F.col("a1") == F.col("a2")), "1/1").when(alt1 & alt2, "1/2").when((alt1 & (F.col("a2") == F.col("ref"))) | (alt2 & (F.col("a1") == F.col("ref"))), "0/1").when(alt1 | alt2, "1/.")
    return g.where("snp").withColumn("gt", gt).where("gt is not null").withColumn("alt", F.when(alt1, F.col("a1")).otherwise(F.col("a2"))).select("locus", contig_bare(F.col("contig")).alias("contig"), "pos", "ref", "alt", "gt")


def eigenstrat(snp: DataFrame, geno: DataFrame, sample: int) -> DataFrame:
    """(contig, pos, a1, a2, dosage) of one sample; ``snp`` and ``geno`` are numbered lines (n, value), joined by n.

    A digit counts copies of the first allele; anything else is missing and goes.
    """
    c = F.split(F.trim("value"), r"\s+")
    sites = snp.select("n", F.get(c, F.lit(0)).alias("id"), F.get(c, F.lit(1)).alias("contig"), F.get(c, F.lit(3)).cast("long").alias("pos"), F.get(c, F.lit(4)).alias("ref"), F.get(c, F.lit(5)).alias("alt"))
    digit = geno.select("n", F.substring("value", sample + 1, 1).alias("g")).where(F.col("g").isin("0", "1", "2"))
    j = sites.join(digit, "n")
    a1 = F.when(F.col("g") == "0", F.col("alt")).otherwise(F.col("ref"))
    a2 = F.when(F.col("g") == "2", F.col("ref")).otherwise(F.col("alt"))
    return j.select(contig_bare(F.col("contig")).alias("contig"), "pos", a1.alias("a1"), a2.alias("a2"), (2 - F.col("g").cast("int")).alias("dosage"))


def numbered_lines(whole: DataFrame) -> DataFrame:
    """(n, value) of files read with ``wholetext``: lines numbered from 0."""
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "value")).where("value <> ''")


def marker_values(whole: DataFrame) -> DataFrame:
    """(marker, value): rows of two fields, or exactly two lines of five or more; blanks are skipped."""
    ls = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    part = lambda x: F.transform(F.split(x, r"[,\t]"), lambda y: F.trim(F.regexp_replace(y, '"', "")))
    wide = (F.size("ls") == 2) & (F.size(part(F.col("ls")[0])) >= 5)
    w = whole.select(ls.alias("ls"))
    a = w.where(wide).select(F.explode(F.arrays_zip(part(F.col("ls")[0]).alias("m"), part(F.col("ls")[1]).alias("v"))).alias("x")).select("x.m", "x.v")
    b = w.where(~wide).select(F.explode("ls").alias("l")).select(part(F.col("l")).alias("c")).where(F.size("c") >= 2).select(F.get("c", F.lit(0)), F.get("c", F.lit(1)))
    return a.union(b).toDF("marker", "value").where((F.col("value") != "") & F.col("value").isNotNull() & ~F.lower("marker").isin("marker", "name")).withColumn("marker", F.upper("marker"))


def named_panel(lines: DataFrame) -> DataFrame:
    """(name, genotype, verdict) rows of a named SNP panel; prose, the header and other lines don't parse."""
    c = F.split("value", "\t")
    v = F.lower(F.trim(F.get(c, F.lit(2))))
    verdict = F.when(v.startswith("positive"), "positive").when(v.startswith("negative"), "negative").when(v.startswith("no call") | v.startswith("no-call"), "no_call").when(v.startswith("back"), "back_mutated")
    return lines.where(F.size(c) >= 3).select(F.trim(F.get(c, F.lit(0))).alias("name"), F.trim(F.get(c, F.lit(1))).alias("genotype"), verdict.alias("verdict")).where("verdict is not null and name <> ''")


def resolve_panel(panel: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Outcome counts of naming a panel's calls by a dictionary (name, pos, ancestral, derived)."""
    d = dictionary.select(F.upper("name").alias("_n"), "pos", "ancestral", "derived")
    j = panel.join(d, F.upper("name") == F.col("_n"), "left")
    o = F.when(F.col("verdict") == "no_call", "no_call").when(F.col("verdict") == "back_mutated", "back_mutated").when(F.col("pos").isNull(), "unresolved").when(F.col("verdict") == "negative", "ancestral")
    base = F.substring("genotype", 1, 1)
    o = o.when(base == F.col("derived"), "derived").when(F.translate(base, "ACGT", "TGCA") == F.col("derived"), "derived").otherwise("strand_mismatch")
    return j.groupBy(o.alias("outcome")).agg(F.count("*").alias("n"))


def bed(lines: DataFrame) -> DataFrame:
    c = F.split("value", "\t")
    ok = ~F.col("value").rlike("^(track|browser|#)") & (F.size(c) >= 3)
    return lines.where(ok).select(contig_bare(F.get(c, F.lit(0))).alias("contig"), F.get(c, F.lit(1)).cast("long").alias("start"), F.get(c, F.lit(2)).cast("long").alias("end"), F.get(c, F.lit(3)).alias("name"), F.get(c, F.lit(4)).alias("score"))


def str_loci(rows: DataFrame, min_period: int = 2) -> DataFrame:
    """Repeat loci of BED rows whose fourth field is the period."""
    return rows.withColumn("period", F.col("name").try_cast("int")).where(F.col("period") >= min_period).withColumn("copies", (F.col("end") - F.col("start")) / F.col("period"))


def centromeres(bands: DataFrame) -> DataFrame:
    """First and last position of each contig's centromeric bands."""
    return bands.where("score = 'acen'").groupBy("contig").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def telomeres(bands: DataFrame, size: int = 10_000) -> DataFrame:
    ends = bands.groupBy("contig").agg(F.max("end").alias("length"))
    return ends.select("contig", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(size).cast("long").alias("end")), F.struct((F.col("length") - size).alias("start"), F.col("length").alias("end")))).alias("x")).select("contig", "x.*")


def stats_numbers(lines: DataFrame) -> DataFrame:
    """(key, value) of the summary numbers of an alignment statistics report."""
    c = F.split("value", "\t")
    return lines.where(F.col("value").startswith("SN\t")).select(F.rtrim(F.regexp_replace(F.get(c, F.lit(1)), ":$", "")).alias("key"), F.get(c, F.lit(2)).try_cast("double").alias("value")).where("value is not null")


def stats_histogram(lines: DataFrame, kind: str) -> DataFrame:
    """(bin, n) of the report's length (RL) or insert size (IS) histogram."""
    c = F.split("value", "\t")
    return lines.where(F.col("value").startswith(f"{kind}\t")).groupBy(F.get(c, F.lit(1)).cast("int").alias("bin")).agg(F.sum(F.get(c, F.lit(2)).cast("long")).alias("n"))


def coverage_table(lines: DataFrame) -> DataFrame:
    """Contig rows of a nine-column coverage report; the breadth is a percentage."""
    c = F.split("value", "\t")
    r = lines.where(~F.col("value").startswith("#") & (F.size(c) >= 9))
    return r.select(F.get(c, F.lit(0)).alias("contig"), (F.get(c, F.lit(2)).cast("long") - F.get(c, F.lit(1)).cast("long") + 1).alias("length"), F.get(c, F.lit(3)).cast("long").alias("reads"), F.get(c, F.lit(4)).cast("long").alias("covered"), F.get(c, F.lit(5)).cast("double").alias("breadth_percent"), F.get(c, F.lit(6)).cast("double").alias("depth"), F.get(c, F.lit(7)).cast("double").alias("mean_baseq"), F.get(c, F.lit(8)).cast("double").alias("mean_mapq"))


def fasta(whole: DataFrame) -> DataFrame:
    """(name, seq, n_count) of FASTA text read with ``wholetext``."""
    rec = F.filter(F.split("value", r"(?m)^>"), lambda x: F.trim(x) != "")
    r = whole.select(F.explode(rec).alias("r"))
    head = F.split(F.split("r", r"\r?\n")[0], r"\s+")[0]
    seq = F.upper(F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s+", ""))
    return r.select(head.alias("name"), seq.alias("seq")).withColumn("n_count", F.length("seq") - F.length(F.translate("seq", "N", "")))


def bases(sequences: DataFrame) -> DataFrame:
    """One row per base, positions from 1."""
    return sequences.select("name", F.posexplode(F.split("seq", "(?!^)")).alias("i", "base")).select("name", (F.col("i") + 1).alias("pos"), "base")


def sequence_variants(sample: DataFrame, reference: DataFrame) -> DataFrame:
    """Positions at which two aligned sequences of one length differ; N says nothing."""
    r = bases(reference).select("pos", F.col("base").alias("ref"))
    return bases(sample).select("pos", F.col("base").alias("alt")).join(r, "pos").where("alt <> ref and alt <> 'N' and ref <> 'N'")


NODE = "struct<haplogroupId:bigint,name:string,isRoot:boolean,variants:array<struct<variant:string,position:bigint,ancestral:string,derived:string>>,children:array<bigint>>"


def flat_tree(json: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, variants) of tree JSON keyed by node: nodes have ``node, parent, name``."""
    n = json.select(F.explode(F.from_json("value", f"allNodes map<string,{NODE}>")["allNodes"]).alias("k", "n")).select("n.*")
    up = n.select(F.explode("children").alias("node"), F.col("haplogroupId").alias("parent"))
    nodes = n.select(F.col("haplogroupId").alias("node"), "name").join(up, "node", "left").select("node", "parent", "name")
    return nodes, n.select(F.col("haplogroupId").alias("node"), F.explode("variants").alias("v")).select("node", F.col("v.position").alias("pos"), "v.ancestral", "v.derived", F.col("v.variant").alias("snp"))


def name_lookup(nodes: DataFrame) -> DataFrame:
    """The smallest node of each name."""
    return nodes.groupBy("name").agg(F.min("node").alias("node"))


def deepest_marker(rows: DataFrame) -> DataFrame:
    """For each marker the row of most depth, the first by value on ties."""
    w = Window.partitionBy("marker").orderBy(F.desc("depth"), "value")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
