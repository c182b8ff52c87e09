"""What a file is: type by name and head, vendor by header, directories by listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ends(name: Column, *suffixes: str) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | name.endswith(s)
    return out


def _lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def _is_data(line: Column) -> Column:
    return ~F.ltrim(line).startswith("#") & (F.trim(line) != "")


def lineage_only(head: Column) -> Column:
    """Whether a VCF's head names contigs but no autosome: declared contigs decide, else those of its records."""
    bare = lambda c: F.regexp_replace(c, "(?i)^chr", "")
    lines = _lines(head)
    declared = F.transform(F.filter(lines, lambda x: x.startswith("##contig=<ID=")), lambda x: F.regexp_extract(x, "^##contig=<ID=([^,>]*)", 1))
    used = F.transform(F.filter(lines, lambda x: ~x.startswith("#") & (F.trim(x) != "")), lambda x: F.split(x, "\t")[0])
    contigs = F.when(F.size(declared) > 0, declared).otherwise(used)
    return (F.size(contigs) > 0) & ~F.exists(contigs, lambda c: bare(c).rlike("^0*([1-9]|1[0-9]|2[0-2])$"))


def _scaled(n: Column) -> Column:
    """Points for so many tokens: fixed values."""
    return F.when(n >= 10, 4).when(n >= 5, 3).when(n >= 2, 2).when(n >= 1, 1).otherwise(0)


def _points(found: Column, points: int) -> Column:
    return F.when(found, points).otherwise(0)


def _contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, F.when(line.contains("\t"), "\t").otherwise(",")), lambda c: F.trim(F.trim(c), F.lit('"')))


def marker_score(name: Column, data: Column) -> Column:
    """How much a text looks like Y-STR markers: fixed words and points."""
    content, first = F.upper(F.array_join(data, "\n")), _cells(F.get(data, F.lit(0)))
    value = F.get(first, F.lit(1))
    small = (F.size(first) == 2) & value.rlike(r"^([0-9]{1,2}|[0-9]+-[0-9]+)$")
    return (
        _points(name.contains("str"), 2)
        + _points(_contains_any(name, ("ftdna", "yseq")), 1)
        + _scaled(F.regexp_count(content, F.lit(r"DYS[0-9]{2,3}(?![0-9])")))
        + _points(_contains_any(content, ("DYF", "GATA", "YCAII", "CDY")), 2)
        + _points(F.coalesce(small, F.lit(False)), 1)
    )


def chip_score(name: Column, lines: Column, data: Column) -> Column:
    """How much a text looks like a genotyping chip's: fixed words and points."""
    comments = F.lower(F.array_join(F.filter(lines, lambda x: F.ltrim(x).startswith("#") | F.ltrim(x).startswith('"#')), "\n"))
    content, first = F.lower(F.array_join(F.slice(data, 1, 20), "\n")), F.get(data, F.lit(0))
    hits = sum((_points(F.upper(first).contains(w), 1) for w in ("CHROMOSOME", "CHROM", "CHR", "POSITION", "POS", "GENOTYPE", "ALLELE1", "ALLELE2", "RSID")), F.lit(0))
    cells = _cells(first)
    genotype = F.size(cells).between(4, 6) & F.upper(F.element_at(cells, -1)).rlike("^([ACGT]{2}|--|NC)$")
    return (
        sum((_points(name.contains(w), 3) for w in ("23andme", "ancestry", "myheritage", "livingdna")), F.lit(0))
        + _points(name.contains("ftdna") & name.contains("raw"), 2)
        + _points(_contains_any(name, ("snp", "chip", "array")), 1)
        + _points(_contains_any(comments, ("23andme", "ancestrydna", "ancestry dna", "myheritage", "living dna", "livingdna")), 3)
        + _scaled(F.regexp_count(content, F.lit(r"rs[0-9]{4,12}(?![0-9])")))
        + F.least(hits, F.lit(3))
        + _points(F.coalesce(genotype, F.lit(False)), 2)
    )


def big_y_report(head: Column) -> Column:
    """named or private if the first line with text is the header of such a report, else null."""
    first = F.get(F.filter(_lines(head), lambda x: F.trim(x) != ""), F.lit(0))
    cells = F.transform(F.split(first, ","), lambda c: F.lower(F.trim(F.trim(c), F.lit('"'))))
    named = F.forall(F.array(*map(F.lit, ("snp_name", "position", "ancestral", "derived"))), lambda c: F.array_contains(cells, c))
    return F.when(named, "named").when(cells == F.array(*map(F.lit, ("position", "ancestral", "derived"))), "private")


def file_type(name: Column, head: Column) -> Column:
    """Type by extension, then by unmistakable preambles, then by points for marker and chip text in 50 lines.

    Extensions, signatures and points are fixed values.
    """
    n, h = F.lower(name), F.coalesce(head, F.lit(""))
    gvcf = (".g.vcf", ".g.vcf.gz", ".g.vcf.bgz")
    vcf = (".vcf", ".vcf.gz", ".vcf.bgz")
    columns = lambda x: F.split(x, "\t")
    homref = F.exists(F.filter(_lines(h), lambda x: ~x.startswith("#") & (F.size(columns(x)) >= 10)), lambda x: F.split(columns(x)[8], ":")[0].eqNullSafe("GT") & F.split(columns(x)[9], ":")[0].isin("0/0", "0|0"))
    locus = F.exists(F.slice(_lines(h), 1, 64), lambda x: F.lower(x).startswith(">locus\t") & F.lower(x).contains("chromosome") & F.lower(x).contains("vartype") & F.lower(x).contains("alleleseq"))
    preamble = F.exists(F.slice(_lines(h), 1, 64), lambda x: x.startswith("#") & F.lower(x).rlike("cgatools|var-annotation"))
    lines = F.slice(_lines(h), 1, 50)
    data = F.filter(lines, _is_data)
    tabbed = F.transform(F.filter(lines, lambda x: F.size(columns(x)) >= 3), lambda x: F.transform(F.slice(columns(x), 1, 3), lambda c: F.lower(F.trim(c))))
    panel = F.exists(tabbed, lambda c: c == F.array(*map(F.lit, ("snpid", "genotype", "result")))) | (F.size(F.filter(tabbed, lambda c: c[2].rlike(r'^"?\(?(positive|negative|no_call|back-mutated)\)?"?$'))) >= 3)
    marker, chip = marker_score(n, data), chip_score(n, lines, data)
    return (
        F.when(_ends(n, ".bam", ".cram"), "alignment")
        .when(_ends(n, *gvcf) & ~lineage_only(h), "gvcf_call_set")
        .when(_ends(n, ".geno", ".snp", ".ind"), "eigenstrat_call_set")
        .when(_ends(n, *vcf) & homref & ~lineage_only(h), "gvcf_call_set")
        .when(_ends(n, *vcf), "variants")
        .when(_ends(n, ".fasta", ".fa", ".fna", ".fas", ".fasta.gz", ".fa.gz", ".fna.gz"), "mtdna_fasta")
        .when(locus | (preamble & h.contains("masterVar")), "master_var")
        .when(F.size(data) == 0, "unknown")
        .when(big_y_report(h).isNotNull(), "ftdna_csv_variants")
        .when(panel, "ysnp_panel")
        .when((marker > chip) & (marker >= 3), "str_profile")
        .when((chip > marker) & (chip >= 3), "chip_data")
        .when(marker >= 2, "str_profile")
        .when(chip >= 2, "chip_data")
        .otherwise("unknown")
    )


def vendor(meta: Column, contigs: Column, name: Column, readme: Column) -> Column:
    """Vendor of a VCF by tokens in its header, name or readme, then by its contigs."""
    hay = F.lower(F.concat_ws(" ", meta, name, F.coalesce(readme, F.lit(""))))
    mt = (F.size(contigs) > 0) & F.forall(contigs, lambda c: F.upper(c).rlike("^(CHR)?(M|MT)$"))
    big = hay.rlike("aengine|big ?y|mtfull")
    return F.when(big & mt, "FTDNA mtFull Sequence").when(big, "FTDNA Big Y").when(hay.contains("yseq"), "YSEQ").when(hay.rlike("full ?genomes|y ?elite"), "Full Genomes").when(hay.contains("nebula"), "Nebula Genomics").when(hay.contains("dante"), "Dante Labs").when(mt, "FTDNA mtFull Sequence").otherwise("Imported VCF")


def source_type(vendor_name: Column) -> Column:
    targeted = vendor_name.isin("FTDNA Big Y", "FTDNA mtFull Sequence", "YSEQ", "Full Genomes")
    return F.when(targeted, "TargetedNgs").when(vendor_name.isin("Nebula Genomics", "Dante Labs"), "WgsShortRead").otherwise("Imported")


def scan_samples(paths: DataFrame, root: str) -> DataFrame:
    """(project, sample, files) of a listing two levels deep; samples without a data file go."""
    rel = F.split(F.regexp_replace("path", f"^{root.rstrip('/')}/", ""), "/")
    data = F.lower("path").rlike(r"\.(bam|cram|vcf|vcf\.gz|txt|csv|tsv|fasta|fa)$")
    r = paths.select("path", rel.alias("r"), data.alias("d")).where(F.size("r") == 3)
    return r.groupBy(F.col("r")[0].alias("project"), F.col("r")[1].alias("sample")).agg(F.count_if("d").alias("files"), F.count_if(~F.col("d")).alias("sidecars")).where("files > 0")


#: Parts of words that speak of health: fixed values.
HEALTH_TERMS = ("disease", "diagnos", "cancer", "tumor", "tumour", "clinical", "symptom", "prognos", "medication", "treatment", "medical condition", "health risk", "carrier status", "pathogenic")


def health_topic(text: Column) -> Column:
    """Whether a text speaks of health."""
    return _contains_any(F.lower(text), HEALTH_TERMS)
