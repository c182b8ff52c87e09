"""Threshold bands: sex, test type, relationship, run-of-homozygosity class, quality phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sex_call(ratio: Column, covered: Column, least: int = 5) -> Column:
    return F.when(covered < least, "unknown").when(ratio <= 0.65, "male").when(ratio >= 0.85, "female").otherwise("unknown")


def sex_confidence(ratio: Column, covered: Column, least: int = 5) -> Column:
    sure, likely = (ratio <= 0.55) | (ratio >= 0.95), (ratio <= 0.65) | (ratio >= 0.85)
    return F.when(covered < least, "low").when(sure, "high").when(likely, "medium").otherwise("low")


def ploidy(contig: Column, sex: Column) -> Column:
    c = F.upper(F.regexp_replace(contig, "^chr", ""))
    return F.when(c.isin("M", "MT", "Y"), 1).when((c == "X") & (sex == "male"), 1).otherwise(2)


#: Depths that tell tests apart, by mean depth, ratio and read length: fixed values.
Y_PRESENT, Y_ENRICHED, MT_PRESENT, AUTOSOME_PRESENT, EXOME_DEPTH, LOW_PASS_DEPTH, LONG_READ = 1.0, 5.0, 10.0, 1.0, 50.0, 5.0, 1000


def test_type(autosome: Column, y: Column, mt: Column, has_autosomes: Column, platform: Column, vendor: Column, read_length: Column, label: Column) -> Column:
    """Test type from mean depths of the contig classes, the platform and the vendor; a label in the header decides.

    Null depths mean that no profile is known: then the platform alone is read, and null comes back without one.
    """
    p, v = F.upper(platform), F.lower(F.coalesce(vendor, F.lit("")))
    long = F.coalesce(p.contains("PACBIO"), F.lit(False)) | F.coalesce(read_length > LONG_READ, F.lit(False))
    whole = F.when(long, "WGS_HIFI").when(p.contains("NANOPORE") | (p == "ONT"), "WGS_NANOPORE").otherwise("WGS")
    seen = has_autosomes & (autosome > AUTOSOME_PRESENT)
    enriched = (autosome <= 0) | (y > Y_ENRICHED * autosome)
    targeted_y = (y > Y_PRESENT) & (~seen | enriched)
    product = F.when(v.contains("full genomes") | v.contains("fullgenomes"), "Y_ELITE").when(v.contains("yseq"), "Y_PRIME")
    generic = v.contains("ftdna") | v.contains("familytreedna")
    by_depth = (
        F.when(targeted_y, F.when(~generic, F.coalesce(product, F.lit("TARGETED_Y"))).otherwise("TARGETED_Y"))
        .when((mt > MT_PRESENT) & ~seen & (y <= Y_PRESENT), "MT_FULL_SEQUENCE")
        .when(seen & (y <= Y_PRESENT) & (autosome > EXOME_DEPTH), "WES")
        .when(seen & (autosome < LOW_PASS_DEPTH), "WGS_LOW_PASS")
        .otherwise(whole)
    )
    return F.coalesce(label, F.when(autosome.isNotNull(), by_depth).when(platform.isNotNull(), whole))


#: Least total centimorgans of each band, closest first: fixed values.
RELATIONSHIPS = (
    (3400.0, "ParentChild"),
    (2550.0, "FullSibling"),
    (1700.0, "Grandparent"),
    (1200.0, "AuntUncle"),
    (680.0, "FirstCousin"),
    (400.0, "FirstCousinOnceRemoved"),
    (200.0, "SecondCousin"),
    (90.0, "SecondCousinOnceRemoved"),
    (50.0, "ThirdCousin"),
    (25.0, "FourthCousin"),
    (10.0, "FifthCousin"),
    (7.0, "Distant"),
)


def relationship(total_cm: Column) -> Column:
    out = F.lit("Unknown")
    for least, name in reversed(RELATIONSHIPS):
        out = F.when(total_cm >= least, name).otherwise(out)
    return out


def roh_class(megabases: Column) -> Column:
    """5 and 15 Mb."""
    return F.when(megabases < 5, "short").when(megabases < 15, "medium").otherwise("long")


def roh_pattern(f_roh: Column, total: Column, short: Column, long: Column) -> Column:
    """Outbred below 0.02 of the autosomes; else by which class holds more than half of the runs' length."""
    part = lambda x: F.when(total > 0, x / total).otherwise(0.0)
    return F.when(f_roh < 0.02, "Outbred").when(part(long) > 0.5, "RecentConsanguinity").when(part(short) > 0.5, "Endogamy").otherwise("Mixed")


def confidence_band(x: Column) -> Column:
    return F.when(x >= 0.9, "high").when(x >= 0.6, "moderate").otherwise("low")
