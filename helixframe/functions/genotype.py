"""Allele, genotype and strand expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complement(x: Column) -> Column:
    return F.translate(x, "ACGTacgt", "TGCAtgca")


def reverse_complement(x: Column) -> Column:
    return complement(F.reverse(x))


def palindromic(a: Column, b: Column) -> Column:
    """Whether a pair of alleles reads the same on either strand."""
    pair = F.concat(F.least(a, b), F.greatest(a, b))
    return pair.isin("AT", "CG")


def dosage(a1: Column, a2: Column, ref: Column, alt: Column) -> Column:
    """Alternate copies of an allele pair, read on the other strand if it doesn't fit this one; null if neither."""

    def copies(x: Column, y: Column) -> Column:
        fits = ((x == ref) | (x == alt)) & ((y == ref) | (y == alt))
        return F.when(fits, (x == alt).cast("int") + (y == alt).cast("int"))

    return F.coalesce(copies(a1, a2), copies(complement(a1), complement(a2)))


def ibs_state(a: Column, b: Column) -> Column:
    return 2 - F.abs(a - b)


def zygosity(gt: Column) -> Column:
    g = F.upper(F.regexp_replace(gt, "[^A-Za-z]", ""))
    return F.when(F.length(g) == 0, "no_call").when(F.length(g) == 1, "hemizygous").when(F.substring(g, 1, 1) == F.substring(g, 2, 1), "homozygous").otherwise("heterozygous")


def hemizygous(gt: Column) -> Column:
    """Whether a VCF genotype holds one distinct called allele."""
    return F.size(F.array_distinct(F.filter(F.split(gt, r"[/|]"), lambda a: a != "."))) == 1


def chip_rates(rows: DataFrame, by: list[str], gt: str) -> DataFrame:
    """Sites, calls, and the rates of missing and of heterozygous two-letter calls."""
    called = F.col(gt) != "--"
    two = called & (F.length(gt) == 2)
    het = two & (F.substring(gt, 1, 1) != F.substring(gt, 2, 1))
    return rows.groupBy(*by).agg(F.count("*").alias("possible"), F.count_if(called).alias("called"), (F.count_if(~called) / F.count("*")).alias("no_call_rate"), F.when(F.count_if(two) == 0, 0.0).otherwise(F.count_if(het) / F.count_if(two)).alias("het_rate"))


def contig_bare(x: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(x), "(?i)^chr", ""))


def contig_number(x: Column) -> Column:
    """Autosome number, else null."""
    return F.expr("1") * F.try_to_number(F.regexp_extract(contig_bare(x), r"^(\d{1,2})$", 1), F.lit("99")).cast("int")


def contig_class(x: Column) -> Column:
    c = contig_bare(x)
    return F.when(c.rlike(r"^([1-9]|1[0-9]|2[0-2])$"), "autosome").when(c == "X", "X").when(c == "Y", "Y").when(c.isin("M", "MT"), "M").otherwise("other")
