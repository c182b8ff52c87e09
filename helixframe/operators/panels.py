"""Calls of any source on a common panel of sites, and comparisons of two sources by what they share there.

A source is a chip, a call set of another program, a genome VCF or an alignment: all become allele pairs at loci of some
build. The panel knows each site's locus in every build, so calls find their site by one equality join, whatever the
build, and are counted against the panel's own alleles: labels of other builds often have both the other way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.bands import relationship
from helixframe.functions.genotype import contig_bare, dosage, ibs_state, palindromic
from helixframe.operators.consensus import identity_band, identity_method
from helixframe.operators.intervals import interpolate
from helixframe.operators.kernels import MIN_CM, MIN_SITES, WINDOW, ibd_segments

#: What can become of a call, in the order in which it is asked.
OUTCOMES = ("off_panel", "no_call", "palindromic", "mismatched", "resolved")


def pair_of_dosage(copies: Column, ref: Column, alt: Column) -> Column:
    """The allele pair that a caller saw, from its count of its own build's alternate allele; null without a call."""
    first, second = F.when(copies >= 2, alt).otherwise(ref), F.when(copies >= 1, alt).otherwise(ref)
    return F.when(copies >= 0, F.struct(first.alias("a1"), second.alias("a2")))


def classify_calls(calls: DataFrame, panel: DataFrame, loci: DataFrame) -> DataFrame:
    """(source, site, dosage, outcome, n): equal calls of a source become one row, with their number.

    ``calls``: source, build, contig, pos, a1, a2; ``panel``: site, ref, alt; ``loci``: site, build, contig, pos. Other
    columns are ignored. Contigs agree whatever their prefix and case. Pairs that read alike on either strand can't be
    told apart and are left out, others are tried on both. A null locus is off the panel; alleles that are null or no
    base are no call. Calls are counted before they are joined, so a site that most calls name costs no more rows than
    it has sources. Where a build has two sites at one locus, each takes the call.
    """
    locus = [F.col("build"), contig_bare(F.col("contig")).alias("contig"), F.col("pos").cast("long").alias("pos")]
    c = calls.select("source", *locus, F.upper("a1").alias("a1"), F.upper("a2").alias("a2"))
    c = c.groupBy(*c.columns).agg(F.count("*").alias("n"))
    sites = panel.select("site", F.upper("ref").alias("ref"), F.upper("alt").alias("alt"))
    at = loci.select("site", *locus).join(sites, "site")
    j = c.join(at, ["build", "contig", "pos"], "left")
    base = lambda a: F.coalesce(F.col(a).isin(*"ACGT"), F.lit(False))
    copies = dosage(F.col("a1"), F.col("a2"), F.col("ref"), F.col("alt"))
    tests = (F.col("site").isNull(), ~(base("a1") & base("a2")), palindromic(F.col("ref"), F.col("alt")), copies.isNull())
    outcome = F.lit(OUTCOMES[-1])
    for test, name in reversed(list(zip(tests, OUTCOMES, strict=False))):
        outcome = F.when(test, name).otherwise(outcome)
    return j.withColumn("outcome", outcome).select("source", "site", F.when(F.col("outcome") == "resolved", copies).alias("dosage"), "outcome", "n")


def genotypes(classified: DataFrame) -> DataFrame:
    """(source, site, dosage) of resolved calls; a source whose calls of a site disagree has none there."""
    g = classified.where("outcome = 'resolved'").groupBy("source", "site").agg(F.min("dosage").alias("dosage"), F.max("dosage").alias("_most"))
    return g.where("dosage = _most").drop("_most")


def import_outcomes(classified: DataFrame) -> DataFrame:
    """One row a source: its calls by outcome, sites with a genotype, sites where calls disagree, and a verdict.

    The verdict names a source of which nothing resolved: its build is probably not the one it claims.
    """
    resolved = F.col("outcome") == "resolved"
    by_site = classified.groupBy("source", "site").agg(
        *(F.sum(F.when(F.col("outcome") == o, F.col("n")).otherwise(0)).alias(o) for o in OUTCOMES),
        F.count_distinct(F.when(resolved, F.col("dosage"))).alias("_kinds"),
    )
    totals = [F.sum(o).alias(o) for o in OUTCOMES]
    out = by_site.groupBy("source").agg(*totals, F.count_if(F.col("_kinds") == 1).alias("sites"), F.count_if(F.col("_kinds") > 1).alias("conflicting"))
    return out.withColumn("verdict", F.when(F.col("resolved") == 0, "check the build").otherwise("imported"))


def paired(pairs: DataFrame, values: DataFrame, on: str, value: str) -> DataFrame:
    """(a, b, on, x, y): values that both sources of a stated pair have.

    The first join is by one source, the second by source and ``on``, so a source that is in very many pairs is spread
    over all that it has.
    """
    p = pairs.select("a", "b").where("a <> b").distinct()
    x = values.select(F.col("source").alias("a"), F.col(on), F.col(value).alias("x"))
    y = values.select(F.col("source").alias("b"), F.col(on), F.col(value).alias("y"))
    return p.join(x, "a").join(y, ["b", on]).select("a", "b", on, "x", "y")


def verify_identity(pairs: DataFrame, dosages: DataFrame, markers: DataFrame) -> DataFrame:
    """One row a stated pair (a, b): whether both are one person, by genotypes at shared sites and marker values.

    ``dosages``: source, site, dosage, one row a site, others than 0 to 2 are no calls; ``markers``: source, marker,
    value as text, one profile a source, compared whatever their case. Pairs that share nothing stay, as uncertain;
    pairs of a source with itself, or with null, are left out.
    """
    called = dosages.where(F.col("dosage").isin(0, 1, 2))
    s = paired(pairs, called, "site", "dosage").groupBy("a", "b").agg(F.count("*").alias("sites"), F.count_if(F.col("x") == F.col("y")).alias("matched"))
    named = markers.select("source", F.lower("marker").alias("marker"), F.lower("value").alias("value")).where("marker is not null and value is not null")
    m = paired(pairs, named, "marker", "value").groupBy("a", "b").agg(F.count("*").alias("markers"), F.count_if(F.col("x") != F.col("y")).alias("differing"))
    out = pairs.select("a", "b").where("a <> b").distinct().join(s, ["a", "b"], "left").join(m, ["a", "b"], "left").na.fill(0, ["sites", "matched", "markers", "differing"])
    out = out.withColumn("concordance", F.when(F.col("sites") > 0, F.col("matched") / F.col("sites")))
    c, n, d, k = (F.col(x) for x in ("concordance", "sites", "differing", "markers"))
    return out.withColumn("band", identity_band(c, n, d, k)).withColumn("method", identity_method(c, n, k))


def shared_segments(pairs: DataFrame, dosages: DataFrame, panel: DataFrame, curve: DataFrame, window: int = WINDOW, min_cm: float = MIN_CM, min_sites: int = MIN_SITES) -> DataFrame:
    """(a, b, contig, start, end, cm, sites) of segments that both sources of a stated pair share.

    ``panel``: site, contig, pos; ``curve``: contig, pos, cm. Genetic positions are found once a site, not once a pair;
    one pair's sites of one contig, no more than the panel has, make a group.
    """
    mapped = interpolate(panel.select("site", "contig", "pos"), curve, ["contig"], "pos", "pos", "cm", "cm")
    both = paired(pairs, dosages.where(F.col("dosage").isin(0, 1, 2)), "site", "dosage").join(mapped, "site")
    rows = both.select("a", "b", "contig", "pos", "cm", ibs_state(F.col("x"), F.col("y")).alias("ibs"))
    return ibd_segments(rows, ["a", "b", "contig"], window, min_cm, min_sites)


def compare_sources(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """One row a stated pair: total and longest length of its segments, their number, and the relationship they suggest."""
    s = segments.groupBy("a", "b").agg(F.sum("cm").alias("total_cm"), F.max("cm").alias("longest_cm"), F.count("*").alias("segments"))
    p = pairs.select("a", "b").where("a <> b").distinct().join(s, ["a", "b"], "left").na.fill(0, ["total_cm", "longest_cm", "segments"])
    return p.withColumn("relationship", relationship(F.col("total_cm")))
