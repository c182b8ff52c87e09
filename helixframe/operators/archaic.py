"""Archaic markers and segments, deep ancestry: classes, concordance, attribution, percentiles, f4 fits and gates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.ancestry import chi2_survival
from helixframe.operators.intervals import point_in_interval, point_in_many
from helixframe.operators.kernels import grouped

#: Concordance that a segment needs, and the sites from which it is judged: fixed values.
MIN_CONCORDANCE, MIN_SITES = 0.70, 3
#: Expected carrier rates, and the matches and the ratio that name a lineage: fixed values.
BASE_NEANDERTHAL, BASE_DENISOVAN, MIN_MATCHES, MIN_RATIO = 0.043, 0.039, 10, 2.0
#: Sites from which a percentile is shown: a fixed value.
PERCENTILE_SITES = 200
#: Gates of deep ancestry: sites, dispersion, West Eurasian share in percent, tail probability, tolerance of weights.
DEEP_SITES, DEEP_DISPERSION, WEST_EURASIAN, MIN_P, WEIGHT_TOLERANCE = 500, 4.0, 50.0, 0.05, 0.02
#: Base pairs of a jackknife block: a fixed value.
BLOCK_BP = 5_000_000


def carried_sites(panel: DataFrame, calls: DataFrame, key: list[str]) -> DataFrame:
    """(key, contig, pos, carries) of panel sites with a record: whether the alternate is the archaic allele."""
    j = panel.select("contig", "pos", F.upper("derived").alias("_d")).join(calls, ["contig", "pos"])
    return j.select(*key, "contig", "pos", ((F.col("dosage") > 0) & (F.substring(F.upper("alt"), 1, 1) == F.col("_d"))).alias("carries"))


def marker_counts(panel: DataFrame, calls: DataFrame, key: list[str]) -> DataFrame:
    """(key, class, copies, called, call_rate): derived copies by class over the panel's sites that were called."""
    size = panel.groupBy("class").agg(F.count("*").alias("sites"))
    j = calls.where(F.col("dosage") >= 0).join(panel.select("contig", "pos", "class"), ["contig", "pos"])
    g = j.groupBy(*key, "class").agg(F.sum("dosage").alias("copies"), F.count("*").alias("called"))
    return g.join(F.broadcast(size), "class").select(*key, "class", "copies", "called", (F.col("called") / F.col("sites")).alias("call_rate"))


def segment_concordance(segments: DataFrame, panel: DataFrame, carried: DataFrame, width: int, least: int = MIN_SITES, share: float = MIN_CONCORDANCE) -> DataFrame:
    """(segment, concordance, kept): of the sites where a genome has the allele, the share that the sample has too.

    The best genome with enough sites counts; a segment without one can't be judged and is kept. ``segments``:
    segment, sample, contig, start, end; ``panel``: contig, pos, calls (copies by genome, null where not called).
    """
    genomes = panel.select("contig", "pos", F.posexplode("calls").alias("genome", "n")).where("n > 0")
    genomes = genomes.select("contig", "pos", "genome")
    # Sites and hits are counted apart: pairs of site and segment needn't meet the calls.
    sites = point_in_many(genomes, segments, ["contig"], "pos", "start", "end", width)
    has = carried.where("carries").select("sample", "contig", "pos").distinct().join(segments.select("sample").distinct(), "sample", "left_semi")
    hits = point_in_many(has.join(genomes, ["contig", "pos"]), segments, ["sample", "contig"], "pos", "start", "end", width)
    both = sites.select("segment", "genome", F.lit(1).alias("site"), F.lit(0).alias("hit")).union(hits.select("segment", "genome", F.lit(0), F.lit(1)))
    g = both.groupBy("segment", "genome").agg(F.sum("site").alias("sites"), F.sum("hit").alias("hits")).where(F.col("sites") >= least)
    best = g.groupBy("segment").agg(F.max(F.col("hits") / F.col("sites")).alias("concordance"))
    return segments.join(best, "segment", "left").select("segment", "concordance", (F.col("concordance").isNull() | (F.col("concordance") >= share)).alias("kept"))


def attribute_segments(segments: DataFrame, sites: DataFrame, alleles: DataFrame, width: int) -> DataFrame:
    """(segment, neanderthal, denisovan, source): matches by lineage, and the one clearly enriched over the other.

    ``sites``: contig, pos, derived, class; ``alleles``: sample, contig, pos, ref, alt, dosage.
    """
    inside = point_in_interval(sites.where(F.col("class") != "SharedArchaic"), segments, ["contig"], "pos", "start", "end", width)
    j = inside.join(alleles, ["sample", "contig", "pos"], "left")
    d = F.upper("derived")
    carries = F.coalesce(((F.upper("alt") == d) & (F.col("dosage") >= 1)) | ((F.upper("ref") == d) & (F.col("dosage") <= 1)), F.lit(False))
    of = lambda c: F.col("class") == c
    g = j.groupBy("segment").agg(F.count_if(of("Neanderthal") & carries).alias("neanderthal"), F.count_if(of("Denisovan") & carries).alias("denisovan"), F.count_if(of("Neanderthal")).alias("ns"), F.count_if(of("Denisovan")).alias("ds"))
    g = segments.select("segment").join(g, "segment", "left").na.fill(0)
    rich = lambda n, s, rate: F.when(s > 0, n / (s * rate)).otherwise(0.0)
    en, ed = rich(F.col("neanderthal"), F.col("ns"), BASE_NEANDERTHAL), rich(F.col("denisovan"), F.col("ds"), BASE_DENISOVAN)
    source = F.when((F.col("neanderthal") >= MIN_MATCHES) & (en >= ed * MIN_RATIO), "Neanderthal").when((F.col("denisovan") >= MIN_MATCHES) & (ed >= en * MIN_RATIO), "Denisovan").otherwise("Unknown")
    return g.select("segment", "neanderthal", "denisovan", source.alias("source"))


def callable_fraction(points: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """``points`` with the callable share of the window that holds them; unknown windows are not callable.

    ``windows``: contig, window (number from 0), callable bases.
    """
    j = points.withColumn("window", F.floor(F.col("pos") / width)).join(windows, ["contig", "window"], "left")
    return j.withColumn("callable_share", F.least(F.coalesce(F.col("callable") / width, F.lit(0.0)), F.lit(1.0))).drop("window", "callable")


def callable_megabases(windows: DataFrame) -> DataFrame:
    return windows.agg((F.sum("callable") / 1e6).alias("callable_mb"))


def _inflation(density: Column, ladder: list[tuple[float, float]]) -> Column:
    """Variance inflation at a density of sites: log-linear between the rungs, constant beyond them, 1 at least."""
    rungs = sorted(ladder)
    if not rungs:
        return F.lit(1.0)
    out = F.lit(rungs[-1][1])
    x = F.log(F.greatest(density, F.lit(1e-6)))
    for (d0, i0), (d1, i1) in reversed(list(zip(rungs, rungs[1:], strict=False))):
        a, b = float(np.log(max(d0, 1e-6))), float(np.log(max(d1, 1e-6)))
        out = F.when(density <= d1, i0 + (x - a) / (b - a) * (i1 - i0) if b > a else F.lit(i0)).otherwise(out)
    return F.greatest(F.when(density <= rungs[0][0], rungs[0][1]).otherwise(out), F.lit(1.0))


def normal_cdf(z: Column) -> Column:
    """By the rational approximation 7.1.26 of Abramowitz and Stegun: fixed values."""
    x = F.abs(z) / float(np.sqrt(2))
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    y = 1 - poly * F.exp(-x * x)
    return 0.5 * (1 + F.when(z < 0, -1).otherwise(1) * y)


def count_percentile(called: DataFrame, key: list[str], panel_sites: int, ladder: list[tuple[float, float]], least: int = PERCENTILE_SITES) -> DataFrame:
    """(key, sites, copies, percentile) against what the same sites give in a population.

    ``called``: key, copies, freq (of the population). Copies are summed binomials under Hardy-Weinberg, their variance
    inflated for linkage at the density of the sites; null below ``least`` sites.
    """
    f = F.col("freq")
    g = called.groupBy(*key).agg(F.count("*").alias("sites"), F.sum("copies").alias("copies"), F.sum(2 * f).alias("mean"), F.sum(2 * f * (1 - f)).alias("var"))
    var = F.col("var") * _inflation(F.col("sites") / max(panel_sites, 1), ladder)
    p = 100 * normal_cdf((F.col("copies") - F.col("mean")) / F.sqrt(var))
    return g.select(*key, "sites", "copies", F.when((F.col("sites") >= least) & (var > 0), F.least(F.greatest(p, F.lit(0.0)), F.lit(100.0))).alias("percentile"))


def roh_summary(runs: DataFrame, key: list[str], autosomal_mb: Column) -> DataFrame:
    """(key, runs, total_mb, longest_mb, f_roh, counts and lengths by class, pattern); ``runs``: key, mb."""
    from helixframe.functions.bands import roh_class, roh_pattern

    c = roh_class(F.col("mb"))
    n = lambda k: F.count_if(c == k)
    mb = lambda k: F.sum(F.when(c == k, F.col("mb")).otherwise(0.0))
    g = runs.groupBy(*key).agg(F.count("*").alias("runs"), F.sum("mb").alias("total_mb"), F.max("mb").alias("longest_mb"), n("short").alias("n_short"), n("medium").alias("n_medium"), n("long").alias("n_long"), mb("short").alias("short_mb"), mb("medium").alias("medium_mb"), mb("long").alias("long_mb"))
    g = g.withColumn("f_roh", F.when(autosomal_mb > 0, F.col("total_mb") / autosomal_mb).otherwise(0.0))
    return g.withColumn("pattern", roh_pattern(F.col("f_roh"), F.col("total_mb"), F.col("short_mb"), F.col("long_mb")))


def dispersion(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, sites, dispersion): mean squared residual over its variance; near 1 if the mixture explains the sample.

    ``rows``: key, dosage, freqs and weights (arrays over the same populations).
    """
    clip = lambda x, lo: F.least(F.greatest(x, F.lit(lo)), F.lit(1 - lo))
    mixed = F.aggregate(F.zip_with("weights", "freqs", lambda w, f: w * clip(f, 0.001)), F.lit(0.0), lambda a, x: a + x)
    r = rows.where("dosage >= 0").withColumn("_f", clip(mixed, 1e-6))
    ratio = F.pow(F.col("dosage") - 2 * F.col("_f"), F.lit(2.0)) / (2 * F.col("_f") * (1 - F.col("_f")))
    return r.groupBy(*key).agg(F.count("*").alias("sites"), F.avg(ratio).alias("dispersion"))


def deep_gate(sites: Column, dispersion_: Column, west_eurasian: Column) -> Column:
    """Whether a three-way mixture may be shown."""
    return F.coalesce((west_eurasian >= WEST_EURASIAN) & (sites >= DEEP_SITES) & (dispersion_ <= DEEP_DISPERSION), F.lit(False))


def fine_populations(segments: DataFrame, alleles: DataFrame, panel: DataFrame, supers: list[tuple[str, str]], width: int, least: int = 10, margin: float = 0.02) -> DataFrame:
    """(segment, fine): the likeliest fine population inside a segment's super-population, if it is clearly ahead.

    ``segments``: segment, sample, side, contig, start, end, population; ``alleles``: sample, side, contig, pos,
    allele 0 or 1; ``panel``: contig, pos, freqs in the order of ``supers`` (fine population, super-population).
    """
    spark = segments.sparkSession
    names = spark.createDataFrame([(k, c, s) for k, (c, s) in enumerate(supers) if c != s], "k int, fine string, population string")
    inside = point_in_interval(panel, segments, ["contig"], "pos", "start", "end", width).join(alleles, ["sample", "side", "contig", "pos"])
    f = F.least(F.greatest(F.get("freqs", F.col("k")), F.lit(1e-4)), F.lit(1 - 1e-4))
    j = inside.join(F.broadcast(names), "population").withColumn("l", F.log(F.when(F.col("allele") == 1, f).otherwise(1 - f)))
    s = j.groupBy("segment", "fine", "k").agg(F.sum("l").alias("ll"), F.count("*").alias("n"))
    w = Window.partitionBy("segment").orderBy(F.desc("ll"), "k")
    s = s.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("ll").over(w))
    clear = F.col("next").isNull() | ((F.col("ll") - F.col("next")) / F.col("n") >= margin)
    best = s.where((F.col("r") == 1) & (F.col("n") >= least) & clear).select("segment", "fine")
    return segments.select("segment").join(best, "segment", "left")


def anchor_sides(phased: DataFrame, parent: DataFrame, key: list[str], least: int = 50, share: float = 0.75) -> DataFrame:
    """(key, informative, side): the side of a child's phase that a parent transmitted, null if unclear.

    ``phased``: key, contig, pos, side0, side1; ``parent``: key, contig, pos, dosage. Only heterozygous sites of the
    child at which the parent is homozygous tell.
    """
    j = phased.where("side0 <> side1").join(parent.where("dosage in (0, 2)"), [*key, "contig", "pos"])
    g = j.groupBy(*key).agg(F.count("*").alias("informative"), F.count_if(F.col("side0") == F.col("dosage") / 2).alias("m0"))
    most = F.greatest("m0", F.col("informative") - F.col("m0"))
    side = F.when((F.col("informative") >= least) & (most / F.col("informative") >= share), F.when(F.col("m0") * 2 >= F.col("informative"), 0).otherwise(1))
    return g.select(*key, "informative", side.alias("side"))


# ---- f4 statistics and mixture fits


def quartets(sources: list[int], outgroups: list[int]) -> list[tuple[int, int, int, int]]:
    """f4(X, S1; R1, Rj) for the target (-1) and all sources but the first, over all outgroups but the first."""
    return [(x, sources[0], outgroups[0], r) for x in (-1, *sources[1:]) for r in outgroups[1:]]


def f4_blocks(rows: DataFrame, key: list[str], wanted: list[tuple[int, int, int, int]], block: int = BLOCK_BP) -> DataFrame:
    """(key, contig, block, n, s): sums of each statistic by genome block. ``rows``: key, contig, pos, dosage, freqs."""
    at = lambda p: F.col("dosage") / 2.0 if p < 0 else F.get("freqs", F.lit(p))
    r = rows.where("dosage >= 0")
    sums = [F.sum((at(a) - at(b)) * (at(c) - at(d))).alias(f"s{k}") for k, (a, b, c, d) in enumerate(wanted)]
    g = r.groupBy(*key, "contig", F.floor(F.col("pos") / block).alias("block")).agg(F.count("*").alias("n"), *sums)
    return g.select(*key, "contig", "block", "n", F.array(*(f"s{k}" for k in range(len(wanted)))).alias("s"))


def jackknife(s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates, and their covariance when blocks of unequal size are left out one at a time.

    ``s``: (blocks, statistics) sums, ``n``: sites of each block. Pseudo-values are weighted by total over block size.
    """
    total, size, g = s.sum(0), n.sum(), len(n)
    theta = total / size
    h = size / n
    left = (total - s) / (size - n)[:, None]
    centre = g * theta - (((h - 1) / h)[:, None] * left).sum(0)
    pseudo = h[:, None] * theta - (h - 1)[:, None] * left - centre
    return theta, (pseudo / (h - 1)[:, None]).T @ pseudo / g


def mixture_weights(theta: np.ndarray, cov: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(weights, standard errors, chi-square, freedom) of target = sum of weights times sources, weights summing to 1.

    Least squares under the covariance of the residual, which depends on the weights and is renewed until they settle.
    """
    k = m - 1
    y, a = theta[:k], theta[k:].reshape(n - 1, k).T
    blocks = cov.reshape(n, k, n, k)

    def inverse(w: np.ndarray) -> np.ndarray:
        c = np.concatenate(([1.0], -w))
        sigma = np.einsum("b,bpcq,c->pq", c, blocks, c)
        return np.linalg.inv(sigma + np.eye(k) * max(1e-12 * np.abs(np.diag(sigma)).sum() / max(k, 1), 1e-18))

    w = np.full(n - 1, 1.0 / n)
    for _ in range(100):
        inv = inverse(w)
        new = np.linalg.solve(a.T @ inv @ a, a.T @ inv @ y)
        done, w = np.abs(new - w).max() < 1e-10, new
        if done:
            break
    inv = inverse(w)
    rest = y - a @ w
    spread = np.linalg.inv(a.T @ inv @ a)
    errors = np.sqrt(np.maximum(np.concatenate(([spread.sum()], np.diag(spread))), 0))
    return np.concatenate(([1 - w.sum()], w)), errors, float(rest @ inv @ rest), m - n


def fit_mixtures(rows: DataFrame, key: str, sources: list[int], outgroups: list[int], block: int = BLOCK_BP) -> DataFrame:
    """(key, weights, errors, chi2, dof, p, sites, blocks, feasible) of each sample's mixture of the sources.

    Sums by block are one aggregate over all samples; a sample's blocks, at most some hundreds, are solved together.
    """
    n, m = len(sources), len(outgroups)
    if n < 2 or m < n:
        raise ValueError("two sources, and as many outgroups, are needed")
    blocks = f4_blocks(rows, [key], quartets(sources, outgroups), block)
    kind = dict(rows.dtypes)[key]

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=[key, "weights", "errors", "chi2", "dof", "p", "sites", "blocks", "feasible"])
        if len(g) < 2:
            return empty
        g = g.sort_values(["contig", "block"])
        try:
            w, e, chi2, dof = mixture_weights(*jackknife(np.stack(g["s"]), g["n"].to_numpy(float)), n, m)
        except np.linalg.LinAlgError:
            return empty
        p = chi2_survival(chi2, dof) if dof else float(chi2 <= 0)
        ok = bool(((w >= -WEIGHT_TOLERANCE) & (w <= 1 + WEIGHT_TOLERANCE)).all())
        return pd.DataFrame([(g[key].iloc[0], w.tolist(), e.tolist(), chi2, dof, p, int(g["n"].sum()), len(g), ok)], columns=empty.columns)

    return grouped(blocks, [key], kernel, f"{key} {kind}, weights array<double>, errors array<double>, chi2 double, dof int, p double, sites long, blocks long, feasible boolean")


def mixture_gate(fit: DataFrame, west_eurasian: Column) -> DataFrame:
    """Fits that may be shown: applicable, deep enough, not rejected, with possible weights (cut at 0, summing to 1)."""
    ok = (west_eurasian >= WEST_EURASIAN) & (F.col("sites") >= DEEP_SITES) & (F.col("p") >= MIN_P) & F.col("feasible")
    cut = F.transform("weights", lambda w: F.greatest(w, F.lit(0.0)))
    total = F.aggregate(cut, F.lit(0.0), lambda a, x: a + x)
    return fit.where(ok).withColumn("weights", F.transform(cut, lambda w: w / total))
