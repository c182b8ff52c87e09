"""Population models: likelihoods, admixture, f-statistics, principal components, and their summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.kernels import sited
from helixframe.operators.scan import WIDTH, Running, position_block, running

BLOCK = 5_000_000


def population_posterior(dosages: DataFrame, freqs: DataFrame, site: list[str], sample: str = "sample") -> DataFrame:
    """(sample, pop, sites, loglik, posterior): each dosage scored under each population's frequency.

    ``dosages``: sample, site, dosage (missing below 0, skipped); ``freqs``: site, pop, freq.
    """
    p = F.least(F.greatest(F.col("freq"), F.lit(0.001)), F.lit(0.999))
    like = F.when(F.col("dosage") == 0, (1 - p) * (1 - p)).when(F.col("dosage") == 1, 2 * p * (1 - p)).otherwise(p * p)
    s = dosages.where("dosage >= 0").join(freqs, site).groupBy(sample, "pop").agg(F.count("*").alias("sites"), F.sum(F.log(like)).alias("loglik"))
    w = Window.partitionBy(sample)
    s = s.withColumn("_e", F.exp(F.col("loglik") - F.max("loglik").over(w)))
    return s.withColumn("posterior", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def roll_up(shares: DataFrame, sample: str, super_pop: str, share: str, sites: Column, error: float = 1.96) -> DataFrame:
    """Shares by super-population with rank and the width of a binomial interval."""
    g = shares.groupBy(sample, super_pop).agg(F.sum(share).alias("share"), F.max(sites).alias("sites"))
    ci = 2 * error * F.sqrt(F.greatest(F.col("share") * (1 - F.col("share")), F.lit(0.0)) / F.col("sites"))
    rank = F.row_number().over(Window.partitionBy(sample).orderBy(F.desc(F.floor(F.col("share") * 1e6 + 0.5)), super_pop))
    return g.withColumn("ci_width", ci).withColumn("place", rank)


#: Sites whose shares are held at once.
BLOCK_SITES = 65_536


def admixture(x: np.ndarray, p: np.ndarray, most: int = 500, stop: float = 1e-7, times: np.ndarray | None = None) -> np.ndarray:
    """Ancestry shares of one sample by expectation-maximisation over allele copies; a site may count several times."""
    q = np.full(p.shape[1], 1 / p.shape[1])
    total = len(x) if times is None else times.sum()
    for _ in range(most):
        new = np.zeros(len(q))
        for a in range(0, len(x), BLOCK_SITES):
            own, f = x[a : a + BLOCK_SITES], np.clip(p[a : a + BLOCK_SITES], 0.001, 0.999)
            n = 1 if times is None else times[a : a + BLOCK_SITES]
            alt, ref = f * q, (1 - f) * q
            new += (n * own / alt.sum(1)) @ alt + (n * (2 - own) / ref.sum(1)) @ ref
        new /= 2 * total
        if np.abs(new - q).max() < stop:
            return new
        q = new
    return q


def admixture_shares(joined: DataFrame, sample: str, pops: list[str], min_sites: int = 1) -> DataFrame:
    """(sample, pop, share, sites); rows need ``dosage`` and ``freqs``, an array in the order of ``pops``.

    A sample's equal rows are one, with their number.
    """
    n = joined.where(F.col("dosage") >= 0).groupBy(sample, "dosage", "freqs").agg(F.count("*").alias("n"))

    def kernel(g: dict[str, np.ndarray]) -> pd.DataFrame:
        sites = int(g["n"].sum())
        if sites < max(min_sites, 1):
            return pd.DataFrame()
        return pd.DataFrame({"pop": pops, "share": admixture(g["dosage"], g["freqs"], times=g["n"]), "sites": sites})

    return sited(n, [sample], {"dosage": float, "freqs": float, "n": float}, kernel, "pop string, share double, sites long")


def f4_jackknife(sites: DataFrame, a: str, b: str, c: str, d: str, block: list[Column]) -> DataFrame:
    """f4(a, b; c, d) over sites with its block-jackknife standard error, in one row.

    Leave-one-out sums are totals less a block's sums, so one aggregate by block and one over blocks suffice.
    """
    x = (F.col(a) - F.col(b)) * (F.col(c) - F.col(d))
    by = sites.groupBy(*block).agg(F.sum(x).alias("s"), F.count("*").alias("n"))
    total = by.agg(F.sum("s").alias("sum_all"), F.sum("n").alias("n_all"))
    loo = by.join(F.broadcast(total)).withColumn("l", (F.col("sum_all") - F.col("s")) / (F.col("n_all") - F.col("n")))
    return loo.agg((F.first("sum_all") / F.first("n_all")).alias("f4"), F.sqrt((F.count("*") - 1) / F.count("*") * F.sum(F.pow(F.col("l") - F.col("sum_all") / F.col("n_all"), F.lit(2.0)))).alias("se"), F.count("*").alias("blocks"))


def f4_covariance(loo: np.ndarray) -> np.ndarray:
    """Jackknife covariance of several f4 statistics; rows are leave-one-out values by block."""
    g = len(loo)
    dev = loo - loo.mean(0)
    return (g - 1) / g * dev.T @ dev


def gls_weights(y: np.ndarray, x: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Weights summing to one that best explain target statistics y by sources x; chi-square and its freedom."""
    inv = np.linalg.pinv(cov)
    base, diff = x[:, -1], x[:, :-1] - x[:, -1:]
    w = np.linalg.solve(diff.T @ inv @ diff, diff.T @ inv @ (y - base)) if diff.shape[1] else np.zeros(0)
    resid = y - base - diff @ w
    return np.append(w, 1 - w.sum()), float(resid @ inv @ resid), len(y) - diff.shape[1]


def ln_gamma(x: float) -> float:
    from math import lgamma

    return lgamma(x)


def incomplete_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by series or continued fraction."""
    from math import exp, log

    if x <= 0:
        return 0.0
    scale = exp(-x + a * log(x) - ln_gamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def chi2_survival(x: float, df: int) -> float:
    return 1 - incomplete_gamma(df / 2, x / 2)


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7; a half at 0 alone, so that its side is always right."""
    x = F.abs(z) / float(np.sqrt(2))
    t = 1 / (1 + 0.3275911 * x)
    # Fixed values of the published approximation.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z == 0, 0.5).when(z > 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def normal_percentile(value: Column, mean: Column, sd: Column, sites: Column, least: int = 200) -> Column:
    return F.when((sites < least) | (sd <= 0), None).otherwise(100 * normal_cdf((value - mean) / sd))


def fst(freqs: Column) -> Column:
    """Nei's fixation index of an array of population frequencies; 0 where nothing varies."""
    n = F.size(freqs)
    mean = F.aggregate(freqs, F.lit(0.0), lambda a, x: a + x) / n
    within = F.aggregate(freqs, F.lit(0.0), lambda a, x: a + 2 * x * (1 - x)) / n
    total = 2 * mean * (1 - mean)
    return F.when(total <= 0, 0.0).otherwise((total - within) / total)


def panel_frequencies(dosages: DataFrame, site: list[str], pop: str, dosage: str = "dosage") -> DataFrame:
    """Alternate-allele frequency and calls of each site in each population; missing calls don't count."""
    return dosages.where(F.col(dosage) >= 0).groupBy(*site, pop).agg((F.sum(dosage) / (2 * F.count("*"))).alias("freq"), F.count("*").alias("calls"))


def project(rows: DataFrame, vector: str, means: list[float], loadings: list[list[float]]) -> DataFrame:
    """Coordinates of centred vectors on components; missing entries are skipped and the rest scaled up."""
    out = rows
    used = F.size(F.filter(vector, lambda x: x.isNotNull()))
    for k, load in enumerate(loadings):
        centred = F.zip_with(F.col(vector).cast("array<double>"), F.array(*map(F.lit, means)), lambda x, m: x - m)
        terms = F.zip_with(centred, F.array(*map(F.lit, load)), lambda x, w: F.coalesce(x * w, F.lit(0.0)))
        out = out.withColumn(f"pc{k + 1}", F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) * (F.size(vector) / used))
    return out


def fit_components(rows: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, loadings (k, d), variances) from sums of products by pair of dimensions: d^2 rows, not samples.

    The sign of a component is that of its largest loading.
    """
    dims = rows.select(F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").toPandas()
    means = dims["m"].to_numpy()
    d = len(means)

    def gram(batches):
        total, n = np.zeros((d, d)), 0
        for b in batches:
            if len(b):
                x = np.stack(b[vector].to_numpy()).astype(float) - means
                total += x.T @ x
                n += len(x)
        yield pd.DataFrame({"g": [total.ravel().tolist()], "n": [n]})

    parts = rows.select(vector).mapInPandas(gram, "g array<double>, n long")
    sums = parts.select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()["x"].to_numpy().reshape(d, d)
    n = rows.count()
    values, vectors = np.linalg.eigh(sums / max(n - 1, 1))
    order = np.argsort(-values)[:k]
    load = vectors[:, order].T
    sign = np.sign(load[np.arange(len(order)), np.abs(load).argmax(1)])
    return means, load * sign[:, None], values[order]


def genetic_map(points: DataFrame, chrom: str, pos: str, cm: str, width: int = WIDTH) -> DataFrame:
    """(chrom, pos, cm, place): one row a position, centimorgans that never fall, numbered from 0 in each contig.

    The least value of a position counts; the greatest so far and the number are scans over blocks of positions.
    """
    one = points.groupBy(chrom, pos).agg(F.min(cm).alias("_cm"))
    wanted = [Running(cm, F.col("_cm"), "max"), Running("place", F.lit(1).cast("long"), "sum")]
    found = running(one, [chrom], [pos], wanted, position_block(F.col(pos), width))
    return found.select(chrom, pos, cm, (F.col("place") - 1).alias("place"))
