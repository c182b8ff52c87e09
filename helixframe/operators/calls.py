"""Base tallies, genotype likelihoods and the reconciliation of calls over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")
MAX_PL, MAX_GQ = 255, 99


def base_tally(obs: DataFrame, by: list[str], base: str) -> DataFrame:
    """Counts by site and base, and the site's depth."""
    n = obs.groupBy(*by, F.col(base).alias("base")).agg(F.count("*").alias("n"))
    return n.withColumn("depth", F.sum("n").over(Window.partitionBy(*by)))


def top_two(tally: DataFrame, by: list[str]) -> DataFrame:
    """The two commonest bases of a site, ties to the smaller base."""
    best = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("base").alias("base"))))
    t = tally.groupBy(*by).agg(best.alias("s"), F.sum("n").alias("depth"))
    return t.select(*by, "depth", F.col("s")[0]["base"].alias("top"), (-F.col("s")[0]["m"]).alias("top_n"), F.get("s", F.lit(1))["base"].alias("second"), F.coalesce(-F.get("s", F.lit(1))["m"], F.lit(0)).alias("second_n"))


def haploid_call(two: DataFrame, min_depth: int = 4, min_share: float = 0.5, paralog_reads: int = 2, paralog_share: float = 0.2) -> DataFrame:
    """The commonest base where it is deep and clear enough, null where a second one hints at a paralog."""
    paralog = (F.col("second_n") >= paralog_reads) & (F.col("second_n") > paralog_share * F.col("depth"))
    ok = (F.col("depth") >= min_depth) & (F.col("top_n") >= min_share * F.col("depth")) & ~paralog
    return two.withColumn("call", F.when(ok, F.col("top"))).withColumn("paralog", paralog)


def force_calls(sites: DataFrame, tally: DataFrame, by: list[str]) -> DataFrame:
    """Each site's state by the counts of its reference and alternate base; uncovered sites are no calls."""
    j = sites.join(tally, by, "left").groupBy(*by, "ref", "alt").agg(F.sum(F.when(F.col("base") == F.col("ref"), F.col("n")).otherwise(0)).alias("ref_n"), F.sum(F.when(F.col("base") == F.col("alt"), F.col("n")).otherwise(0)).alias("alt_n"))
    seen = F.col("ref_n") + F.col("alt_n")
    state = F.when(seen == 0, "NoCall").when(F.col("alt_n") > F.col("ref_n"), "Alternate").when(F.col("ref_n") > F.col("alt_n"), "Reference").otherwise("NoCall")
    return j.withColumn("state", state).withColumn("af", F.when(seen == 0, 0.0).otherwise(F.col("alt_n") / seen))


def error_rate(baseq: Column) -> Column:
    return F.pow(F.lit(10.0), -baseq / 10.0)


def _log_sum(like: Column) -> Column:
    return F.sum(F.log10(F.greatest(like, F.lit(1e-300))))


def genotype_likelihoods(obs: DataFrame, by: list[str], is_alt: Column, error: Column, is_ref: Column | None = None) -> DataFrame:
    """log10 likelihoods of 0, 1 and 2 alternate copies, summed over reads; a wrong base is one of three."""
    is_ref = ~is_alt if is_ref is None else is_ref
    ref = F.when(is_ref, 1 - error).otherwise(error / 3)
    alt = F.when(is_alt, 1 - error).otherwise(error / 3)
    return obs.groupBy(*by).agg(F.count("*").alias("depth"), F.count_if(is_alt).alias("alt_depth"), _log_sum(ref).alias("l0"), _log_sum((ref + alt) / 2).alias("l1"), _log_sum(alt).alias("l2"))


def genotypes(like: DataFrame) -> DataFrame:
    """dosage of the likeliest genotype (ties of scaled likelihoods to fewer copies), those likelihoods, and quality."""
    best = F.greatest("l0", "l1", "l2")
    pl = lambda c: F.least(F.floor(-10 * (F.col(c) - best) + 0.5), F.lit(MAX_PL)).cast("int")
    out = like.withColumn("pl", F.array(pl("l0"), pl("l1"), pl("l2")))
    dosage = F.when(F.col("pl")[0] == 0, 0).when(F.col("pl")[1] == 0, 1).otherwise(2)
    return out.withColumn("dosage", dosage).withColumn("gq", F.least(F.sort_array("pl")[1], F.lit(MAX_GQ)))


def allele_pairs(obs: DataFrame, by: list[str], allele: str, error: Column) -> DataFrame:
    """Log likelihood of each pair of a site's alleles: every read supports each pair half by each member."""
    alleles = obs.groupBy(*by).agg(F.sort_array(F.collect_set(allele)).alias("_as"))
    pairs = alleles.select(*by, F.explode("_as").alias("a"), "_as").select(*by, "a", F.explode(F.filter("_as", lambda x: x >= F.col("a"))).alias("b"))
    side = lambda c: F.when(F.col(allele) == F.col(c), 1 - F.col("_e")).otherwise(F.col("_e") / 3)
    j = obs.withColumn("_e", error).join(pairs, by)
    return j.groupBy(*by, "a", "b").agg(F.sum(F.log10((side("a") + side("b")) / 2)).alias("loglik"))


def heteroplasmy(two: DataFrame, min_depth: int = 20, min_reads: int = 3, min_share: float = 0.03) -> DataFrame:
    share = F.col("second_n") / F.col("depth")
    return two.where((F.col("depth") >= min_depth) & (F.col("second_n") >= min_reads) & (share >= min_share)).withColumn("minor_share", share)


def run_weight(depth: Column) -> Column:
    """One plus the square root of the depth over ten, at most two."""
    return 1 + F.least(F.sqrt(depth.cast("double")) / 10, F.lit(1.0))


def reconcile_runs(calls: DataFrame, by: list[str], min_depth: int = 2) -> DataFrame:
    """The dosage with the most weight over runs, ties to the smaller; sites that are reference alone go."""
    w = calls.where(F.col("depth") >= min_depth).groupBy(*by, "dosage").agg(F.sum(run_weight(F.col("depth"))).alias("w"), F.count("*").alias("runs"))
    key = F.struct(F.floor(F.col("w") * 1e6 + 0.5).alias("k"), (-F.col("dosage")).alias("d"))
    return w.groupBy(*by).agg(F.max_by("dosage", key).alias("dosage"), F.max("w").alias("weight"), F.sum("runs").alias("runs")).where("dosage > 0")
