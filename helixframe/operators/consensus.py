"""Weighted votes over several sources, their status bands, and profile comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_TIERS, STRETCHES = 1000, 64
CONFLICT_SHARE, CONFIRMED_SHARE = 0.30, 0.70
MILLIONTHS = 1e6


def observation_weight(method: Column, depth: Column, mapq: Column, callable_: Column, region: Column) -> Column:
    """Method weight scaled by depth, mapping quality, callability and the quality of the region."""
    by_depth = 1 + F.least(F.sqrt(depth.cast("double")) / 10, F.lit(1.0))
    return method * by_depth * F.least(mapq / 60.0, F.lit(1.0)) * callable_ * F.least(F.greatest(region, F.lit(0.1)), F.lit(1.0))


def vote(obs: DataFrame, key: list[str], value: str, weight: str) -> DataFrame:
    """The value with the most weight, ties by count, then the smallest value; with its share and the runner-up's.

    Weights are compared in millionths, so that the order of summation can't decide.
    """
    w = obs.groupBy(*key, value).agg(F.floor(F.sum(weight) * MILLIONTHS + 0.5).cast("long").alias("w"), F.count("*").alias("n"))
    win = Window.partitionBy(*key)
    ranked = w.withColumn("r", F.row_number().over(win.orderBy(F.desc("w"), F.desc("n"), F.asc(value)))).withColumn("total", F.sum("w").over(win)).withColumn("obs", F.sum("n").over(win)).withColumn("values", F.count("*").over(win))
    return ranked.where("r = 1").select(*key, F.col(value).alias("value"), (F.col("w") / MILLIONTHS).alias("weight"), F.when(F.col("total") == 0, 0.0).otherwise(F.col("w") / F.col("total")).alias("share"), F.col("obs").alias("n_obs"), F.col("values").alias("n_values"))


def status(share: Column, n_obs: Column, derived: Column, in_tree: Column) -> Column:
    s = F.when(n_obs == 0, "NoCoverage").when(1 - share > CONFLICT_SHARE, "Conflict").when(derived & ~in_tree, "Novel")
    return s.when(n_obs == 1, "SingleSource").when(share >= CONFIRMED_SHARE, "Confirmed").otherwise("Pending")


#: Fixed order of display.
STATUS_ORDER = ("Conflict", "Novel", "Pending", "SingleSource", "Confirmed", "NoCoverage")


def status_rank(column: str = "status") -> Column:
    out = F.lit(len(STATUS_ORDER))
    for k, s in enumerate(STATUS_ORDER):
        out = F.when(F.col(column) == s, k).otherwise(out)
    return out


def profile(consensus: DataFrame, key: list[str]) -> DataFrame:
    """Counts by status and the confidence: confirmed, plus .7 of novel, less .5 of conflicts, over all."""
    n = {s: F.count_if(F.col("status") == s) for s in STATUS_ORDER}
    raw = (n["Confirmed"] + 0.7 * n["Novel"] - 0.5 * n["Conflict"]) / F.count("*")
    return consensus.groupBy(*key).agg(F.count("*").alias("total"), *(x.alias(s.lower()) for s, x in n.items()), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)).alias("confidence"))


def dosage_consensus(obs: DataFrame, key: list[str], dosage: str, weight: str) -> DataFrame:
    """A vote on 0, 1 or 2 copies; other values are no calls and don't count."""
    return vote(obs.where(F.col(dosage).isin(0, 1, 2)), key, dosage, weight)


def pooled_vote(obs: DataFrame, key: list[str], value: str, weight: Column) -> DataFrame:
    """Total weight by value over typed sources; ties go to the greatest value."""
    w = obs.groupBy(*key, value).agg(F.sum(weight).cast("long").alias("w"))
    return w.groupBy(*key).agg(F.max(F.struct("w", value)).alias("b")).select(*key, F.col(f"b.{value}").alias("value"), F.col("b.w").alias("weight"))


def precedence(rows: DataFrame, key: list[str], rank: Column) -> DataFrame:
    """Rows of the highest-ranked source of each key, and how many lower-ranked rows disagree with the best."""
    w = Window.partitionBy(*key)
    r = rows.withColumn("_r", rank).withColumn("_m", F.max("_r").over(w))
    best = r.withColumn("_v", F.max(F.when(F.col("_r") == F.col("_m"), F.col("value"))).over(w))
    warn = F.count_if((F.col("_r") < F.col("_m")) & (F.col("value") != F.col("_v"))).over(w)
    return best.withColumn("warnings", warn).where("_r = _m and value = _v").select(*key, "value", "warnings").distinct()


def identity_band(concordance: Column, sites: Column, str_distance: Column, str_markers: Column) -> Column:
    """Whether two sources are one person, by shared genotypes (fixed values); markers only where no site is shared."""
    snp = concordance.isNotNull() & (sites > 0)
    c = F.when(snp & (concordance >= 0.95), "VerifiedSame").when(snp & (concordance >= 0.85), "LikelySame").when(snp & (concordance >= 0.65), "Uncertain")
    c = c.when(snp & (concordance >= 0.50), "LikelyDifferent").when(snp, "VerifiedDifferent")
    return c.when((str_markers > 0) & (str_distance == 0), "LikelySame").otherwise("Uncertain")


def identity_method(concordance: Column, sites: Column, str_markers: Column) -> Column:
    snp = concordance.isNotNull() & (sites > 0)
    return F.when(snp & (str_markers > 0), "SNP concordance + Y-STR").when(snp, "SNP concordance").when(str_markers > 0, "Y-STR only").otherwise("no shared data")


def marker_consensus(obs: DataFrame, key: list[str], value: str) -> DataFrame:
    """The commonest value of a marker, ties to the smallest, and whether sources disagree."""
    n = obs.groupBy(*key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key)
    r = n.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), value))).withColumn("kinds", F.count("*").over(w)).withColumn("total", F.sum("n").over(w))
    return r.where("r = 1").select(*key, F.col(value).alias("value"), "n", "total", (F.col("kinds") > 1).alias("conflict"))


def provider_comparison(obs: DataFrame, key: list[str], provider: str, value: str) -> DataFrame:
    """Markers that two or more providers report, and whether all their values agree."""
    g = obs.groupBy(*key).agg(F.count_distinct(provider).alias("providers"), F.count_distinct(value).alias("kinds"))
    return g.where("providers >= 2").withColumn("verdict", F.when(F.col("kinds") == 1, "agree").otherwise("conflict"))


def tuple_stats(obs: DataFrame, key: list[str], value: str) -> DataFrame:
    """Least, greatest and commonest tuple of a marker; arrays compare element by element."""
    n = obs.groupBy(*key, value).agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), F.col(value)))
    return n.withColumn("r", first).groupBy(*key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.max(F.when(F.col("r") == 1, F.col(value))).alias("mode"))


def share_below(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Percentage of a group's rows that are strictly below each row: ties share the rank of the first.

    A group is cut into stretches of values by approximate quantiles, so that no task sorts a whole group; ranks are
    exact, as equal values share a stretch and stretches are counted.
    """
    splits = rows.groupBy(group).agg(F.percentile_approx(value, [k / STRETCHES for k in range(1, STRETCHES)], 1000).alias("_s"), F.count(value).alias("_n"))
    r = rows.join(splits, group).withColumn("_k", F.size(F.filter("_s", lambda s: s < F.col(value)))).drop("_s")
    sizes = r.groupBy(group, "_k").agg(F.count(value).alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(group).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = r.join(sizes.select(group, "_k", before.alias("_before")), [group, "_k"])
    below = F.col("_before") + F.rank().over(Window.partitionBy(group, "_k").orderBy(value)) - 1
    return r.withColumn("percentile", below * 100.0 / F.col("_n")).select(*rows.columns, "percentile")


def precision_recall(matched: Column, left: Column, right: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of matched, only-left (called) and only-right (true) counts; empty sides give 1."""
    p = F.when(matched + left == 0, 1.0).otherwise(matched / (matched + left))
    r = F.when(matched + right == 0, 1.0).otherwise(matched / (matched + right))
    return p, r, F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def tier_membership(profiles: DataFrame, tiers: DataFrame, key: list[str], full: float = 0.9, partial: float = 0.8) -> DataFrame:
    """The largest tier of which a profile has ``full`` of the markers; else the one that overlaps it by ``partial``.

    ``profiles``: key, markers array; ``tiers``: tier, tier_markers array (cumulative), at most ``MOST_TIERS`` rows.
    """
    known = tiers.select("tier", "tier_markers").limit(MOST_TIERS + 1).collect()
    if len(known) > MOST_TIERS:
        raise ValueError(f"more than {MOST_TIERS} tiers")
    each = F.array(*(F.struct(F.lit(r.tier).alias("tier"), F.array(*map(F.lit, r.tier_markers)).alias("tier_markers")) for r in known))
    j = profiles.withColumn("_t", F.explode(each)).select(*profiles.columns, "_t.*")
    hit = F.size(F.array_intersect("markers", "tier_markers"))
    j = j.withColumn("overlap", hit / F.size("tier_markers")).withColumn("ok", F.when(F.col("overlap") >= full, 2).when(F.col("overlap") >= partial, 1).otherwise(0))
    best = F.max_by(F.struct("tier", "overlap", "ok"), F.struct("ok", F.size("tier_markers")))
    return j.groupBy(*key).agg(best.alias("b")).select(*key, F.when(F.col("b.ok") > 0, F.col("b.tier")).alias("tier"), F.col("b.overlap").alias("overlap"))
