"""Read filters, pileups, depth statistics and callable states.

Reads are rows ``contig, pos, cigar, mapq, flags, quals``; observations are one row per covered base. Everything is
grouped by ``(contig, pos)``, so work spreads by position and map-side combine does most of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNMAPPED, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x4, 0x100, 0x200, 0x400, 0x800
COVERAGE_MASK = UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE | SUPPLEMENTARY
MAX_DEPTH_BIN = 255
#: Positions that one task looks at together.
BLOCK = 1 << 16
MISSING_MAPQ = 255
#: States in the order in which they are decided.
STATES = ("REF_N", "NO_COVERAGE", "POOR_MAPPING_QUALITY", "LOW_COVERAGE", "EXCESSIVE_COVERAGE", "CALLABLE")


def primary_reads(reads: DataFrame, flags: str = "flags", mask: int = COVERAGE_MASK) -> DataFrame:
    return reads.where(F.col(flags).bitwiseAND(F.lit(mask)) == 0)


def caller_reads(reads: DataFrame, min_mapq: int, flags: str = "flags", mapq: str = "mapq") -> DataFrame:
    """Primary reads of enough mapping quality; an unknown quality passes."""
    return primary_reads(reads, flags).where(F.coalesce(F.col(mapq), F.lit(MISSING_MAPQ)) >= min_mapq)


def cigar_ops(cigar: Column) -> Column:
    """array<struct<op, len>> of a CIGAR string."""
    n = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    op = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    return F.zip_with(n, op, lambda a, b: F.struct(b.alias("op"), a.cast("int").alias("len")))


def aligned_bases(reads: DataFrame) -> DataFrame:
    """One row per aligned base: the read's columns, ``ref_pos`` and ``query_index`` (from 0)."""

    def step(acc: Column, x: Column) -> Column:
        both = x["op"].isin("M", "=", "X")
        run = F.struct(acc["r"].alias("r"), acc["q"].alias("q"), x["len"].alias("len"))
        return F.struct(
            (acc["r"] + F.when(both | x["op"].isin("D", "N"), x["len"]).otherwise(0)).alias("r"),
            (acc["q"] + F.when(both | x["op"].isin("I", "S"), x["len"]).otherwise(0)).alias("q"),
            F.when(both, F.concat(acc["runs"], F.array(run))).otherwise(acc["runs"]).alias("runs"),
        )

    start = F.struct(F.col("pos").cast("long").alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<r:bigint,q:int,len:int>>").alias("runs"))
    runs = F.aggregate(cigar_ops(F.col("cigar")), start, step, lambda acc: acc["runs"])
    return reads.withColumn("_run", F.explode(runs)).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_run.len") - 1))).withColumn("ref_pos", F.col("_run.r") + F.col("_k")).withColumn("query_index", F.col("_run.q") + F.col("_k")).drop("_run", "_k")


def position_depths(obs: DataFrame, contig: str = "contig", pos: str = "pos", baseq: str = "baseq", mapq: str = "mapq", min_baseq: int = 0, min_mapq: int = 0, low_mapq: int = 1) -> DataFrame:
    """Raw and counted depth per position; mapping quality excludes before base quality does."""
    by_mapq = F.coalesce(F.col(mapq), F.lit(MISSING_MAPQ)) < min_mapq
    by_baseq = ~by_mapq & (F.col(baseq) < min_baseq)
    kept = ~by_mapq & ~by_baseq
    return obs.groupBy(F.col(contig).alias("contig"), F.col(pos).cast("long").alias("pos")).agg(
        F.count("*").alias("raw_depth"),
        F.count_if(kept).alias("depth"),
        F.sum(F.when(kept, F.col(baseq)).otherwise(0)).cast("long").alias("baseq_sum"),
        F.sum(F.when(kept, F.col(mapq)).otherwise(0)).cast("long").alias("mapq_sum"),
        F.count_if(F.coalesce(F.col(mapq), F.lit(MISSING_MAPQ)) <= low_mapq).alias("low_mapq"),
        F.count_if(by_mapq).alias("excluded_mapq"),
        F.count_if(by_baseq).alias("excluded_baseq"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def contig_stats(depths: DataFrame) -> DataFrame:
    """Covered bases, reads on them and means for each contig; an empty denominator gives 0."""
    return depths.groupBy("contig").agg(
        F.sum("depth").alias("bases"),
        F.count_if(F.col("depth") > 0).alias("covered"),
        _ratio(F.sum("depth"), F.count_if(F.col("depth") > 0)).alias("mean_depth"),
        _ratio(F.sum("baseq_sum"), F.sum("depth")).alias("mean_baseq"),
        _ratio(F.sum("mapq_sum"), F.sum("depth")).alias("mean_mapq"),
    )


def excluded_share(depths: DataFrame) -> DataFrame:
    """Shares of the raw depth that each filter took."""
    return depths.groupBy("contig").agg(_ratio(F.sum("excluded_mapq"), F.sum("raw_depth")).alias("by_mapq"), _ratio(F.sum("excluded_baseq"), F.sum("raw_depth")).alias("by_baseq"))


def depth_histogram(depths: DataFrame, by: list[str]) -> DataFrame:
    """Positions by depth, the last bin holding all that is deeper; at most 256 rows a group."""
    return depths.groupBy(*by, F.least(F.col("depth"), F.lit(MAX_DEPTH_BIN)).alias("bin")).agg(F.count("*").alias("n"))


def fraction_at_least(hist: DataFrame, by: list[str], levels: list[int]) -> DataFrame:
    """Share of positions with at least each depth."""
    return hist.groupBy(*by).agg(*(_ratio(F.sum(F.when(F.col("bin") >= k, F.col("n")).otherwise(0)), F.sum("n")).alias(f"at_least_{k}") for k in levels))


def histogram_median(hist: DataFrame, by: list[str], value: str = "bin", n: str = "n", out: str = "median") -> DataFrame:
    """The first bin whose running count reaches half the total, halves rounded down: not the usual median."""
    w = Window.partitionBy(*by).orderBy(value)
    total = F.sum(n).over(Window.partitionBy(*by))
    run = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return hist.withColumn("_run", run).withColumn("_half", F.floor(total / 2)).where(F.col("_run") >= F.col("_half")).groupBy(*by).agg(F.min(value).alias(out))


def histogram_mad(hist: DataFrame, by: list[str]) -> DataFrame:
    """Median of the absolute deviations from the histogram's median."""
    dev = hist.join(histogram_median(hist, by), by).groupBy(*by, F.abs(F.col("bin") - F.col("median")).alias("dev")).agg(F.sum("n").alias("n"))
    return histogram_median(hist, by).join(histogram_median(dev, by, "dev", "n", "mad"), by)


def mean_and_sd(hist: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population standard deviation from bins; fewer than two positions have deviation 0."""
    m = F.sum(F.col("bin") * F.col("n")) / F.sum("n")
    sq = F.sum(F.col("bin") * F.col("bin") * F.col("n")) / F.sum("n")
    return hist.groupBy(*by).agg(m.alias("mean"), F.when(F.sum("n") < 2, 0.0).otherwise(F.sqrt(F.greatest(sq - m * m, F.lit(0.0)))).alias("sd"))


def callable_state(min_depth: int = 4, max_low_share: float = 0.1, max_depth: int | None = None, ref_n: Column | None = None) -> Column:
    """State of a row of ``position_depths``."""
    s = F.when(ref_n if ref_n is not None else F.lit(False), "REF_N").when(F.col("raw_depth") == 0, "NO_COVERAGE")
    s = s.when(F.col("low_mapq") / F.col("raw_depth") > max_low_share, "POOR_MAPPING_QUALITY").when(F.col("depth") < min_depth, "LOW_COVERAGE")
    if max_depth is not None:
        s = s.when(F.col("depth") > max_depth, "EXCESSIVE_COVERAGE")
    return s.otherwise("CALLABLE")


def state_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("contig").agg(*(F.count_if(F.col("state") == s).alias(s.lower()) for s in STATES))


def state_intervals(states: DataFrame, min_run: int = 1, state: str = "CALLABLE") -> DataFrame:
    """Runs of adjacent positions in one state, of at least ``min_run``: gaps and islands.

    Runs are found inside blocks of positions, so that no task sorts a contig, and stitched where they meet.
    """
    own = states.where(F.col("state") == state).select("contig", "pos", F.floor(F.col("pos") / BLOCK).alias("_b"))
    isle = F.col("pos") - F.row_number().over(Window.partitionBy("contig", "_b").orderBy("pos"))
    runs = own.withColumn("_isle", isle).groupBy("contig", "_b", "_isle").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    w = Window.partitionBy("contig").orderBy("start")
    new = F.when(F.col("start") == F.lag("end").over(w) + 1, 0).otherwise(1)
    joined = runs.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = joined.groupBy("contig", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("length", F.col("end") - F.col("start") + 1)
    return out.where(F.col("length") >= min_run).drop("_run")


def read_metrics(reads: DataFrame) -> DataFrame:
    """One row of totals over reads with ``flags, mapq, contig, mate_contig``."""
    bit = lambda b: F.col("flags").bitwiseAND(F.lit(b)) != 0
    aligned = ~bit(UNMAPPED)
    return reads.agg(
        F.count("*").alias("total"),
        F.count_if(~bit(QC_FAIL)).alias("passing"),
        F.count_if(aligned).alias("aligned"),
        F.count_if(bit(0x1)).alias("paired"),
        F.count_if(bit(0x2)).alias("proper"),
        F.count_if(bit(0x1) & aligned & (F.col("contig") != F.col("mate_contig"))).alias("chimeric"),
        F.avg(F.when(aligned & (F.col("mapq") != MISSING_MAPQ), F.col("mapq"))).alias("mean_mapq"),
    )


def pair_orientation(reads: DataFrame) -> DataFrame:
    """The commonest orientation of mapped pairs on one contig; ties favour FR, then RF."""
    rev, mate = F.col("flags").bitwiseAND(F.lit(0x10)) != 0, F.col("flags").bitwiseAND(F.lit(0x20)) != 0
    left_forward = F.when(F.col("pos") <= F.col("mate_pos"), ~rev).otherwise(~mate)
    kind = F.when(rev == mate, "TANDEM").when(left_forward, "FR").otherwise("RF")
    counts = reads.where(F.col("contig") == F.col("mate_contig")).groupBy(kind.alias("orientation")).agg(F.count("*").alias("n"))
    rank = F.when(F.col("orientation") == "FR", 2).when(F.col("orientation") == "RF", 1).otherwise(0)
    return counts.agg(F.max_by("orientation", F.struct("n", rank)).alias("orientation"), F.max("n").alias("n"))


def insert_sizes(reads: DataFrame, limit: int = 10_000) -> DataFrame:
    """Histogram of template lengths of proper pairs, each pair once."""
    bits = F.col("flags").bitwiseAND(F.lit(0x42)) == 0x42
    n = F.abs("tlen")
    return reads.where(bits & (n > 0) & (n < limit)).groupBy(n.alias("insert_size")).agg(F.count("*").alias("n"))


def weighted_mean_depth(rows: DataFrame, depth: str = "depth", length: str = "length") -> DataFrame:
    return rows.agg((F.sum(F.col(depth) * F.col(length)) / F.sum(length)).alias("mean_depth"))
