"""Structural variants and short tandem repeats: evidence, clusters, calls and genotypes."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stutter model: share of exact repeats, the geometric decay of longer slips, and the least depth: fixed values.
NO_STUTTER, DECAY, MIN_DEPTH = 0.9, 0.5, 5


def discordant(reads: DataFrame, mean: Column, sd: Column, times: float = 4.0) -> DataFrame:
    """Mapped pairs with the first reason that applies: other contig, odd insert size, wrong orientation."""
    bit = lambda b: F.col("flags").bitwiseAND(F.lit(b)) != 0
    pair = bit(0x1) & ~bit(0x4) & ~bit(0x8) & ~bit(0x100) & ~bit(0x800)
    left = F.col("pos") <= F.col("mate_pos")
    forward_first = F.when(left, ~bit(0x10) & bit(0x20)).otherwise(bit(0x10) & ~bit(0x20))
    why = F.when(F.col("contig") != F.col("mate_contig"), "InterChromosomal").when(F.abs(F.abs("tlen") - mean) > times * sd, "InsertSizeOutlier").when(~forward_first, "WrongOrientation")
    return reads.where(pair).withColumn("reason", why).where("reason is not null")


def split_reads(reads: DataFrame, min_clip: int = 10) -> DataFrame:
    """One row per supplementary placement of a clipped read: from where to where."""
    clip = F.greatest(F.regexp_extract("cigar", r"^(\d+)[SH]", 1).try_cast("int"), F.regexp_extract("cigar", r"(\d+)[SH]$", 1).try_cast("int"))
    s = reads.where(F.col("sa").isNotNull() & (clip >= min_clip)).withColumn("_sa", F.explode(F.filter(F.split("sa", ";"), lambda x: x != "")))
    p = F.split("_sa", ",")
    return s.select("name", "contig", "pos", p[0].alias("to_contig"), p[1].cast("long").alias("to_pos"), p[2].alias("to_strand"), p[4].cast("int").alias("to_mapq"))


def call_quality(support: Column, mapq: Column) -> Column:
    return F.least(5 * support + 0.5 * mapq, F.lit(99.0))


def segment_calls(segments: DataFrame, bin_size: int) -> DataFrame:
    """Depth segments as calls: quality, interval of confidence, zygosity and signed length."""
    z, l2 = F.abs("mean_z"), F.col("log2")
    gt = F.when((l2 < -0.9) | (l2 > 0.7), "1/1").otherwise("0/1")
    n = F.col("end") - F.col("start")
    return segments.withColumn("quality", F.least(10 * z, F.lit(99.0))).withColumn("ci", F.lit(max(bin_size // 2, 100))).withColumn("gt", gt).withColumn("length", F.when(F.col("kind") == "DEL", -n).otherwise(n))


def merge_evidence(a: DataFrame, b: DataFrame, width: int = 10_000) -> DataFrame:
    """Each call of ``a`` (id, contig, kind, start, end) with the first overlapping call of ``b`` not taken by an earlier one.

    Calls that touch are one stretch, found by scans over blocks of positions; a choice in one stretch can't change
    another. A task runs over its stretches in the order of starts, both sides together: what waits is either calls of
    ``a`` that no call of ``b`` has met yet, or calls of ``b`` that none of ``a`` has, never both. No pair is listed and
    no stretch handled apart: the work is in proportion to the calls, however many of them overlap or stand alone.
    """
    from helixframe.operators.scan import islands

    ids = [dict(x.dtypes)["id"] for x in (a, b)]
    none = F.lit(None)
    x = a.select("contig", "kind", "start", "end", F.col("id").alias("a_id"), none.cast(ids[1]).alias("b_id"), F.lit(True).alias("_a"))
    y = b.select("contig", "kind", "start", "end", none.cast(ids[0]).alias("a_id"), F.col("id").alias("b_id"), F.lit(False).alias("_a"))
    rows = islands(x.unionByName(y).where("start <= end"), ["contig", "kind"], "start", "end", 0, width)
    stretch = ["contig", "kind", "_isle"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine, other, done, used = None, deque(), deque(), set(), set()
        for batch in batches:
            found = []
            for *own, start, end, i, j, left in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    key, mine, other, done, used = own, deque(), deque(), set(), set()
                if left:
                    if i in done:
                        continue
                    while other and (other[0][0] < start or other[0][1] in used):
                        other.popleft()
                    if not other:
                        mine.append((end, i))
                        continue
                    j = other.popleft()[1]
                else:
                    if j in used:
                        continue
                    while mine and (mine[0][0] < start or mine[0][1] in done):
                        mine.popleft()
                    if not mine:
                        other.append((end, j))
                        continue
                    i = mine.popleft()[1]
                done.add(i)
                used.add(j)
                found.append((i, j))
            kinds = (batch.schema.field(c).type for c in ("a_id", "b_id"))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=["a_id", "b_id"])

    order = [*stretch, "start", F.asc_nulls_last("a_id"), F.asc_nulls_last("b_id")]
    placed = rows.select(*stretch, "start", "end", "a_id", "b_id", "_a").repartition(*stretch).sortWithinPartitions(*order)
    return placed.mapInArrow(run, "a_id {}, b_id {}".format(*ids))


def stutter_loglik(observed: Column, allele: Column, no_stutter: float = NO_STUTTER, decay: float = DECAY) -> Column:
    """log P(observed copies | allele): slips are as likely up as down and fall off geometrically."""
    d = F.abs(observed - allele)
    slip = (1 - no_stutter) * 0.5 * (1 - decay) * F.pow(F.lit(decay), d - 1)
    return F.when(d == 0, F.log(F.lit(no_stutter))).otherwise(F.log(F.greatest(slip, F.lit(1e-12))))


def str_haploid(obs: DataFrame, by: list[str], copies: str, min_depth: int = MIN_DEPTH) -> DataFrame:
    """Likeliest copy number of each locus; ties go to the larger."""
    n = obs.groupBy(*by, F.col(copies).alias("o")).agg(F.count("*").alias("n"))
    cand = n.select(*by, F.col("o").alias("allele"))
    s = cand.join(n, by).groupBy(*by, "allele").agg(F.sum(F.col("n") * stutter_loglik(F.col("o"), F.col("allele"))).alias("ll"), F.sum("n").alias("depth")).where(F.col("depth") >= min_depth)
    w = Window.partitionBy(*by).orderBy(F.desc(F.floor(F.col("ll") * 1e6 + 0.5)), F.desc("allele"))
    return s.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, "allele", "depth")


def str_diploid(obs: DataFrame, by: list[str], copies: str, min_depth: int = MIN_DEPTH) -> DataFrame:
    """Likeliest pair of copy numbers, each read coming from either with equal chance; ties to the smaller pair."""
    n = obs.groupBy(*by, F.col(copies).alias("o")).agg(F.count("*").alias("n"))
    a, b = n.select(*by, F.col("o").alias("a")), n.select(*by, F.col("o").alias("b"))
    pairs = a.join(b, by).where("a <= b")
    mix = 0.5 * F.exp(stutter_loglik(F.col("o"), F.col("a"))) + 0.5 * F.exp(stutter_loglik(F.col("o"), F.col("b")))
    s = pairs.join(n, by).groupBy(*by, "a", "b").agg(F.sum(F.col("n") * F.log(F.greatest(mix, F.lit(1e-12)))).alias("ll"), F.sum("n").alias("depth")).where(F.col("depth") >= min_depth)
    w = Window.partitionBy(*by).orderBy(F.desc(F.floor(F.col("ll") * 1e6 + 0.5)), "a", "b")
    return s.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, "a", "b", "depth")


def spanning_copies(bases: DataFrame, loci: DataFrame, flank: int = 5) -> DataFrame:
    """(name, locus, copies) of reads that cover a locus and both flanks: aligned query length over the period.

    ``bases`` are rows of ``aligned_bases``; ``loci``: contig, locus, start, end, period. A locus is as long in the
    read as the query distance between its flanks; a flank with a missing base rejects the read.
    """
    lo, hi = F.col("start") - flank, F.col("end") + flank
    from helixframe.operators.intervals import point_in_interval

    wide = loci.withColumn("_lo", lo).withColumn("_hi", hi)
    j = point_in_interval(bases.select("name", "contig", "ref_pos", "query_index"), wide, ["contig"], "ref_pos", "_lo", "_hi", 256)
    left = F.col("ref_pos") < F.col("start")
    right = F.col("ref_pos") > F.col("end")
    g = j.groupBy("name", "locus", "period").agg(F.count_if(left).alias("l"), F.count_if(right).alias("r"), F.max(F.when(left, F.col("query_index"))).alias("q0"), F.min(F.when(right, F.col("query_index"))).alias("q1"))
    return g.where((F.col("l") == flank) & (F.col("r") == flank)).select("name", "locus", F.floor((F.col("q1") - F.col("q0") - 1) / F.col("period")).cast("int").alias("copies"))


def revert(reads: DataFrame) -> DataFrame:
    """Reads as they came off the machine: primary, named, with sequence, not hard-clipped, in original orientation."""
    from helixframe.functions.genotype import reverse_complement

    ok = (F.col("flags").bitwiseAND(F.lit(0x900)) == 0) & F.col("seq").isNotNull() & F.col("name").isNotNull() & ~F.coalesce(F.col("cigar"), F.lit("")).contains("H")
    rev = F.col("flags").bitwiseAND(F.lit(0x10)) != 0
    q = F.coalesce("quals", F.repeat(F.lit("I"), F.length("seq")))
    return reads.where(ok).withColumn("quals", F.when(rev, F.reverse(q)).otherwise(q)).withColumn("seq", F.when(rev, reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
