"""Interval joins, merges, islands and as-of interpolation, without nested loops.

Range joins go through bins: both sides are expanded to the bins they touch and joined on equality, so the join
shuffles by (key, bin) and no side has to be small. ``width`` should be near the usual interval length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.scan import WIDTH, islands
from helixframe.session import materialize

#: Intervals of a bin that are met at once.
MOST = 100_000


def point_in_interval(points: DataFrame, intervals: DataFrame, key: list[str], pos: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Points with every closed interval that holds them; ``how``: inner, left, left_semi or left_anti."""
    p = points.withColumn("_bin", F.floor(F.col(pos) / width))
    i = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    held = F.col(f"p.{pos}").between(F.col(f"i.{start}"), F.col(f"i.{end}"))
    on = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in [*key, "_bin"]] + [held]
    j = p.alias("p").join(i.alias("i"), on, how)
    if how in ("left_semi", "left_anti"):
        return j.drop("_bin")
    rest = [F.col(f"i.{c}") for c in intervals.columns if c not in key]
    return j.select(*(F.col(f"p.{c}") for c in points.columns), *rest)


def point_in_many(points: DataFrame, intervals: DataFrame, key: list[str], pos: str, start: str, end: str, width: int, most: int = MOST) -> DataFrame:
    """As the inner ``point_in_interval``, where very many intervals may share a bin: those are dealt to parts of ``most``
    or so, and the bin's points meet each part. Such bins are as few as the intervals allow."""
    i = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    hot = i.groupBy(*key, "_bin").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    hot = F.broadcast(materialize(hot.select(*key, "_bin", F.ceil(F.col("_n") / most).alias("_parts")), "hot-bins"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = i.join(hot, [*key, "_bin"], "left").withColumn("_part", F.pmod(F.xxhash64(*intervals.columns), parts)).drop("_parts")
    p = points.withColumn("_bin", F.floor(F.col(pos) / width)).join(hot, [*key, "_bin"], "left")
    p = p.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    found = p.join(dealt, [*key, "_bin", "_part"]).where(F.col(pos).between(F.col(start), F.col(end)))
    return found.select(*points.columns, *(c for c in intervals.columns if c not in key))


def overlapping_pairs(a: DataFrame, b: DataFrame, key: list[str], start: str, end: str, width: int) -> DataFrame:
    """Pairs of closed intervals that overlap, each once: it is taken in the bin of the later start."""
    bins = lambda d: d.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    x, y = bins(a).alias("x"), bins(b).alias("y")
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in [*key, "_bin"]]
    late = F.greatest(F.col(f"x.{start}"), F.col(f"y.{start}"))
    j = x.join(y, [*on, late <= F.least(F.col(f"x.{end}"), F.col(f"y.{end}")), F.floor(late / width) == F.col("x._bin")])
    return j.select(*(F.col(f"x.{k}").alias(k) for k in key), *(F.col(f"x.{c}").alias(f"a_{c}") for c in a.columns if c not in key), *(F.col(f"y.{c}").alias(f"b_{c}") for c in b.columns if c not in key))


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2) + 1, F.lit(0))


def merge_intervals(rows: DataFrame, key: list[str], start: str, end: str, gap: int = 0, width: int = WIDTH) -> DataFrame:
    """Union of intervals that overlap, touch or lie at most ``gap`` apart, by blocks of ``width`` positions."""
    r = islands(rows.where(F.col(start).isNotNull()), key, start, end, gap, width)
    return r.groupBy(*key, "_isle").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("_isle")


def covered_length(merged: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    return merged.groupBy(*key).agg(F.sum(F.col(end) - F.col(start)).alias("covered"))


def merge_nearby(rows: DataFrame, key: list[str], start: str, end: str, gap: int, weight: str, values: list[str]) -> DataFrame:
    """Segments of one key at most ``gap`` apart become one, values averaged by weight."""
    r = islands(rows.where(F.col(start).isNotNull()), key, start, end, gap)
    means = [(F.sum(F.col(v) * F.col(weight)) / F.sum(weight)).alias(v) for v in values]
    return r.groupBy(*key, "_isle").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum(weight).alias(weight), *means).drop("_isle")


def isolated(rows: DataFrame, key: list[str], pos: str, distance: int) -> DataFrame:
    """Rows with no neighbour within ``distance`` on either side."""
    w = Window.partitionBy(*key).orderBy(pos)
    far = lambda x: x.isNull() | (x > distance)
    return rows.withColumn("_l", F.col(pos) - F.lag(pos).over(w)).withColumn("_r", F.lead(pos).over(w) - F.col(pos)).where(far(F.col("_l")) & far(F.col("_r"))).drop("_l", "_r")


def interpolate(points: DataFrame, curve: DataFrame, key: list[str], x: str, cx: str, cy: str, out: str) -> DataFrame:
    """Value of a piecewise linear curve at each point: an as-of join with the marker on either side.

    Outside the curve the rate of the nearest segment goes on; a curve of one marker is constant. Points and markers
    are brought together by one union and two windows over each key's order.
    """
    marks = curve.select(*key, F.col(cx).alias("_x"), F.struct(F.col(cx).alias("x"), F.col(cy).alias("y")).alias("_m"), F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("_p"))
    w = Window.partitionBy(*key).orderBy("x")
    rates = curve.select(*key, F.col(cx).alias("x"), F.col(cy).alias("y"))
    ends = rates.withColumn("n", F.lead(F.struct("x", "y")).over(w)).where("n is not null").groupBy(*key).agg(F.min_by(F.struct("x", "y", "n"), "x").alias("_first"), F.max_by(F.struct("x", "y", "n"), "x").alias("_last"))
    both = points.select(*key, F.col(x).alias("_x"), F.lit(None).cast(marks.schema["_m"].dataType).alias("_m"), F.struct(*points.columns).alias("_p")).unionByName(marks)
    at = Window.partitionBy(*key).orderBy(F.col("_x"), F.col("_m").isNull())
    back = Window.partitionBy(*key).orderBy(F.col("_x").desc(), F.col("_m").isNull())
    lo = F.last("_m", ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, 0))
    hi = F.last("_m", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    r = both.withColumn("_lo", lo).withColumn("_hi", hi).where("_p is not null").join(ends, key, "left")
    line = lambda a, b: a["y"] + (F.col("_x") - a["x"]) * (b["y"] - a["y"]) / (b["x"] - a["x"])
    inside = F.when(F.col("_lo.x") == F.col("_hi.x"), F.col("_lo.y")).otherwise(line(F.col("_lo"), F.col("_hi")))
    f, g = F.col("_first"), F.col("_last")
    value = F.when(F.col("_lo").isNotNull() & F.col("_hi").isNotNull(), inside).when(f.isNull(), F.coalesce("_lo.y", "_hi.y")).when(F.col("_lo").isNull(), line(f, f["n"])).otherwise(line(g, g["n"]))
    return r.select("_p.*", value.alias(out))


def sliding_share(rows: DataFrame, key: list[str], order: list[str], value: str, before: int, after: int, out: str) -> DataFrame:
    """Average of a value over so many rows on either side, clipped at the ends."""
    return rows.withColumn(out, F.avg(value).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(-before, after)))


def first_of_signature(rows: DataFrame, signature: list[str], order: list[str]) -> DataFrame:
    """Rows with whether an earlier one has the same signature: duplicates."""
    r = F.row_number().over(Window.partitionBy(*signature).orderBy(*order))
    return rows.withColumn("duplicate", r > 1)


def expected_depth_z(counts: DataFrame, key: list[str], n: str) -> DataFrame:
    """Deviation of each bin's count from its group's mean, in Poisson standard deviations."""
    e = F.avg(n).over(Window.partitionBy(*key))
    return counts.withColumn("expected", e).withColumn("z", (F.col(n) - F.col("expected")) / F.sqrt(F.greatest(F.col("expected"), F.lit(1.0))))


def base_overlap(called: DataFrame, truth: DataFrame, key: list[str], width: int) -> DataFrame:
    """(key, called, truth, shared, sensitivity, precision) in bases, of closed intervals merged beforehand."""
    length = F.sum(F.col("end") - F.col("start") + 1)
    a, b = (merge_intervals(x, key, "start", "end").drop("parts") for x in (called, truth))
    pairs = overlapping_pairs(a, b, key, "start", "end", width)
    shared = pairs.groupBy(*key).agg(F.sum(overlap_length(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))).alias("shared"))
    j = a.groupBy(*key).agg(length.alias("called")).join(b.groupBy(*key).agg(length.alias("truth")), key, "full_outer").join(shared, key, "left").na.fill(0, ["called", "truth", "shared"])
    share = lambda whole: F.when(F.col(whole) > 0, F.col("shared") / F.col(whole))
    return j.withColumn("sensitivity", share("truth")).withColumn("precision", share("called"))


#: Bases at either end of a chromosome that count as its telomeres: a fixed value.
TELOMERE = 10_000


def annotate_bands(points: DataFrame, bands: DataFrame, chrom: str, pos: str = "pos", width: int = 1 << 16) -> DataFrame:
    """1-based points with their band, and whether they lie in the centromere (all acen bands) or a telomere.

    ``bands``: chrom, start, end (half open, from 0), band, acen.
    """
    whole = bands.groupBy(chrom).agg(F.max("end").alias("_len"), F.min(F.when(F.col("acen"), F.col("start"))).alias("_cs"), F.max(F.when(F.col("acen"), F.col("end"))).alias("_ce"))
    p = points.withColumn("_z", F.col(pos) - 1)
    j = point_in_interval(p, bands.select(chrom, F.col("start").alias("_s"), (F.col("end") - 1).alias("_e"), "band"), [chrom], "_z", "_s", "_e", width, "left").drop("_s", "_e")
    j = j.join(whole, chrom)
    z = F.col("_z")
    return j.withColumn("in_centromere", F.coalesce((z >= F.col("_cs")) & (z < F.col("_ce")), F.lit(False))).withColumn("in_telomere", (z < TELOMERE) | (z >= F.col("_len") - TELOMERE)).drop("_z", "_len", "_cs", "_ce")
