"""Region access to intervals by hierarchical bins.

A bin is one of six levels of windows, from the whole sequence down to 16 kb; an interval lies in the smallest that holds
it, so it is stored once. A region touches few bins, and only intervals in those can overlap it: a join on equality, or
a short list of values that reaches the scan of a table written in the order of bins. Intervals that begin before a
region and reach into it are found as others are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First bin of a level and the bits of its windows, smallest windows first: fixed values of the binning scheme.
LEVELS = ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26), (0, 29))
#: Positions that the scheme covers.
LIMIT = 1 << 29


def bin_of(start: Column, end: Column) -> Column:
    """The bin of an interval, 1-based and closed at both ends; beyond ``LIMIT`` all share the topmost one."""
    a, b = start.cast("long") - 1, end.cast("long") - 1
    out = F.when((a < 0) | (b >= LIMIT), 0)
    for first, bits in LEVELS[:-1]:
        out = out.when(F.shiftright(a, bits) == F.shiftright(b, bits), F.shiftright(a, bits) + first)
    return out.otherwise(0).cast("int")


def bins_over(start: Column, end: Column) -> Column:
    """All bins that may hold an interval which overlaps this one, as an array."""
    a = F.least(F.greatest(start.cast("long") - 1, F.lit(0)), F.lit(LIMIT - 1))
    b = F.least(F.greatest(end.cast("long") - 1, F.lit(0)), F.lit(LIMIT - 1))
    each = [F.sequence(F.shiftright(a, bits) + first, F.shiftright(b, bits) + first) for first, bits in LEVELS[:-1]]
    return F.concat(F.array(F.lit(0).cast("long")), *each)


def overlaps(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    return (start <= hi) & (end >= lo)


def write_binned(rows: DataFrame, path: str, contig: str, start: str, end: str, bin_name: str = "bin") -> None:
    """A table by contig in the order of bins: a region's bins are few stretches of each file."""
    out = rows.withColumn(bin_name, bin_of(F.col(start), F.col(end)))
    out.repartitionByRange(contig, bin_name, start).sortWithinPartitions(contig, bin_name, start).write.partitionBy(contig).parquet(path)


def read_region(table: DataFrame, contig: str, start: str, end: str, where: tuple[str, int, int], bin_name: str = "bin") -> DataFrame:
    """Rows of a binned table that overlap a region: the contig's partition, the bins' row groups, then the rows."""
    name, lo, hi = where
    a, b = (min(max(x - 1, 0), LIMIT - 1) for x in (lo, hi))
    spans = [F.col(bin_name).between((a >> bits) + first, (b >> bits) + first) for first, bits in LEVELS[:-1]]
    may = F.col(bin_name) == 0
    for s in spans:
        may = may | s
    return table.where((F.col(contig) == name) & may & overlaps(F.col(start), F.col(end), F.lit(lo), F.lit(hi)))


#: Bits of the windows that rows and regions meet in, by a row's length, smallest first.
WINDOWS = (13, 16, 18, 20, 22, 25, 28, 32, 38, 46, 62)


def _touched(start: Column, end: Column, bits: int) -> Column:
    """The windows of one size that an interval touches, as (bits, at)."""
    a, b = F.least(start, end), F.greatest(start, end)
    return F.transform(F.sequence(F.shiftright(a, bits), F.shiftright(b, bits)), lambda at: F.struct(F.lit(bits).alias("bits"), at.alias("at")))


def rows_in_regions(rows: DataFrame, regions: DataFrame, contig: str, start: str, end: str) -> DataFrame:
    """Every row with every region that it overlaps, each pair once. ``regions``: contig, region, lo, hi.

    A row lies in windows about as long as itself, two at most; a region in all that it touches, of every size. They meet
    in the window of the later beginning alone, wherever on a contig that is. A region is many rows there, far more than
    its table's size tells: they are dealt by window, and never sent whole.
    """
    s, e, lo, hi = (F.col(c).cast("long") for c in (start, end, "lo", "hi"))
    size = F.abs(e - s)
    own = F.when(size < 1 << WINDOWS[0], _touched(s, e, WINDOWS[0]))
    for bits in WINDOWS[1:-1]:
        own = own.when(size < 1 << bits, _touched(s, e, bits))
    own = own.otherwise(_touched(s, e, WINDOWS[-1]))
    met = lambda d, windows: d.withColumn("_w", F.explode(windows)).select("*", F.col("_w.bits").alias("_bits"), F.col("_w.at").alias("_at")).drop("_w")
    x = met(rows, own).alias("x")
    y = met(regions, F.concat(*(_touched(lo, hi, bits) for bits in WINDOWS))).alias("y")
    a, b = F.col(f"x.{start}"), F.col(f"x.{end}")
    late = F.expr(f"shiftright(greatest(cast(x.`{start}` as bigint), cast(y.lo as bigint)), x._bits) = x._at")
    on = [F.col(f"x.{contig}") == F.col("y.contig"), F.col("x._bits") == F.col("y._bits"), F.col("x._at") == F.col("y._at"), overlaps(a, b, F.col("y.lo"), F.col("y.hi")), late]
    return x.join(y.hint("merge"), on).select(*(F.col(f"x.{c}") for c in rows.columns), "y.region", "y.lo", "y.hi")


def reference_length(cigar: Column) -> Column:
    """Reference bases that an alignment covers; an empty one counts as one base."""
    sizes = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.greatest(F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")), F.lit(1).cast("long"))
