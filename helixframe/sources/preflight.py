"""What a table's columns hold, from sketches that are made once a part and merged at will.

For each part (a file's day, a run, a folder) one row of sketches is kept: quantiles (KLL), distinct values (HLL), counts
and bounds. Any set of parts is described by merging their rows, without reading the data again; so is a table that
grows, by the rows of its new parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Log2 of the registers of a distinct sketch and the size of a quantile sketch: relative error near 1.04 / 2^(k/2) and
#: rank error near 2.3 / k^0.9.
DISTINCT_K, QUANTILE_K = 12, 400


def part_sketches(df: DataFrame, parts: list[str], numbers: list[str], keys: list[str]) -> DataFrame:
    """One row a part: rows, and for each column nulls, and sketches of its quantiles (``numbers``) or distinct values."""
    wanted = [F.count("*").alias("rows")]
    for c in numbers:
        x = F.col(c).cast("double")
        wanted += [F.count_if(x.isNull()).alias(f"{c}__nulls"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"), F.kll_sketch_agg_double(x, QUANTILE_K).alias(f"{c}__kll")]
    for c in keys:
        wanted += [F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), F.hll_sketch_agg(F.col(c).cast("string"), DISTINCT_K).alias(f"{c}__hll")]
    return df.groupBy(*parts).agg(*wanted)


def merged(sketches: DataFrame, by: list[str], numbers: list[str], keys: list[str], shares: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Sketches of parts, merged by ``by``: rows, nulls, bounds, quantiles and numbers of distinct values."""
    wanted: list[Column] = [F.sum("rows").alias("rows")]
    for c in numbers:
        q = F.kll_sketch_get_quantile_double(F.kll_merge_agg_double(f"{c}__kll"), F.array(*map(F.lit, shares)))
        wanted += [F.sum(f"{c}__nulls").alias(f"{c}_nulls"), F.min(f"{c}__min").alias(f"{c}_min"), F.max(f"{c}__max").alias(f"{c}_max"), q.alias(f"{c}_quantiles")]
    for c in keys:
        wanted += [F.sum(f"{c}__nulls").alias(f"{c}_nulls"), F.hll_sketch_estimate(F.hll_union_agg(f"{c}__hll")).alias(f"{c}_distinct")]
    return sketches.groupBy(*by).agg(*wanted)
