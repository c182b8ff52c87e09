"""Running aggregates over long orders in two passes: totals of blocks, then each block from where the one before ended.

A window over a whole contig or table is one task. Here a key's order is cut into blocks; rows are ordered within a
block alone, each block is summed up in one row, the few sums are run over, and what a block begins with is joined back.
Rows move once, by key and block. Blocks come from positions (``position_block``: no extra pass) or, for orders without
a unit of length, from range partitions (``range_blocks``), which split a key that holds most of the rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.session import materialize

#: Positions in one block, unless said otherwise.
WIDTH = 1 << 16


class Running(NamedTuple):
    """One running value: its column's name, what is aggregated, how, and whether the row itself counts."""

    name: str
    value: Column
    kind: str  # sum, max, min or last (of values that aren't null)
    inclusive: bool = True


def position_block(position: Column, width: int = WIDTH) -> Column:
    return F.floor(position / width)


def range_blocks(rows: DataFrame, key: list[str], order: list[Column | str], block: str = "_block", parts: int | None = None) -> DataFrame:
    """``rows`` with the number of their range of (key, order): written, so that the numbers hold."""
    by = [*key, *order]
    placed = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    return materialize(placed.withColumn(block, F.spark_partition_id().cast("long")), "ranges")


def _combined(kind: str, carried: Column, own: Column) -> Column:
    if kind == "sum":
        return F.when(carried.isNull(), own).when(own.isNull(), carried).otherwise(carried + own)
    if kind == "last":
        return F.coalesce(own, carried)
    return (F.greatest if kind == "max" else F.least)(carried, own)


def running(rows: DataFrame, key: list[str], order: list[Column | str], wanted: list[Running], block: Column | str = "_block") -> DataFrame:
    """``rows`` with one column for each of ``wanted``, in ``order`` within ``key``; blocks ascend with the order.

    Rows that tie in ``order`` are taken in any order: the order should be one without ties, or ties not matter.
    """
    r = rows.withColumn("_b", F.col(block) if isinstance(block, str) else block)
    apply = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    inside = Window.partitionBy(*key, "_b").orderBy(*order)
    numbered = r.withColumn("_n", F.row_number().over(inside)) if any(w.kind == "last" for w in wanted) else r
    last = lambda w: F.max_by(w.value, F.when(w.value.isNotNull(), F.col("_n")))
    totals = numbered.groupBy(*key, "_b").agg(*((last(w) if w.kind == "last" else apply[w.kind](w.value)).alias(f"_t{k}") for k, w in enumerate(wanted)))
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), F.col("_b").alias("_kb"), *(apply[w.kind](F.col(f"_t{k}")).over(before).alias(f"_c{k}") for k, w in enumerate(wanted)))
    end = lambda w: 0 if w.inclusive else -1
    own = r.select("*", *(apply[w.kind](w.value).over(inside.rowsBetween(Window.unboundedPreceding, end(w))).alias(f"_o{k}") for k, w in enumerate(wanted)))
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)] + [F.col("_b").eqNullSafe(F.col("_kb"))]
    joined = own.join(carried, on)
    return joined.select(*(F.col(c) for c in rows.columns), *(_combined(w.kind, F.col(f"_c{k}"), F.col(f"_o{k}")).alias(w.name) for k, w in enumerate(wanted)))


def numbered(rows: DataFrame, key: list[str], order: list[Column | str], name: str = "place", parts: int | None = None) -> DataFrame:
    """``rows`` numbered from 1 by ``order`` within ``key`` (none: over the whole table), without one task for it all."""
    placed = range_blocks(rows, key, order, parts=parts)
    return running(placed, key, order, [Running(name, F.lit(1), "sum")]).drop("_block").withColumn(name, F.col(name).cast("int"))


def islands(rows: DataFrame, key: list[str], start: str, end: str, gap: int = 0, width: int = WIDTH) -> DataFrame:
    """``rows`` with ``_isle``, the first start of the run of intervals that overlap, touch or lie ``gap`` apart at most.

    The greatest end so far and the last beginning of a run are two scans over blocks of positions.
    """
    block = position_block(F.col(start), width)
    r = running(rows, key, [start, end], [Running("_reach", F.col(end), "max", inclusive=False)], block)
    head = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + gap), F.col(start))
    # Of equal rows the one that begins a run comes first again.
    order = [F.col(start), F.col(end), head.isNull()]
    return running(r.withColumn("_head", head), key, order, [Running("_isle", F.col("_head"), "max")], block).drop("_reach", "_head")
