"""Ordered funnel counting by monotone pointers over secondary-sorted partitions.

1. Cut. A step is reached within ``within`` of the one before, so an attempt ends a known time after its start. Each
   client's rows are cut into blocks of time, with those that attempts begun in the block can still reach; a client with
   a third of all rows is spread over all its blocks. (client, block) is the partition key, time the secondary sort key.
2. Merge. One pass over a sorted partition counts, for every row, the rows of each kind up to it: these counts are the
   pointers into the kinds' streams. Starts ascend, so each step's pointer only advances; excluded kinds are two counts'
   difference. Groups are laid end to end on one time axis, further apart than a step may take.
3. Spill. Attempts leave as (funnel, client, step, time, number) and are summed by Spark, written, and ranked there: by
   the times' upper bits first, then by the lower bits of the one bucket that holds the rank, so that no task orders more
   than 2^15 rows of a client.

Edge cases: rows with a null client, kind or time count nowhere; repeated rows are one; rows of equal time are never each
other's next step; clients without a first step have no row; extra columns of any name are left out; an empty table gives
an empty table. A block of one client is one group of rows: some megabytes where a client has gigabytes in a year.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.words import tidied
from helixframe.session import ensure_importable, materialize, settled


class Funnel(NamedTuple):
    name: str
    steps: tuple[str, ...]
    excluded: str


FUNNELS = (
    Funnel("A", ("view", "click", "view", "purchase"), "error"),
    Funnel("B", ("signup", "view", "click", "purchase"), "error"),
    Funnel("C", ("click", "click", "purchase", "view"), "signup"),
)
#: Microseconds that a step may take, and that a block spans.
WITHIN = 15 * 60 * 1_000_000
BLOCK = 3 * 3600 * 1_000_000
PERCENT = 50
#: Bits of a time that the second ranking looks at.
LOW_BITS = 15
#: Rows that one pass over whole groups takes at least.
LEAST_ROWS = 1 << 17


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def blocks(df: DataFrame, client: str, kind: str, ts: str, kinds: tuple[str, ...], reach: int, block: int) -> DataFrame:
    """(c, b, t, k): every distinct row in each block whose attempts may reach it, sorted within partitions."""
    code = F.coalesce(*(F.when(F.col(kind) == x, F.lit(i)) for i, x in enumerate(kinds))).cast("byte")
    rows = df.where(F.col(kind).isin(*kinds) & F.col(client).isNotNull() & F.col(ts).isNotNull())
    rows = rows.select(F.col(client).alias("c"), micros(f"`{ts}`").alias("t"), code.alias("k")).distinct()
    first, last = (F.expr(f"({x} - pmod({x}, {block}L)) div {block}L") for x in (f"(t - {reach}L)", "t"))
    placed = rows.withColumn("b", F.explode(F.sequence(first, last)))
    return placed.select("c", "b", "t", "k").repartition("c", "b").sortWithinPartitions("c", "b", "t", "k")


def group_heads(batch: pa.Table) -> np.ndarray:
    """True at the first row of each run of one client and block; the first row is one."""
    c, b = batch.column("c").combine_chunks(), batch.column("b").to_numpy()
    head = np.ones(len(b), bool)
    if len(b) > 1:
        other = pa.compute.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        head[1:] = other | (b[1:] != b[:-1])
    return head


class Streams:
    """The kinds' streams of whole groups, and for every row how far each stream has come."""

    def __init__(self, time: np.ndarray, kind: np.ndarray, n_kinds: int):
        self.time = time
        last = np.flatnonzero(np.concatenate((time[1:] != time[:-1], [True])))
        tied = np.repeat(last, np.diff(np.concatenate(([-1], last))))  # the last row of the same time
        self.rows = [np.flatnonzero(kind == k) for k in range(n_kinds)]
        self.seen = [np.cumsum(kind == k)[tied] for k in range(n_kinds)]

    def advance(self, at: np.ndarray, kind: int, excluded: int, within: int) -> tuple[np.ndarray, np.ndarray]:
        """(reached, row of the next step) of attempts that stand at the rows ``at``."""
        pointer, stream = self.seen[kind][at], self.rows[kind]
        reached = pointer < len(stream)
        to = stream[np.minimum(pointer, len(stream) - 1)] if len(stream) else np.zeros(len(at), np.int64)
        reached &= self.time[to] - self.time[at] <= within
        reached &= self.seen[excluded][to] == self.seen[excluded][at]
        return reached, to


_ATTEMPTS = "funnel byte, c {client}, step int, took long, n long"


def _merge(funnels: tuple[Funnel, ...], kinds: tuple[str, ...], within: int, reach: int, block: int):
    span = block + reach + within + 1
    code = {x: i for i, x in enumerate(kinds)}

    def attempts(rows: pa.Table, head: np.ndarray) -> Iterator[pa.RecordBatch]:
        t, b, k = (rows.column(x).to_numpy() for x in ("t", "b", "k"))
        client = rows.column("c").combine_chunks()
        place = t - b * block
        streams = Streams(place + (np.cumsum(head) - 1) * span, k, len(kinds))
        turn = np.zeros(len(t), bool)
        turn[1:] = pa.compute.not_equal(client.slice(1), client.slice(0, len(client) - 1)).to_numpy(zero_copy_only=False)
        run = np.cumsum(turn)
        lead = np.concatenate(([0], np.flatnonzero(turn)))
        for f, (_, steps, excluded) in enumerate(funnels):
            at = streams.rows[code[steps[0]]]
            at = at[place[at] < block]  # those past the block start in the next one
            found = [(1, *np.unique(run[at], return_counts=True), None)]
            whose = run[at]
            for step, kind in enumerate(steps[1:], 2):
                reached, to = streams.advance(at, code[kind], code[excluded], within)
                took, whose, at = (streams.time[to] - streams.time[at])[reached], whose[reached], to[reached]
                pairs, count = np.unique(whose * (within + 1) + took, return_counts=True)
                found.append((step, pairs // (within + 1), count, pairs % (within + 1)))
            for step, who, count, took in found:
                if len(who):
                    times = pa.nulls(len(who), pa.int64()) if took is None else pa.array(took, pa.int64())
                    same = [pa.array(np.full(len(who), x, t)) for x, t in ((f, np.int8), (step, np.int32))]
                    columns = [same[0], client.take(pa.array(lead[who])), same[1], times, pa.array(count)]
                    yield pa.RecordBatch.from_arrays(columns, names=["funnel", "c", "step", "took", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < LEAST_ROWS:
                continue
            # A group may go on in the next batch: rows before the last head are whole groups.
            tail = pa.Table.from_batches(([held[-2].slice(held[-2].num_rows - 1)] if len(held) > 1 else []) + [batch])
            heads = np.flatnonzero(group_heads(tail)[1:]) + 1 - (len(held) > 1)
            if not len(heads):
                continue
            cut = int(heads[-1])
            ready = pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            yield from attempts(ready, group_heads(ready))
            held = [batch.slice(cut)]
        if held:
            ready = pa.Table.from_batches(held)
            yield from attempts(ready, group_heads(ready))

    return run


def ranked(attempts: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """``keys`` with ``took``: the ceil(percent * n / 100)-th smallest of the key's n times, by two rounds of counts."""
    times = attempts.where(F.col("took").isNotNull()).withColumn("high", F.shiftright("took", LOW_BITS))
    sums = times.groupBy(*keys, "high").agg(F.sum("n").alias("n"))
    running = Window.partitionBy(*keys).orderBy("high").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("n").over(running)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    rank = F.expr(f"({percent}L * total + 99) div 100")
    inside = sums.withColumn("rank", rank).where("rank > upto - n and rank <= upto")
    inside = inside.select(*keys, "high", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    # A bucket of one key has 2^15 different times at most.
    near = times.join(inside, [*keys, "high"])
    upto = F.sum("n").over(Window.partitionBy(*keys, "high").orderBy("took").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("upto", upto).where("rank > upto - n and rank <= upto")
    return near.select(*keys, "took")


@settled("funnels")
def count_funnels(
    df: DataFrame,
    client: str = "client_id",
    kind: str = "kind",
    ts: str = "ts",
    funnels: tuple[Funnel, ...] = FUNNELS,
    within: int = WITHIN,
    block: int = BLOCK,
    percent: int = PERCENT,
) -> DataFrame:
    """Per funnel and client with attempts: funnel, client, n1.., deepest, t2.., same_depth."""
    ensure_importable(df.sparkSession)
    kinds = tuple(sorted({x for f in funnels for x in (*f.steps, f.excluded)}))
    most = max(len(f.steps) for f in funnels)
    reach = within * (most - 1)
    if block <= 0 or within < 0:
        raise ValueError("a block spans some time, and a step takes none or some")
    placed = blocks(df, client, kind, ts, kinds, reach, block)
    schema = _ATTEMPTS.format(client=dict(placed.dtypes)["c"])
    each = placed.mapInArrow(tidied(_merge(funnels, kinds, within, reach, block)), schema)
    each = materialize(each.groupBy("funnel", "c", "step", "took").agg(F.sum("n").alias("n")), "attempts")

    reached = [F.coalesce(F.sum(F.when(F.col("step") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(1, most + 1)]
    counts = materialize(each.groupBy("funnel", "c").agg(*reached, F.max("step").alias("deepest")), "reached")
    times = [F.max(F.when(F.col("step") == k, F.col("took"))).alias(f"t{k}") for k in range(2, most + 1)]
    middle = ranked(each, ["funnel", "c", "step"], percent).groupBy("funnel", "c").agg(*times)
    # One row a funnel and depth.
    depths = counts.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))
    out = counts.join(middle, ["funnel", "c"], "left").join(F.broadcast(depths), ["funnel", "deepest"])
    name = F.element_at(F.array(*(F.lit(f.name) for f in funnels)), F.col("funnel").cast("int") + 1)
    steps = range(1, most + 1)
    return out.select(name.alias("funnel"), F.col("c").alias(client), *(f"n{k}" for k in steps), "deepest", *(f"t{k}" for k in steps[1:]), "same_depth")
