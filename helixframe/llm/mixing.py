"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). A small graph routes words:
pattern -> (first copy at cost 0, second copy at cost 1) -> sources -> quota. Successive shortest paths give the
cheapest routing, so repetition is used only where a quota can't be met otherwise. Then each pattern takes every
document a whole number of times plus a seeded subset once more: those up to a cut in the order of a hash, and a few
that fill what is still missing. Reruns agree.

Edge cases: a null text has size 0; texts of any length count whole; extra columns of any name pass through; a null source
is a source of its own and sorts last; repeated rows are rows, each with a place of its own in the order, so that a mix
takes as many of them as fit; an empty table gives an empty table.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.words import chunks, table_nonspace, utf8, word_spans
from helixframe.session import ensure_importable, materialize, settled

SHARE = 1.5
MOST_COPIES = 2
WEIGHTS = (3, 1, 2)
SEED = 20240
#: Bits of a document's place in the seeded order, those of them that tell equal rows apart, and bits of one round.
PLACE_BITS, OWN_BITS, STEP_BITS = 60, 24, 12
#: Rows of patterns, cuts or fills that are sent to all executors; more are joined by shuffle.
BROADCAST_ROWS = 50_000
#: Documents that may fill a pattern's gap after the cut.
FILL_ROUNDS = 5
#: Patterns of overlapping sources that the flow is solved for on the driver; more are refused, never dropped.
MAX_PATTERNS = 20_000


class Plan(NamedTuple):
    """What decides every document's copies: one small row a membership pattern, and the documents that fill gaps."""

    patterns: DataFrame
    fills: DataFrame


def _words(column: Column) -> Column:
    """Number of whitespace-separated words, whole texts, null counts 0."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        data, offs = utf8(texts)
        n = [np.diff(word_spans(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], table_nonspace())[2]) for i, j in chunks(offs)]
        return pa.array(np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64))

    return count(column)


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> list[float]:
    """Quota of each source: by weight, none above ``most`` times its size, the excess shared again by weight."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    total, capped = share * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in capped)
        unit = left / sum(w[i] for i in free) if free else 0.0
        over = [i for i in free if unit * w[i] > most * sizes[i]]
        if not over:
            return [most * sizes[i] if i in capped else unit * w[i] for i in range(len(sizes))]
        capped.update(over)


def min_cost_flow(supply: list[float], members: list[list[int]], quota: list[float], copies: int = MOST_COPIES) -> dict[tuple[int, int], float]:
    """Words sent from pattern p to source s: as much as possible, least repetition first.

    Every copy after the first costs one unit more than the one before, a convex cost. Paths of equal cost are
    augmented together level by level; within a level, residual edges let later paths reroute earlier ones.
    """
    flow = {(p, s): 0.0 for p, ms in enumerate(members) for s in ms}
    by_source: dict[int, list[int]] = {}
    for p, s in flow:
        by_source.setdefault(s, []).append(p)
    need = list(quota)
    eps = 1e-9 * (1 + sum(quota))
    for _ in range(copies):
        left = list(supply)
        while True:
            # Breadth first from patterns with capacity at this level to a source with need, over residual edges.
            came: dict[tuple[str, int], tuple[str, int] | None] = {("p", p): None for p, x in enumerate(left) if x > eps}
            queue, end = list(came), None
            for kind, v in queue:
                if kind == "p":
                    for s in members[v]:
                        if ("s", s) not in came:
                            came["s", s] = (kind, v)
                            if need[s] > eps:
                                end = s
                                break
                            queue.append(("s", s))
                    if end is not None:
                        break
                else:
                    for p in by_source[v]:
                        if ("p", p) not in came and flow[p, v] > eps:
                            came["p", p] = (kind, v)
                            queue.append(("p", p))
            if end is None:
                break
            path: list[tuple[str, int]] = [("s", end)]
            while (prev := came[path[-1]]) is not None:
                path.append(prev)
            path.reverse()
            amount = min(left[path[0][1]], need[end])
            for (k, a), (_, b) in zip(path, path[1:], strict=False):
                if k == "s":
                    amount = min(amount, flow[b, a])
            for (k, a), (_, b) in zip(path, path[1:], strict=False):
                if k == "p":
                    flow[a, b] += amount
                else:
                    flow[b, a] -= amount
            left[path[0][1]] -= amount
            need[end] -= amount
    return flow


def _described(df: DataFrame, text: str, doc_id: str, source: str, seed: int) -> DataFrame:
    """(row, doc_id, held, key, size, u): u is a place in [0, 2**60) that doc_id, text and seed give, to its last bits,
    which tell equal rows apart by where they are read. The result is written before it is used, so they hold."""
    ensure_importable(df.sparkSession)
    many = dict(df.dtypes)[source].startswith("array")
    held = F.coalesce(F.sort_array(F.array_distinct(F.col(source))), F.array(F.lit(None).cast("string"))) if many else F.array(F.col(source))
    place = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.col(text), F.lit(seed)), 64 - PLACE_BITS + OWN_BITS), OWN_BITS)
    place = place + F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), 64 - OWN_BITS)
    out = df.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("doc_id"), held.alias("held"), place.alias("u"), _words(F.col(text)).alias("size"))
    # Elements may be null, so patterns are compared as text.
    return out.withColumn("key", F.to_json(F.struct(F.col("held").alias("x"))))


def _quotas(spark: SparkSession, sized: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(key, whole, extra, source_size, target) of every membership pattern.

    A source without overlap is its own flow: its pattern sends its quota. Only patterns of sources that overlap are
    routed together, up to ``MAX_PATTERNS`` of them.
    """
    found = sized.groupBy("key").agg(F.first("held").alias("held"), F.sum("size").alias("words")).collect()
    patterns = sorted(((r.key, r.held, int(r.words)) for r in found), key=lambda r: [(x is None, x or "") for x in r[1]])
    names = sorted({x for _, held, _ in patterns for x in held}, key=lambda x: (x is None, x or ""))
    index = {x: i for i, x in enumerate(names)}
    members = [[index[x] for x in held] for _, held, _ in patterns]
    sizes = [0] * len(names)
    for (_, _, words), ms in zip(patterns, members, strict=True):
        for s in ms:
            sizes[s] += words
    quota = targets(sizes, weights, share, most)
    shared = {s for ms in members if len(ms) > 1 for s in ms}
    routed = [k for k, ms in enumerate(members) if shared.intersection(ms)]
    if len(routed) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns of overlapping sources")
    sent = [min(quota[ms[0]], float(most * words)) for ms, (_, _, words) in zip(members, patterns, strict=True)]
    for k in routed:
        sent[k] = 0.0
    flow = min_cost_flow([float(patterns[k][2]) for k in routed], [members[k] for k in routed], quota, most)
    for (p, _), x in flow.items():
        sent[routed[p]] += x
    rows = []
    for (key, _, words), ms, x in zip(patterns, members, sent, strict=True):
        whole = min(int(x / words + 1e-9), most) if words else 0
        extra = 0.0 if whole == most else max(0.0, x - whole * words)
        rows.append((key, whole, extra, sum(sizes[s] for s in ms), float(sum(quota[s] for s in ms))))
    return spark.createDataFrame(rows, "key string, whole int, extra double, source_size long, target double")


def _cuts(sized: DataFrame, quotas: DataFrame) -> DataFrame:
    """``quotas`` with ``cut``, the place up to which documents that fit are taken once more, and their words.

    Twelve bits of the place a round: words are summed by bucket, and the bucket in which the running total passes
    what is wanted is opened in the next round. No bucket is ever ordered by rows.
    """
    state = quotas.withColumn("prefix", F.when(F.col("extra") > 0, F.lit(0).cast("long"))).withColumn("before", F.lit(0).cast("long")).withColumn("cut", F.lit(0).cast("long"))
    running = F.sum("words").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    for level in range(PLACE_BITS // STEP_BITS):
        shift = PLACE_BITS - STEP_BITS * (level + 1)
        open_ = state.where(F.col("prefix").isNotNull()).select("key", "extra", "prefix", "before")
        bucket = F.shiftright("u", shift)
        inside = sized.join(open_, "key").where((F.col("size") <= F.col("extra")) & (F.shiftright("u", shift + STEP_BITS) == F.col("prefix")))
        sums = inside.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("extra").alias("extra"), F.first("before").alias("before"))
        sums = sums.withColumn("before", F.col("before") + F.coalesce(running, F.lit(0)))
        over = F.col("before") + F.col("words") > F.col("extra")
        edge = F.min_by(F.struct("bucket", "before", "n"), F.when(over, F.col("bucket")))
        # Without an edge all documents that fit are taken.
        step = sums.groupBy("key").agg(edge.alias("e"), F.max(F.col("before") + F.col("words")).alias("all"))
        more = F.col("e.n") > 1
        step = step.select("key", F.when(more, F.col("e.bucket")).alias("p2"), F.coalesce("e.before", "all").alias("b2"), F.when(F.col("e").isNull(), F.lit(1 << PLACE_BITS)).otherwise(F.shiftleft("e.bucket", shift)).alias("c2"))
        state = state.join(step, "key", "left").select(*quotas.columns, F.when(F.col("prefix").isNotNull(), F.col("p2")).alias("prefix"), F.coalesce("b2", "before").alias("before"), F.coalesce("c2", "cut").alias("cut"))
        state = materialize(state, "mix-cuts")
        if state.where(F.col("prefix").isNotNull()).limit(1).count() == 0:
            break
    return state.drop("prefix")


def _sent(df: DataFrame) -> DataFrame:
    """``df``, for a broadcast join if it is small enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _fills(sized: DataFrame, cuts: DataFrame) -> DataFrame:
    """(key, u, size, doc_id) of the documents past the cut that fill what is still missing, largest first.

    A round adds the largest document that isn't too large to each pattern; the last one the nearest in size.
    """
    gaps = cuts.select("key", "cut", F.col("extra").alias("most"), (F.col("extra") - F.col("before")).alias("gap"))
    chosen = None
    for k in range(FILL_ROUNDS):
        wanted = (F.col("size") > 0) & (F.col("size") <= F.col("most")) & (F.col("u") >= F.col("cut"))
        rest = sized.join(_sent(gaps.where("gap >= 0.5")), "key").where(wanted)
        if chosen is not None:
            rest = rest.join(_sent(chosen.select("key", "u", "size")), ["key", "u", "size"], "left_anti")
        if k < FILL_ROUNDS - 1:
            rest, order = rest.where("size <= gap"), F.struct("size", "u")
        else:
            rest, order = rest.where("abs(gap - size) < gap"), F.struct(-F.abs(F.col("gap") - F.col("size")), "u")
        more = rest.groupBy("key").agg(F.max_by(F.struct("u", "size", "doc_id"), order).alias("f")).select("key", "f.*")
        chosen = materialize(more if chosen is None else chosen.union(more), "mix-fills")
        filled = chosen.groupBy("key").agg(F.sum("size").alias("filled"))
        missing = F.col("extra") - F.col("before") - F.coalesce("filled", F.lit(0))
        gaps = cuts.join(filled, "key", "left").select("key", "cut", F.col("extra").alias("most"), missing.alias("gap"))
    return chosen


def _with_copies(described: DataFrame, plan: Plan) -> DataFrame:
    """``described`` with copies, source_size and target: a map over documents while the plan is small."""
    fills = plan.fills.select("key", "u", "size", F.lit(True).alias("filled"))
    out = described.join(_sent(plan.patterns), "key").join(_sent(fills), ["key", "u", "size"], "left")
    again = ((F.col("size") <= F.col("extra")) & (F.col("u") < F.col("cut"))) | F.coalesce("filled", F.lit(False))
    return out.withColumn("copies", (F.col("whole") + F.when(again, 1).otherwise(0)).cast("int"))


def _plan(sized: DataFrame, weights: tuple[int, ...], share: float, most: int) -> Plan:
    cuts = _cuts(sized, _quotas(sized.sparkSession, sized, weights, share, most))
    return Plan(cuts, _fills(sized, cuts))


@settled("mix")
def mix_sources(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """Per document: doc_id, sources, size, source_size, target, copies, taken.

    ``source`` may be a string column or an array of strings for documents that several sources hold.
    """
    sized = materialize(_described(df, text, doc_id, source, seed).drop("row"), "mix-described")
    out = _with_copies(sized, _plan(sized, weights, share, most))
    return out.select("doc_id", F.col("held").alias("sources"), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """The rows of ``df``, as many times as the mix takes each. Texts are written once, and not shuffled while no more
    than ``BROADCAST_ROWS`` membership patterns hold them."""
    described = materialize(_described(df, text, doc_id, source, seed), "mix-rows")
    out = _with_copies(described, _plan(described.drop("row"), weights, share, most))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies")))).where("copy > 0").select("row.*")
