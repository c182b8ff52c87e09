"""Structural calls from discordant pairs and split reads: clusters of breakpoints, their type, support and genotype.

Evidence is cut into islands (stretches without a gap wider than a cluster), which can't touch each other's clusters;
an island's distinct positions are walked in order, each cluster beginning where the last one's reach ends. Everything
else is an aggregate by cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.scan import islands
from helixframe.operators.structural import call_quality, merge_evidence
from helixframe.session import ensure_importable, materialize

#: Greatest distance from a cluster's first position, least support in all, by pairs and by split reads, and support of a
#: homozygous call: fixed values.
DISTANCE, MIN_SUPPORT, MIN_PAIRS, MIN_SPLITS, HOMOZYGOUS = 500, 3, 2, 1, 10


def cluster_starts(points: DataFrame, key: list[str], pos: str, distance: int = DISTANCE) -> DataFrame:
    """(key, pos, first): every distinct position with the first position of its cluster."""
    spans = points.select(*key, F.col(pos).alias("s"), F.col(pos).alias("e")).distinct()
    isle = islands(spans, key, "s", "e", distance).select(*key, "s", "_isle")
    whole = [*key, "_isle"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, anchor = None, 0  # the island that the last batch ended in, and its last cluster's first position
        for g in frames:
            if not len(g):
                continue
            turn = (g[whole] != g[whole].shift()).any(axis=1).to_numpy()
            going_on = held is not None and held == tuple(g[whole].iloc[0])
            turn[0] = not going_on
            at = g["s"].to_numpy()
            # Islands laid end to end, further apart than a cluster reaches.
            line = np.cumsum(turn) * (1 << 40) + at
            first = np.empty(len(at), np.int64)
            k = 0
            if going_on:
                k = int(np.searchsorted(line, anchor + distance, "right"))
                first[:k] = anchor
            while k < len(at):
                z = int(np.searchsorted(line, line[k] + distance, "right"))
                first[k:z] = at[k]
                k = z
            held, anchor = tuple(g[whole].iloc[-1]), int(first[-1])
            yield g[key].assign(pos=at, first=first)

    kinds = dict(points.dtypes)
    ensure_importable(points.sparkSession)
    placed = isle.repartition(*whole).sortWithinPartitions(*whole, "s")
    return placed.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", pos long, first long")


def breakpoint_calls(pairs: DataFrame, splits: DataFrame, distance: int = DISTANCE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(contig, kind, start, end, length, low, high, pe, sr, quality, genotype, filter, mate_contig, mate_pos).

    ``pairs``: id, contig, pos, mate_contig, mate_pos, same_strand, insert_size, mapq, outlier (reported for the size of
    its insert); ``splits``: contig, pos, mapq. Pairs across contigs make BND calls by pair of contigs, whatever their
    support; the others and split reads make clusters by contig.
    """
    evidence = pairs.select("contig", "pos", F.lit(True).alias("pair"), "id", "mate_contig", "mate_pos", "same_strand", "insert_size", "mapq", "outlier")
    evidence = evidence.unionByName(splits.select("contig", "pos", F.lit(False).alias("pair"), "mapq"), allowMissingColumns=True)
    across = F.col("pair") & (F.col("contig") != F.col("mate_contig"))
    evidence = evidence.withColumn("other", F.when(across, F.col("mate_contig")).otherwise(F.lit("")))
    key = ["contig", "other"]
    starts = cluster_starts(evidence, key, "pos", distance)
    # Written once: calls and the mates' places both come from it.
    clustered = materialize(evidence.join(starts, [*key, "pos"]), "clustered")
    e = clustered.groupBy(*key, "first")
    pair = F.col("pair")
    of = lambda value, when: F.when(when, value)
    place = F.floor(F.sum("pos") / F.count("*"))
    g = e.agg(
        place.alias("start"), F.min("pos").alias("least"), F.max("pos").alias("most"), F.count_if(pair).alias("pe"), F.count_if(~pair).alias("sr"),
        F.avg("mapq").alias("mapq"), F.count_if(pair & F.col("same_strand")).alias("same"), F.avg(of(F.col("insert_size"), pair & F.col("outlier"))).alias("odd"),
        F.min_by("insert_size", of(F.struct("pos", "id"), pair)).alias("insert_first"), F.sum(of(F.col("mate_pos"), pair)).alias("mate_sum"),
    )
    # Mates that stand at the cluster's own position don't count towards its length.
    mates = clustered.where(pair).join(g.select(*key, "first", "start"), [*key, "first"]).where(F.col("mate_pos") != F.col("start"))
    mates = mates.groupBy(*key, "first").agg(F.floor(F.sum("mate_pos") / F.count("*")).alias("far"))
    c = g.join(mates, [*key, "first"], "left")
    bnd, support = F.col("other") != "", F.col("pe") + F.col("sr")
    half = F.coalesce(F.col("insert_first") * 0.5, F.lit(400.0))
    kind = F.when(bnd, "BND").when(F.col("same") > F.floor(F.col("pe") / 2), "INV")
    kind = kind.when(F.col("odd") > half * 2, "DEL").when(F.col("odd") < half * 0.5, "DUP").otherwise("DEL")
    c = c.withColumn("kind", kind).withColumn("_length", F.when(F.col("far").isNull(), distance).otherwise(F.abs(F.col("far") - F.col("start"))))
    deletion = (F.col("kind") == "DEL") & F.col("far").isNotNull()
    length = F.when(bnd, 0).when(deletion, -F.col("_length")).otherwise(F.col("_length"))
    low, high = (F.when(bnd, s * distance).otherwise(F.col(x) - F.col("start")) for s, x in ((-1, "least"), (1, "most")))
    mate = F.when(bnd, F.floor(F.col("mate_sum") / F.col("pe")))
    passes = (F.col("pe") >= MIN_PAIRS) | (F.col("sr") >= MIN_SPLITS)
    return c.where(bnd | (support >= min_support)).select(
        "contig", "kind", "start", F.when(bnd, F.col("start")).otherwise(F.col("start") + F.col("_length")).alias("end"), length.cast("long").alias("length"),
        low.cast("long").alias("low"), high.cast("long").alias("high"), "pe", "sr", call_quality(support, F.col("mapq")).alias("quality"),
        F.when(support >= HOMOZYGOUS, "1/1").otherwise("0/1").alias("genotype"), F.when(passes, "PASS").otherwise("LowSupport").alias("filter"),
        F.when(bnd, F.col("other")).alias("mate_contig"), mate.alias("mate_pos"),
    )


def with_depth(calls: DataFrame, depth: DataFrame) -> DataFrame:
    """``calls`` (id, contig, kind, start, end and more) with ``relative_depth`` of the depth call of its kind that it
    overlaps, each used once; depth calls that none used are rows of their own. ``depth``: id, contig, kind, start, end,
    relative_depth."""
    calls = materialize(calls, "calls")
    plain = ("id", "contig", "kind", "start", "end")
    # Written once: both what calls take and what is left come from it.
    used = materialize(merge_evidence(calls.select(*plain), depth.select(*plain)), "merged")
    own = depth.select(F.col("id").alias("b_id"), "relative_depth").join(used, "b_id").select(F.col("a_id").alias("id"), "relative_depth")
    rest = depth.join(used.select(F.col("b_id").alias("id")), "id", "left_anti")
    return calls.join(own, "id", "left").unionByName(rest, allowMissingColumns=True)


def support_score(pe: Column, sr: Column, relative_depth: Column) -> Column:
    """Confidence from 0 to 1: pairs, split reads and depth weigh 0.3, 0.4 and 0.3."""
    share = lambda x, full: F.least(x / full, F.lit(1.0))
    depth = F.when(relative_depth.isNull(), 0.0).otherwise(share(F.abs(1.0 - relative_depth), 0.5))
    return 0.3 * share(pe, 10.0) + 0.4 * share(sr, 5.0) + 0.3 * depth
