"""Variants found without a site list: haploid and diploid bases, indels, realignment windows and paralog rescue.

Tallies are rows ``contig, pos, base, n``; the reference is rows ``contig, pos, ref``, or blocks ``contig, start, seq``
(1-based) that overlap by as much as a kernel looks back. Everything is keyed by position or window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.batched import HMM_CELLS, align_batch, batches_of_cells, hmm_batch
from helixframe.operators.calls import BASES, haploid_call, top_two
from helixframe.operators.intervals import merge_intervals
from helixframe.operators.kernels import grouped
from helixframe.operators.pileup import cigar_ops
from helixframe.session import ensure_importable

#: Quality that a counted base stands for, and the reads that an alternate needs: fixed values.
COUNT_QUALITY, MIN_ALT_READS = 30, 2
#: Log-odds and fragments that a rescue needs, and how far apart candidates share a window: fixed values.
RESCUE_ODDS, RESCUE_FRAGMENTS, RESCUE_WINDOW = 2.0, 2, 60


#: Observations of a task that genotypes a panel: a fixed value.
PANEL_ROWS = 1_000_000


def haploid_variants(tally: DataFrame, reference: DataFrame, min_depth: int = 4, min_share: float = 0.5, paralog_reads: int = 2, paralog_share: float = 0.2) -> DataFrame:
    """(contig, pos, ref, alt, depth, alt_depth, af) where a clear consensus differs from a known reference base."""
    called = haploid_call(top_two(tally, ["contig", "pos"]), min_depth, min_share, paralog_reads, paralog_share).where(F.col("call").isNotNull())
    j = called.join(reference.where(F.upper("ref").isin(*BASES)), ["contig", "pos"]).where(F.col("call") != F.upper("ref"))
    return j.select("contig", "pos", F.upper("ref").alias("ref"), F.col("call").alias("alt"), "depth", F.col("top_n").alias("alt_depth"), (F.col("top_n") / F.col("depth")).alias("af"))


def in_region(calls: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    return calls.where((F.col("contig") == contig) & F.col("pos").between(start, end))


def _allele_counts(tally: DataFrame, reference: DataFrame, min_alt: int) -> DataFrame:
    """(contig, pos, ref, depth, alleles): the reference's count first, then alternates, commonest first."""
    j = tally.where(F.col("base").isin(*BASES)).join(reference.where(F.upper("ref").isin(*BASES)).withColumn("ref", F.upper("ref")), ["contig", "pos"])
    alt = F.when((F.col("base") != F.col("ref")) & (F.col("n") >= min_alt), F.struct((-F.col("n")).alias("k"), F.col("base").alias("base")))
    g = j.groupBy("contig", "pos", "ref").agg(F.sum("n").alias("depth"), F.sum(F.when(F.col("base") == F.col("ref"), F.col("n")).otherwise(0)).alias("ref_n"), F.sort_array(F.collect_list(alt)).alias("alts"))
    return g.where(F.size("alts") > 0)


def diploid_variants(tally: DataFrame, reference: DataFrame, min_depth: int = 4, min_alt: int = MIN_ALT_READS, quality: int = COUNT_QUALITY) -> DataFrame:
    """(contig, pos, ref, alt, gt, dosage, gq, depth, ref_depth, alt_depth) of sites that aren't reference alone.

    Alternates below ``min_alt`` reads are left out. Every counted base stands for one of ``quality``, so a genotype's
    likelihood follows from the counts; genotypes i/j are in the order of VCF.
    """
    e = 10 ** (-quality / 10)
    own, none = float(np.log10(1 - e)), float(np.log10(e / 3))
    both = float(np.log10((1 - e) / 2 + e / 6))
    s = _allele_counts(tally, reference, min_alt).where(F.col("depth") >= min_depth)
    n = F.concat(F.array("ref_n"), F.transform("alts", lambda a: -a["k"]))
    s = s.withColumn("counts", n).withColumn("k", F.size("alts"))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    s = s.withColumn("used", total).where(F.col("used") >= min_depth)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.col("k")), lambda j: F.transform(F.sequence(F.lit(0), j), lambda i: F.struct(i.alias("i"), j.alias("j")))))
    count = lambda x: F.get("counts", x)

    def loglik(p: Column) -> Column:
        same = count(p["i"]) * own + (F.col("used") - count(p["i"])) * none
        mixed = (count(p["i"]) + count(p["j"])) * both + (F.col("used") - count(p["i"]) - count(p["j"])) * none
        return F.when(p["i"] == p["j"], same).otherwise(mixed)

    s = s.withColumn("pairs", pairs).withColumn("ll", F.transform("pairs", loglik))
    s = s.withColumn("pl", F.transform("ll", lambda x: F.least(F.floor(-10 * (x - F.array_max("ll")) + 0.5), F.lit(255)).cast("int")))
    best = F.get("pairs", (F.array_position("pl", F.lit(0)) - 1).cast("int"))
    s = s.withColumn("g", best).withColumn("gq", F.least(F.get(F.sort_array("pl"), F.lit(1)), F.lit(99))).where("g.j > 0")
    alts = F.array_join(F.transform("alts", lambda a: a["base"]), ",")
    dosage = (F.col("g.i") > 0).cast("int") + (F.col("g.j") > 0).cast("int")
    return s.select("contig", "pos", "ref", alts.alias("alt"), F.concat_ws("/", F.col("g.i").cast("string"), F.col("g.j").cast("string")).alias("gt"), dosage.alias("dosage"), "gq", "depth", F.col("ref_n").alias("ref_depth"), (F.col("used") - F.col("ref_n")).alias("alt_depth"))


# ---- indels


def indel_events(reads: DataFrame) -> DataFrame:
    """One row per insertion or deletion of a read: the read's columns, anchor, kind (I or D), length and inserted bases.

    A deletion is anchored at its first base, an insertion at the reference base after it.
    """

    def step(acc: Column, x: Column) -> Column:
        both = x["op"].isin("M", "=", "X")
        event = F.struct(acc["r"].alias("anchor"), x["op"].alias("kind"), x["len"].alias("length"), acc["q"].alias("q"))
        return F.struct(
            (acc["r"] + F.when(both | x["op"].isin("D", "N"), x["len"]).otherwise(0)).alias("r"),
            (acc["q"] + F.when(both | x["op"].isin("I", "S"), x["len"]).otherwise(0)).alias("q"),
            F.when(x["op"].isin("I", "D", "N"), F.concat(acc["events"], F.array(event))).otherwise(acc["events"]).alias("events"),
        )

    start = F.struct(F.col("pos").cast("long").alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<anchor:bigint,kind:string,length:int,q:int>>").alias("events"))
    found = F.aggregate(cigar_ops(F.col("cigar")), start, step, lambda acc: acc["events"])
    out = reads.withColumn("_e", F.explode(found))
    bases = F.when(F.col("_e.kind") == "I", F.upper(F.substring("seq", F.col("_e.q") + 1, F.col("_e.length"))))
    kind = F.when(F.col("_e.kind") == "I", "I").otherwise("D")
    return out.select(*reads.columns, F.col("_e.anchor").alias("anchor"), kind.alias("kind"), F.col("_e.length").alias("length"), bases.alias("bases"))


def shift_left(anchor: int, kind: str, length: int, bases: str | None, seq: str, start: int) -> tuple[int, str | None]:
    """The leftmost anchor (and rotated bases) of an event inside ``seq``, whose first base is at ``start``."""
    at = lambda p: seq[p - start].upper() if start <= p < start + len(seq) else None
    while anchor > start:
        before = at(anchor - 1)
        if before is None or before != (at(anchor + length - 1) if kind == "D" else bases[-1]):
            break
        if kind == "I":
            bases = bases[-1] + bases[:-1]
        anchor -= 1
    return anchor, bases


def normalize_indels(events: DataFrame, blocks: DataFrame, block: int) -> DataFrame:
    """``events`` with ``anchor`` and ``bases`` moved left as far as the reference allows.

    ``blocks``: contig, start, seq, where start = k * block + 1 less the overlap that lies before it.
    """
    b = blocks.select("contig", F.floor((F.col("start") + F.length("seq") - 2) / block).alias("_b"), F.col("start").alias("_s"), F.col("seq").alias("_seq"))
    j = events.withColumn("_b", F.floor((F.col("anchor") - 1) / block)).join(b, ["contig", "_b"])
    schema = events.schema

    def run(frames):
        for f in frames:
            moved = [shift_left(a, k, n, x, s, o) for a, k, n, x, s, o in zip(f["anchor"], f["kind"], f["length"], f["bases"], f["_seq"], f["_s"], strict=True)]
            f["anchor"], f["bases"] = [a for a, _ in moved], [x for _, x in moved]
            yield f[schema.names]

    return j.select(*events.columns, "_seq", "_s").mapInPandas(run, schema)


def expected_indel(ancestral: Column, derived: Column) -> Column:
    """struct(kind, length, bases) of a tree's indel: the longer allele begins with the shorter; else null."""
    a, d = F.upper(ancestral), F.upper(derived)
    grows = (F.length(d) > F.length(a)) & d.startswith(a)
    shrinks = (F.length(a) > F.length(d)) & a.startswith(d)
    more = F.struct(F.lit("I").alias("kind"), (F.length(d) - F.length(a)).alias("length"), F.substring(d, F.length(a) + 1, F.length(d)).alias("bases"))
    less = F.struct(F.lit("D").alias("kind"), (F.length(a) - F.length(d)).alias("length"), F.lit(None).cast("string").alias("bases"))
    return F.when(grows, more).when(shrinks, less)


def confirm_indels(targets: DataFrame, spans: DataFrame, events: DataFrame, min_depth: int = 4, min_share: float = 0.5) -> DataFrame:
    """(contig, pos) of the targets that reads carry; never a statement that they don't.

    ``targets``: contig, pos, anchor, kind, length, bases (normalized); ``spans``: read, contig, start, end;
    ``events``: read, contig, anchor, kind, length, bases (normalized). A read without an event at the anchor counts
    against the target if it covers position and deleted bases.
    """
    from helixframe.operators.intervals import point_in_interval

    # A target needs one read with its own event, so the others can't be confirmed, whatever covers them.
    signs = events.select(*(F.col(c).alias(f"_{c}") for c in ("contig", "anchor", "kind", "length", "bases"))).distinct()
    own = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c == "bases" else F.col(c) == F.col(f"_{c}") for c in ("contig", "anchor", "kind", "length", "bases")]
    targets = targets.join(signs, own, "left_semi")
    near = point_in_interval(targets, spans, ["contig"], "pos", "start", "end", 64)
    at = events.groupBy("read", "contig", "anchor").agg(F.collect_list(F.struct("kind", "length", "bases")).alias("seen"))
    j = near.join(at, ["read", "contig", "anchor"], "left")
    hit = F.exists("seen", lambda s: (s["kind"] == F.col("kind")) & (s["length"] == F.col("length")) & s["bases"].eqNullSafe(F.col("bases")))
    reach = F.col("end") >= F.col("pos") + F.when(F.col("kind") == "D", F.greatest(F.col("length"), F.lit(1))).otherwise(1)
    g = j.groupBy("contig", "pos").agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("matched"), F.count_if(F.col("seen").isNull() & reach).alias("spanning"))
    depth = F.col("matched") + F.col("spanning")
    return g.where((depth >= min_depth) & (F.col("matched") > F.col("spanning")) & (F.col("matched") >= min_share * depth))


def active_windows(evidence: DataFrame, min_reads: int = 2, pad: int = 10) -> DataFrame:
    """(contig, start, end) around positions where enough reads show an indel; windows that touch become one."""
    w = evidence.where(F.col("reads") >= min_reads).select("contig", F.greatest(F.col("pos") - pad, F.lit(1)).alias("start"), (F.col("pos") + pad).alias("end"))
    return merge_intervals(w, ["contig"], "start", "end", 1).select("contig", "start", "end")


def align_pieces(pieces: DataFrame, keep: list[str]) -> DataFrame:
    """(``keep``, places, queries), one row a piece of a read that has aligned bases: their places on the reference,
    ascending, and in the piece from 0.

    ``pieces``: contig, start, ref (the window's bases), bases and those of ``keep``. A batch of pieces is aligned at
    once, along the diagonals of all their tables.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bases, refs = b.column("bases").to_pylist(), b.column("ref").to_pylist()
            starts, kept = b.column("start").to_numpy(), b.select(keep)
            for part in batches_of_cells(np.array([len(x) for x in bases], np.int64), np.array([len(x) for x in refs], np.int64)):
                _, piece, query, target = align_batch([bases[k] for k in part], [refs[k] for k in part])
                n = np.bincount(piece, minlength=len(part))
                ends = pa.array(np.concatenate(([0], np.cumsum(n[n > 0]))), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (starts[part][piece] + target, query.astype(np.int32)))
                own = kept.take(pa.array(part[n > 0]))
                yield pa.RecordBatch.from_arrays([*own.columns, *lists], names=[*keep, "places", "queries"])

    ensure_importable(pieces.sparkSession)
    kinds = dict(pieces.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), "places array<long>", "queries array<int>"])
    return pieces.select(*dict.fromkeys(["start", "ref", "bases", *keep])).withColumn("start", F.col("start").cast("long")).mapInArrow(run, schema)


def realign(pieces: DataFrame) -> DataFrame:
    """(read, contig, ref_pos, base, quality) of pieces of reads aligned anew to the reference of their window.

    ``pieces``: read, contig, start, ref (the window's bases), bases, quals (array).
    """
    whole = align_pieces(pieces, ["read", "contig", "bases", "quals"])
    each = whole.select("read", "contig", "bases", "quals", F.explode(F.arrays_zip("places", "queries")).alias("x"))
    base, quality = F.substring("bases", F.col("x.queries") + 1, F.lit(1)), F.get("quals", F.col("x.queries"))
    return each.select(F.col("read").cast("string").alias("read"), "contig", F.col("x.places").alias("ref_pos"), base.alias("base"), quality.cast("int").alias("quality"))


def rescue(candidates: DataFrame, reads: DataFrame, min_odds: float = RESCUE_ODDS, min_fragments: int = RESCUE_FRAGMENTS, min_loglik: float = -30.0) -> DataFrame:
    """(contig, pos, depth, alt_depth, log_odds, derived) of sites with two alleles, by whole reads.

    ``candidates``: contig, pos, alt, start, ref (the window's bases); ``reads``: contig, pos (of the candidate),
    fragment, bases, quals. One read a fragment, the longest, is scored against both haplotypes by a pair HMM, a batch of
    reads at once; reads that fit neither don't vote. Sites are sums over reads: none is one task's group.
    """
    longest = F.max_by(F.struct("bases", "quals"), F.struct(F.length("bases"), "bases"))
    one = reads.groupBy("contig", "pos", "fragment").agg(longest.alias("r")).select("contig", "pos", "r.bases", "r.quals")
    j = one.join(candidates, ["contig", "pos"]).select("contig", "pos", "bases", "quals", "ref", "alt", (F.col("pos") - F.col("start")).cast("int").alias("off"))

    def run(frames):
        for f in frames:
            n, m = f["bases"].str.len().to_numpy(), f["ref"].str.len().to_numpy()
            for part in batches_of_cells(n, m, HMM_CELLS):
                g = f.iloc[part]
                other = [h[:o] + x + h[o + 1 :] for h, x, o in zip(g["ref"], g["alt"], g["off"], strict=True)]
                a, b = (hmm_batch(g["bases"].tolist(), g["quals"].tolist(), list(h)) * np.log(10) for h in (g["ref"], other))
                yield pd.DataFrame({"contig": g["contig"], "pos": g["pos"], "a": a, "b": b})

    ensure_importable(j.sparkSession)
    scored = j.mapInPandas(run, "contig string, pos long, a double, b double")
    fits = F.greatest("a", "b") >= min_loglik
    odds, alt = F.sum(F.when(fits, F.col("b") - F.col("a")).otherwise(0.0)), F.count_if(fits & (F.col("b") > F.col("a")))
    g = scored.groupBy("contig", "pos").agg(F.count_if(fits).alias("depth"), alt.alias("alt_depth"), odds.alias("log_odds"))
    return g.withColumn("derived", (F.col("log_odds") > min_odds) & (F.col("alt_depth") >= min_fragments))


def molecule_lengths(reads: DataFrame, order: list[str], most: int = 50_000) -> DataFrame:
    """Mean read and fragment length over the first ``most`` primary reads with a sequence; the number is the feature.

    Fragments come from proper pairs shorter than 100 kb; without any, the read length stands for them.
    """
    bit = lambda b: F.col("flags").bitwiseAND(F.lit(b)) != 0
    first = reads.where(~bit(0x4) & ~bit(0x100) & ~bit(0x800) & (F.col("length") > 0)).orderBy(*order).limit(most)
    n = F.abs("tlen")
    fragment = F.avg(F.when(bit(0x2) & (n > 0) & (n < 100_000), n))
    return first.agg(F.count("*").alias("reads"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("read_length"), F.coalesce(fragment, F.avg("length"), F.lit(0.0)).alias("fragment_length"))


def panel_genotypes(panel: DataFrame, obs: DataFrame, min_depth: int = 4) -> DataFrame:
    """Genotype of every panel site, all contigs at once; ``obs``: contig, pos, base, baseq. Thin sites are no calls (-1)."""
    from helixframe.operators.calls import error_rate, genotype_likelihoods, genotypes

    # Sites are summed where their rows meet, in as many tasks as the rows ask for; partial sums of all sites in each task
    # would be nearly as many as the rows.
    tasks = -(-obs.count() // PANEL_ROWS) or 1
    dealt = lambda d: d.repartition(tasks, "contig", "pos")
    panel = dealt(panel)
    j = dealt(obs).join(panel.hint("merge"), ["contig", "pos"])
    g = genotypes(genotype_likelihoods(j, ["contig", "pos"], F.col("base") == F.col("alt"), error_rate(F.col("baseq")), F.col("base") == F.col("ref")))
    out = panel.join(g, ["contig", "pos"], "left")
    deep = F.coalesce(F.col("depth"), F.lit(0)) >= min_depth
    return out.select("contig", "pos", F.when(deep, F.col("dosage")).otherwise(-1).alias("dosage"), F.when(deep, F.col("gq")).otherwise(0).alias("gq"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("alt_depth", F.lit(0)).alias("alt_depth"))


def consensus_calls(per_run: DataFrame, min_depth: int = 2) -> DataFrame:
    """One genotype a site over a subject's runs: every run is genotyped at every site any run has, then they vote."""
    from helixframe.operators.calls import reconcile_runs

    sites = per_run.select("contig", "pos", "alt").distinct()
    runs = per_run.select("subject", "run").distinct()
    # All runs of a subject meet the sites that the subject's runs have, not all sites.
    own = per_run.select("subject", "contig", "pos", "alt").distinct().join(sites, ["contig", "pos", "alt"]).join(runs, "subject")
    filled = own.join(per_run, ["subject", "run", "contig", "pos", "alt"], "left").na.fill(0, ["dosage", "depth"])
    return reconcile_runs(filled, ["subject", "contig", "pos", "alt"], min_depth)
