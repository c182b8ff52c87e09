"""Substring dedup by seed and extend: word passages that a document with a smaller number holds too.

1. Seeds. In every window of ``LENGTH`` words the run of ``SEED`` words with the least hash, leftmost on ties, is the
   window's seed (winnowing): equal windows have equal seeds at equal offsets, so documents that share a window meet at
   its seed. A seed with the windows that grow from it, by so many words to the left and the rest to the right, is sent
   as one short record; texts are not.
2. Extend. Records meet by seed. From the seed outwards, equal extensions are found by sorting the hashes of the windows
   they reach; in each group of equal ones the smallest doc_id stays, all others lose the window. No pair is listed.
   Every chunk of documents has kept the first of its own equal windows before, so a passage that a third of the corpus
   repeats arrives once a chunk.
3. Maximal repeats. Windows that overlap or touch are merged by document into spans, which can't be extended further.

A seed that stands in very many different contexts would send them all to one task. Such seeds are looked for in a
bounded sample (``SAMPLE_BYTES`` of texts); their windows are dealt by their own hashes instead. The sample decides where
windows meet, never what is found.

Edge cases: null texts have no words; texts under LENGTH words lose nothing; rows with a null doc_id stay whole and
remove nothing elsewhere; rows that share a doc_id remove nothing from each other, whatever their texts; very long texts
are looked at in overlapping slices; extra columns of any name are left out; an empty table gives an empty table. Equal
windows are those of equal 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.words import chunks, gram_hashes, mix, prefix_sums, ranges, span_hashes, table_nonspace, tidied, utf8, within_docs, word_spans
from helixframe.session import ensure_importable, materialize

LENGTH = 13
SEED = 5
#: Bytes of text that are looked at together; a longer text is cut into slices of this size.
SHARD_BYTES = 2 << 20
#: Bytes of input whose records one task of the exchange takes.
TASK_BYTES = 8 << 20
SAMPLE_BYTES = 32 << 20
#: Different windows around one seed in the sample, from which on they are dealt by their own hashes.
HOT_WINDOWS = 64


class Slice(NamedTuple):
    """Words of some texts, or of a part of one: bytes, word spans, first words, texts' numbers, words before."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    docs: np.ndarray
    before: int


def slices(data: np.ndarray, offs: np.ndarray, length: int, limit: int = SHARD_BYTES) -> Iterator[Slice]:
    """All texts, several at a time; a text over ``limit`` in slices that share ``length`` - 1 words."""
    for i, j in chunks(offs, limit):
        d = data[offs[i] : offs[j]]
        if len(d) <= 2 * limit or j - i > 1:
            s, e, first = word_spans(d, offs[i : j + 1] - offs[i], table_nonspace())
            yield Slice(d, s, e, first, np.arange(i, j), 0)
            continue
        at, before, size = 0, 0, limit
        while True:
            end = min(at + size, len(d))
            while end < len(d) and table_nonspace()[d[end]]:
                end += 1 + int(np.argmin(np.append(table_nonspace()[d[end + 1 : end + 4096]], False)))
            end = min(end, len(d))
            s, e, first = word_spans(d[at:end], np.array([0, end - at]), table_nonspace())
            if end < len(d) and len(s) < 2 * length:
                size *= 2
                continue
            yield Slice(d[at:end], s, e, first, np.array([i]), before)
            if end == len(d):
                break
            back = len(s) - length + 1
            at, before, size = at + int(s[back]), before + back, limit


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    m = x[: len(x) - width + 1].copy()
    for k in range(1, width):
        np.minimum(m, x[k : len(x) - width + 1 + k], out=m)
    return m


def grown_windows(part: Slice, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(text, start word, hash, seed's hash, seed's place) of every window, in the order of places."""
    at = within_docs(part.first, length)
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64))
    words = span_hashes(prefix_sums(part.data), part.starts, part.ends)
    grams = gram_hashes(words, seed)
    spread = length - seed + 1
    place = sliding_least((grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64), spread)
    place = (place[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = np.zeros(len(at), np.uint64)
    for k in [*range(0, length - seed, seed), length - seed]:  # runs that cover the window
        whole = mix(whole * np.uint64(3) + grams[at + k] + np.uint64(k + 1))
    text = np.searchsorted(part.first, at, "right") - 1
    return text, at - part.first[text] + part.before, whole, grams[place], place


_CUTS = "gi long, gx long, start long, windows int"
_CUTS_ARROW = pa.schema([("gi", pa.int64()), ("gx", pa.int64()), ("start", pa.int64()), ("windows", pa.int32())])
_PACKET = "bucket int, docs binary, keys binary, starts binary, sizes binary, hashes binary"
_PACKET_ARROW = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("docs", "keys", "starts", "sizes", "hashes"))])


def later_windows(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """True for windows that a smaller doc_id holds too."""
    order = np.lexsort((docs, hashes))
    h, d = hashes[order], docs[order]
    lead = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    least = np.repeat(d[lead], np.diff(np.concatenate((lead, [len(h)]))))
    out = np.zeros(len(h), bool)
    out[order] = d != least
    return out


def runs(docs: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, sizes): windows by document and place, and the sizes of their runs of consecutive places."""
    order = np.lexsort((starts, keys, docs))
    d, x, s = docs[order], keys[order], starts[order]
    fresh = np.concatenate(([True], (d[1:] != d[:-1]) | (x[1:] != x[:-1]) | (s[1:] != s[:-1])))[: len(d)]
    order, d, x, s = order[fresh], d[fresh], x[fresh], s[fresh]
    lead = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (x[1:] != x[:-1]) | (s[1:] != s[:-1] + 1)))[: len(d)])
    return order, np.diff(np.concatenate((lead, [len(d)])))


def _cuts(docs: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(docs):
        return
    order, sizes = runs(docs, keys, starts)
    lead = order[np.cumsum(sizes) - sizes]
    arrays = [pa.array(docs[lead]), pa.array(keys[lead]), pa.array(starts[lead]), pa.array(sizes, pa.int32())]
    yield pa.RecordBatch.from_arrays(arrays, schema=_CUTS_ARROW)


def _records(buckets: int, hot, length: int):
    """Packets of windows by bucket; in packets without a bucket, what a chunk has removed itself."""

    def packet(bucket: int | None, docs, keys, starts, sizes, hashes) -> dict:
        raw = (docs.astype("<i8"), keys.astype("<i8"), starts.astype("<u4"), sizes.astype(np.uint8), hashes.astype("<u8"))
        return {"bucket": bucket, **{c: x.tobytes() for c, x in zip(("docs", "keys", "starts", "sizes", "hashes"), raw, strict=True)}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.is_valid(b.column("i")))
            data, offs = utf8(b.column("t"))
            ids, xs = b.column("i").to_numpy(), b.column("x").to_numpy()
            for part in slices(data, offs, length):
                text, start, whole, seed, place = grown_windows(part, length)
                if not len(text):
                    continue
                doc, key = ids[part.docs[text]], xs[part.docs[text]]
                gone = later_windows(whole, doc)
                rows = []
                if gone.any():
                    order, sizes = runs(doc[gone], key[gone], start[gone])
                    # No run is longer than a packet's byte can tell.
                    more = np.maximum(1, -(-sizes // 255))
                    lead = order[np.cumsum(sizes) - sizes]
                    nth = ranges(np.zeros(len(more), np.int64), more)
                    size = np.minimum(np.repeat(sizes, more) - 255 * nth, 255)
                    d, x, s = (v[gone][np.repeat(lead, more)] for v in (doc, key, start))
                    rows.append(packet(-1, d, x, s + 255 * nth, size, np.zeros(0, np.uint64)))
                keep = np.flatnonzero(~gone)
                sent = hot.value
                known = np.searchsorted(sent, seed[keep])
                own = (sent[np.minimum(known, len(sent) - 1)] == seed[keep]) if len(sent) else np.zeros(len(keep), bool)
                bucket = (np.where(own, whole[keep], seed[keep]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")  # places ascend within a bucket
                keep, bucket = keep[order], bucket[order]
                follows = np.zeros(len(keep), bool)
                follows[1:] = (place[keep[1:]] == place[keep[:-1]]) & (keep[1:] == keep[:-1] + 1) & (bucket[1:] == bucket[:-1]) & (start[keep[1:]] == start[keep[:-1]] + 1)
                lead = np.flatnonzero(~follows)
                sizes = np.diff(np.concatenate((lead, [len(keep)])))
                cut = np.flatnonzero(np.diff(bucket[lead], prepend=-1))
                for u, v in zip(cut.tolist(), [*cut[1:].tolist(), len(lead)], strict=False):
                    w = keep[lead[u:v]]
                    z = int(lead[v]) if v < len(lead) else len(keep)
                    rows.append(packet(int(bucket[lead[u]]), doc[w], key[w], start[w], sizes[u:v], whole[keep[lead[u] : z]]))
                yield pa.RecordBatch.from_pylist(rows, schema=_PACKET_ARROW)

    return run


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts of all windows that meet one of a smaller doc_id among the records of some seeds."""
    held: list[list[np.ndarray]] = [[], [], [], [], []]
    for b in batches:
        for k in range(b.num_rows):
            raw = [np.frombuffer(b.column(c)[k].as_buffer(), t) for c, t in (("docs", "<i8"), ("keys", "<i8"), ("starts", "<u4"), ("sizes", np.uint8), ("hashes", "<u8"))]
            if b.column("bucket")[k].as_py() < 0:
                arrays = [pa.array(raw[0]), pa.array(raw[1]), pa.array(raw[2].astype(np.int64)), pa.array(raw[3].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, schema=_CUTS_ARROW)
                continue
            for into, x in zip(held, raw, strict=True):
                into.append(x)
    if not held[0]:
        return
    docs, keys, starts, sizes, hashes = (np.concatenate(x) for x in held)
    held.clear()
    sizes = sizes.astype(np.int64)
    every = np.repeat(docs, sizes)
    gone = np.flatnonzero(later_windows(hashes, every))
    record = np.repeat(np.arange(len(docs)), sizes)[gone]
    start = ranges(starts.astype(np.int64), sizes)[gone]
    yield from _cuts(every[gone], keys[record], start)


def crowded_seeds(docs: DataFrame, size: int, length: int) -> np.ndarray:
    """Hashes of seeds with many different windows in a sample of texts; at most one for ``HOT_WINDOWS`` words of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column("t"))
            for part in slices(data, offs, length):
                _, _, whole, seed, _ = grown_windows(part, length)
                _, first = np.unique(whole, return_index=True)
                s, n = np.unique(seed[first], return_counts=True)
                several = n > length - SEED + 1  # more than one context
                yield pa.RecordBatch.from_arrays([pa.array(s[several].view(np.int64)), pa.array(n[several])], names=["s", "n"])

    some = docs.where(F.pmod(F.xxhash64("i"), F.lit(max(1, -(-size // SAMPLE_BYTES)))) == 0)
    found = some.select("t").mapInArrow(tidied(run), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_WINDOWS)
    return np.sort(np.array([r.s for r in found.select("s").collect()], np.int64).view(np.uint64))


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words with one space between them."""
    out = []
    for i in range(0, len(starts), 1 << 17):
        s, size = starts[i : i + (1 << 17)], ends[i : i + (1 << 17)] - starts[i : i + (1 << 17)] + 1
        at = ranges(s, size)
        last = np.cumsum(size) - 1
        at[last] = 0
        part = data[at]
        part[last] = 0x20
        out.append(part.tobytes())
    return b"".join(out)[:-1]


_KEPT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"


def _apply(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column("t"))
            cuts = b.column("cuts")
            for i, j in chunks(offs):
                d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                s, e, first = word_spans(d, o, table_nonspace())
                own = cuts.slice(i, j - i)
                count = pc.fill_null(pc.list_value_length(own), 0).to_numpy()
                flat = own.flatten()
                at, size = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                at = at + np.repeat(first[:-1], count)
                delta = np.zeros(len(s) + 1, np.int32)
                np.add.at(delta, at, 1)
                np.add.at(delta, at + size + length - 1, -1)
                cover = np.cumsum(delta[:-1]) > 0
                # Spans end with their document.
                edge = np.zeros(len(s) + 1, bool)
                edge[first] = True
                opens = np.flatnonzero(cover & (edge[:-1] | ~np.concatenate(([False], cover[:-1]))))
                closes = np.flatnonzero(cover & (edge[1:] | ~np.concatenate((cover[1:], [False])))) + 1
                bounds = np.searchsorted(opens, first)
                base = np.repeat(first[:-1], np.diff(bounds))
                spans = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(opens - base), pa.array(closes - base)], names=["start", "end"]))
                gone = np.concatenate(([0], np.cumsum(cover)))[first]
                kept = []
                for k in range(j - i):
                    left = np.flatnonzero(~cover[first[k] : first[k + 1]]) + first[k]
                    kept.append(joined_words(d, s[left], e[left]) if len(left) else b"")
                arrays = [b.column("i").slice(i, j - i), pa.array(np.diff(first)), pa.array(np.diff(gone)), spans, pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return run


def drop_repeated_passages(df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept): each text's words less those of passages in a smaller doc_id."""
    from helixframe.llm.setjoin import input_bytes

    spark = df.sparkSession
    ensure_importable(spark)
    docs = df.select(F.col(doc_id).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    docs = docs.withColumn("x", F.xxhash64("t"))
    size = input_bytes(docs.select("t"))
    hot = spark.sparkContext.broadcast(crowded_seeds(docs, size, length))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    records = docs.mapInArrow(tidied(_records(2 * parts, hot, length)), _PACKET)
    # What a chunk has removed itself stays where it is.
    place = F.when(F.col("bucket") < 0, F.xxhash64("docs")).otherwise(F.col("bucket").cast("long"))
    cuts = materialize(records.repartition(parts, place).mapInArrow(tidied(_extend), _CUTS), "passage-cuts")
    mine = cuts.groupBy("gi", "gx").agg(F.collect_set(F.struct("start", "windows")).alias("cuts"))
    whole = docs.join(mine, (F.col("i") == F.col("gi")) & (F.col("x") == F.col("gx")), "left").select("i", "t", "cuts")
    return whole.mapInArrow(tidied(_apply(length)), _KEPT)


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
