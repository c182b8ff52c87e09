"""Suffix-array dedup: exact removal of byte strings that occur earlier in the corpus.

1. Anchors. In every window of ``LENGTH`` bytes the k-gram with the least hash, leftmost on ties, is the window's
   anchor: equal windows have equal anchors at equal offsets. Windows of one document that follow each other with
   one anchor make a fragment. Fragments, not texts, are compared.
2. Exchange. Each chunk of documents sends the first of its equal fragments, packed, to a bucket of the anchor's
   hash; later ones are removed there and then, so a passage that a third of the corpus repeats arrives once a
   chunk. A bucket keeps the first of equal fragments, removes the others, and asks for the bytes of those whose
   anchor has several different fragments: the ends of shared passages.
3. Suffix sorting of these. Groups of fragments are laid end to end; suffixes smaller than their successors are
   sorted directly, the others induced from them by one scan over the buckets of first bytes; adjacent common
   prefixes of LENGTH bytes or more show the repeated windows. An anchor with more than ``MOST_FRAGMENTS`` different
   fragments would make one group too large; its windows are compared by a 128-bit digest in a grouped aggregate, with
   the same result.

Fragments of one anchor count as equal where their 64-bit hashes are; beyond that, bytes are compared.

Edge cases: null texts are empty; texts under LENGTH bytes lose nothing; rows with a null doc_id are left whole and
remove nothing elsewhere; rows that share a doc_id are one place in the order, so none removes from another what
starts at the same offset, and what one loses is told from what another does by the text's hash; extra columns of any
name are left out; a text is looked at whole, so a worker needs some thirty times the size of the longest; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.words import chunks, mix, prefix_sums, ranges, span_hashes, tidied, utf8
from helixframe.session import ensure_importable, materialize

LENGTH = 100
GRAM = 24
MOST_FRAGMENTS = 20_000
BUCKET_BYTES = 512 << 10
#: Bytes of text in one shard: fewer shards make fewer packets.
SHARD_BYTES = 2 << 20
GROUP_BYTES = 2 << 20


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m, have = x, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return m if have == width else np.minimum(m[: len(m) - (width - have)], m[width - have :])


def fragments(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Fragments of a chunk: document, first window, windows, anchor hash, fragment hash."""
    n = len(data)
    none = {k: np.zeros(0, t) for k, t in (("doc", np.int64), ("start", np.int64), ("windows", np.int64), ("anchor", np.uint64), ("hash", np.uint64))}
    if n < length:
        return none
    sums = prefix_sums(data)
    at = np.arange(n - gram + 1)
    h = span_hashes(sums, at, at + gram)
    least = sliding_min((h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), length - gram + 1)
    where = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(offs)
    long = np.flatnonzero(size >= length)
    v = ranges(offs[:-1][long], size[long] - length + 1)
    if not len(v):
        return none
    a = where[v]
    lead = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (v[1:] != v[:-1] + 1))))
    count = np.diff(np.concatenate((lead, [len(v)])))
    start = v[lead]
    doc = np.searchsorted(offs, start, "right") - 1
    whole = mix(span_hashes(sums, start, start + count - 1 + length) + count.astype(np.uint64))
    return {"doc": doc, "start": start - offs[doc], "windows": count, "anchor": h[a[lead]], "hash": whole}


_PACKET = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("anchors", pa.binary()), ("hashes", pa.binary()), ("docs", pa.binary()), ("keys", pa.binary()), ("starts", pa.binary()), ("windows", pa.binary())])
_PACKET_DDL = "bucket int, shard long, anchors binary, hashes binary, docs binary, keys binary, starts binary, windows binary"
_FOUND = pa.schema([("kind", pa.int32()), ("anchors", pa.binary()), ("docs", pa.binary()), ("keys", pa.binary()), ("starts", pa.binary()), ("windows", pa.binary())])
_FOUND_DDL = "kind int, anchors binary, docs binary, keys binary, starts binary, windows binary"
REMOVE, ASK, ASK_HOT = 0, 1, 2
_LOW_BITS = 40


def _low_bytes(x: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _from_low(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return out.reshape(-1).view("<u8")


def _at_least_place(anchors: np.ndarray, hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of fragments in order: which is the first of its equals, and which lie at a later place than that."""
    new = np.ones(len(anchors), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (hashes[1:] != hashes[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(anchors)), 0))
    return new, ~new & ((docs != docs[lead]) | (starts != starts[lead]))


def _fragment_packets(bits: int) -> Callable:
    """Packets of the first of equal fragments by bucket; one packet of bucket -1 with what is removed already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for b in batches:
            b = b.filter(pc.is_valid(b.column("doc_id")))
            data, offs = utf8(b.column("t"))
            ids, xs = b.column("doc_id").to_numpy(), b.column("x").to_numpy()
            for i, j in chunks(offs, SHARD_BYTES):
                f = fragments(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                doc, key = ids[i:j][f["doc"]], xs[i:j][f["doc"]]
                order = np.lexsort((key, f["start"], doc, f["hash"], f["anchor"]))
                a, h, doc, key, start, w = f["anchor"][order], f["hash"][order], doc[order], key[order], f["start"][order], f["windows"][order]
                _, later = _at_least_place(a, h, doc, start)
                # Rows that are equal in all say the same once.
                again = np.zeros(len(a), bool)
                again[1:] = (a[1:] == a[:-1]) & (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1]) & (key[1:] == key[:-1])
                rows: dict[str, list] = {c: [] for c in _PACKET.names}

                def put(bucket: int, m, rows=rows, a=a, h=h, doc=doc, key=key, start=start, w=w, shard=shard) -> None:
                    rows["bucket"].append(bucket)
                    rows["shard"].append(shard)
                    rows["anchors"].append(_low_bytes(a[m] >> np.uint64(64 - bits - _LOW_BITS), 5) if bucket >= 0 else None)
                    rows["hashes"].append(h[m].astype("<u8").tobytes() if bucket >= 0 else None)
                    rows["docs"].append(doc[m].astype("<i8").tobytes())
                    rows["keys"].append(key[m].astype("<i8").tobytes())
                    rows["starts"].append(start[m].astype("<i4").tobytes())
                    rows["windows"].append(w[m].astype(np.uint8).tobytes())

                if (later & ~again).any():
                    put(-1, later & ~again)
                # Anchors are sorted, so buckets are ranges; in each, documents ascend to compress well.
                keep = np.flatnonzero(~later & ~again)
                bucket = (a[keep] >> np.uint64(64 - bits)).astype(np.int64)
                keep = keep[np.lexsort((start[keep], doc[keep], bucket))]
                cut = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    put(k, keep[cut[k] : cut[k + 1]])
                shard += 1
                if rows["bucket"]:
                    yield pa.RecordBatch.from_pydict(rows, schema=_PACKET)

    return run


_CUT = (("docs", "<i8"), ("keys", "<i8"), ("starts", "<i4"), ("windows", np.uint8))


def _found_rows(kind: int, anchors: np.ndarray, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(arrays[0]), 1 << 16):
        m = slice(i, i + (1 << 16))
        row = {"kind": [kind], "anchors": [anchors[m].astype("<u8").tobytes()]}
        yield pa.RecordBatch.from_pydict(row | {c: [x[m].astype(t).tobytes()] for (c, t), x in zip(_CUT, arrays, strict=True)}, schema=_FOUND)


def _bucket_fragments(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, hashes, cuts = [], [], []
        for b in batches:
            for r in b.to_pylist():
                own = [np.frombuffer(r[c], t) for c, t in _CUT]
                if r["bucket"] < 0:
                    yield from _found_rows(REMOVE, np.zeros(0, np.uint64), *own)
                    continue
                anchors.append(_from_low(r["anchors"], 5) | np.uint64(r["bucket"]) << np.uint64(_LOW_BITS))
                hashes.append(np.frombuffer(r["hashes"], "<u8"))
                cuts.append(own)
        if not anchors:
            return
        a, h = np.concatenate(anchors), np.concatenate(hashes)
        d, x, s, w = (np.concatenate(c) for c in zip(*cuts, strict=True))
        del anchors, hashes, cuts
        order = np.lexsort((x, s, d, h, a))
        a, h, d, x, s, w = a[order], h[order], d[order], x[order], s[order], w[order]
        new, later = _at_least_place(a, h, d, s)
        yield from _found_rows(REMOVE, np.zeros(0, np.uint64), d[later], x[later], s[later], w[later])
        # Fragments by anchor: those with equals at the least place are asked for alike.
        group = np.cumsum(np.concatenate(([True], a[1:] != a[:-1]))) - 1
        several = np.bincount(group, weights=new).astype(np.int64)[group]
        for kind, m in ((ASK, ~later & (several > 1) & (several <= most)), (ASK_HOT, ~later & (several > most))):
            yield from _found_rows(kind, a[m], d[m], x[m], s[m], w[m])

    return run


_CUT_DDL = "doc_id long, x long, start int, windows int"


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            d, x, s, w = (np.frombuffer(r[c], t) for c, t in _CUT)
            a = np.frombuffer(r["anchors"], "<i8") if r["kind"] else np.zeros(len(d), np.int64)
            arrays = [pa.array(d), pa.array(x), pa.array(s), pa.array(w.astype(np.int32)), pa.array(a), pa.array(np.full(len(d), r["kind"], np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "x", "start", "windows", "anchor", "kind"])


_SYMBOLS = 7  # of 9 bits in one 64-bit key


def symbol_keys(text: np.ndarray) -> np.ndarray:
    """The next seven symbols of each position in one integer; positions past the end hold zeros."""
    t = np.concatenate((text, np.zeros(_SYMBOLS, text.dtype))).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(_SYMBOLS):
        out = out << np.uint64(9) | t[k : k + len(text)]
    return np.concatenate((out, np.zeros(1, np.uint64)))


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than the suffix one place on; the last suffix is not."""
    n = len(text)
    step = np.full(n, -1, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    decided = np.where(step != 0, np.arange(n), n - 1)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    return step[decided] > 0


def _sort_directly(pos: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` symbols; only ties go on to the next key."""
    k = keys[pos]
    order = np.argsort(k, kind="stable")
    pos, k = pos[order], k[order]
    head = np.ones(len(pos), bool)
    head[1:] = k[1:] != k[:-1]
    for at in range(_SYMBOLS, depth, _SYMBOLS):
        tied = ~head
        tied[:-1] |= ~head[1:]
        idx = np.flatnonzero(tied)
        if not len(idx):
            break
        group = np.cumsum(head)[idx]
        k = keys[np.minimum(pos[idx] + at, len(keys) - 1)]
        order = np.lexsort((k, group))
        pos[idx], k = pos[idx[order]], k[order]
        head[idx[1:]] |= (k[1:] != k[:-1]) & (group[1:] == group[:-1])
    return pos


def suffix_order(text: np.ndarray, keys: np.ndarray, depth: int = LENGTH + _SYMBOLS) -> np.ndarray:
    """All suffixes by their first ``depth`` symbols: the smaller kind sorted, the others induced.

    A suffix that is larger than its successor follows from the successor's rank: scanning buckets of first symbols
    upwards, each suffix met puts its predecessor, if that begins with a larger symbol, at the end of the front part
    of that symbol's bucket. Predecessors with the same symbol join the part being scanned, in waves.
    """
    n = len(text)
    direct = _sort_directly(np.flatnonzero(smaller_than_successor(text)), keys, depth)
    symbols = int(text.max()) + 1
    cut = np.searchsorted(text[direct], np.arange(symbols + 1))
    front: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    front[int(text[-1])].append(np.array([n - 1]))
    out = []
    for c in range(symbols):
        part = []
        wave = np.concatenate(front[c]) if front[c] else np.zeros(0, np.int64)
        while len(wave):
            part.append(wave)
            before = wave[wave > 0] - 1
            wave = before[text[before] == c]
        part.append(direct[cut[c] : cut[c + 1]])
        whole = np.concatenate(part)
        if not len(whole):
            continue
        out.append(whole)
        before = whole[whole > 0] - 1
        t = text[before]
        before, t = before[t > c], t[t > c]
        order = np.argsort(t, kind="stable")
        before, t = before[order], t[order]
        lead = np.flatnonzero(np.diff(t.astype(np.int32), prepend=-1))
        for x, y in zip(lead.tolist(), [*lead[1:].tolist(), len(t)], strict=False):
            front[int(t[x])].append(before[x:y])
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, keys: np.ndarray, cap: int = LENGTH) -> np.ndarray:
    """Symbols that each suffix shares with the one before it, up to ``cap``; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    last = len(keys) - 1
    for at in range(0, cap, _SYMBOLS):
        a, b = keys[np.minimum(order[live - 1] + at, last)], keys[np.minimum(order[live] + at, last)]
        x = a ^ b
        differ = x != 0
        if differ.any():
            top = np.floor(np.log2(x[differ].astype(np.longdouble))).astype(np.int64)
            out[live[differ]] = at + _SYMBOLS - 1 - top // 9
        live = live[~differ]
    out[live] = cap
    return np.minimum(out, cap)


def repeated_windows(pieces: list[bytes], docs: np.ndarray, starts: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(piece, start in its document) of the windows of ``pieces`` that an earlier place of another piece holds too."""
    sizes = np.array([len(p) + 1 for p in pieces])
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    text = raw.astype(np.uint16) + 1
    text[at + sizes - 1] = 0
    keys = symbol_keys(text)
    piece = np.full(len(text), -1)
    piece[ranges(at, windows)] = np.repeat(np.arange(len(pieces)), windows)
    order = suffix_order(text, keys)
    order = order[piece[order] >= 0]
    same = common_prefixes(order, keys, length) >= length
    group = np.cumsum(~same)
    own = piece[order]
    doc, start = docs[own], starts[own] + order - at[own]
    shared = same.copy()
    shared[:-1] |= same[1:]
    own, doc, start, group = own[shared], doc[shared], start[shared], group[shared]
    rank = np.lexsort((start, doc, group))
    own, doc, start, group = own[rank], doc[rank], start[rank], group[rank]
    head = np.ones(len(group), bool)
    head[1:] = group[1:] != group[:-1]
    lead = np.maximum.accumulate(np.where(head, np.arange(len(group)), 0)) if len(group) else np.zeros(0, np.int64)
    gone = (doc != doc[lead]) | (start != start[lead])
    return own[gone], start[gone]


def _as_ranges(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts in one row, each start once."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    head = np.ones(len(row), bool)
    new = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)
    head[1:] = new
    # No run exceeds 100 windows, so that a run packs into seven bits.
    first = np.maximum.accumulate(np.where(head, np.arange(len(row)), 0)) if len(row) else np.zeros(0, np.int64)
    head |= (start - start[first]) % 100 == 0
    head[1:] &= (start[1:] != start[:-1]) | (row[1:] != row[:-1])
    lead = np.flatnonzero(head)
    last = np.concatenate((lead[1:] - 1, [len(row) - 1])) if len(lead) else lead
    return row[lead], start[lead], start[last] - start[lead] + 1


_RANGES = pa.schema([("doc_id", pa.int64()), ("x", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())])


def _suffix_group(t: pa.Table) -> pa.Table:
    pieces = [x.as_py() for x in t.column("piece")]
    docs, keys = t.column("doc_id").to_numpy(), t.column("x").to_numpy()
    starts, windows = (t.column(c).to_numpy().astype(np.int64) for c in ("start", "windows"))
    piece, start = repeated_windows(pieces, docs, starts, windows)
    # Pieces of one row are one row again.
    rows, row = np.unique(np.stack((docs, keys)), axis=1, return_inverse=True)
    r, s, w = _as_ranges(row.reshape(-1)[piece], start)
    return pa.Table.from_arrays([pa.array(rows[0][r]), pa.array(rows[1][r]), pa.array(s.astype(np.int32)), pa.array(w.astype(np.int32))], schema=_RANGES)


_PIECE = pa.schema([("anchor", pa.int64()), ("hot", pa.bool_()), ("doc_id", pa.int64()), ("x", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("piece", pa.binary())])
_PIECE_DDL = "anchor long, hot boolean, doc_id long, x long, start int, windows int, piece binary"


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for d, x, t, asks in zip(*(b.column(c).to_pylist() for c in ("doc_id", "x", "t", "asks")), strict=True):
            raw = t.encode()
            rows = {c: [y[c] for y in asks] for c in ("anchor", "hot", "start", "windows")}
            rows |= {"doc_id": [d] * len(asks), "x": [x] * len(asks), "piece": [raw[y["start"] : y["start"] + y["windows"] - 1 + LENGTH] for y in asks]}
            yield pa.RecordBatch.from_pydict(rows, schema=_PIECE)


def _hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("w", pa.binary()), ("doc_id", pa.int64()), ("x", pa.int64()), ("start", pa.int32())])
    for b in batches:
        for d, x, s, w, p in zip(*(b.column(c).to_pylist() for c in ("doc_id", "x", "start", "windows", "piece")), strict=True):
            own = [hashlib.blake2b(p[k : k + LENGTH], digest_size=16).digest() for k in range(w)]
            yield pa.RecordBatch.from_pydict({"w": own, "doc_id": [d] * w, "x": [x] * w, "start": [s + k for k in range(w)]}, schema=schema)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, size, gone, spans = [], [], [], []
        for t, cuts in zip(b.column("t").to_pylist(), b.column("cuts").to_pylist(), strict=True):
            raw = t.encode()
            size.append(len(raw))
            if not cuts:
                kept.append(raw)
                gone.append(0)
                spans.append(0)
                continue
            c = np.array(cuts, np.int64)
            delta = np.zeros(len(raw) + 1, np.int64)
            lo, hi = c >> 7, np.minimum((c >> 7) + (c & 127) - 1 + LENGTH, len(raw))
            ok = lo < len(raw)
            np.add.at(delta, lo[ok], 1)
            np.add.at(delta, hi[ok], -1)
            cover = np.cumsum(delta[:-1]) > 0
            kept.append(np.frombuffer(raw, np.uint8)[~cover].tobytes())
            gone.append(int(cover.sum()))
            spans.append(int((cover & ~np.concatenate(([False], cover[:-1]))).sum()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def drop_repeated_bytes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = MOST_FRAGMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text's bytes less those of strings that occur earlier."""
    from helixframe.llm.setjoin import input_bytes

    spark = df.sparkSession
    ensure_importable(spark)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    bits = max(4, min(64 - _LOW_BITS, (input_bytes(docs) // BUCKET_BYTES).bit_length()))
    docs = docs.withColumn("x", F.xxhash64("t"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 8)
    packets = docs.mapInArrow(tidied(_fragment_packets(bits)), _PACKET_DDL)
    key = F.when(F.col("bucket") < 0, F.col("shard")).otherwise(F.col("bucket").cast("long"))
    found = materialize(packets.repartition(parts, key).mapInArrow(tidied(_bucket_fragments(most)), _FOUND_DDL), "fragments")
    rows = found.mapInArrow(_unpack, _CUT_DDL + ", anchor long, kind int")
    removed = rows.where(F.col("kind") == REMOVE).select("doc_id", "x", "start", "windows")

    asked = found.where(F.col("kind") != REMOVE).agg(F.sum(F.octet_length("windows")).alias("n"), F.max("kind").alias("kind")).first()
    if asked.n:
        ask = F.struct("start", "windows", "anchor", (F.col("kind") == ASK_HOT).alias("hot"))
        wanted = rows.where(F.col("kind") != REMOVE).groupBy("doc_id", "x").agg(F.collect_set(ask).alias("asks"))
        pieces = docs.join(wanted, ["doc_id", "x"]).mapInArrow(tidied(_cut_pieces), _PIECE_DDL)
        groups = max(parts, asked.n * (LENGTH + 40) // GROUP_BYTES)
        own = pieces.where("not hot").withColumn("g", F.pmod(F.xxhash64("anchor"), F.lit(groups)))
        more = own.groupBy("g").applyInArrow(_suffix_group, _CUT_DDL)
        if asked.kind == ASK_HOT:
            each = materialize(pieces.where("hot").mapInArrow(_hash_windows, "w binary, doc_id long, x long, start int"), "windows")
            place = F.struct("doc_id", "start")
            low = each.groupBy("w").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least <> most").select("w", "least")
            more = more.union(each.join(low, "w").where(place != F.col("least")).select("doc_id", "x", "start", F.lit(1).alias("windows")))
        removed = removed.union(materialize(more, "repeats"))
    cuts = removed.groupBy(F.col("doc_id").alias("gi"), F.col("x").alias("gx"))
    cuts = cuts.agg(F.collect_set(F.shiftleft(F.col("start").cast("long"), 7) + F.col("windows").cast("long")).alias("cuts"))
    whole = docs.join(cuts, (F.col("doc_id") == F.col("gi")) & (F.col("x") == F.col("gx")), "left").select("doc_id", "t", "cuts")
    return whole.mapInArrow(tidied(_apply), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
