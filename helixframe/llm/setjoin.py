"""N-gram Jaccard join: a size-aware heavy-light set similarity join, exact, with whole documents as sets.

1. Exchange. Each chunk of documents is a shard; its distinct shingle hashes go, packed, to buckets of the hash
   range. A bucket tells which shingles occur in one document only. A set whose part of shared shingles is below
   the threshold can't link with anything and leaves here; most do. The exchange runs once over documents and once
   over the distinct sets among those that stay, so that exact copies don't keep each other.
2. Candidate components. Sets that share one of their rarest shingles, as many as the prefix filter needs for
   exactness, are tied if sizes and parity bitmaps allow the similarity; a list gives edges that connect its members
   as all such pairs would, never all pairs. Sets that could link share a component, and each set is sent to its
   component once (to a row and column of blocks if a component is large).
3. Heavy-light join inside a component. Light sets enumerate the fixed-size subsets that a linked partner must
   share; heavy sets scan inverted lists and count overlaps. The boundary is the size with the least cost. Links
   are followed breadth first over sets not reached yet, so a dense group costs a few scans, not all its pairs.

Edge cases: null or empty texts have no shingles and link with nothing; rows with a null doc_id keep their count and
get a null component, but link others; rows that share a doc_id share a component when their texts do; texts of any
length are whole sets; extra columns of any name are left out; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.components import connected_components
from helixframe.llm.words import chunks, gram_hashes, mix, table_nonspace, tidied, utf8, within_docs, word_hashes, word_spans
from helixframe.session import ensure_importable, materialize, settled

SHINGLE = 4
PERCENT = 85
#: Bytes of input per bucket of the exchange, and of sets in one block of a component.
BUCKET_BYTES = 512 << 10
#: Bytes of text in one shard: fewer shards make fewer packets.
SHARD_BYTES = 1 << 20
BLOCK_BYTES = 48 << 20
#: Light sets have at most so many shared shingles, whatever the cost says.
MOST_LIGHT = 14

_PACKET = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("docs", pa.binary()), ("tokens", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("sigs", pa.binary())])
_PACKET_DDL = "bucket int, shard long, docs binary, tokens binary, ids array<long>, sizes binary, sigs binary"
_SHARED_DDL = "shard long, docs binary, tokens binary, ranks binary, ids array<long>, sizes binary, sigs binary"
_SET_DDL = "doc_id long, n long, sig long, tokens binary, ranks binary"


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash), distinct and sorted by both, of a chunk of texts."""
    s, e, first = word_spans(data, offs, table_nonspace())
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = word_hashes(data, s, e)
    at = within_docs(first, size)
    doc, g = np.searchsorted(first, at, "right") - 1, gram_hashes(h, size)[at] if len(at) else np.zeros(0, np.uint64)
    words = np.diff(first)
    short = np.flatnonzero((words > 0) & (words < size))
    if len(short):
        own = np.array([gram_hashes(h[first[d] : first[d + 1]], int(words[d]))[0] for d in short], np.uint64)
        doc, g = np.concatenate((doc, short)), np.concatenate((g, mix(own + words[short].astype(np.uint64))))
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], g[new]


def set_signatures(doc: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
    """A hash of each document's whole set."""
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)))))
    cut = np.searchsorted(doc, np.arange(n + 1))
    return mix(sums[cut[1:]] - sums[cut[:-1]] + np.diff(cut).astype(np.uint64))


def _packets(shard: int, ids: list, sizes: np.ndarray, sigs: np.ndarray, doc: np.ndarray, tokens: np.ndarray, bits: int) -> pa.RecordBatch:
    """One packet for each bucket that the shard's tokens reach, and the shard's documents in a packet of bucket -1.

    A bucket is the first ``bits`` bits of a token; a packet holds all the others, in whole bytes.
    """
    bucket = (tokens >> np.uint64(64 - bits)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, doc = bucket[order], doc[order].astype("<u2")
    low = tokens[order] & np.uint64((1 << 64 - bits) - 1)
    raw = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-(64 - bits) // 8)]
    lead = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, np.int64)
    ends = [*lead[1:].tolist(), len(bucket)]
    rows = {"bucket": [-1], "shard": [shard], "docs": [None], "tokens": [None], "ids": [ids], "sizes": [sizes.astype("<i8").tobytes()], "sigs": [sigs.astype("<u8").tobytes()]}
    for a, b in zip(lead.tolist(), ends, strict=False):
        rows["bucket"].append(int(bucket[a]))
        rows["docs"].append(doc[a:b].tobytes())
        rows["tokens"].append(raw[a:b].tobytes())
    more = len(rows["bucket"]) - 1
    rows["shard"] += [shard] * more
    for c in ("ids", "sizes", "sigs"):
        rows[c] += [None] * more
    return pa.RecordBatch.from_pydict(rows, schema=_PACKET)


def _shard_ids() -> Iterator[int]:
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 32
    while True:
        yield at
        at += 1


def _text_packets(bits: int, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _shard_ids()
        for b in batches:
            data, offs = utf8(b.column("t"))
            ids = b.column("doc_id").to_pylist()
            for i, j in chunks(offs, SHARD_BYTES):
                for i2 in range(i, j, 1 << 16):
                    j2 = min(j, i2 + (1 << 16))
                    doc, tok = shingle_sets(data[offs[i2] : offs[j2]], offs[i2 : j2 + 1] - offs[i2], size)
                    n = j2 - i2
                    yield _packets(next(shards), ids[i2:j2], np.bincount(doc, minlength=n), set_signatures(doc, tok, n), doc, tok, bits)

    return run


def _set_packets(bits: int) -> Callable:
    """Packets of sets that an exchange gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _shard_ids()
        for b in batches:
            for i in range(0, b.num_rows, 1 << 12):
                c = b.slice(i, 1 << 12)
                sets = [np.frombuffer(x.as_py(), "<u8") for x in c.column("tokens")]
                tok = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                yield _packets(next(shards), c.column("doc_id").to_pylist(), c.column("n").to_numpy(), c.column("sig").to_numpy().view(np.uint64), doc, tok, bits)

    return run


def _shared_tokens(bits: int) -> Callable:
    """Of each packet, the tokens that occur in several documents, with how common they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("docs", pa.binary()), ("tokens", pa.binary()), ("ranks", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("sigs", pa.binary())])
        packets: list[tuple[int, int, bytes, bytes]] = []
        for b in batches:
            meta = b.filter(pa.compute.equal(b.column("bucket"), -1))
            if meta.num_rows:
                none = pa.nulls(meta.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([meta.column("shard"), none, none, none, *(meta.column(c) for c in ("ids", "sizes", "sigs"))], schema=schema)
            for x in zip(*(b.column(c) for c in ("bucket", "shard", "docs", "tokens")), strict=True):
                if (bucket := x[0].as_py()) >= 0:
                    packets.append((bucket, x[1].as_py(), x[2].as_py(), x[3].as_py()))
        if not packets:
            return
        lengths = np.array([len(p[2]) // 2 for p in packets])
        key = np.zeros((int(lengths.sum()), 8), np.uint8)
        stored = -(-(64 - bits) // 8)
        key[:, :stored] = np.frombuffer(b"".join(p[3] for p in packets), np.uint8).reshape(-1, stored)
        key = key.reshape(-1).view("<u8") | np.repeat(np.array([p[0] for p in packets], np.uint64), lengths) << np.uint64(64 - bits)
        order = np.argsort(key)
        k = key[order]
        lead = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        df = np.diff(np.concatenate((lead, [len(k)])))
        rank = np.minimum(255, np.floor(np.log2(df) * 8)).astype(np.uint8)
        ranks = np.empty(len(k), np.uint8)
        ranks[order] = np.repeat(rank, df)
        at = 0
        rows: dict[str, list] = {c: [] for c in schema.names}
        for (_, shard, docs, _), n in zip(packets, lengths.tolist(), strict=True):
            many = ranks[at : at + n] > 0
            if many.any():
                rows["shard"].append(shard)
                rows["docs"].append(np.frombuffer(docs, "<u2")[many].tobytes())
                rows["tokens"].append(key[at : at + n][many].tobytes())
                rows["ranks"].append(ranks[at : at + n][many].tobytes())
            at += n
            if len(rows["shard"]) >= 2000:
                yield pa.RecordBatch.from_pydict(rows | {c: [None] * len(rows["shard"]) for c in ("ids", "sizes", "sigs")}, schema=schema)
                rows = {c: [] for c in schema.names}
        if rows["shard"]:
            yield pa.RecordBatch.from_pydict(rows | {c: [None] * len(rows["shard"]) for c in ("ids", "sizes", "sigs")}, schema=schema)

    return run


def _shard_sets(percent: int) -> Callable:
    """A shard's documents; those whose shared tokens may suffice carry them, rarest first."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("tokens", pa.binary()), ("ranks", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        ids, sizes, sigs, docs, tokens, ranks = [], None, None, [], [], []
        for r in t.select(["ids", "sizes", "sigs", "docs", "tokens", "ranks"]).to_pylist():
            if r["docs"] is None:
                ids, sizes, sigs = r["ids"], np.frombuffer(r["sizes"], "<i8"), np.frombuffer(r["sigs"], "<i8")
            else:
                docs.append(np.frombuffer(r["docs"], "<u2"))
                tokens.append(np.frombuffer(r["tokens"], "<u8"))
                ranks.append(np.frombuffer(r["ranks"], np.uint8))
        doc = np.concatenate(docs) if docs else np.zeros(0, np.uint16)
        tok = np.concatenate(tokens) if docs else np.zeros(0, np.uint64)
        rank = np.concatenate(ranks) if docs else np.zeros(0, np.uint8)
        shared = np.bincount(doc, minlength=len(ids))
        may = (sizes > 0) & (100 * shared >= percent * sizes)
        keep = may[doc] if len(doc) else np.zeros(0, bool)
        doc, tok, rank = doc[keep], tok[keep], rank[keep]
        order = np.lexsort((tok, rank, doc))
        doc, tok, rank = doc[order], tok[order], rank[order]
        cut = np.searchsorted(doc, np.arange(len(ids) + 1))
        own = [(tok[a:b].tobytes(), rank[a:b].tobytes()) if m else (None, None) for a, b, m in zip(cut[:-1].tolist(), cut[1:].tolist(), may.tolist(), strict=True)]
        return pa.Table.from_pydict({"doc_id": ids, "n": sizes, "sig": sigs, "tokens": [x for x, _ in own], "ranks": [y for _, y in own]}, schema=schema)

    return run


def _exchange(packets: DataFrame, percent: int, parts: int, bits: int) -> DataFrame:
    # The documents of a shard pass by its own number, so that bucket -1 isn't one key.
    key = F.when(F.col("bucket") < 0, F.col("shard")).otherwise(F.col("bucket").cast("long"))
    shared = packets.repartition(parts, key).mapInArrow(tidied(_shared_tokens(bits)), _SHARED_DDL)
    return shared.groupBy("shard").applyInArrow(_shard_sets(percent), _SET_DDL)


def input_bytes(df: DataFrame, text: str = "t") -> int:
    """The optimizer's estimate, from file sizes; the texts' bytes, counted, where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """Least overlap of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def _light_links(sets: list[np.ndarray], sizes: np.ndarray, light: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links among light sets: equal subsets of the size that the pair needs."""
    by_subset: dict[tuple, list[int]] = {}
    for v in light.tolist():
        n, t = int(sizes[v]), sorted(sets[v].tolist())
        lo, hi = -(-percent * n // 100), n * 100 // percent
        for c in sorted({needed(n, m, percent) for m in range(max(lo, 1), hi + 1)}):
            if c <= len(t):
                for sub in combinations(t, c):
                    by_subset.setdefault(sub, []).append(v)
    for sub, vs in by_subset.items():
        if len(vs) > 1:
            first = min(vs, key=lambda v: sizes[v])
            for v in vs:
                if v != first and needed(int(sizes[first]), int(sizes[v]), percent) <= len(sub):
                    yield first, v


def boundary(sizes: np.ndarray, shared: np.ndarray, scan: np.ndarray, percent: int = PERCENT) -> int:
    """The size up to which enumerating subsets costs less than scanning lists."""
    best, at = float(scan.sum()), 0
    for x in range(1, MOST_LIGHT + 1):
        small = np.flatnonzero(sizes <= x)
        enum = 0
        for n, k in zip(sizes[small].tolist(), shared[small].tolist(), strict=True):
            cs = {needed(n, m, percent) for m in range(max(1, -(-percent * n // 100)), n * 100 // percent + 1)}
            enum += sum(comb(k, c) for c in cs if c <= k)
        cost = 4.0 * enum + float(scan[sizes > x].sum())
        if cost < best:
            best, at = cost, x
    return at


def linked_components(sets: list[np.ndarray], sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Component number of each set: links are Jaccard similarities of at least ``percent``, none is missed.

    ``sets`` hold the shared shingles, ``sizes`` count all of a set's shingles.
    """
    n = len(sets)
    shared = np.array([len(x) for x in sets])
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    _, code, df = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), shared)
    ptr = np.concatenate(([0], np.cumsum(shared)))
    scan = np.add.reduceat(df[code], ptr[:-1][shared > 0]) if len(flat) else np.zeros(0)
    cost = np.zeros(n)
    cost[shared > 0] = scan
    edge = boundary(sizes, shared, cost, percent)
    heavy = sizes > edge
    near: dict[int, list[int]] = {}
    for a, b in _light_links(sets, sizes, np.flatnonzero(~heavy), percent):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    scans = bool(heavy.any())
    comp = np.full(n, -1)
    open_ = np.ones(n, bool)
    left = indexed = n

    def index() -> tuple[np.ndarray, np.ndarray]:
        live = open_[owner]
        o = np.argsort(code[live], kind="stable")
        return owner[live][o], np.searchsorted(code[live][o], np.arange(len(df) + 1))

    lists, start = index() if scans else (None, None)
    for seed in range(n):
        if not open_[seed]:
            continue
        comp[seed], open_[seed] = seed, False
        left -= 1
        queue = [seed]
        while queue and left:
            v = queue.pop()
            found = [u for u in near.get(v, ()) if open_[u]]
            if scans:
                if left * 2 < indexed:
                    lists, start = index()
                    indexed = left
                mine = code[ptr[v] : ptr[v + 1]]
                a, m = start[mine], start[mine + 1] - start[mine]
                at = np.repeat(a - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(int(m.sum())) if len(m) else a
                both = np.bincount(lists[at], minlength=n)
                ok = open_ & (both > 0) & (100 * both >= percent * (sizes[v] + sizes - both))
                if not heavy[v]:
                    ok &= heavy
                found.extend(np.flatnonzero(ok).tolist())
            for u in set(found):
                comp[u], open_[u] = seed, False
                left -= 1
                queue.append(u)
    return comp


_PREFIX = pa.schema([("g", pa.int32()), ("level", pa.int32()), ("sig", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("bitmap", pa.binary()), ("tokens", pa.binary())])
_PREFIX_DDL = "g int, level int, sig long, n long, own long, bitmap binary, tokens binary"
#: Sets of up to so many shingles, and the bits of their bitmaps; a set a little above a limit is on both levels.
LEVELS = ((1_300, 512), (10_000, 4_096), (80_000, 32_768), (1 << 62, 262_144))


def parity_bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the shingles that fall on each bit: two bitmaps differ in no more bits than the sets in shingles."""
    odd = np.bincount((tokens >> np.uint64(20)) % np.uint64(bits), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def most_apart(a, b, percent: int = PERCENT):
    """Largest symmetric difference of linked sets of sizes a and b."""
    return a + b - 2 * (-(-percent * (a + b) // (100 + percent)))


def _prefixes(groups: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {c: [] for c in _PREFIX.names}
            for n, s, t in zip(b.column("n").to_pylist(), b.column("sig").to_pylist(), b.column("tokens"), strict=True):
                tok = np.frombuffer(t.as_py(), "<u8")
                own = n - len(tok)
                pre = tok[: n - -(-percent * n // 100) + 1 - own]
                g = (mix(pre) % np.uint64(groups)).astype(np.int64)
                low = 0
                for level, (limit, bits) in enumerate(LEVELS):
                    if low < n and n * percent <= limit * 100:
                        bitmap = parity_bitmap(tok, bits).tobytes()
                        for k in np.unique(g).tolist():
                            for c, x in zip(_PREFIX.names, (k, level, s, n, own, bitmap, pre[g == k].tobytes()), strict=True):
                                rows[c].append(x)
                    low = limit
            if rows["g"]:
                yield pa.RecordBatch.from_pydict(rows, schema=_PREFIX)

    return run


def near_in_list(members: np.ndarray, n: np.ndarray, own: np.ndarray, bitmaps: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges that connect the members of a list as all pairs within the bounds would, breadth first."""
    out, left = [], members
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            v = queue.pop()
            apart = np.bitwise_count(bitmaps[left] ^ bitmaps[v]).sum(1, dtype=np.int64) + own[left] + own[v]
            ok = apart <= most_apart(n[left], n[v], percent)
            out.extend((int(v), int(u)) for u in left[ok])
            queue.extend(left[ok].tolist())
            left = left[~ok]
    return out


def _near_lists(percent: int) -> Callable:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        edges: set[tuple[int, int]] = set()
        for level in range(len(LEVELS)):
            rows = t.filter(pa.compute.equal(t.column("level"), level))
            if not rows.num_rows:
                continue
            sig, n, own = (rows.column(c).to_numpy() for c in ("sig", "n", "own"))
            bitmaps = np.frombuffer(b"".join(rows.column("bitmap").to_pylist()), np.uint64).reshape(len(sig), -1)
            toks = [np.frombuffer(x.as_py(), "<u8") for x in rows.column("tokens")]
            owner = np.repeat(np.arange(len(sig)), [len(x) for x in toks])
            tok = np.concatenate(toks)
            order = np.argsort(tok, kind="stable")
            tok, owner = tok[order], owner[order]
            lead = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
            size = np.diff(np.concatenate((lead, [len(tok)])))
            # Lists of two at once; copies of one list of members need one look.
            two = lead[size == 2]
            x, y = owner[two], owner[two + 1]
            both = np.unique(x * len(sig) + y)
            x, y = both // len(sig), both % len(sig)
            ok = np.bitwise_count(bitmaps[x] ^ bitmaps[y]).sum(1, dtype=np.int64) + own[x] + own[y] <= most_apart(n[x], n[y], percent)
            edges.update(zip(sig[x[ok]].tolist(), sig[y[ok]].tolist(), strict=True))
            seen: set[bytes] = set()
            for k, m in zip(lead[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                members = owner[k : k + m]
                if (key := members.tobytes()) not in seen:
                    seen.add(key)
                    edges.update((int(sig[u]), int(sig[v])) for u, v in near_in_list(members, n, own, bitmaps, percent))
        a, b = np.array(list(edges), np.int64).reshape(-1, 2).T if edges else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.Table.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return run


def _link(percent: int) -> Callable:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        sig = t.column("sig").to_numpy()
        sets = [np.frombuffer(x.as_py(), "<u8") for x in t.column("tokens")]
        comp = linked_components(sets, t.column("n").to_numpy(), percent)
        low = np.full(len(sig), np.iinfo(np.int64).max)
        np.minimum.at(low, comp, sig)
        root = low[comp]
        return pa.Table.from_arrays([pa.array(sig[sig != root]), pa.array(root[sig != root])], schema=schema)

    return run


@settled("jaccard-classes")
def jaccard_classes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``df``."""
    spark = df.sparkSession
    ensure_importable(spark)
    src = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    bits = max(4, min(20, (input_bytes(src) // BUCKET_BYTES).bit_length()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 8)
    docs = materialize(_exchange(src.mapInArrow(tidied(_text_packets(bits, size)), _PACKET_DDL), percent, parts, bits), "sets", codec="uncompressed")

    # Exact copies: the smallest document of each distinct set stands for it.
    may = docs.where(F.col("tokens").isNotNull()).withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    first = may.groupBy("sig").agg(F.min("k").alias("k"))
    distinct = may.join(first, ["sig", "k"]).dropDuplicates(["sig"])
    bits2 = max(4, bits - 2)
    again = distinct.select("doc_id", "n", "sig", "tokens").mapInArrow(tidied(_set_packets(bits2)), _PACKET_DDL)
    sets = materialize(_exchange(again, percent, parts, bits2).where(F.col("tokens").isNotNull()), "near-sets", codec="uncompressed")

    # Sets that share one of their rarest shingles, as many as the prefix filter needs, and pass the size and bitmap
    # bounds. Each set goes to a group once with the shingles that belong there.
    groups = max(32, parts // 4)
    packed = sets.select("n", "sig", "tokens").mapInArrow(tidied(_prefixes(groups, percent)), _PREFIX_DDL)
    edges = packed.groupBy("g").applyInArrow(_near_lists(percent), "a long, b long").distinct()
    label = connected_components(edges, "near-components")
    label = label.union(label.select("root", "root").distinct())

    owned = sets.select("n", "sig", "tokens").join(label.select(F.col("node").alias("sig"), F.col("root").alias("comp")), "sig")
    weight = sets.select("sig", F.octet_length("tokens").alias("w")).join(label.select(F.col("node").alias("sig"), F.col("root").alias("comp")), "sig").groupBy("comp").agg(F.sum("w").alias("w")).where(F.col("w") > BLOCK_BYTES).select("comp", F.ceil(F.col("w") / BLOCK_BYTES).cast("int").alias("blocks"))
    weight = materialize(weight, "large-components")
    split = weight.limit(1).count() > 0
    if split:
        block = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
        owned = owned.join(weight, "comp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", block).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        owned = owned.withColumn("i", F.least("mine", "o")).withColumn("j", F.greatest("mine", "o"))
    else:
        owned = owned.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    links = owned.select("comp", "i", "j", "sig", "n", "tokens").groupBy("comp", "i", "j").applyInArrow(_link(percent), "a long, b long")
    found = connected_components(links, "classes") if split else materialize(links, "classes").select(F.col("a").alias("node"), F.col("b").alias("root"))

    own = docs.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sig")).alias("sig"))
    by_set = own.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows"))
    heads = found.select("root").distinct().select(F.col("root").alias("node"), "root")
    roots = found.union(heads)
    several = by_set.join(roots, by_set.sig == roots.node, "left").where(F.col("root").isNotNull() | (F.col("rows") > 1)).select("sig", "low", F.coalesce("root", "sig").alias("root"))
    lowest = several.groupBy("root").agg(F.min("low").alias("component"))
    classes = materialize(several.join(lowest, "root").select("sig", "component"), "class-ids")
    return own.join(classes, "sig", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
