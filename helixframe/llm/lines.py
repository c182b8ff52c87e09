"""Line dedup over sharded minimal perfect hashing.

Every distinct key of a repeated line gets a slot by a minimal perfect hash built per shard (levels of bit arrays;
keys that collide on a level go to the next one). Slots index compact arrays: a 64-bit fingerprint, the number of
documents and the largest doc_id. Documents probe the arrays while their text streams by, so texts are never
shuffled and lines never joined, as long as the arrays fit ``BROADCAST_BYTES``. A larger index stays on the executors:
the hashes of a batch's lines go, packed, to a task that holds the arrays of their shard, once for all packets that come
there, and only the numbers of the lines to drop come back to their documents. Every shard's arrays are sent to
``SALTS`` tasks, so that a line of very many documents doesn't lead them all to one.

Edge cases: texts of any length are split whole; extra columns of any name are left out; null or empty texts are one
empty line; rows that share a doc_id count as one document; rows with a null doc_id hold no keys, their lines go where a
key qualifies; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.words import mix, tidied
from helixframe.session import ensure_importable, materialize

MIN_CHARS = 20
MIN_DOCS = 3
#: Bytes of arrays that are sent to every worker; a larger index is probed shard by shard.
BROADCAST_BYTES = 48 << 20
ENTRY_BYTES = 28
SHARD_KEYS = 1 << 16
#: Tasks among which the packets of one shard are dealt.
SALTS = 16
GAMMA = 1.6
_WS = " \t\n\x0b\x0c\r"


def line_key(line: str) -> bytes | None:
    """The key of a line, None where it has fewer than MIN_CHARS code points."""
    k = line.strip(_WS)
    return k.encode().lower() if len(k) >= MIN_CHARS else None


def _hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def build_mph(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays by level, and the slot of each of the distinct keys."""
    slots = np.zeros(len(keys), np.int64)
    left, level, base, bits = np.arange(len(keys)), 0, 0, []
    while len(left):
        size = max(8, int(len(left) * GAMMA) + 1)
        at = (mix(keys[left] + np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)
        once = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(once) - 1
        done = once[at]
        slots[left[done]] = base + rank[at[done]]
        base += int(once.sum())
        bits.append(once)
        left, level = left[~done], level + 1
    return bits, slots


def probe_mph(bits: list[np.ndarray], ranks: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slots of keys, -1 where no level holds one; a foreign key may get any slot, its fingerprint tells."""
    out = np.full(len(keys), -1, np.int64)
    left = np.arange(len(keys))
    for level, (b, r) in enumerate(zip(bits, ranks, strict=True)):
        if not len(left):
            break
        at = (mix(keys[left] + np.uint64(level + 1)) % np.uint64(len(b))).astype(np.int64)
        hit = b[at]
        out[left[hit]] = r[at[hit]]
        left = left[~hit]
    return out


class Shards:
    """Probe side of the index: per shard the levels and the arrays."""

    def __init__(self, rows: list, n_shards: int):
        self.n, self.shards = n_shards, {}
        for r in rows:
            bits, base, ranks = [], 0, []
            raw = np.frombuffer(r.bits, np.uint8)
            at = 0
            for size in r.sizes:
                b = np.unpackbits(raw[at : at + (size + 7) // 8], count=size).astype(bool)
                at += (size + 7) // 8
                bits.append(b)
                ranks.append(base + np.cumsum(b) - 1)
                base += int(b.sum())
            self.shards[r.shard] = (bits, ranks, np.frombuffer(r.fingerprints, np.uint64), np.frombuffer(r.counts, np.int32), np.frombuffer(r.last, np.int64))

    def last_holder(self, hashes: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(found in so many documents, largest doc_id) of each hash."""
        found, last = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        shard = (hashes >> np.uint64(32)) % np.uint64(self.n)
        for s in np.unique(shard):
            if (got := self.shards.get(int(s))) is None:
                continue
            mine = np.flatnonzero(shard == s)
            slot = probe_mph(got[0], got[1], hashes[mine])
            ok = slot >= 0
            ok[ok] = (got[2][slot[ok]] == hashes[mine[ok]]) & (got[3][slot[ok]] >= min_docs)
            found[mine[ok]] = True
            last[mine[ok]] = got[4][slot[ok]]
        return found, last


def line_statistics(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(h, docs, last): each key's hash, its number of documents and the largest doc_id among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, ids = [], []
            for i, t in zip(b.column("i").to_pylist(), b.column("t").to_pylist(), strict=True):
                if i is None or not t:
                    continue
                own = {_hash(k) for line in t.split("\n") if len(line) >= MIN_CHARS and (k := line_key(line)) is not None}
                hs.extend(own)
                ids.extend([i] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(hs, np.uint64).view(np.int64)), pa.array(ids, pa.int64())], names=["h", "doc"])

    found = df.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(tidied(run), "h long, doc long")
    return found.dropDuplicates(["h", "doc"]).groupBy("h").agg(F.count("*").alias("docs"), F.max("doc").alias("last"))


def line_index(stats: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard: levels and arrays of the keys in ``stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        h = t.column("h").to_numpy().view(np.uint64)
        docs, last = t.column("docs").to_numpy(), t.column("last").to_numpy()
        shard = (h >> np.uint64(32)) % np.uint64(n_shards)
        for s in np.unique(shard):
            mine = np.flatnonzero(shard == s)
            bits, slots = build_mph(h[mine])
            arrays = {}
            for name, a, kind in (("fingerprints", h[mine], np.uint64), ("counts", np.minimum(docs[mine], (1 << 31) - 1), np.int32), ("last", last[mine], np.int64)):
                arrays[name] = np.zeros(len(mine), kind)
                arrays[name][slots] = a
            yield pa.RecordBatch.from_pydict({"shard": [int(s)], "sizes": [[len(x) for x in bits]], "bits": [b"".join(np.packbits(x).tobytes() for x in bits)], **{k: [v.tobytes()] for k, v in arrays.items()}}, schema=pa.schema([("shard", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), *((k, pa.binary()) for k in arrays)]))

    shard = F.expr(f"pmod(shiftrightunsigned(h, 32), {n_shards})")
    return stats.repartition(max(1, min(n_shards, 512)), shard).mapInArrow(tidied(run), "shard long, sizes array<long>, bits binary, fingerprints binary, counts binary, last binary")


def drop_repeated_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): each document less its lines that a later document repeats."""
    spark = df.sparkSession
    ensure_importable(spark)
    # Keys below the least number of documents decide nothing and get no slot.
    stats = materialize(line_statistics(df, text, doc_id).where(F.col("docs") >= min_docs), "line-keys")
    n_keys = stats.count()
    n_shards = max(1, -(-n_keys // SHARD_KEYS))
    index = materialize(line_index(stats, n_shards), "line-index")
    src = df.select(F.col(doc_id).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    if n_keys * ENTRY_BYTES <= BROADCAST_BYTES:
        sent = spark.sparkContext.broadcast(index.collect())
        return src.mapInArrow(_probe_here(sent, n_shards, min_docs), _KEPT)
    return _probe_there(src, index, n_shards, min_docs)


_KEPT = "doc_id long, n_lines long, n_dropped long, kept string"


def _line_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, line) of every line with a key."""
    hs, docs, at = [], [], []
    for d, t in enumerate(texts):
        for j, line in enumerate(t.split("\n")):
            if len(line) >= MIN_CHARS and (k := line_key(line)) is not None:
                hs.append(_hash(k))
                docs.append(d)
                at.append(j)
    return np.array(hs, np.uint64), np.array(docs, np.int64), np.array(at, np.int64)


def _without(ids: list, texts: list[str], gone: list) -> pa.RecordBatch:
    kept, sizes = [], []
    for t, g in zip(texts, gone, strict=True):
        lines = t.split("\n")
        drop = set(g or ())
        sizes.append(len(lines))
        kept.append("\n".join(x for j, x in enumerate(lines) if j not in drop) if drop else t)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array([len(g or ()) for g in gone], pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])


def _probe_here(rows, n_shards: int, min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Shards(rows.value, n_shards)
        for b in batches:
            ids, texts = b.column("i").to_pylist(), b.column("t").to_pylist()
            hs, docs, at = _line_hashes(texts)
            found, last = index.last_holder(hs, min_docs)
            gone: list[list[int]] = [[] for _ in texts]
            for x in np.flatnonzero(found):
                if ids[docs[x]] != last[x]:
                    gone[docs[x]].append(int(at[x]))
            yield _without(ids, texts, gone)

    return run


_ASKED = pa.schema([("shard", pa.int64()), ("salt", pa.int32()), ("ids", pa.list_(pa.int64())), ("xs", pa.list_(pa.int64())), ("at", pa.list_(pa.int64())), ("hashes", pa.binary())])
_ASKED_DDL = "shard long, salt int, ids array<long>, xs array<long>, at array<long>, hashes binary"
_INDEX = ("sizes", "bits", "fingerprints", "counts", "last")
_DROPS = pa.schema([("gi", pa.int64()), ("gx", pa.int64()), ("line", pa.int32())])


def _probe_there(src: DataFrame, index: DataFrame, n_shards: int, min_docs: int) -> DataFrame:
    """Packets of hashes and a shard's arrays meet in one sorted partition, the arrays first; documents are told apart by
    doc_id and the hash of their text."""
    src = src.withColumn("x", F.xxhash64("t"))

    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId()
        for b in batches:
            salt += 1
            ids, xs = b.column("i").to_pylist(), b.column("x").to_pylist()
            hs, docs, at = _line_hashes(b.column("t").to_pylist())
            shard = ((hs >> np.uint64(32)) % np.uint64(n_shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cut = np.flatnonzero(np.diff(shard[order], prepend=-1)) if len(order) else np.zeros(0, np.int64)
            for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=False):
                o = order[a:z]
                row = {"shard": [int(shard[o[0]])], "salt": [salt % SALTS], "ids": [[ids[d] for d in docs[o]]], "xs": [[xs[d] for d in docs[o]]]}
                yield pa.RecordBatch.from_pydict(row | {"at": [at[o]], "hashes": [hs[o].tobytes()]}, schema=_ASKED)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shards = None, None
        for b in batches:
            for k in range(b.num_rows):
                shard = b.column("shard")[k].as_py()
                if b.column("bits")[k].is_valid:
                    held = shard
                    shards = Shards([SimpleNamespace(shard=shard, **{c: b.column(c)[k].as_py() for c in _INDEX})], n_shards)
                    continue
                if held != shard:
                    continue  # no key of this shard is held often enough
                hashes = np.frombuffer(b.column("hashes")[k].as_buffer(), np.uint64)
                found, last = shards.last_holder(hashes, min_docs)
                hit = np.flatnonzero(found)
                own = b.column("ids")[k].values.take(pa.array(hit))
                gone = pa.compute.fill_null(pa.compute.not_equal(own, pa.array(last[hit])), True).to_numpy(zero_copy_only=False)
                hit = pa.array(hit[gone])
                if len(hit):
                    columns = [b.column(c)[k].values.take(hit) for c in ("ids", "xs", "at")]
                    yield pa.RecordBatch.from_arrays([columns[0], columns[1], columns[2].cast(pa.int32())], schema=_DROPS)

    sent = src.mapInArrow(tidied(packets), _ASKED_DDL)
    arrays = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = sent.unionByName(arrays, allowMissingColumns=True)
    # Null hashes, those of the arrays' rows, sort first.
    met = met.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("hashes").isNotNull())
    gone = met.mapInArrow(tidied(probe), "gi long, gx long, line int").groupBy("gi", "gx").agg(F.collect_set("line").alias("gone"))
    gone = materialize(gone, "line-drops")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _without(*(b.column(c).to_pylist() for c in ("i", "t", "gone")))

    return src.join(gone, F.col("i").eqNullSafe(F.col("gi")) & (F.col("x") == F.col("gx")), "left").select("i", "t", "gone").mapInArrow(drop, _KEPT)


def digest(df: DataFrame) -> DataFrame:
    """The kept text as its hash."""
    return df.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
