"""Binary alignments (BAM): a split index, and reads decoded in parallel from it.

A BAM is a chain of compressed blocks; where records begin isn't marked. ``build_index`` walks the file once and notes
the place of a record every so many records and at each contig's beginning; readers then decode the stretches between
those places side by side. Files are opened through Arrow's file systems, so any store that those reach will do.
Decoding is lazy: only the wanted columns of a record are made. CRAM isn't read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.regions import overlaps, reference_length
from helixframe.session import ensure_importable

EVERY = 10_000
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
SCHEMA = "name string, flags int, contig string, pos long, mapq int, cigar string, mate_contig string, mate_pos long, tlen int, seq string, quals string, sa string"
INDEX = "place long, contig string, pos long, reach long"


def _open(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(name)


class Blocks:
    """Bytes of a BAM from a virtual place (file offset of a block << 16 | offset inside it)."""

    def __init__(self, f, place: int = 0):
        self.f, self.data, self.at, self.start, self.next = f, b"", 0, 0, place >> 16
        if place & 0xFFFF:
            self._load()
            self.at = place & 0xFFFF

    def _load(self) -> bool:
        self.start = self.next
        self.f.seek(self.start)
        head = self.f.read(18)
        if len(head) < 18:
            return False
        extra = struct.unpack_from("<H", head, 10)[0]
        rest = head[12:] + self.f.read(max(0, extra - 6))
        k, size = 0, 0
        while k + 4 <= extra:
            tag, n = rest[k : k + 2], struct.unpack_from("<H", rest, k + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", rest, k + 4)[0] + 1
            k += 4 + n
        if not size:
            raise ValueError("not a block-compressed file")
        self.f.seek(self.start + 12 + extra)
        self.data = zlib.decompress(self.f.read(size - 20 - extra), -15)
        self.next, self.at = self.start + size, 0
        return True

    @property
    def place(self) -> int:
        while self.at == len(self.data):
            if not self._load():
                return self.next << 16
        return self.start << 16 | self.at

    def read(self, n: int) -> bytes:
        out = []
        while n:
            if self.at == len(self.data) and not self._load():
                break
            part = self.data[self.at : self.at + n]
            out.append(part)
            self.at, n = self.at + len(part), n - len(part)
        return b"".join(out)

    def record(self) -> bytes | None:
        size = self.read(4)
        return self.read(struct.unpack("<i", size)[0]) if len(size) == 4 else None


def read_header(path: str) -> tuple[str, list[tuple[str, int]], int]:
    """(header text, contigs with lengths, place of the first record)."""
    with _open(path) as f:
        b = Blocks(f)
        if b.read(4) != b"BAM\1":
            raise ValueError("not a BAM file")
        text = b.read(struct.unpack("<i", b.read(4))[0]).rstrip(b"\0").decode()
        contigs = []
        for _ in range(struct.unpack("<i", b.read(4))[0]):
            name = b.read(struct.unpack("<i", b.read(4))[0])[:-1].decode()
            contigs.append((name, struct.unpack("<i", b.read(4))[0]))
        return text, contigs, b.place


def build_index(spark: SparkSession, path: str, every: int = EVERY) -> DataFrame:
    """(place, contig, pos, reach) of records from which a reader may begin: the first position of the stretch that begins
    there, and the last one that a read of it covers; null contig for the unmapped tail."""
    ensure_importable(spark)
    _, contigs, first = read_header(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p in f["path"]:
                rows, n, last = [], 0, None
                with _open(p) as file:
                    b = Blocks(file, first)
                    while True:
                        place = b.place
                        if (r := b.record()) is None:
                            break
                        ref, pos = struct.unpack_from("<ii", r)
                        if n % every == 0 or ref != last:
                            rows.append([place, contigs[ref][0] if ref >= 0 else None, pos + 1 if ref >= 0 else None, None])
                        if ref >= 0:
                            rows[-1][3] = max(rows[-1][3] or 0, pos + covered(r))
                        n, last = n + 1, ref
                out = pd.DataFrame(rows, columns=["place", "contig", "pos", "reach"])
                yield out.astype({"pos": "Int64", "reach": "Int64"})

    return spark.createDataFrame([(path,)], "path string").coalesce(1).mapInPandas(run, INDEX)


def covered(r: bytes) -> int:
    """Reference bases of a record, one at least."""
    n_name, n_ops = r[8], struct.unpack_from("<H", r, 12)[0]
    ops = struct.unpack_from(f"<{n_ops}I", r, 32 + n_name)
    return max(1, sum(x >> 4 for x in ops if OPS[x & 15] in "MDN=X"))


def _supplementary(aux: bytes) -> str | None:
    sizes = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
    k = 0
    while k + 3 <= len(aux):
        tag, kind = aux[k : k + 2], chr(aux[k + 2])
        k += 3
        if kind in "ZH":
            end = aux.index(0, k)
            if tag == b"SA":
                return aux[k:end].decode()
            k = end + 1
        elif kind == "B":
            k += 5 + sizes[chr(aux[k])] * struct.unpack_from("<i", aux, k + 1)[0]
        else:
            k += sizes[kind]
    return None


def decode(r: bytes, contigs: list[tuple[str, int]], columns: list[str]) -> list:
    ref, pos, n_name, mapq, _, n_ops, flags, n_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", r)
    ops_at = 32 + n_name
    seq_at = ops_at + 4 * n_ops
    qual_at = seq_at + (n_seq + 1) // 2
    out = []
    for c in columns:
        if c == "name":
            v = r[32 : ops_at - 1].decode()
        elif c == "flags":
            v = flags
        elif c in ("contig", "mate_contig"):
            k = ref if c == "contig" else mate
            v = contigs[k][0] if k >= 0 else None
        elif c in ("pos", "mate_pos"):
            p = pos if c == "pos" else mate_pos
            v = p + 1 if p >= 0 else None
        elif c == "mapq":
            v = mapq if mapq != 255 else None
        elif c == "cigar":
            v = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{n_ops}I", r, ops_at)) or None
        elif c == "tlen":
            v = tlen
        elif c == "seq":
            pairs = r[seq_at:qual_at]
            v = "".join(BASES[x >> 4] + BASES[x & 15] for x in pairs)[:n_seq] or None
        elif c == "quals":
            raw = r[qual_at : qual_at + n_seq]
            v = None if not raw or raw[0] == 255 else bytes(q + 33 for q in raw).decode()
        else:
            v = _supplementary(r[qual_at + n_seq :])
        out.append(v)
    return out


def _stretches(spark: SparkSession, stretches: list[tuple[int, int]], path: str, columns: list[str] | None) -> DataFrame:
    ensure_importable(spark)
    contigs = read_header(path)[1]
    kinds = dict(x.strip().split(" ") for x in SCHEMA.split(","))
    wanted = columns or list(kinds)
    cuts = [(path, a, b) for a, b in stretches]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples():
                rows = []
                with _open(row.path) as file:
                    b = Blocks(file, row.a)
                    while (row.b < 0 or b.place < row.b) and (r := b.record()) is not None:
                        rows.append(decode(r, contigs, wanted))
                        if len(rows) >= 20_000:
                            yield pd.DataFrame(rows, columns=wanted).convert_dtypes()
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=wanted).astype({c: "Int64" for c in wanted if kinds[c] in ("int", "long")})

    src = spark.createDataFrame(cuts, "path string, a long, b long").repartition(max(1, len(cuts)))
    return src.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in wanted))


def read_bam(spark: SparkSession, path: str, index: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """All reads; without an index the file is one stretch. ``columns`` are all that is decoded."""
    first = read_header(path)[2]
    places = sorted({first, *(r.place for r in index.select("place").collect())}) if index is not None else [first]
    return _stretches(spark, list(zip(places, [*places[1:], -1], strict=True)), path, columns)


def read_region(spark: SparkSession, path: str, index: DataFrame, contig: str, start: int, end: int, columns: list[str] | None = None) -> DataFrame:
    """Reads that overlap a region: only the stretches of the index that may hold them are opened.

    A read that begins before the region and reaches into it is one of them: stretches are told by how far they reach.
    """
    from pyspark.sql import Window

    ends = index.withColumn("next", F.lead("place", 1, -1).over(Window.orderBy("place")))  # one row a stretch
    may = ends.where((F.col("contig") == contig) & (F.col("pos") <= end) & (F.col("reach") >= start))
    cuts = [(r.place, r.next) for r in may.select("place", "next").collect()]
    need = list(dict.fromkeys([*(columns or [x.strip().split(" ")[0] for x in SCHEMA.split(",")]), "contig", "pos", "cigar"]))
    found = _stretches(spark, cuts, path, need).where(F.col("contig") == contig)
    found = found.where(overlaps(F.col("pos"), F.col("pos") + reference_length(F.col("cigar")) - 1, F.lit(start), F.lit(end)))
    return found.select(*(columns or need))


def read_unmapped(spark: SparkSession, path: str, index: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The tail of reads without a contig."""
    tail = index.where(F.col("contig").isNull()).agg(F.min("place")).first()[0]
    return _stretches(spark, [(tail, -1)] if tail is not None else [], path, columns)


def scan_into(reads: DataFrame, sink, group: str) -> None:
    """Push every partition's rows into ``sink``; ``SparkContext.cancelJobGroup(group)`` ends the scan."""
    sc = reads.sparkSession.sparkContext
    sc.setJobGroup(group, "read scan", interruptOnCancel=True)
    reads.foreachPartition(sink)
