"""Token ids in files: frequency-ranked ids, byte-aligned variable-length codes, separate control bytes.

Format. A file is a table of blocks in document order. Each block holds ``data`` (1 to 4 little-endian bytes an
id), ``control`` (two bits an id: its number of bytes less one, four ids to a byte, first id lowest), and the
doc_id and number of ids of each document. Ids are stored as ranks: the id found most often has rank 0, so common
ids take one byte. ``ranks`` is stored beside the blocks. Decoding looks control bytes up in a 256-row table and
gathers with numpy; no loop runs over ids.

Texts are encoded once, by the tokenizers library. Its byte-level pre-tokenizer always ends a piece where white space
follows another character, and where an ASCII mark follows a letter or digit, and white space before a word is set by
its own length: so texts are cut there, a batch of them at once as bytes (``piece_starts``). Equal pieces of a batch meet
in Arrow's dictionary, a worker keeps the ids of those met before; of new ones, words of Latin letters, one piece for
sure, go to the library's model, others to the whole library, a line each. Texts with other white space are cut at single spaces only, or not at all; texts with added tokens, and all texts if
the tokenizer isn't of that kind, go to the library whole. ``encode`` is tested against the library.

Edge cases: texts of any length are encoded whole; extra columns of any name are left out; null or empty texts give the end id alone; rows with equal doc_id are ordered by their ids, null
doc_ids come first; an empty table gives no blocks.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.words import CACHES, tidied
from helixframe.session import ensure_importable, remove, scratch_path

END_ID = 2
#: Ids of one block, so that readers hold a few MB.
BLOCK_IDS = 1 << 20
#: Distinct pieces of one generation; a worker keeps two, and what is met again moves to the younger.
CACHE_PIECES = 200_000
#: Longer pieces seldom meet again and aren't kept.
CACHE_CHARS = 64
#: Letters below this code point are the same in every version of Unicode.
LATIN = 0x250
#: New pieces that go to the library as one text, and bytes of the texts that are cut together.
LINES, CHUNK_BYTES = 500, 4 << 20
#: Pieces of a chunk that meet in one dictionary: a text beyond that has several.
CHUNK_PIECES = 1 << 20
PARTITION_BYTES = 32 << 20
#: By byte: a space or line break, an ASCII letter or digit, an ASCII character that is none of these.
WHITE, PLAIN, MARK = (np.array([b < 128 and f(chr(b)) for b in range(256)]) for f in (lambda c: c in " \n", str.isalnum, lambda c: 32 < ord(c) < 127 and not c.isalnum()))
_NEAR_SPACE = re.compile(r"\s | \s| \Z")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_starts(raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of texts that lie one after another, ``begins`` being the texts' own.

    The texts aren't empty and their white space is spaces and line breaks. Of a run of white space before a word the
    last character stands apart, a space with the word; letters of two bytes up to U+027F are known as such.
    """
    white = WHITE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[begins] = True
    last = np.append(white[:-1] & ~white[1:] & ~cut[1:-1], False)
    cut[1:-1] |= white[1:] & (~white[:-1] | last[1:])
    cut[1:-1] |= ~white[1:] & (raw[:-1] == 10)
    mark = np.flatnonzero(MARK[raw])
    mark = mark[mark > 0]
    one, two = raw[mark - 1], raw[np.maximum(mark - 2, 0)]
    cut[mark[PLAIN[one] | ((two >= 0xC3) & (two <= 0xC9) & ((two != 0xC3) | ((one != 0x97) & (one != 0xB7))))]] = True
    return np.flatnonzero(cut[:-1])


def cut_text(t: str) -> list[str] | None:
    """Pieces of any text at its spaces; None if some space has white space beside it or ends the text, so that cutting
    there isn't safe."""
    return None if "\0" in t or _NEAR_SPACE.search(t) else t.replace(" ", "\0 ").split("\0")


class Pieces(dict):
    """Ids of pieces, as bytes; those not met before are encoded by the library, many at a time."""

    def __init__(self, tokenizer, code: str):
        self.tokenizer, self.code, self.older = tokenizer, code, {}
        self.model, as_bytes = tokenizer.model, tokenizer.pre_tokenizer.pre_tokenize_str
        # The model's character for each byte of a word.
        self.letters = np.zeros(256, "<u4")
        for c in filter(str.isalpha, map(chr, range(LATIN))):
            self.letters[list(c.encode())] = list(map(ord, as_bytes(c)[0][0]))
        self.letters[ord(" ")], self.letters[10] = ord(as_bytes(" a")[0][0][0]), 10
        line = tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None

    def clear(self) -> None:
        super().clear()
        self.older = {}

    def library(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece."""
        found = list(map(self.get, pieces))
        missed = [k for k, x in enumerate(found) if x is None]
        new = []
        for k in missed:
            if (ids := self.older.get(pieces[k])) is None:
                new.append(k)
            else:
                found[k] = ids
        for k, ids in zip(new, self.encoded([pieces[k] for k in new]), strict=True):
            found[k] = ids
        if len(self) + len(missed) > CACHE_PIECES:
            older = self.copy()
            self.clear()
            self.older = older
        for k in missed[:CACHE_PIECES]:
            if len(pieces[k]) <= CACHE_CHARS:
                self[pieces[k]] = found[k]
        return found

    def encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids by the library, of each piece. Pieces without white space, but for a space before them, are lines of one
        text, as a line break between them is a piece of its own; others go alone."""
        out: list[bytes | None] = [None] * len(pieces)
        words, lines = [], []
        for k, p in enumerate(pieces):
            body = p[1:] if p[:1] == " " else p
            if body.isalpha() and (body.isascii() or max(body) < chr(LATIN)):
                words.append(k)
            elif self.line is not None and body and " " not in body and body.isprintable():
                lines.append(k)
        for k, ids in zip(words, self.words([pieces[k] for k in words]), strict=True):
            out[k] = ids
        for i in range(0, len(lines), LINES):
            part = lines[i : i + LINES]
            text = "".join([pieces[k] + "\n" for k in part])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.code)
            ends = np.flatnonzero(ids == self.line)
            if len(ends) == len(part):
                for k, x in zip(part, _parts(ids, ends, 1), strict=True):
                    out[k] = x
        return [self.library(p) if x is None else x for p, x in zip(pieces, out, strict=True)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids by the library's model, of words of Latin letters with or without a space before them."""
        if not words:
            return []
        text = self.letters[np.frombuffer("\n".join(words).encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids, ends, tokenize = [], [], self.model.tokenize
        for w in text.split("\n"):
            ids += [x.id for x in tokenize(w)]
            ends.append(len(ids))
        return _parts(np.array(ids, self.code), np.array(ends), 0)


def _parts(ids: np.ndarray, ends: np.ndarray, skip: int) -> list[bytes]:
    """Bytes of the ids before each end; the next begin ``skip`` ids after it."""
    raw, ends = ids.tobytes(), ends * ids.itemsize
    begins = np.concatenate(([0], ends[:-1] + skip * ids.itemsize))
    return [raw[i:j] for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]


class Encoder:
    """Texts to ids, as arrays of the narrowest unsigned type that holds the vocabulary."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        self.width = np.uint16 if t.get_vocab_size() <= 1 << 16 else np.uint32
        kind = json.loads(t.to_str())
        cut = kind["pre_tokenizer"] or {}
        self.cuts = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not kind["normalizer"]
        self.library = t
        self.added = [x["content"] for x in kind["added_tokens"]]
        self.pieces = Pieces(t, "H" if self.width == np.uint16 else "I") if self.cuts else {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = [np.zeros(0, self.width)] * len(texts)
        if not self.cuts:
            return [np.array(self.library.encode(t, add_special_tokens=False).ids, self.width) for t in texts]
        chunk, held = [], 0
        for k, t in enumerate(texts):
            added = any(x in t for x in self.added)
            if not t:
                continue
            if not added and t.replace("\n", "").isprintable():  # then spaces and line breaks are the only white space
                chunk.append((k, t.encode()))
                held += len(chunk[-1][1])
                if held >= CHUNK_BYTES:
                    self.encode_chunk(chunk, out)
                    chunk, held = [], 0
            else:
                pieces = None if added else cut_text(t)
                ids = self.pieces.library(t) if pieces is None else b"".join(self.pieces.of(pieces))
                out[k] = np.frombuffer(ids, self.width)
        if chunk:
            self.encode_chunk(chunk, out)
        return out

    def encode_chunk(self, chunk: list[tuple[int, bytes]], out: list[np.ndarray]) -> None:
        """Texts that ``piece_starts`` cuts, to their places in ``out``."""
        raw = b"".join([t for _, t in chunk])
        begins = np.cumsum([0] + [len(t) for _, t in chunk])
        starts = piece_starts(np.frombuffer(raw, np.uint8), begins[:-1])
        offsets = np.append(starts, len(raw))
        flat, ends = [], [np.zeros(1, np.int64)]
        for i in range(0, len(starts), CHUNK_PIECES):
            own = offsets[i : i + CHUNK_PIECES + 1]
            met = pa.LargeStringArray.from_buffers(len(own) - 1, pa.py_buffer(own), pa.py_buffer(raw)).dictionary_encode()
            ids = self.pieces.of(met.dictionary.to_numpy(zero_copy_only=False).tolist())
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width().itemsize
            which = met.indices.to_numpy()
            n = size[which]
            to = np.cumsum(n)
            flat.append(np.frombuffer(b"".join(ids), self.width)[np.repeat((np.cumsum(size) - size)[which] - to + n, n) + np.arange(to[-1])])
            ends.append(ends[-1][-1] + to)
        flat, ends = np.concatenate(flat), np.concatenate(ends)
        at = ends[np.searchsorted(offsets, begins)].tolist()
        for (k, _), i, j in zip(chunk, at[:-1], at[1:], strict=True):
            out[k] = flat[i:j]


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process, so that tasks that follow find its pieces, until other work needs the memory."""
    made = Encoder(path)
    CACHES.append(made.pieces)
    return made


def vbyte_encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    v = values.astype(np.uint32)
    n = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = n - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    raw = v.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), raw[np.arange(4) < n[:, None]].tobytes()


def length_table() -> np.ndarray:
    """Bytes of each of the four ids, for every control byte."""
    c = np.arange(256)
    return np.stack([(c >> 2 * k & 3) + 1 for k in range(4)], 1).astype(np.uint8)


def vbyte_decode(control: bytes, data: bytes, count: int, table: np.ndarray) -> np.ndarray:
    n = table[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    ends = np.cumsum(n, dtype=np.int64)
    starts = ends - n
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(n > k)
        if not len(more):
            break
        out[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_texts(df: DataFrame, tokenizer: str, text: str, doc_id: str, end_id: int) -> DataFrame:
    """(doc_id, n, crc, ids): ids compressed, the end id appended; crc orders rows of equal doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pack = encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], enc.width)
        for b in batches:
            if not b.num_rows:
                continue
            ids = [np.concatenate((x, end)) for x in enc.encode([t or "" for t in b.column("t").to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array([pack.compress(x.astype(np.uint32 if enc.width == np.uint32 else np.uint16).tobytes()) for x in ids], pa.binary())], names=["doc_id", "n", "crc", "ids"])

    src = df.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    return src.mapInArrow(tidied(run), "doc_id long, n long, crc long, ids binary")


def id_counts(encoded: DataFrame, vocab: int, wide: bool) -> np.ndarray:
    """How often each id occurs, over all documents: a vector of the vocabulary's size per task is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor(), np.zeros(vocab, np.int64)
        kind = np.uint32 if wide else np.uint16
        for b in batches:
            parts = [np.frombuffer(unpack.decompress(x.as_py()), kind) for x in b.column("ids")]
            if parts:
                total += np.bincount(np.concatenate(parts), minlength=vocab)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    rows = encoded.select("ids").mapInArrow(tidied(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(vocab, np.int64)
    out[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return out


_BLOCK = "part int, block int, before long, count long, doc_ids array<long>, lengths array<long>, control binary, data binary"


def write_token_files(df: DataFrame, path: str, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID) -> dict:
    """Write the blocks of all documents, ascending by doc_id, to ``path``/blocks and the ranks to ``path``/ranks."""
    from tokenizers import Tokenizer

    spark = df.sparkSession
    ensure_importable(spark)
    tokenizer = tokenizer or default_tokenizer()
    vocab = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    wide = vocab > 1 << 16
    raw = f"{path}/encoded"
    encode_texts(df, tokenizer, text, doc_id, end_id).write.option("compression", "uncompressed").parquet(raw)
    encoded = spark.read.schema("doc_id long, n long, crc long, ids binary").parquet(raw)
    counts = id_counts(encoded, vocab, wide)
    by_rank = np.argsort(-counts, kind="stable")
    rank = np.empty(vocab, np.uint32)
    rank[by_rank] = np.arange(vocab)
    size = encoded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    ranks = spark.sparkContext.broadcast(rank)
    ordered = encoded.repartitionByRange(max(1, -(-size // PARTITION_BYTES)), F.asc_nulls_first("doc_id"), "crc", "n").sortWithinPartitions(F.asc_nulls_first("doc_id"), "crc", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        unpack, to_rank = zstandard.ZstdDecompressor(), ranks.value
        kind = np.uint32 if wide else np.uint16
        part, block, before = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            control, data = vbyte_encode(to_rank[ids])
            row = {"part": [part], "block": [block], "before": [before], "count": [len(ids)], "doc_ids": [docs], "lengths": [[len(x) for x in parts]], "control": [control], "data": [data]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("count", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())]))

        for b in batches:
            for i, z in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                docs.append(i)
                parts.append(np.frombuffer(unpack.decompress(z.as_py()), kind))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield flush()
                    block, before = block + 1, before + held
                    docs, parts, held = [], [], 0
        if parts:
            yield flush()

    ordered.select("doc_id", "ids").mapInArrow(tidied(run), _BLOCK).write.option("compression", "zstd").parquet(f"{path}/blocks")
    spark.createDataFrame([(np.asarray(by_rank, "<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")
    remove(spark, raw)
    return {"path": path, "vocab": vocab, "ids": int(counts.sum())}


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): decoded documents, ids as little-endian unsigned 32-bit bytes."""
    ensure_importable(spark)
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    by_rank = np.frombuffer(spark.read.parquet(f"{path}/ranks").first()[0], "<u4")
    totals = blocks.groupBy("part").agg(F.sum("count").alias("n")).collect()
    starts, at = {}, 0
    for r in sorted(totals, key=lambda r: r.part):
        starts[r.part] = at
        at += r.n
    shared = spark.sparkContext.broadcast((by_rank, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, first = shared.value
        table = length_table()
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in ("part", "before", "count", "doc_ids", "lengths", "control", "data")}
                ids = ids_of[vbyte_decode(row["control"], row["data"], row["count"], table)].astype("<u4")
                n = np.array(row["lengths"], np.int64)
                ends = np.cumsum(n)
                raw = ids.tobytes()
                at = first[row["part"]] + row["before"]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(at + ends - n), pa.array(n), pa.array([raw[4 * (e - m) : 4 * e] for e, m in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids binary")


def tokenize(df: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write token files to a scratch folder and read them back, digested by document."""
    spark = df.sparkSession
    path = scratch_path(spark, "tokens")
    write_token_files(df, path, tokenizer, end_id=end_id)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
