"""Vectorised word handling over Arrow string columns, shared by the operators here.

A chunk of documents is one UTF-8 byte array plus offsets; words are runs of bytes found by table lookup, so
no Python object is made per word. Every helper takes whole texts; chunks are cut between documents only.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; arrays of eight bytes for each are the most that a worker holds.
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_C1 = np.uint64(0xBF58476D1CE4E5B9)
_C2 = np.uint64(0x94D049BB133111EB)


#: Caches that other operators keep in this worker process over their tasks.
CACHES: list[dict] = []


def give_back() -> None:
    """Return freed memory of this worker to the system; a worker lives on between tasks, beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable) -> Callable:
    """An Arrow kernel that gives memory back at its end."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return kernel


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls become empty texts.

    A worker that comes here has turned to another operator: caches are given back.
    """
    if any(CACHES):
        for c in CACHES:
            c.clear()
        give_back()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Document ranges of at most ``limit`` bytes each, or of one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@cache
def table_alnum() -> np.ndarray:
    """True for bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased."""
    t = np.ones(256, bool)
    t[0x00:0x30] = t[0x3A:0x61] = t[0x7B:0x80] = False
    t[0x41:0x5B] = True
    return t


@cache
def table_nonspace() -> np.ndarray:
    """True for bytes of ``[^\\x20\\x09-\\x0D]``."""
    t = np.ones(256, bool)
    t[0x20] = t[0x09:0x0E] = False
    return t


@cache
def table_lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 0x20
    return t


def word_spans(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document with the total at the end), words never crossing documents."""
    w = table[data]
    full = offs[:-1] < offs[1:]
    s = w.copy()
    s[1:] &= ~w[:-1]
    first = offs[:-1][full]
    s[first] = w[first]
    e = w
    tail = e.copy()
    tail[:-1] &= ~e[1:]
    last = offs[1:][full] - 1
    tail[last] = e[last]
    starts, ends = np.flatnonzero(s), np.flatnonzero(tail) + 1
    return starts, ends, np.searchsorted(starts, offs)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers.get("p", ())) < n:
        size = max(n, CHUNK_BYTES + 1024)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for key, base in (("p", _BASE), ("q", inverse)):
                t = np.full(size, base, np.uint64)
                t[0] = 1
                _powers[key] = np.multiply.accumulate(t)
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _C1
    h = (h ^ (h >> np.uint64(27))) * _C2
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """P with P[j] - P[i] the polynomial of bytes i..j-1, scaled by base**i."""
    v = (table_lower()[data] if lower else data).astype(np.uint64)
    v += np.uint64(1)
    p, _ = powers(len(data) + 1)
    v *= p[: len(data)]
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(v, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hashes of byte spans."""
    _, q = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * q[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_sums(data, lower=True), starts, ends)


def hash_word(word: bytes) -> int:
    d = np.frombuffer(word, np.uint8)
    return int(word_hashes(d, np.array([0]), np.array([len(d)]))[0])


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, one for each place where all n exist in the array."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(3) + h[k : k + m] + np.uint64(k + 1))
    return out


def within_docs(first: np.ndarray, n: int) -> np.ndarray:
    """Starts, as word indices, of all n-word windows that stay inside one document."""
    total = int(first[-1])
    ok = np.ones(max(total - n + 1, 0), bool)
    for e in range(1, n):
        last = first[1:] - e
        last = last[(last >= first[:-1]) & (last < len(ok))]
        ok[last] = False
    return np.flatnonzero(ok)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated arange(s, s + l) for each pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return at + np.arange(total)
