"""Alignment and read likelihoods for many reads at once, along the diagonals of their tables.

Cells of one diagonal don't depend on each other, so one vector step computes a diagonal of every read's table; reads
are padded to the longest of their batch, and batches are bounded in cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Cells of one batch's tables, and of one whose likelihoods are summed: a few diagonals stay near the processor.
CELLS, HMM_CELLS = 4_000_000, 1_000_000
MATCH, MISMATCH, GAP = 2, -4, -3
OPEN, EXTEND = 1e-3, 0.1
_FLOOR = 1e-300


def batches_of_cells(n: np.ndarray, m: np.ndarray, cells: int = CELLS) -> Iterator[np.ndarray]:
    """Rows in batches of about equal lengths whose padded tables hold ``cells`` cells at most, or of one row."""
    order = np.lexsort((m, n))
    i = 0
    while i < len(order):
        j, most_n, most_m = i, 0, 0
        while j < len(order):
            most_n, most_m = max(most_n, int(n[order[j]]) + 1), max(most_m, int(m[order[j]]) + 1)
            if j > i and (j - i + 1) * most_n * most_m > cells:
                break
            j += 1
        yield order[i:j]
        i = j


def _codes(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, characters), a text a column, padded; texts run along the last axis, so that a step is one stretch."""
    size = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), int(size.max(initial=0))), pad, np.int32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return size, np.ascontiguousarray(out.T)


def _narrow(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of both sides as bytes, where all fit beside the two paddings."""
    if max(a.max(initial=0), b.max(initial=0)) < 254:
        return a.astype(np.uint8), b.astype(np.uint8)
    return a, b


def _holding(most: float, *numbers: float) -> type:
    """The narrowest type that holds sums up to ``most`` of ``numbers``."""
    if not all(float(x).is_integer() for x in numbers):
        return np.float64
    return np.int16 if most < 1 << 14 else np.int32 if most < 1 << 30 else np.int64


def align_batch(reads: list[str], refs: list[str], match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP) -> tuple[np.ndarray, ...]:
    """(scores, pair, query, target): global scores, and every aligned base as pair's number, place in read and in reference.

    Of equal ways the one with a base on a base comes first, then an insertion, then a deletion, from the end backwards.
    """
    n, a = _codes(reads, -1)
    m, b = _codes(refs, -2)
    a, b = _narrow(a, b)
    count, rows, cols = len(reads), len(a), len(b)
    kind = _holding(max(abs(match), abs(mismatch), abs(gap)) * (rows + cols + 2), match, mismatch, gap)
    # By diagonal, row and pair; the reference runs backwards, so that both sides of a diagonal run forwards.
    s = np.empty((rows + cols + 1, rows + 1, count), kind)
    s[np.arange(cols + 1), 0] = gap * np.arange(cols + 1)[:, None]
    s[np.arange(rows + 1), np.arange(rows + 1)] = gap * np.arange(rows + 1)[:, None]
    back, gain, add = b[::-1], kind(match - mismatch), kind(mismatch)
    for d in range(2, rows + cols + 1):
        lo, hi = max(1, d - cols), min(rows, d - 1) + 1
        if lo >= hi:
            continue
        on = np.multiply(a[lo - 1 : hi - 1] == back[cols - d + lo : cols - d + hi], gain, dtype=kind)
        on += add
        on += s[d - 2, lo - 1 : hi - 1]
        here = s[d, lo:hi]
        np.maximum(s[d - 1, lo - 1 : hi - 1], s[d - 1, lo:hi], out=here)
        here += kind(gap)
        np.maximum(here, on, out=here)
    every = np.arange(count)
    scores = s[n + m, n, every].astype(np.float64 if kind is np.float64 else np.int64)
    i, j = n.copy(), m.copy()
    met = np.full((count, rows), -1, np.int32)
    live = every[(i > 0) | (j > 0)]
    while len(live):
        x, y = i[live], j[live]
        here = s[x + y, x, live]
        up, left = np.maximum(x - 1, 0), np.maximum(y - 1, 0)
        inside = (x > 0) & (y > 0)
        same = np.zeros(len(live), kind)
        same[inside] = np.where(a[up[inside], live[inside]] == b[left[inside], live[inside]], kind(match), add)
        on = inside & (here == s[up + left, up, live] + same)
        insert = ~on & (x > 0) & (here == s[up + y, up, live] + kind(gap))
        met[live[on], up[on]] = left[on]
        i[live] = x - (on | insert)
        j[live] = y - ~insert
        live = live[(i[live] > 0) | (j[live] > 0)]
    pair, query = np.nonzero(met >= 0)
    return scores, pair, query, met[pair, query].astype(np.int64)


def _errors(quals: list, n: np.ndarray, rows: int) -> np.ndarray:
    """Chances of an error, a read a column; 1 beyond its end."""
    own = [np.asarray(q, float)[:k] for q, k in zip(quals, n, strict=True)]
    size = np.array([len(q) for q in own], np.int64)
    out = np.ones((len(own), rows))
    out[np.arange(rows) < size[:, None]] = 10 ** (-np.concatenate([*own, np.zeros(0)]) / 10)
    return np.ascontiguousarray(out.T)


def hmm_batch(reads: list[str], quals: list, haplotypes: list[str], open_: float = OPEN, extend: float = EXTEND) -> np.ndarray:
    """log10 likelihood of each read given its haplotype, over all alignments; a read may start anywhere."""
    n, a = _codes(reads, -1)
    m, b = _codes(haplotypes, -2)
    a, b = _narrow(a, b)
    count, rows, cols = len(reads), len(a), len(b)
    error = _errors(quals, n, rows)
    right, wrong, ragged = 1 - error, error / 3, bool((m < cols).any())
    # By row and read, of this diagonal and the two before; row 0 is where a read may begin, with equal chance at every
    # place. Rows below a diagonal's last hold 0: no diagonal before has written them.
    start, back = 1.0 / np.maximum(m, 1), b[::-1]
    m0, m1, m2, i0, i1, i2, d0, d1, d2 = (np.zeros((rows + 1, count)) for _ in range(9))
    total = np.zeros(count)
    d1[0] = start  # the diagonal 0
    for d in range(1, rows + cols + 1):
        d2[0] = np.where(d <= m, start, 0.0)
        lo, hi = max(1, d - cols), min(rows, d - 1) + 1
        if lo < hi:
            p = np.where(a[lo - 1 : hi - 1] == back[cols - d + lo : cols - d + hi], right[lo - 1 : hi - 1], wrong[lo - 1 : hi - 1])
            if ragged:
                p *= (d - np.arange(lo, hi))[:, None] <= m
            # From one row and one column before: the diagonal before the last.
            x = np.add(i0[lo - 1 : hi - 1], d0[lo - 1 : hi - 1], out=m2[lo:hi])
            x *= 1 - extend
            x += (1 - 2 * open_) * m0[lo - 1 : hi - 1]
            x *= p
            x = np.multiply(m1[lo - 1 : hi - 1], open_, out=i2[lo:hi])
            x += extend * i1[lo - 1 : hi - 1]
            x *= 0.25
            x = np.multiply(m1[lo:hi], open_, out=d2[lo:hi])
            x += extend * d1[lo:hi]
        own = np.flatnonzero((d - n >= 1) & (d - n <= m) & (n > 0))
        if len(own):
            total[own] += m2[n[own], own] + i2[n[own], own]
        m0, m1, m2, i0, i1, i2, d0, d1, d2 = m1, m2, m0, i1, i2, i0, d1, d2, d0
    return np.log10(np.maximum(total, _FLOOR))
