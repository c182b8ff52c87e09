"""Fill-in-middle transformation by a table-driven automaton over bytes.

One scan runs the automaton over the bytes of many texts at once: a table maps bytes to classes (continuation byte, line
end, the characters of sentinels, all others) and a second one maps state and class to the next state. The automaton
forgets a byte after three steps, so three vector steps from any state give every state. Its transitions are counted by
text: code points begun, units ended, sentinels recognised. A second pass finds the bytes at which the drawn units end
and lays prefix, suffix and middle out. Units are lines; texts that hold a sentinel stay plain, so that every output can
be taken apart again (``restored``).

Edge cases: null texts are empty and stay plain; a text without a line end is one unit; rows without a doc_id draw as one
with an empty number; equal rows give equal outputs; texts of any length are taken whole; extra columns of any name are
left out; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.words import chunks, tidied, utf8
from helixframe.session import ensure_importable

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SALT = "7:"
#: Of a hundred texts, those that are transformed, and of these, those whose suffix comes first.
RATE, SUFFIX_FIRST = 100, 50

OTHER, CONTINUATION, LINE_END, OPEN, LETTER, CLOSE = range(6)
PLAIN, OPENED, LETTERED, SENTINEL, ENDED = range(5)
#: Steps after which the state depends on the bytes alone.
MEMORY = 3


def byte_classes() -> np.ndarray:
    t = np.full(256, OTHER, np.uint8)
    t[0x80:0xC0] = CONTINUATION
    t[ord("\n")] = LINE_END
    for mark in (PREFIX, SUFFIX, MIDDLE):
        t[ord(mark[0])], t[ord(mark[1])], t[ord(mark[2])] = OPEN, LETTER, CLOSE
    return t


def transitions() -> np.ndarray:
    """Next state by state and class."""
    t = np.full((5, 6), PLAIN, np.uint8)
    t[:, LINE_END] = ENDED
    t[:, OPEN] = OPENED
    t[OPENED, LETTER] = LETTERED
    t[LETTERED, CLOSE] = SENTINEL
    return t


_CLASSES, _NEXT = byte_classes(), transitions()


class Scan(NamedTuple):
    """Counted transitions of each text, and the places of line ends in all of them."""

    code_points: np.ndarray  # begun before each byte, with the total at the end
    line_ends: np.ndarray  # bytes
    units: np.ndarray
    sentinels: np.ndarray


def states(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, state after it) of every byte; every text starts in PLAIN."""
    kind = _CLASSES[data]
    state = np.full(len(data), PLAIN, np.uint8)
    heads = offs[:-1][offs[:-1] < offs[1:]]
    for _ in range(MEMORY):
        before = np.empty_like(state)
        before[1:] = state[:-1]
        before[heads] = PLAIN
        state = _NEXT[before, kind]
    return kind, state


def scan(data: np.ndarray, offs: np.ndarray) -> Scan:
    kind, state = states(data, offs)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kind != CONTINUATION, out=points[1:])
    ends = np.flatnonzero(state == ENDED)
    marks = np.flatnonzero(state == SENTINEL)
    units = np.diff(np.searchsorted(ends, offs))
    full = offs[1:] > offs[:-1]
    open_end = np.zeros(len(units), bool)
    open_end[full] = state[offs[1:][full] - 1] != ENDED
    return Scan(points, ends, units + open_end, np.diff(np.searchsorted(marks, offs)))


def cut_places(found: Scan, offs: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """The byte after ``unit`` units of each text."""
    first = np.searchsorted(found.line_ends, offs[:-1])
    inside = (unit > 0) & (unit < found.units)
    at = np.where(unit > 0, offs[1:], offs[:-1])
    at[inside] = found.line_ends[first[inside] + unit[inside] - 1] + 1
    return at


def draws(doc_id: Column, salt: str = SALT) -> list[Column]:
    """Four numbers that the document's number gives: the first 8-digit groups of a digest."""
    h = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


_RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _transformed(rate: int, suffix_first: int):
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column("t"))
            h = [b.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
            for i, j in chunks(offs):
                d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                found = scan(d, o)
                n = found.units
                one, two = h[0][i:j] % (n + 1), h[1][i:j] % (n + 1)
                x, y = cut_places(found, o, np.minimum(one, two)), cut_places(found, o, np.maximum(one, two))
                plain = (n == 0) | (found.sentinels > 0) | (h[2][i:j] % 100 >= rate)
                spm = h[3][i:j] % 100 < suffix_first
                raw = d.tobytes()
                out = []
                for a, u, v, z, keep, rear in zip(*(c.tolist() for c in (o[:-1], x, y, o[1:], plain, spm)), strict=True):
                    if keep:
                        out.append(raw[a:z])
                    elif rear:
                        out.append(b"".join((s, raw[v:z], p, raw[a:u], m, raw[u:v])))
                    else:
                        out.append(b"".join((p, raw[a:u], s, raw[v:z], m, raw[u:v])))
                points = found.code_points
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(i, j - i),
                        pa.array(n.astype(np.int64)),
                        pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).astype(object), pa.string()),
                        pa.array(points[x] - points[o[:-1]], mask=plain),
                        pa.array(points[y] - points[x], mask=plain),
                        pa.array(out, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def fill_in_middle(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, salt: str = SALT
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every text; nothing is shuffled."""
    ensure_importable(df.sparkSession)
    src = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"), *draws(F.col(doc_id).cast("long"), salt))
    return src.mapInArrow(tidied(_transformed(rate, suffix_first)), _RESULT)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of."""
    first, second = F.when(form == "spm", PREFIX).otherwise(SUFFIX), F.lit(MIDDLE)
    a, b = F.instr(output, first), F.instr(output, second)
    head = F.substring(output, F.lit(len(PREFIX) + 1), a - len(PREFIX) - 1)
    rear = F.substring(output, a + len(PREFIX), b - a - len(PREFIX))
    middle = F.substring(output, b + len(PREFIX), F.length(output))
    psm, spm = F.concat(head, middle, rear), F.concat(rear, middle, head)
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def digest(found: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars")
    return found.select(*columns, sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))
