"""Quality rules as a short-circuit cascade.

A rule is a measure, a bound and a direction. ``plan_cascade`` times every rule and counts its rejections on a
bounded sample of the documents, then orders rules by rejections per second; ``apply_cascade`` runs them in that
order, each only on documents that all earlier rules passed. The verdict is the conjunction of all rules, so the
order changes the work and never the outcome.

Edge cases: a null text counts as empty and fails the word minimum; whitespace-only texts have no words; an empty
table gives an empty table; repeated rows are judged alike; texts of any length are measured whole; extra columns of
any name pass through the filter and are not looked at.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.words import chunks, gram_hashes, mix, prefix_sums, ranges, span_hashes, table_nonspace, tidied, utf8, within_docs, word_hashes, word_spans
from helixframe.session import ensure_importable

SAMPLE_DOCS = 512
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Characters that mark markup or machine output.
SYMBOLS = b"#*$%&|<>"


class Chunk:
    """A run of documents with the views that rules share, each made once when first asked for."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, self.n = data, offs, len(offs) - 1
        self._made: dict[str, object] = {}

    def _once(self, key: str, make: Callable):
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]

    def spans(self):
        return self._once("spans", lambda: word_spans(self.data, self.offs, table_nonspace()))

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Flagged bytes of each document."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[self.offs[1:]] - sums[self.offs[:-1]]

    def take(self, keep: np.ndarray) -> Chunk:
        lengths = np.diff(self.offs)[keep]
        return Chunk(self.data[ranges(self.offs[:-1][keep], lengths)], np.concatenate(([0], np.cumsum(lengths))))


def n_words(c: Chunk) -> np.ndarray:
    return np.diff(c.spans()[2])


def word_chars(c: Chunk) -> np.ndarray:
    return c.per_doc(table_nonspace()[c.data] & ((c.data & 0xC0) != 0x80))


def n_symbols(c: Chunk) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(SYMBOLS)] = True
    return c.per_doc(t[c.data])


def lines(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the lines that hold a word."""
    breaks = np.flatnonzero(c.data == 0x0A)
    starts = np.concatenate((c.offs[:-1], breaks + 1))
    ends = np.concatenate((breaks, c.offs[1:]))
    starts.sort()
    ends.sort()
    ws = c.spans()[0]
    has = np.searchsorted(ws, ends) > np.searchsorted(ws, starts)
    starts, ends = starts[has], ends[has]
    return starts, ends, np.searchsorted(c.offs, starts, "right") - 1


def _keyed(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(h + doc.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def n_dup_lines(c: Chunk) -> np.ndarray:
    """Lines with a word that equal an earlier line of the document."""
    s, e, doc = lines(c)
    key = _keyed(span_hashes(prefix_sums(c.data), s, e), doc)
    _, first = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=c.n) - np.bincount(doc[first], minlength=c.n)


def n_repeat_words(c: Chunk) -> np.ndarray:
    """Words inside 3-word windows that occur twice or more in the document."""
    starts, ends, first = c.spans()
    at = within_docs(first, 3)
    if not len(at):
        return np.zeros(c.n, np.int64)
    h = np.empty(len(starts), np.uint64)
    sums = prefix_sums(c.data)
    h[:] = span_hashes(sums, starts, ends)
    doc = np.searchsorted(first, at, "right") - 1
    key = _keyed(gram_hashes(h, 3)[at], doc)
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    hit = np.zeros(len(k), bool)
    hit[1:] |= same
    hit[:-1] |= same
    at = at[order[hit]]
    marked = np.zeros(len(starts), bool)
    for d in range(3):
        marked[at + d] = True
    sums = np.concatenate(([0], np.cumsum(marked, dtype=np.int64)))
    return sums[first[1:]] - sums[first[:-1]]


def n_exclaim(c: Chunk) -> np.ndarray:
    return c.per_doc(c.data == 0x21)


def n_upper(c: Chunk) -> np.ndarray:
    return c.per_doc((c.data >= 0x41) & (c.data <= 0x5A))


def n_letters(c: Chunk) -> np.ndarray:
    low = c.data | 0x20
    return c.per_doc((low >= 0x61) & (low <= 0x7A))


def n_lines(c: Chunk) -> np.ndarray:
    return np.bincount(lines(c)[2], minlength=c.n)


@dataclass(frozen=True)
class Rule:
    """Rejects a document where ``measure(chunk) * scale > limit * per(chunk)``, or the reverse if ``below``."""

    name: str
    measure: Callable[[Chunk], np.ndarray]
    per: Callable[[Chunk], np.ndarray] | None
    scale: int
    limit: int
    below: bool = False

    def rejects(self, c: Chunk) -> np.ndarray:
        left = self.measure(c).astype(np.int64) * self.scale
        right = self.limit * (self.per(c) if self.per else np.ones(c.n, np.int64))
        return left < right if self.below else left > right


#: Fixed bounds, wide enough that ordinary prose in any language with spaces stays.
RULES = (
    Rule("few_words", n_words, None, 1, MIN_WORDS, below=True),
    Rule("repeated_words", n_repeat_words, n_words, 100, REPEAT_PERCENT),
    Rule("symbols", n_symbols, n_words, 100, 25),
    Rule("exclamation", n_exclaim, n_words, 100, 50),
    Rule("capitals", n_upper, n_letters, 100, 60),
    Rule("long_words", word_chars, n_words, 1, 20),
    Rule("short_words", word_chars, n_words, 10, 15, below=True),
    Rule("repeated_lines", n_dup_lines, n_lines, 100, 60),
)


def plan_cascade(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample: int = SAMPLE_DOCS) -> list[Rule]:
    """Rules in descending order of rejections per second on at most ``sample`` whole documents, measured by a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected = np.zeros(len(rules)), np.zeros(len(rules), np.int64)
        for b in batches:
            data, offs = utf8(b.column("t"))
            for i, j in chunks(offs):
                for k, r in enumerate(rules):
                    c = Chunk(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    began = time.perf_counter()
                    rejected[k] += int(r.rejects(c).sum())
                    spent[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(rejected), pa.array(spent)], names=["rule", "rejected", "spent"])

    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(7)) == 0).limit(sample)
    found = rows.mapInArrow(tidied(run), "rule int, rejected long, spent double").groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("spent").alias("spent")).collect()
    score = {r.rule: (r.rejected + 0.5) / (r.spent + 1e-6) for r in found}
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: -score.get(k, 0.0))]


def apply_cascade(c: Chunk, rules: list[Rule]) -> np.ndarray:
    """True for documents that every rule passes; later rules see only what earlier ones left."""
    kept = np.ones(c.n, bool)
    alive, left = np.arange(c.n), c
    for r in rules:
        if not len(alive):
            break
        bad = r.rejects(left)
        if bad.any():
            kept[alive[bad]] = False
            alive = alive[~bad]
            left = left.take(~bad)
    return kept


def quality_filter(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that pass every rule, columns unchanged."""
    ensure_importable(df.sparkSession)
    order = plan_cascade(df, rules, text)
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column(text))
            kept = [apply_cascade(Chunk(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]), order) for i, j in chunks(offs)]
            if kept:
                yield b.filter(pa.array(np.concatenate(kept)))

    return df.mapInArrow(tidied(run), schema)


def quality_measures(df: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Base measures of every document and the verdict of base and cascade."""
    ensure_importable(df.sparkSession)
    # Rules that repeat the base test have nothing left to reject here.
    order = [r for r in plan_cascade(df, rules, text) if r.name not in ("few_words", "repeated_words")]
    base = (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column("t"))
            for i, j in chunks(offs):
                c = Chunk(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                got = [f(c).astype(np.int64) for f in base]
                failed = (got[0] < MIN_WORDS) | (100 * got[4] > REPEAT_PERCENT * got[0])
                kept = np.zeros(c.n, bool)
                kept[~failed] = apply_cascade(c.take(~failed), order)
                yield pa.RecordBatch.from_arrays([b.column("i").slice(i, j - i), *map(pa.array, got), pa.array(failed), pa.array(kept)], names=["doc_id", *(f.__name__ for f in base), "base_failed", "kept"])

    src = df.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    return src.mapInArrow(tidied(run), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
