"""Benchmark decontamination on a positional inverted index that is distributed by documents.

``build_index`` makes one shard per batch of documents: for each indexed term its postings, as token positions
counted through the whole shard. ``match_index`` takes benchmark windows; in each shard it starts from the posting
list of the window's rarest term (by the corpus' counts), shifts it by the term's offset and intersects it with the
shifted lists of the neighbouring terms outwards, until the window is covered or no place is left. Proximity
matches (the rarest terms of an item that the corpus has, within ``slop`` tokens) come from the same lists and are
returned beside the exact ones. Postings never leave their shard; only a term count per shard is shuffled. Benchmark
items are sent in blocks of bounded bytes; of the counts, those of a block's own terms come to the driver.

Edge cases: null or empty texts and items have no words; an item shorter than the window is one window; repeated
items or rows each count; texts of any length are indexed whole; extra columns of any name are left out; an empty
table gives an empty table, no items gives no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.words import chunks, table_alnum, tidied, utf8, word_hashes, word_spans
from helixframe.session import ensure_importable, materialize, settled

WINDOW = 13
#: Bytes of benchmark items that one pass over the index takes; a longer item is a block of its own.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 1 << 20
#: Tokens within which an item's rarest terms count as a proximity match, and how many terms.
SLOP, RARE_TERMS = 32, 4
_SHARD = "shard long, doc_ids array<long>, first array<long>, terms binary, counts array<int>, postings binary"
_SHARD_ARROW = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("first", pa.list_(pa.int64())), ("terms", pa.binary()), ("counts", pa.list_(pa.int32())), ("postings", pa.binary())])
_HITS = "shard long, doc_ids array<long>, first array<long>, hits binary, items array<array<string>>, near array<array<string>>"
_ITEMS = pa.list_(pa.list_(pa.string()))
_HITS_ARROW = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("first", pa.list_(pa.int64())), ("hits", pa.binary()), ("items", _ITEMS), ("near", _ITEMS)])


def text_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the first word of each text."""
    data, offs = utf8(texts)
    s, e, first = word_spans(data, offs, table_alnum())
    return word_hashes(data, s, e) if len(s) else np.zeros(0, np.uint64), first


class Block:
    """Benchmark items of one pass: ids, terms by item, windows and the order of terms by rarity."""

    def __init__(self, ids: list, terms: np.ndarray, first: np.ndarray):
        self.ids, self.terms, self.first = ids, terms, first
        self.vocabulary = np.unique(terms)

    def anchors(self, counts: dict[int, int], window: int) -> dict[int, list[tuple[int, int, list[int]]]]:
        """By term: (item, its position there, starts of the windows of which it is the rarest word)."""
        out: dict[int, list[tuple[int, int, list[int]]]] = {}
        for k in range(len(self.ids)):
            t = self.terms[self.first[k] : self.first[k + 1]].tolist()
            n = min(window, len(t))
            rare = [counts.get(x, 0) for x in t]
            groups: dict[int, list[int]] = {}
            for s in range(len(t) - n + 1 if t else 0):
                if all(rare[s : s + n]):
                    groups.setdefault(min(range(s, s + n), key=lambda j: (rare[j], j)), []).append(s)
            for j, starts in groups.items():
                out.setdefault(t[j], []).append((k, j, starts))
        return out

    def rarest(self, counts: dict[int, int], most: int) -> dict[int, list[tuple[int, list[int]]]]:
        """By the rarest term that the corpus has: (item, its ``most`` rarest distinct terms, that one first)."""
        out: dict[int, list[tuple[int, list[int]]]] = {}
        for k in range(len(self.ids)):
            t = dict.fromkeys(self.terms[self.first[k] : self.first[k + 1]].tolist())
            held = sorted((x for x in t if counts.get(x, 0)), key=counts.__getitem__)[:most]  # ties in the item's order
            if held:
                out.setdefault(held[0], []).append((k, held))
        return out


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[Block]:
    """Items in blocks of at most ``block_bytes`` bytes, streamed through the driver a block at a time."""
    ids: list = []
    texts: list[str] = []
    size = 0
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    for r in rows.toLocalIterator():
        if ids and size + len(r.t.encode()) > block_bytes:
            yield Block(ids, *text_terms(pa.array(texts)))
            ids, texts, size = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t.encode())
    if ids:
        yield Block(ids, *text_terms(pa.array(texts)))


def build_index(df: DataFrame, text: str, doc_id: str, vocabulary=None) -> DataFrame:
    """Shards of postings. ``vocabulary`` (a broadcast of sorted term hashes) keeps postings of those terms only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for b in batches:
            data, offs = utf8(b.column("t"))
            ids = b.column("i").to_pylist()
            for i, j in chunks(offs, SHARD_BYTES):
                d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                s, e, first = word_spans(d, o, table_alnum())
                h = word_hashes(d, s, e) if len(s) else np.zeros(0, np.uint64)
                if vocabulary is None:
                    at = np.arange(len(h))
                    _, code = np.unique(h, return_inverse=True)
                else:
                    v = vocabulary.value
                    code = np.searchsorted(v, h)
                    code[code == len(v)] = 0
                    at = np.flatnonzero(v[code] == h) if len(v) else np.zeros(0, np.int64)
                    code = code[at]
                # Positions keep one gap between documents, so that no window crosses.
                order = at[np.argsort(code.astype(np.uint32), kind="stable")]
                terms = h[order]
                doc = np.searchsorted(first, order, "right") - 1
                postings = (order + doc).astype(np.int32)
                lead = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
                counts = np.diff(np.concatenate((lead, [len(terms)])))
                row = {"shard": [shard], "doc_ids": [ids[i:j]], "first": [first], "terms": [terms[lead].tobytes()], "counts": [counts.astype(np.int32)], "postings": [postings.tobytes()]}
                shard += 1
                yield pa.RecordBatch.from_pydict(row, schema=_SHARD_ARROW)

    src = df.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    return src.mapInArrow(tidied(run), _SHARD)


def term_counts(index: DataFrame, vocabulary=None) -> DataFrame:
    """(term, n): postings of each term over all shards, or of those in ``vocabulary`` (a broadcast of sorted hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("terms")] or [np.zeros(0, np.uint64)])
            n = np.concatenate([x.values.to_numpy() for x in b.column("counts")] or [np.zeros(0, np.int32)])
            if vocabulary is not None:
                own = np.isin(terms, vocabulary.value)
                terms, n = terms[own], n[own]
            terms, at = np.unique(terms, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(np.bincount(at, weights=n, minlength=len(terms)).astype(np.int64))], names=["term", "n"])

    rows = index.select("terms", "counts").mapInArrow(tidied(run), "term long, n long")
    return rows.groupBy("term").agg(F.sum("n").alias("n"))


def _by_term(counts: DataFrame) -> dict[int, int]:
    """Counts of no more terms than one block has."""
    return {int(np.int64(r.term).view(np.uint64)): r.n for r in counts.collect()}


class Shard:
    """Posting lists of one shard by term."""

    def __init__(self, terms: bytes, counts: np.ndarray, postings: bytes):
        self.p = np.frombuffer(postings, np.int32)
        self.terms = np.frombuffer(terms, np.uint64)  # ascending
        self.ends = np.concatenate(([0], np.cumsum(counts)))

    def get(self, term: int) -> np.ndarray:
        k = int(np.searchsorted(self.terms, np.uint64(term)))
        return self.p[self.ends[k] : self.ends[k + 1]] if k < len(self.terms) and self.terms[k] == term else self.p[:0]

    def among(self, wanted: np.ndarray) -> list[int]:
        """Those of the sorted terms ``wanted`` that the shard holds."""
        return np.intersect1d(self.terms, wanted, assume_unique=True).tolist()


def _among(places: np.ndarray, sorted_list: np.ndarray) -> np.ndarray:
    if not len(sorted_list) or not len(places):
        return np.zeros(len(places), bool)
    at = np.searchsorted(sorted_list, places)
    at[at == len(sorted_list)] = 0
    return sorted_list[at] == places


def window_places(shard: Shard, terms: list[int], anchor: int, starts: list[int], n: int) -> np.ndarray:
    """Shard positions at which windows of an item begin, by extending the anchor's places both ways."""
    places = shard.get(terms[anchor])
    lo, hi = min(starts), max(starts) + n - 1
    right = np.full(len(places), anchor)
    alive = np.arange(len(places))
    for j in range(anchor + 1, hi + 1):
        alive = alive[_among(places[alive] + (j - anchor), shard.get(terms[j]))]
        if not len(alive):
            break
        right[alive] = j
    left = np.full(len(places), anchor)
    alive = np.arange(len(places))
    for j in range(anchor - 1, lo - 1, -1):
        alive = alive[_among(places[alive] - (anchor - j), shard.get(terms[j]))]
        if not len(alive):
            break
        left[alive] = j
    found = [places[(left <= s) & (right >= s + n - 1)] - (anchor - s) for s in starts]
    return np.concatenate(found)


def proximity_places(shard: Shard, rare: list[int], slop: int, gapped: np.ndarray) -> np.ndarray:
    """Positions of the first of the ``rare`` terms that have all the others within ``slop`` tokens of their document."""
    places = shard.get(rare[0])
    for x in rare[1:]:
        other = shard.get(x)
        if not len(other) or not len(places):
            return places[:0]
        doc, at = np.searchsorted(gapped, places, "right"), np.searchsorted(other, places)
        near = np.zeros(len(places), bool)
        for k in (np.minimum(at, len(other) - 1), np.maximum(at - 1, 0)):
            near |= (np.abs(other[k] - places) <= slop) & (np.searchsorted(gapped, other[k], "right") == doc)
        places = places[near]
    return places


def match_index(index: DataFrame, block: Block, counts: dict[int, int], window: int, slop: int = SLOP, rare_terms: int = RARE_TERMS, alone: bool = True) -> DataFrame:
    """Per shard: positions hit by exact windows, and by document the items with windows and those near each other.

    The shard's own terms lead to the windows that may be there: items that it can't hold cost nothing. Unless ``alone``,
    a shard in which nothing is found has no row, and none repeats the shard's documents.
    """
    anchors, rarest = block.anchors(counts, window), block.rarest(counts, rare_terms)
    keys = [np.sort(np.array(list(x), np.uint64)) for x in (anchors, rarest)]
    sent = index.sparkSession.sparkContext.broadcast((block, anchors, rarest, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, anchors, rarest, keys = sent.value
        for b in batches:
            for k in range(b.num_rows):
                first = np.array(b.column("first")[k].as_py(), np.int64)
                shard = Shard(b.column("terms")[k].as_py(), b.column("counts")[k].values.to_numpy(), b.column("postings")[k].as_py())
                gapped = first + np.arange(len(first))
                marks = [np.zeros(0, np.int32)]
                items: list[set] = [set() for _ in range(len(first) - 1)]
                near: list[set] = [set() for _ in range(len(first) - 1)]

                def note(at: np.ndarray, found: list[set], item: int, gapped: np.ndarray = gapped) -> None:
                    for d in set((np.searchsorted(gapped, at, "right") - 1).tolist()):
                        found[d].add(block.ids[item])

                for term in shard.among(keys[0]):
                    for item, anchor, starts in anchors[term]:
                        terms = block.terms[block.first[item] : block.first[item + 1]].tolist()
                        n = min(window, len(terms))
                        at = np.unique(window_places(shard, terms, anchor, starts, n))
                        if len(at):
                            marks.append((at[:, None] + np.arange(n)).reshape(-1).astype(np.int32))
                            note(at, items, item)
                for term in shard.among(keys[1]):
                    for item, rare in rarest[term]:
                        at = proximity_places(shard, rare, slop, gapped)
                        if len(at):
                            note(at, near, item)
                hits = np.unique(np.concatenate(marks)).astype(np.int32)
                if not (alone or any(items) or any(near)):
                    continue
                out = {"shard": [b.column("shard")[k].as_py()], "hits": [hits.tobytes()], "items": [[sorted(x) for x in items]], "near": [[sorted(x) for x in near]]}
                out |= {"doc_ids": [b.column("doc_ids")[k].as_py() if alone else None], "first": [first if alone else None]}
                yield pa.RecordBatch.from_pydict(out, schema=_HITS_ARROW)

    return index.mapInArrow(tidied(run), _HITS)


def merge_hits(index: DataFrame, hits: DataFrame) -> DataFrame:
    """One row a shard, of its documents and of what all blocks of items have found there."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        all_hits = np.unique(np.concatenate([np.frombuffer(r["hits"], np.int32) for r in rows]))
        both = {c: [[sorted(set().union(*(r[c][d] for r in rows))) for d in range(len(rows[0][c]))]] for c in ("items", "near")}
        return pa.Table.from_pydict({"shard": [rows[0]["shard"]], "doc_ids": [None], "first": [None], "hits": [all_hits.tobytes()], **both}, schema=_HITS_ARROW)

    found = hits.groupBy("shard").applyInArrow(run, _HITS).select("shard", "hits", "items", "near")
    return index.select("shard", "doc_ids", "first").join(found, "shard", "left")


def report(index: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, the matching items sorted as strings, the digests of the contract, and the
    number of items whose rarest terms stand near each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                first = np.array(b.column("first")[k].as_py(), np.int64)
                hits = np.frombuffer(b.column("hits")[k].as_py() or b"", np.int32)
                gapped = first + np.arange(len(first))
                n_words = np.diff(first)
                n_hit = np.diff(np.searchsorted(hits, gapped))
                none: list = [[]] * len(n_words)
                items, near = b.column("items")[k].as_py() or none, b.column("near")[k].as_py() or none
                n_items = np.array([len(x) for x in items], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b.column("doc_ids")[k].as_py(), pa.int64()),
                        pa.array(n_words),
                        pa.array(n_hit.astype(np.int64)),
                        pa.array(n_items),
                        pa.array(items, pa.list_(pa.string())),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                        pa.array((n_hit > 0) & (20 * n_hit >= n_words)),
                        pa.array([len(x) for x in near], pa.int64()),
                    ],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "n_near"],
                )

    return index.mapInArrow(tidied(run), "doc_id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, n_near long")


@settled("contamination")
def find_contamination(df: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = SLOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``report`` of every document of ``df`` against every item of ``items``."""
    spark = df.sparkSession
    ensure_importable(spark)
    blocks = item_blocks(items, item_id, item_text, block_bytes)
    found = next(blocks, Block([], np.zeros(0, np.uint64), np.zeros(1, np.int64)))
    following = next(blocks, None)
    if following is None:
        words = spark.sparkContext.broadcast(found.vocabulary)
        index = materialize(build_index(df, text, doc_id, words), "postings")
        return report(match_index(index, found, _by_term(term_counts(index, words)), window, slop))
    # Several blocks: one index of every term, counted once; each block passes over it and writes its hits alone.
    index = materialize(build_index(df, text, doc_id), "postings")
    counts = materialize(term_counts(index), "term-counts")
    hits = None
    while found is not None:
        words = spark.createDataFrame(pa.table({"term": found.vocabulary.view(np.int64)}))
        own = _by_term(counts.join(F.broadcast(words), "term"))
        more = materialize(match_index(index, found, own, window, slop, alone=False), "matches")
        hits = more if hits is None else hits.union(more)
        found, following = following, next(blocks, None)
    return report(merge_hits(index, hits))
