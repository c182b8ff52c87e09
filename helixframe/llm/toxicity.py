"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct lower-cased words of a text and the leading bytes of its longer words, hashed to 2**18. Terms
that tell the classes of the training rows apart stay active, the others weigh nothing, so a long text is judged by
its telling terms. The machine adds a bias, a weight for each term, and for each pair of terms the product of their
factor vectors, which lets pairs such as insult and group mention count for more than the sum of the two.

Training is on the driver over at most TRAIN_ROWS labelled rows, the first by hash; scoring runs over all whole
texts with the fixed-size model as a broadcast. Labels, lang, source and doc_id are never inputs of a score.

Edge cases: null and empty texts have no terms and get the bias' score; without training rows of both classes every
score is the share of positives or 0; repeated rows score alike; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.words import chunks, mix, prefix_sums, span_hashes, table_alnum, tidied, utf8, word_spans
from helixframe.session import ensure_importable

BITS = 18
#: Leading bytes that make a term of their own, for words of at least LONG bytes.
PREFIXES = (4, 5, 6)
LONG = 6
#: Bound on the labelled rows that the driver trains on.
TRAIN_ROWS = 12_000
ACTIVE = 8_192
FACTORS = 6
BATCH = 128
STEPS = 3_000
RATE = 0.3
DECAY = 1e-5
#: Weight of a positive row: a missed one costs more than a false alarm.
POSITIVE = 3.0
FOLDS = 5


@dataclass
class Model:
    slot: np.ndarray  # of each hashed term, -1 if inactive
    bias: float
    weight: np.ndarray
    factor: np.ndarray


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, term), repeated as they occur."""
    s, e, first = word_spans(data, offs, table_alnum())
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = prefix_sums(data, lower=True)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    docs, hs = [doc], [span_hashes(sums, s, e)]
    for k in PREFIXES:
        long = (e - s) >= max(LONG, k + 1)
        docs.append(doc[long])
        hs.append(mix(span_hashes(sums, s[long], s[long] + k) + np.uint64(k)))
    return np.concatenate(docs), (np.concatenate(hs) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct_terms(data: np.ndarray, offs: np.ndarray, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) once each, by document; ``slot`` keeps active terms only, renumbered."""
    doc, t = terms(data, offs)
    if slot is not None:
        t = slot[t]
        doc, t = doc[t >= 0], t[t >= 0]
    key = np.unique(doc << BITS | t)
    return key >> BITS, key & ((1 << BITS) - 1)


def logits(m: Model, doc: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    out = m.bias + np.bincount(doc, weights=m.weight[t], minlength=n)
    for k in range(m.factor.shape[1]):
        v = m.factor[t, k]
        out += 0.5 * (np.bincount(doc, weights=v, minlength=n) ** 2 - np.bincount(doc, weights=v * v, minlength=n))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def select_terms(doc: np.ndarray, t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slot of each hashed term: the ACTIVE terms with the largest G statistic above chance, in three rows or more."""
    n1, n0 = y.sum(), (1 - y).sum()
    a = np.bincount(t, weights=y[doc], minlength=1 << BITS)
    b = np.bincount(t, minlength=1 << BITS) - a
    share = (a + b) / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = sum(np.where(o > 0, o * np.log(o / x), 0.0) for o, x in ((a, share * n1), (b, share * n0), (n1 - a, (1 - share) * n1), (n0 - b, (1 - share) * n0)))
    g = np.where((a + b >= 3) & np.isfinite(g), 2 * g, 0.0)
    best = np.argsort(-g, kind="stable")[:ACTIVE]
    best = best[g[best] > 12.0]
    slot = np.full(1 << BITS, -1, np.int64)
    slot[best] = np.arange(len(best))
    return slot


def fit(doc: np.ndarray, t: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Minibatch Adagrad on the log loss; rows are numbered by ``doc`` in ascending order."""
    y = y.astype(np.float64)
    rate = float(y.mean()) if len(y) else 0.0
    slot = select_terms(doc, t, y) if 0 < rate < 1 else np.full(1 << BITS, -1, np.int64)
    n_active = int(slot.max()) + 1
    rng = np.random.default_rng(seed)
    m = Model(slot, float(np.log((rate + 1e-9) / (1 - rate + 1e-9))), np.zeros(n_active), rng.normal(0, 0.03, (n_active, FACTORS)))
    if not n_active:
        return m
    s = slot[t]
    doc, s = doc[s >= 0], s[s >= 0]
    cut = np.searchsorted(doc, np.arange(len(y) + 1))
    gw, gv, gb = np.full(n_active, 1e-2), np.full((n_active, FACTORS), 1e-2), 1e-2
    parts = max(1, len(y) // BATCH)
    for _ in range(max(4, -(-STEPS // parts))):
        order = rng.permutation(len(y))
        for rows in np.array_split(order, parts):
            lengths = cut[rows + 1] - cut[rows]
            at = np.repeat(cut[rows] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(int(lengths.sum()))
            d, x = np.repeat(np.arange(len(rows)), lengths), s[at]
            v = m.factor[x]
            sums = np.zeros((len(rows), FACTORS))
            np.add.at(sums, d, v)
            err = sigmoid(logits(m, d, x, len(rows))) - y[rows]
            err *= np.where(y[rows] > 0, POSITIVE, 1.0) / len(rows)
            used, inv = np.unique(x, return_inverse=True)
            dw = np.bincount(inv, weights=err[d], minlength=len(used)) + DECAY * m.weight[used]
            dv = np.zeros((len(used), FACTORS))
            np.add.at(dv, inv, err[d][:, None] * (sums[d] - v))
            dv += DECAY * m.factor[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += err.sum() ** 2
            m.weight[used] -= RATE * dw / np.sqrt(gw[used])
            m.factor[used] -= 0.3 * RATE * dv / np.sqrt(gv[used])
            m.bias -= RATE * err.sum() / np.sqrt(gb)
    return m


def fold(doc_id: str):
    """crc32 of doc_id as text, modulo FOLDS; a null doc_id is in fold 0 and so never trained on."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0))


def train(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents outside fold 0."""
    ensure_importable(df.sparkSession)
    known = labels.select(F.col(doc_id).cast("long").alias("i"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (fold("i") != 0)).groupBy("i").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("i"), "i").limit(rows)
    # One text a doc_id, the least, so that reruns train on the same rows whatever is repeated.
    src = df.select(F.col(doc_id).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(known), "i").groupBy("i").agg(F.min("t").alias("t"), F.max("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column("t"))
            for i, j in chunks(offs):
                doc, t = distinct_terms(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([b.column("i").slice(i, j - i), b.column("y").slice(i, j - i), pa.array([t[a:z].astype("<i4").tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["i", "y", "x"])

    got = src.mapInArrow(tidied(run), "i long, y int, x binary").toArrow()
    order = np.argsort(got.column("i").to_numpy(), kind="stable") if got.num_rows else np.zeros(0, np.int64)
    sets = [np.frombuffer(x.as_py(), "<i4") for x in got.column("x")]
    sets = [sets[k] for k in order]
    y = got.column("y").to_numpy()[order] if got.num_rows else np.zeros(0)
    doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    return fit(doc, np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64), y)


def score(df: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    spark = df.sparkSession
    ensure_importable(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            data, offs = utf8(b.column("t"))
            for i, j in chunks(offs):
                doc, t = distinct_terms(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], m.slot)
                s = sigmoid(logits(m, doc, t, j - i))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(s)], names=["doc_id", "score"])

    src = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    scored = src.mapInArrow(tidied(run), "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
