import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that operators use inside, as columns of the caller's own.
EXTRA = ("t", "i", "n", "sig", "h", "b", "p", "held", "size", "copies", "kept", "anchor", "doc", "_text", "_flagged", "spans", "start", "shard", "tokens", "_k", "gone", "_term", "x")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def word(r):
    return "".join(r.choice("abcdeéñö") for _ in range(r.randint(2, 9)))


def make_documents():
    r = random.Random(5)
    prose = lambda n: " ".join(word(r) for _ in range(n))
    base, passage = prose(120), prose(60)
    lines = [prose(6) for _ in range(4)]
    texts = [None, "", "  \t\n ", "\n\n\n", "one", "two words", base, base, base, base + " tail", base.replace(" ", "\n", 3), "x " + base]
    texts += [prose(40) + " " + passage + " " + prose(30) for _ in range(5)]
    texts += ["\n".join(r.sample(lines, 3) + [prose(8), "  " + lines[0].upper() + "\t"]) for _ in range(5)]
    texts += [" ".join(["same"] * 300), "a" * 250 + " " + "a" * 250, "ab" * 400, prose(50) + " " + prose(20) * 2]
    texts += ["mail me at a.b+c@ex-ample.co.uk, x@y.z_q@w.e or 1.2.3.4 and 0300.1.1.1 300.1.1.1 call +1 (456) 555-2186. 4111 1111 1111 1111 4111-1111-1111-1112", "9" * 5000 + " " + "1 " * 4000 + "@" * 50, "a@b" + ".c" * 3000]
    texts += ["Released under the MIT License. SPDX-License-Identifier: (Apache-2.0 OR MIT) AND BSD-3-Clause WITH x", "Apache License, Version 2; CC BY-NC 4.0 under  the\nmit-LICENSE", "cc by nc cc by nc"]
    texts += ["tab\tand  two  spaces \r\n trailing ", "nul\0byte text", " odd spaces　here  ", " lead. \n\nEnd.\n next,word 3.14 a_.b", "😀 " * 40 + prose(20)]
    texts += [prose(30_000), "### $$$ %%% " * 40 + prose(60)]
    small = prose(9)
    texts += [small, small, small + " " + word(r), prose(13), prose(13)]
    big = prose(200).split(" ")
    for k in range(12):
        other = list(big)
        other[17 * k % 200] = word(r)
        other[(17 * k + 60) % 200] = word(r)
        texts.append(" ".join(other))
    texts += ["<", "<P", "a <P> b\nc", "<<S>\nx", "<P\n>", "S>\n<M", "M>\n<P\n<S", "é\n😀<\nP>", "no end\nof line", "\n" + prose(30).replace(" ", "\n") + "\n\n"]
    rows = [(3 * k + 1, t, "en", [None, "a", "b", "c"][k % 4], 0 if t is None else len(t)) for k, t in enumerate(texts)]
    rows += rows[5:9] + [(None, base, None, "a", None), (None, None, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def items(rows):
    texts = {r[0]: r[1] for r in rows}
    long = next(t for t in texts.values() if t and len(t.split(" ")) == 131) if any(t and len(t.split(" ")) == 131 for t in texts.values()) else "a b"
    return [(1, " ".join(long.split(" ")[45:70])), (2, "two WORDS"), (3, None), (4, ""), (5, "…"), (5, " ".join(long.split(" ")[45:60])), (6, "never anywhere at all")]


CLICKS = T.StructType([T.StructField("client_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("ts", T.TimestampNTZType())])


@pytest.fixture(scope="session")
def clicks():
    """One client with most rows, ties, repeats, steps at the limit exactly, rows around the borders of blocks."""
    r = random.Random(8)
    kinds = ["view"] * 6 + ["click"] * 5 + ["purchase"] * 2 + ["signup", "error"]
    start = datetime.datetime(2024, 1, 1, 2, 30)
    out = []
    for k in range(6000):
        client = 7 if k % 2 else r.randrange(40)
        at = start + datetime.timedelta(seconds=r.choice((0.000001, 1, 60, 450)) * r.randrange(300 if client != 7 else 3000))
        out.append((client, r.choice(kinds), at))
    limit = datetime.timedelta(minutes=15)
    for client, more in ((101, 0), (102, 1), (103, -1)):
        for step, kind in enumerate(("view", "click", "view", "purchase")):
            out.append((client, kind, start + step * limit + datetime.timedelta(microseconds=more * (step == 3))))
    out += [(104, "view", start), (104, "click", start), (105, "click", start), (105, "view", datetime.datetime(1969, 12, 31, 23, 59, 59, 999999)), (105, "click", datetime.datetime(1970, 1, 1))]
    out += [(106, "view", start), (106, "error", start), (106, "click", start + limit), (107, "view", start), (107, "click", start + limit), (107, "error", start + limit), (108, "other", start)]
    out += [(None, "view", start), (1, None, start), (1, "view", None)] + out[:500]
    r.shuffle(out)
    return out


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory, rows, items, clicks):
    d = str(tmp_path_factory.mktemp("docs"))
    df = spark.createDataFrame(rows, SCHEMA)
    for k, c in enumerate(EXTRA):
        df = df.withColumn(c, F.lit(k))
    df.repartition(5).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(r[0], 1, int(bool(r[1]) and "same" in r[1])) for r in rows] + [(None, None, None)], "doc_id long, quality long, toxic long").write.parquet(f"{d}/labels.parquet")
    df = spark.createDataFrame(clicks, CLICKS)
    for c in ("c", "b", "t", "k", "funnel", "step", "took", "n", "high", "upto", "rank", "deepest"):
        df = df.withColumn(c, F.lit("x"))
    df.repartition(3).write.parquet(f"{d}/clicks.parquet")
    return d


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], CLICKS).write.parquet(f"{d}/clicks.parquet")
    return d
