"""The methods' parts on small inputs, against plain versions."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import components, decontam, licenses, lines, mixing, pii, quality, setjoin, suffixes, tokens, toxicity
from tests.llm import brute


def test_vbyte_round_trip():
    v = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7, 300], np.uint32)
    for n in range(len(v) + 1):
        control, data = tokens.vbyte_encode(v[:n])
        assert (tokens.vbyte_decode(control, data, n, tokens.length_table()) == v[:n]).all()


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    t, e, r = Tokenizer.from_file(path), tokens.Encoder(path), random.Random(3)
    bits = ["a", "Bé", " ", "  ", "\n", "\n\n", "\t", ".", ",", "...", "'s", "3.1", "_", " ", "\r\n", "!", "word", "😀", "<|endoftext|>", " .", ". ", "\0", "²", "ー"]
    for _ in range(3000):
        x = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        assert e.encode([x])[0].tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_batches_of_texts_equal_library(monkeypatch):
    """Texts of a batch are cut together: no cut, cache or dictionary may carry over from one to the next."""
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    t, r = Tokenizer.from_file(path), random.Random(5)
    bits = ["a", "Bé", "ß×", "÷", "É", " ", "  ", "\n", "\n\n", " \n", "\n ", ".", ",", "...", "'s", "'re", "'", "3.1", "_", "word", "😀", "²", "ー", "ɐ", "ɏ", "ʰ", "-", "(", "é.", "é's", "字.", "١.", " '", "ll", "\u0301"]
    odd = ["\t", "\u00a0", "\0", "<|endoftext|>", "\r\n", "\u200b"]
    for cache, lines, chunk, pieces in ((200_000, 500, 4 << 20, 1 << 20), (7, 3, 20, 5), (1, 1, 1, 1)):
        for name, n in (("CACHE_PIECES", cache), ("LINES", lines), ("CHUNK_BYTES", chunk), ("CHUNK_PIECES", pieces)):
            monkeypatch.setattr(tokens, name, n)
        e = tokens.Encoder(path)
        for _ in range(40):
            texts = ["".join(r.choice(bits if r.random() < 0.97 else odd) for _ in range(r.randint(0, 14))) for _ in range(40)]
            for x, ids in zip(texts, e.encode(texts), strict=True):
                assert ids.tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)
        assert len(e.pieces) <= max(cache, 2) and len(e.pieces.older) <= max(cache, 2)


def test_no_text_with_double_spaces_goes_to_the_library_whole(monkeypatch):
    """A batch's equal words are looked up once, and runs of white space don't send their texts to the library."""
    e, whole, asked = tokens.Encoder(tokens.default_tokenizer()), [], []
    library, of = tokens.Pieces.library, tokens.Pieces.of
    monkeypatch.setattr(tokens.Pieces, "library", lambda self, x: whole.append(x) or library(self, x))
    monkeypatch.setattr(tokens.Pieces, "of", lambda self, x: asked.append(x) or of(self, x), raising=False)
    got = e.encode(["word  other, word\n\nother " * 50, " word word"])
    assert sum(map(len, whole)) < 10 and len(asked) == 1 and len(asked[0]) == len(set(asked[0])) < 10
    assert got[1].tolist() == e.library.encode(" word word", add_special_tokens=False).ids


def test_suffix_order_and_prefixes():
    r = random.Random(4)
    for _ in range(60):
        text = np.array([r.randint(1, 3) for _ in range(r.randint(1, 80))] + [0], np.uint16)
        keys = suffixes.symbol_keys(text)
        order = suffixes.suffix_order(text, keys, 200)
        plain = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert order.tolist() == plain
        shared = suffixes.common_prefixes(order, keys, 50)
        for k in range(1, len(plain)):
            a, b = text[plain[k - 1] :].tolist(), text[plain[k] :].tolist()
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[k] == min(n, 50)


def test_hot_fragments_go_the_other_way(spark):
    r = random.Random(8)
    w = lambda n: " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(n))
    passage = w(30)
    docs = [(i, w(20) + " " + passage + " " + w(20)) for i in range(12)] + [(50, passage), (51, passage[10:])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = suffixes.digest(suffixes.drop_repeated_bytes(df, most=2)).collect()
    assert sorted(tuple(x) for x in found) == sorted(brute.repeats(docs))


@pytest.mark.parametrize("most", [1, 20_000])
def test_repeats_inside_the_first_document_and_rows_that_share_an_id(spark, most):
    r = random.Random(12)
    w = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    passage, other = w(100), w(300)
    docs = [(1, w(30) + passage + w(50) + passage + w(20) + passage + passage)] + [(k, w(40) + passage + w(60)) for k in range(2, 8)]
    docs += [(20, other), (25, w(300)), (25, other + w(100)), (25, other[:150] + w(100)), (25, other[:150] + w(100)), (26, other), (26, other), (None, other)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = suffixes.digest(suffixes.drop_repeated_bytes(df, most=most)).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(x) for x in found), key=key) == sorted(brute.repeats(docs), key=key)


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 50)
    for w in (1, 2, 7, 16, 23):
        assert suffixes.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(50 - w + 1)]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64))
    bits, slots = lines.build_mph(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    ranks, base = [], 0
    for b in bits:
        ranks.append(base + np.cumsum(b) - 1)
        base += int(b.sum())
    assert (lines.probe_mph(bits, ranks, keys) == slots).all()


def test_line_index_on_the_executors(spark, monkeypatch):
    docs = [(i, "\n".join(f"this is common line number {k}" for k in range(i, i + 40))) for i in range(30)] + [(3, "other text"), (None, "this is common line number 20\nx"), (None, None)]
    monkeypatch.setattr(lines, "SHARD_KEYS", 8)
    monkeypatch.setattr(lines, "BROADCAST_BYTES", 8 * 28 * 2)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(r) for r in lines.digest(lines.drop_repeated_lines(df)).collect()), key=key) == sorted(brute.line_dedup(docs), key=key)


def test_benchmark_in_several_blocks(spark, rows, items, monkeypatch):
    docs = [(r[0], r[1]) for r in rows]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    taken = []
    monkeypatch.setattr(decontam, "_by_term", lambda counts, plain=decontam._by_term: taken.append(plain(counts)) or taken[-1])
    found = decontam.find_contamination(df, it, block_bytes=12).drop("items", "n_near").collect()
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(r) for r in found), key=key) == sorted(brute.contamination(docs, items), key=key)
    # What came to the driver are counts of each block's own words.
    assert len(taken) > 1 and all(len(x) <= 12 for x in taken)


def test_blocks_of_items_are_bounded_in_bytes(spark):
    it = spark.createDataFrame([(k, "a\nb\n" * 40) for k in range(9)] + [(10, "long " * 200), (11, None)], "item_id long, text string")
    blocks = list(decontam.item_blocks(it, "item_id", "text", 500))
    assert [len(b.ids) for b in blocks] == [3, 3, 3, 1]


def test_proximity(spark):
    df = spark.createDataFrame([(1, "red some green words blue"), (2, "red " + "x " * 40 + "green blue"), (3, "red green")], "doc_id long, text string")
    it = spark.createDataFrame([(9, "blue green red")], "item_id long, text string")
    found = {r.doc_id: (r.n_items, r.n_near) for r in decontam.find_contamination(df, it, slop=8).collect()}
    assert found == {1: (0, 1), 2: (0, 0), 3: (0, 0)}


def test_proximity_with_a_word_that_the_corpus_lacks(spark):
    df = spark.createDataFrame([(1, "red green words blue"), (2, "red green"), (3, "blue x x")], "doc_id long, text string")
    it = spark.createDataFrame([(9, "blue never red")], "item_id long, text string")
    assert {r.doc_id: r.n_near for r in decontam.find_contamination(df, it, slop=8).collect()} == {1: 1, 2: 0, 3: 0}


def test_expressions():
    parse = licenses.parse_expression
    assert parse("MIT OR Apache-2.0 AND BSD-3-Clause") == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert parse("(MIT OR GPL-2.0+) AND ISC and some words") == ["mit", "gpl-2.0+", "or", "isc", "and"]
    assert parse("GPL-2.0 WITH Classpath-exception-2.0 */") == ["gpl-2.0", "classpath-exception-2.0", "with"]
    assert parse("GPL-2.0 WITH MIT") == ["gpl-2.0"] and parse("(MIT) WITH LLVM-exception") == ["mit"]
    assert parse("and MIT") is None and parse("") is None and parse("((MIT") is None and parse("header should be") is None
    assert licenses.expression_labels(parse("GPL-2.0 WITH Classpath-exception-2.0 OR MIT")) == {"gpl-2.0 with classpath-exception-2.0", "mit"}
    assert licenses.allowed(parse("GPL-2.0 OR (MIT AND ISC)"), {"mit", "isc"})
    assert not licenses.allowed(parse("GPL-2.0 AND MIT"), {"mit"})


def test_many_clauses_and_tags_take_little_time(spark):
    began = time.perf_counter()
    many = " AND ".join("(MIT OR ISC)" for _ in range(20_000))
    assert licenses.expression_labels(licenses.parse_expression(many)) == {"mit", "isc"} and licenses.allowed(licenses.parse_expression(many), {"isc"})
    text = "some words before SPDX-License-Identifier: MIT\n" * 5_000 + "SPDX-License-Identifier:\nimport os\n" + "( " * 50_000
    n, places = licenses.scan(text, licenses.automaton(), licenses.word_table())
    assert sum(p[0] == "tag" for p in places) == 5_000 and {p[3] for p in places} == {"mit"}
    assert [p[1] for p in places if p[0] == "tag"][:3] == [3, 10, 17]
    assert time.perf_counter() - began < 20


def test_flow_uses_overlap_and_repeats_last():
    flow = mixing.min_cost_flow([10.0, 10.0], [[0], [0, 1]], [10.0, 15.0])
    to = lambda s: sum(x for (_, t), x in flow.items() if t == s)
    assert abs(to(0) - 10) < 1e-6 and abs(to(1) - 15) < 1e-6
    assert abs(flow[1, 0]) < 1e-6


@pytest.mark.parametrize("sizes", [[(1000, 10)], [(50, 10), (20, 20)], [(700, 3), (1, 5000), (900, 7)]])
def test_equal_rows_are_taken_as_many_as_fit(spark, sizes):
    docs = [(k, "w " * n, "a", "b") for k, (m, n) in enumerate(sizes) for _ in range(m)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, u string").repartition(4)
    r = mixing.mix_sources(df).collect()
    total = sum(m * n for m, n in sizes)
    assert len(r) == len(docs) and abs(sum(x.taken for x in r) - 1.5 * total) <= 5 and {x.copies for x in r} <= {1, 2}
    rows = mixing.mix_documents(df)
    assert rows.columns == df.columns and abs(sum(len(x.text.split()) for x in rows.collect()) - 1.5 * total) <= 5


def test_many_sources_are_joined_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(k, "w " * (k % 7 + 1), f"s{k % 40}") for k in range(2000)], "doc_id long, text string, source string")
    want = sorted(tuple(x) for x in mixing.mix_sources(df.coalesce(1)).drop("sources").collect())
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 3)
    assert sorted(tuple(x) for x in mixing.mix_sources(df.coalesce(1)).drop("sources").collect()) == want


def test_overlapping_sources(spark):
    df = spark.createDataFrame([(k, "w " * 10, ["a"] if k % 2 else ["a", "b"]) for k in range(40)], "doc_id long, text string, source array<string>")
    r = mixing.mix_sources(df).collect()
    assert len(r) == 40 and all(x.taken <= 2 * x["size"] for x in r)


def test_heavy_light_join_equals_brute():
    r = random.Random(6)
    for trial in range(40):
        sets = []
        for _ in range(25):
            base = r.sample(range(60), r.randint(1, 20 if trial % 2 else 8))
            sets += [base, base[:-1] if len(base) > 6 else base, base + [r.randint(60, 70)]]
        sets = [np.array(sorted(set(s)), np.uint64) for s in sets]
        sizes = np.array([len(s) for s in sets])
        comp = setjoin.linked_components(sets, sizes)
        root = list(range(len(sets)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(len(sets)):
            for j in range(i):
                n = len(set(sets[i].tolist()) & set(sets[j].tolist()))
                if 100 * n >= 85 * (sizes[i] + sizes[j] - n):
                    root[find(i)] = find(j)
        assert [[comp[i] == comp[j] for j in range(i)] for i in range(len(sets))] == [[find(i) == find(j) for j in range(i)] for i in range(len(sets))]


@pytest.mark.parametrize("bits", [4, 8, 13, 20])
def test_exchange_keeps_buckets_and_whole_tokens(spark, bits):
    r = random.Random(bits)
    left = sorted({r.getrandbits(64) for _ in range(300)} | {7, 8, 9, (1 << 64) - 1})
    whole = np.array(left, "<u8").tobytes()
    df = spark.createDataFrame([(k, len(left), k, bytearray(whole)) for k in range(2)], "doc_id long, n long, sig long, tokens binary")
    packets = df.mapInArrow(setjoin._set_packets(bits), setjoin._PACKET_DDL)
    buckets = {x.bucket for x in packets.where("bucket >= 0").select("bucket").distinct().collect()}
    assert buckets == {t >> 64 - bits for t in left}
    sets = setjoin._exchange(packets, 85, 4, bits).collect()
    assert len(sets) == 2 and all(sorted(np.frombuffer(x.tokens, "<u8").tolist()) == left for x in sets)


def test_pairs_just_below_the_threshold_stay_apart(spark):
    """Both sets of a pair share all their shingles with other documents, so nothing but the similarity parts them."""
    docs = []
    for k in range(6):
        words = [f"{k}w{j}" for j in range(2200)]
        moved = 162 if k < 3 else 161  # similarity 0.84993 and 0.85079
        a, b = words[:2000], words[moved : 2000 + moved]
        parts = (a, b, a[:1000], a[900:1300], b[1000:])
        docs += [(10 * k + j, " ".join(x)) for j, x in enumerate(parts)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(x) for x in setjoin.jaccard_classes(df).collect()) == sorted(brute.jaccard(docs))


def test_a_document_without_id_links_others(spark):
    words = [f"w{k}" for k in range(400)]
    docs = [(1, " ".join(words[:300])), (None, " ".join(words[22:322])), (3, " ".join(words[44:344]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in setjoin.jaccard_classes(df).collect()} == {1: 1, None: None, 3: 1}


def test_large_components_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK_BYTES", 2000)
    r = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    docs = []
    for k in range(60):
        x = list(base)
        x[r.randrange(60)] = f"v{k}"
        docs.append((k, " ".join(x)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(x) for x in setjoin.jaccard_classes(df).collect()) == sorted(brute.jaccard(docs))


def test_components(spark):
    e = [(1, 2), (2, 3), (5, 4), (9, 9), (30, 31), (31, 32), (32, 33), (33, 34)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 5: 4, 31: 30, 32: 30, 33: 30, 34: 30}


def test_cascade_order_never_changes_the_verdict():
    from helixframe.llm.words import utf8

    import pyarrow as pa

    data, offs = utf8(pa.array([brute_text for brute_text in ("a b " * 80, "x! " * 90, "HELLO WORLD " * 60, "fine words here " + " ".join(f"w{k}" for k in range(90)), "")]))
    want = None
    for order in (quality.RULES, quality.RULES[::-1]):
        got = quality.apply_cascade(quality.Chunk(data, offs), list(order)).tolist()
        assert want in (None, got)
        want = got
    assert want == [False, False, False, True, False]


def test_machine_learns_pairs():
    r = np.random.default_rng(3)
    n = 3000
    a, b = r.integers(0, 2, n), r.integers(0, 2, n)
    docs = [np.array([x for x, on in ((10, u), (20, v), (30, not u), (40, not v)) if on]) for u, v in zip(a, b, strict=True)]
    doc = np.repeat(np.arange(n), [len(d) for d in docs])
    m = toxicity.fit(doc, np.concatenate(docs), (a & b))
    assert len(m.weight) == 4
    s = toxicity.sigmoid(toxicity.logits(m, *_slots(m, doc, np.concatenate(docs)), n))
    assert ((s >= 0.5) == (a & b)).all()


def _slots(m, doc, t):
    s = m.slot[t]
    return doc[s >= 0], s[s >= 0]


def test_disclosing_terms(spark):
    docs = [(k, f"note {k} by smithers today: w.smith@mail.example and more text {k * 7}") for k in range(6)]
    docs += [(100 + k, f"common words today and more text number {k}") for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.digest(pii.find_personal_data(df)).collect()}
    at = docs[0][1].index("smithers")
    assert f"term:{at}:{at + 8}" in found[0] and "term" not in found[100]
    clean = {r.doc_id: r.text for r in pii.sanitize(df).collect()}
    assert "smithers" not in clean[0] and "[email]" in clean[0] and "today" in clean[0] and clean[100] == docs[6][1]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 129, 4096, 4097, 5000])
def test_running_totals(spark, n):
    x = [k * k % 17 for k in range(n)]
    df = spark.createDataFrame([(x,)], "x array<int>")
    assert df.select(pii.running_totals(F.col("x")).alias("y")).first().y == list(itertools.accumulate(x))


def test_long_texts_of_numbers_take_time_as_their_length(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, " ".join(str(10_000 + k) for k in range(n)))], "doc_id long, text string")
        began = time.perf_counter()
        assert pii.base_spans(df).select(F.size("_card").alias("n")).first().n == 0
        return time.perf_counter() - began

    seconds(40_000)
    assert seconds(40_000) < 10 and seconds(160_000) < 30


def test_copies_and_footers_disclose_alike(spark):
    docs = [f"note {k} by smithers today: w.smith@mail.example and more text {k * 7}" for k in range(3)] * 300
    docs += [f"letter {k}x {k * 3} {k * 5}\n" + "so it is as it was then and ever. " * 6 + "Ask for jeeves at bertie@mail.example any day" for k in range(40)]
    docs += [f"common words today and more text number {k}" for k in range(2000)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    told = {r.term: r.disclosure for r in pii.disclosing_terms(df).collect()}
    assert told["smithers"] == pytest.approx(1) and told["jeeves"] == pytest.approx(1)


@pytest.mark.parametrize("text,wanted", [("9" * 30_000, 0), ("1-" * 30_000 + "1", 0), ("a." * 30_000 + "@b.c", 1), ("+1" + " " * 40_000 + "2", 0)])
def test_long_runs_do_not_overflow(spark, text, wanted):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.digest(pii.find_personal_data(df)).first()
    assert r.n_email + r.n_ip + r.n_card + r.n_phone == wanted
