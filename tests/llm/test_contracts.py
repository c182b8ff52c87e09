"""Every contract against brute force on awkward documents, and on no documents."""

import datetime
from collections import Counter, defaultdict

import pytest

from helixframe.llm import registry
from tests.llm import brute

Q = {n.split("_")[0]: f for n, f in registry.queries().items()}


def got(spark, folder, op, columns):
    return Counter(tuple(r) for r in Q[op](spark, folder).select(*columns).collect())


def docs(rows):
    return [(r[0], r[1]) for r in rows]


def check(found, wanted):
    wanted = Counter(wanted)
    assert not found - wanted and not wanted - found, (list((found - wanted).items())[:3], list((wanted - found).items())[:3])


def test_op1(spark, folder, rows):
    check(got(spark, folder, "op1", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]), brute.pii(docs(rows)))


def test_op1_spans(spark, folder, rows):
    check(got(spark, folder, "op1", ["doc_id", "spans"]), brute.all_spans(docs(rows)))


def test_op1_terms_among_real_documents(spark, tmp_path):
    """Names that stand beside one address in several documents are found there, and nothing else is."""
    real = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    own = [(10_000 + k, f"{(t or '')[:400]}\nAsk for mrs quillfeather at desk{k % 2}@mail.example about {k}") for k, (_, t) in enumerate(real[:6])]
    own += [(20_000, "Later mrs Quillfeather spoke.")]
    spark.createDataFrame(real + own, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = got(spark, str(tmp_path), "op1", ["doc_id", "spans"])
    check(found, brute.all_spans(real + own))
    terms = {i: s for i, s in found if "term:" in s}
    assert set(terms) >= {i for i, _ in own} and terms[20_000] == "term:6:9,term:10:22"


def test_op2(spark, folder, rows, items):
    check(got(spark, folder, "op2", ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]), brute.contamination(docs(rows), items))


def test_op3(spark, folder, rows):
    check(got(spark, folder, "op3", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]), brute.measures(docs(rows)))
    check(got(spark, folder, "op3", ["doc_id", "kept"]), brute.verdicts(docs(rows)))


def test_op4(spark, folder, rows):
    from helixframe.llm.tokens import default_tokenizer

    check(got(spark, folder, "op4", ["doc_id", "start", "n_tokens", "ids_crc32"]), brute.token_ids(docs(rows), default_tokenizer()))


def test_op5(spark, folder, rows):
    check(got(spark, folder, "op5", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]), brute.repeats(docs(rows)))


def test_op6(spark, folder, rows):
    check(got(spark, folder, "op6", ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]), brute.licenses(docs(rows)))
    found = Q["op6"](spark, folder).collect()
    check(Counter((r.doc_id, r.labels, round(r.score, 9)) for r in found), brute.license_labels(docs(rows)))
    for r in found:
        assert 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


def test_op7(spark, folder, rows):
    by, size, sums = defaultdict(int), {}, defaultdict(lambda: 1)
    for i, t, _, s, _ in rows:
        n = len(brute.BLACK.findall(t or ""))
        by[s] += n
        size[i] = n
        sums[s] |= sums[s] << n | sums[s] << 2 * n  # bit k: some choice of copies takes k words
    names = sorted(by, key=lambda x: (x is None, x or ""))
    quota = dict(zip(names, brute.targets([by[x] for x in names]), strict=True))
    found = Q["op7"](spark, folder).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    source = {r[0]: r[3] for r in rows if r[0] is not None}
    taken = defaultdict(int)
    for r in found:
        assert r.taken <= 2 * r["size"]
        s = source.get(r.doc_id, "a" if r["size"] else None)  # the two rows without an id
        assert r.doc_id is None or r["size"] == size[r.doc_id]
        assert r.source_size == by[s] and abs(r.target - quota[s]) < 1e-6 * (1 + quota[s])
        taken[s] += r.taken
    for s in names:
        nearest = min(abs(k - quota[s]) for k in range(2 * by[s] + 1) if sums[s] >> k & 1)
        assert abs(taken[s] - quota[s]) <= nearest + 0.002 * quota[s]
    assert sorted(map(str, found)) == sorted(map(str, Q["op7"](spark, folder).collect()))


def test_op8(spark, folder, rows):
    import zlib

    found = Q["op8"](spark, folder).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_op8_scores(spark, folder, rows):
    from helixframe.llm import toxicity

    df, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    m = toxicity.train(df, labels)
    again = toxicity.train(df.repartition(7), labels)
    assert (m.slot == again.slot).all() and (m.weight == again.weight).all() and (m.factor == again.factor).all() and m.bias == again.bias
    short = [d for d in docs(rows) if len(d[1] or "") < 20_000]
    want = Counter((i, round(x, 6)) for i, x in brute.machine_scores(short, m))
    found = Counter((r.doc_id, round(r.score, 6)) for r in toxicity.score(spark.createDataFrame(short, "doc_id long, text string"), m).collect())
    check(found, want)


def test_op9(spark, folder, rows):
    check(got(spark, folder, "op9", ["doc_id", "n_shingles", "component_id"]), brute.jaccard(docs(rows)))


def test_op10(spark, folder, rows):
    check(got(spark, folder, "op10", ["doc_id", "n_lines", "n_dropped", "kept_sha256"]), brute.line_dedup(docs(rows)))


def test_op11(spark, folder, rows):
    check(got(spark, folder, "op11", ["doc_id", "n_words", "n_removed", "kept_sha256"]), brute.passages(docs(rows)))


def test_op12(spark, folder, clicks):
    start = datetime.datetime(1970, 1, 1)
    plain = [(c, k, None if t is None else (t - start) // datetime.timedelta(microseconds=1)) for c, k, t in clicks]
    columns = ["funnel", "client_id", *(f"n{k}" for k in (1, 2, 3, 4)), "deepest", "t2", "t3", "t4", "same_depth"]
    check(got(spark, folder, "op12", columns), brute.funnels(plain))


def test_op13(spark, folder, rows):
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    check(got(spark, folder, "op13", columns), brute.fill(docs(rows)))


@pytest.mark.parametrize("op", sorted(Q))
def test_empty(spark, empty, op):
    assert Q[op](spark, empty).collect() == []


def test_toxicity_is_learnt_and_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [(labels[r.doc_id], r.predicted) for r in Q["op8"](spark, sf).where("held_out").collect() if r.doc_id in labels]
    hit = sum(p for y, p in found if y) / sum(y for y, _ in found)
    false = sum(p for y, p in found if not y) / sum(1 - y for y, _ in found)
    assert hit >= 0.85 and false <= 0.02
