"""Information-theoretic sanitisation with DataFrame functions alone.

Base detection finds e-mail addresses, IP addresses, card and phone numbers by pattern. These are the protected
entities. The corpus then tells which terms give an entity away: for a term t in the context of entity e,

    disclosure(t, e) = PMI(e; t) / IC(e) = log(P(e | t) / P(e)) / log(1 / P(e)),

the share of the entity's information content that the term reveals. P(e | t) is the number of distinct texts with t
in a context of e over the number of distinct texts that hold t; P(e) is that of distinct texts with e over all.
Distinct texts on both sides, so that copies of one document are one piece of evidence. A term above ``GENERALISE`` in
``MIN_CONTEXTS`` texts or more is generalised to its class, one above ``REMOVE`` is removed, wherever it occurs.

Patterns are written with possessive repetition and start guards: they accept what the plain ones accept, without
recursion or quadratic search on long runs.

Contexts are the words within 160 characters, at most 8, on either side of an entity: parameters of the method; the
counts cover all texts whole.

Edge cases: null texts count as empty; repeated rows are scanned alike; rows without a doc_id are told apart by their
texts; texts of any length are scanned whole; extra columns of any name are left out; an empty table gives an empty
table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.session import materialize

GENERALISE = 0.80
REMOVE = 0.95
MIN_CONTEXTS = 2
CONTEXT_CHARS = 160
CONTEXT_WORDS = 8
BLOCK_CHARS = 256
#: Bytes of flagged terms, or of their documents' ids, that are sent to all executors; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"
_MAIL = "A-Za-z0-9._%+-"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: kind, what a text must contain, pattern.
KINDS = (
    ("email", "@", rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", ".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", None, r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
_SPAN = "array<struct<s:int,e:int,v:string>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: expressions inside lambdas aren't shared otherwise."""
    return F.transform(F.array(value), use)[0]


def running_totals(x: Column, levels: int = 5, block: int = 16) -> Column:
    """Sum of each element of an array of integers and all before it, in time that grows as its length.

    Sums of blocks first, their own running totals, then each block's beginning: no growing array is copied.
    """

    def beginning(y: Column, end: Column) -> Column:
        return F.aggregate(F.slice(y, F.lit(1), end), F.lit(0), lambda a, v: a + v)

    def short(y: Column, before: Column) -> Column:
        return F.transform(y, lambda _, i: before + beginning(y, i + 1))

    if levels == 1:
        return _let(x, lambda y: short(y, F.lit(0)))

    def blocks(y: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(y) - 1) / block).cast("int")), lambda k: F.slice(y, k * block + 1, F.lit(block)))
        return _let(parts, within)

    def within(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, v: a + v))
        both = F.arrays_zip(parts.alias("p"), sums.alias("n"), running_totals(sums, levels - 1, block).alias("t"))
        return F.flatten(F.transform(both, lambda z: short(z["p"], z["t"] - z["n"])))

    return _let(x, lambda y: F.when(F.size(y) <= block, short(y, F.lit(0))).otherwise(blocks(y)))


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern with their places in code points: lengths of matches and of what lies between add up."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(found: Column) -> Column:
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.length(g) + F.length(v))
        span = lambda v, end: F.struct((end - F.length(v)).cast("int").alias("s"), end.cast("int").alias("e"), v.alias("v"))
        return F.zip_with(found, running_totals(sizes), span)

    return _let(found, lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(F.array().cast(_SPAN)))


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return (acc + d - F.when(d > 9, 9).otherwise(0)).cast("int")

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _keeps(kind: str):
    return lambda x: valid(kind, x["v"])


def _entities(kind: str) -> Column:
    return F.transform(f"_{kind}", lambda x: F.struct(F.concat(F.lit(f"{kind}:"), F.lower(x["v"])).alias("entity"), x["s"].alias("s"), x["e"].alias("e")))


def _replaced(kind: str) -> Column:
    return F.transform(f"_{kind}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{kind}]").alias("r")))


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with one array of spans for each kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    for kind, mark, pattern in KINDS:
        may = F.contains(t, F.lit(mark)) if mark else F.lit(True)
        if kind != "email":
            may = may & t.rlike("[0-9]")
        found = F.when(may, located(t, pattern)).otherwise(F.array().cast(_SPAN))
        df = df.withColumn(f"_{kind}", F.filter(found, _keeps(kind)))
    return df


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    return F.regexp_extract_all(_lower(text), F.lit(WORD), F.lit(0))


def contexts(spanned: DataFrame, text: str) -> DataFrame:
    """(entity, terms): each entity of each of the distinct texts, with the distinct words near its places there.

    Contexts are cut from blocks of the text, so that neither a text is walked once an entity nor carried beside each.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    spans = F.concat(*(_entities(k) for k, _, _ in KINDS))
    blocks = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))

    def piece(b: Column, lo: Column, size: Column) -> Column:
        """Code points from ``lo`` on; ``size`` is no more than a block."""
        k = F.floor(lo / BLOCK_CHARS).cast("int")
        two = F.concat(F.get(b, k), F.coalesce(F.get(b, k + 1), F.lit("")))
        return F.coalesce(F.substring(two, lo - k * BLOCK_CHARS + 1, size), F.lit(""))

    def near(b: Column, x: Column) -> Column:
        lo = F.greatest(x["s"] - CONTEXT_CHARS, F.lit(0))
        after = F.slice(words(piece(b, x["e"], F.lit(CONTEXT_CHARS))), 1, CONTEXT_WORDS)

        def last(before: Column) -> Column:
            # The word that the cut may have split is the first of a full window before, the last of one after.
            whole = F.greatest(F.size(before) - F.when(lo > 0, 1).otherwise(0), F.lit(0))
            return F.slice(before, F.size(before) - F.least(whole, F.lit(CONTEXT_WORDS)) + 1, F.lit(CONTEXT_WORDS))

        terms = F.concat(_let(words(piece(b, lo, x["s"] - lo)), last), after)
        return F.struct(x["entity"].alias("entity"), F.array_distinct(terms).alias("terms"))

    hit = spanned.where(F.size(spans) > 0)
    placed = hit.select(F.xxhash64(t).alias("row"), F.explode(_let(blocks, lambda b: F.transform(spans, lambda x: near(b, x)))).alias("x"))
    each = placed.groupBy("row", F.col("x.entity").alias("entity"))
    return each.agg(F.array_distinct(F.flatten(F.collect_list("x.terms"))).alias("terms")).drop("row")


def disclosing_terms(df: DataFrame, text: str = "text", generalise: float = GENERALISE, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """(term, disclosure): terms that reveal some entity, by the statistics of the whole corpus."""
    texts = materialize(df.select(F.coalesce(F.col(text), F.lit("")).alias("text")).distinct(), "pii-texts")
    seen = materialize(contexts(base_spans(texts), "text"), "pii-contexts")
    entity = seen.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= min_contexts)
    pairs = seen.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= min_contexts)
    pairs = materialize(pairs.join(entity, "entity"), "pii-pairs")
    if pairs.limit(1).count() == 0:
        return pairs.select("term", F.lit(0.0).alias("disclosure"))
    n_docs = texts.count()
    # Only terms met beside an entity are counted; which they are is sent to the texts while they are few.
    wanted = pairs.select("term").distinct()
    size = wanted.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    terms = texts.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    terms = terms.join(F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted, "term", "left_semi")
    frequent = terms.groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") >= min_contexts)
    p_e = F.least(F.col("n_e") / n_docs, F.lit(0.5))
    p_et = F.least(F.col("n_et") / F.col("n_t"), F.lit(1.0))
    told = F.log2(p_et / p_e) / -F.log2(p_e)
    return pairs.join(frequent, "term").groupBy("term").agg(F.max(told).alias("disclosure")).where(F.col("disclosure") >= generalise)


def term_spans(df: DataFrame, flagged: DataFrame, text: str, key: str) -> DataFrame:
    """``df`` with ``_term``: places of the flagged terms that each document holds.

    Documents are told apart by ``key`` and the hash of their text, so that rows without a key aren't one group.
    """
    size = flagged.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    terms = F.broadcast(flagged) if size <= BROADCAST_BYTES else flagged
    df = df.withColumn("_h", F.xxhash64(text))
    said = F.coalesce(F.col(text), F.lit(""))
    some = df.select(F.col(key).alias("_key"), F.col("_h").alias("_hash"), F.explode(F.array_distinct(words(said))).alias("term"))
    holders = materialize(some.join(terms, "term", "left_semi").select("_key", "_hash").distinct(), "pii-holders")
    few = holders.count() * 24 <= BROADCAST_BYTES
    holds = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_h") == F.col("_hash"))
    own = df.join(F.broadcast(holders) if few else holders, holds, "left_semi")
    # There every word with its place meets the flagged terms: one pass, however many terms a text holds.
    each = own.select(F.col(key).alias("_key"), F.col("_h").alias("_hash"), F.explode(located(_lower(said), WORD)).alias("x"))
    each = each.select("_key", "_hash", F.col("x.v").alias("term"), F.col("x.s").alias("s"), F.col("x.e").alias("e")).join(terms, "term")
    held = each.groupBy("_key", "_hash").agg(F.sort_array(F.collect_set(F.struct("s", "e", F.col("disclosure").alias("d")))).alias("_term"))
    held = materialize(held, "pii-held")
    out = df.join(held, holds, "left").drop("_key", "_hash", "_h")
    return out.withColumn("_term", F.coalesce("_term", F.array().cast("array<struct<s:int,e:int,d:double>>")))


def find_personal_data(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with the spans of the four base kinds and of disclosing terms."""
    plain = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    flagged = materialize(disclosing_terms(plain), "pii-terms")
    if flagged.limit(1).count() == 0:
        return base_spans(plain).withColumn("_term", F.array().cast("array<struct<s:int,e:int,d:double>>"))
    return base_spans(term_spans(plain, flagged, "text", "doc_id"))


def _shown(kind: str) -> Column:
    return F.transform(f"_{kind}", lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def digest(found: DataFrame) -> DataFrame:
    base = F.concat(*(_shown(k) for k, _, _ in KINDS))
    # An array is joined in one pass: spans are shown by kind as listed, those of terms last.
    return found.select("doc_id", *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k, _, _ in KINDS), F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(base, _shown("term")), ",").alias("spans"))


def sanitize(df: DataFrame, text: str = "text", doc_id: str = "doc_id", remove: float = REMOVE) -> DataFrame:
    """(doc_id, text): base spans become their kind in brackets; terms become their class, or go."""
    found = find_personal_data(df, text, doc_id)
    parts = [_replaced(k) for k, _, _ in KINDS]
    shown = lambda x: F.substring(F.col("text"), x["s"] + 1, x["e"] - x["s"])
    general = lambda x: F.when(x["d"] >= remove, "").when(shown(x).rlike("^[0-9]+$"), "[number]").otherwise("[word]")
    parts.append(F.transform("_term", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), general(x).alias("r"))))
    spans = F.array_sort(F.concat(*parts))

    def step(acc: Column, x: Column) -> Column:
        skip = x["s"] < acc["at"]
        out = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), x["r"])
        return F.struct(F.when(skip, acc["at"]).otherwise(x["e"]).alias("at"), F.when(skip, acc["out"]).otherwise(out).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return found.withColumn("_done", done).select("doc_id", F.concat(F.col("_done.out"), F.substring(F.col("text"), F.col("_done.at") + 1, F.lit(2147483647))).alias("text"))
