"""License scans: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser reads expressions.

Texts are reduced to lower-cased words joined by single spaces, in bytes, so that a phrase matches whatever stands
between its words; one automaton walks each text once. Places of identifier tags are looked up again in the text
itself, where the expression that follows on the same line is parsed with the precedence with > and > or; its
operands are known identifiers, so that prose after a tag gives no label.

Edge cases: null and empty texts have no words, no labels and score 0; repeated rows are scanned alike; texts of any
length are scanned whole in time proportional to them; extra columns of any name are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.words import table_alnum, table_lower, tidied
from helixframe.session import ensure_importable

#: The phrases that count as base places, with their labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Further notice phrases, their labels and how surely each names a license.
NOTICES = (
    ("mit license", "mit", 0.8),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 0.9),
    ("apache license", "apache-2", 0.7),
    ("gnu general public license", "gpl", 0.8),
    ("gnu general public license version 2", "gpl-2", 0.9),
    ("gnu general public license version 3", "gpl-3", 0.9),
    ("gnu lesser general public license", "lgpl", 0.9),
    ("gnu affero general public license", "agpl", 0.9),
    ("mozilla public license", "mpl", 0.8),
    ("mozilla public license version 2", "mpl-2", 0.9),
    ("redistribution and use in source and binary forms", "bsd", 0.8),
    ("bsd license", "bsd", 0.7),
    ("isc license", "isc", 0.7),
    ("cc by", "cc-by", 0.6),
    ("cc by sa", "cc-by-sa", 0.8),
    ("cc by nd", "cc-by-nd", 0.8),
    ("cc0 1 0", "cc0", 0.8),
    ("creative commons attribution", "cc-by", 0.7),
    ("creative commons attribution sharealike", "cc-by-sa", 0.8),
    ("creative commons attribution noncommercial", "cc-by-nc", 0.8),
    ("this is free and unencumbered software released into the public domain", "unlicense", 0.9),
    ("released into the public domain", "public-domain", 0.7),
    ("all rights reserved", "all-rights-reserved", 0.5),
)
BASE_SURE = 0.95
TAG = "spdx license identifier"
#: A tag at the beginning of a word, and what follows it on its line.
_TAG = re.compile(r"(?<![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])SPDX-License-Identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9.+:-]+)")
_RANK = {"or": 1, "and": 2, "with": 3}
#: Identifiers that an operand may be, by family; other words end an expression.
_KNOWN = re.compile(
    r"mit(-0|-cmu|-advertising|-feh|-modern-variant|-open-group)?|apache-[12](\.[01])?|0bsd|bsd-[1-4]-clause(-[a-z0-9-]+)?|isc|(a|l)?gpl-[1-3](\.[0-9])?(\+|-only|-or-later)?|gfdl-1\.[1-3](-[a-z-]+)?"
    r"|mpl-[12]\.[01](-no-copyleft-exception)?|epl-[12]\.0|cddl-1\.[01]|cpl-1\.0|cc0-1\.0|cc-by(-nc)?(-sa|-nd)?-[1-4]\.[05]|cc-pddc|unlicense|zlib(-acknowledgement)?|libpng(-2\.0)?|artistic-[12]\.0(-[a-z0-9]+)?"
    r"|bsl-1\.0|wtfpl|python-2\.0(\.1)?|psf-2\.0|cnri-python|ofl-1\.[01]|eupl-1\.[0-2]|ms-(pl|rl)|postgresql|openssl|curl|x11|xnet|w3c(-[0-9a-z]+)?|afl-[1-3]\.[0-2]|osl-[1-3]\.[01]|cecill-([12]\.[01]|[abc])"
    r"|lppl-1\.[0-3][ac]?|vim|ruby|ncsa|upl-1\.0|unicode-(3\.0|dfs-201[56]|tou)|blueoak-1\.0\.0|beerware|hpnd|ijg|intel|ipl-1\.0|json|nasa-1\.3|ntp|odbl-1\.0|odc-by-1\.0|pddl-1\.0|php-3\.0[01]?|qpl-1\.0|sleepycat|tcl"
    r"|zpl-[12]\.[01]|ecl-[12]\.0|eudatagrid|fair|ftl|icu|imagemagick|info-zip|mulanpsl-[12]\.0|naumen|nokia|oldap-2\.[0-8]|sgi-b-[12]\.[01]|spl-1\.0|vsl-1\.0|watcom-1\.0|xfree86-1\.1|(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+"
)
#: Identifiers that may follow "with".
_EXCEPTION = re.compile(r"[a-z0-9.+-]+-exception(-[a-z0-9.]+)*|linux-syscall-note|[a-z0-9.+-]+-linking-exception|addition(ref)?-[a-z0-9.-]+")


def parse_expression(text: str) -> list[str] | None:
    """Postfix form of the longest license expression that ``text`` begins with, None where it holds none.

    Operands are known identifiers, in lower case; "with" stands between one and an exception. What is recorded at each
    possible end is how far the output and which operators hold, so the time is in proportion to the text.
    """
    out: list[str] = []
    ops: list[str] = []
    best: tuple[int, tuple[str, ...]] | None = None
    operand, at, depth, plain = True, 0, 0, False
    while m := _TOKEN.match(text, at):
        t = m[1].lower()
        if operand:
            if t == "(" and (not ops or ops[-1] != "with"):
                ops.append(t)
                depth += 1
            elif (_EXCEPTION if ops and ops[-1] == "with" else _KNOWN).fullmatch(t):
                plain = not (ops and ops[-1] == "with")
                out.append(t)
                operand = False
            else:
                break
        elif t == ")":
            if not depth:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            depth -= 1
            plain = False
        elif t in _RANK and (t != "with" or plain):
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[t]:
                out.append(ops.pop())
            ops.append(t)
            operand = True
        else:
            break
        at = m.end()
        if not operand and not depth:
            best = len(out), tuple(reversed(ops))
    return out[: best[0]] + list(best[1]) if best else None


def expression_labels(postfix: list[str]) -> set[str]:
    """The licenses that an expression names, an exception with its license."""
    stack: list[str] = []
    for t in postfix:
        if t == "with":
            exception = stack.pop()
            stack[-1] += f" with {exception}"
        elif t not in _RANK:
            stack.append(t)
    return set(stack)


def allowed(postfix: list[str], accepted: set[str]) -> bool:
    """Whether some alternative needs accepted licenses only."""
    stack: list[tuple[str, bool]] = []
    for t in postfix:
        if t not in _RANK:
            stack.append((t, t in accepted))
            continue
        (b, yes_b), (a, yes_a) = stack.pop(), stack.pop()
        if t == "with":
            stack.append((f"{a} with {b}", f"{a} with {b}" in accepted))
        else:
            stack.append(("", yes_a or yes_b if t == "or" else yes_a and yes_b))
    return stack.pop()[1]


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    found: dict[str, list[tuple]] = {}
    for phrase, label in BASE_PHRASES:
        found.setdefault(f" {phrase} ", []).append(("base", label, BASE_SURE, len(phrase.split())))
    for phrase, label, sure in NOTICES:
        found.setdefault(f" {phrase} ", []).append(("notice", label, sure, len(phrase.split())))
    found[f" {TAG} "] = [("tag", "", 1.0, len(TAG.split()))]
    for k, v in found.items():
        a.add_word(k, v)
    a.make_automaton()
    return a


def word_table() -> bytes:
    """Byte translation: lower case, and a space for everything between words."""
    return bytes(np.where(table_alnum(), table_lower(), 0x20).astype(np.uint8))


def scan(text: str, machine, table: bytes) -> tuple[int, list[tuple[str, int, int, str, float]]]:
    """Number of words, and (kind, first word, number of words, label, certainty) of each place."""
    words = text.encode().translate(table).split()
    if not words:
        return 0, []
    flat = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places, seen, at = [], 0, 0
    tag = False
    for end, hits in machine.iter(flat):
        seen += flat.count(" ", at, end)
        at = end
        for kind, label, sure, n in hits:
            if kind == "tag":
                tag = True
            else:
                places.append((kind, seen - n, n, label, sure))
    if tag:
        first = at = 0
        for m in _TAG.finditer(text):
            first += len(text[at : m.start()].encode().translate(table).split())
            at = m.start()
            if (post := parse_expression(m[1])) is not None:
                places.extend(("tag", first, 3, label, 1.0) for label in sorted(expression_labels(post)))
    return len(words), places


_PLACE = pa.struct([("kind", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("sure", pa.float64())])


def find_licenses(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, places): every tag and notice of each document."""
    ensure_importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, table = automaton(), word_table()
        keys = ("kind", "first", "words", "label", "sure")
        for b in batches:
            got = [scan(t or "", machine, table) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array([n for n, _ in got], pa.int64()), pa.array([[dict(zip(keys, p, strict=True)) for p in ps] for _, ps in got], pa.list_(_PLACE))], names=["doc_id", "n_words", "places"])

    src = df.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    return src.mapInArrow(tidied(run), "doc_id long, n_words long, places array<struct<kind:string,first:long,words:long,label:string,sure:double>>")


def summarize(found: DataFrame) -> DataFrame:
    """One row per document: base places and labels, all labels, and the chance that none of them is mistaken away."""
    base = F.filter("places", lambda p: p["kind"] == "base")
    text = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda p: p["label"]))), ",")
    missed = F.aggregate("places", F.lit(1.0), lambda acc, p: acc * (1 - p["sure"]))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda p: p["first"])).alias("first_word"), F.array_max(F.transform(base, lambda p: p["first"])).alias("last_word"), text(base).alias("base_labels"), text(F.col("places")).alias("labels"), (1 - missed).alias("score"))
