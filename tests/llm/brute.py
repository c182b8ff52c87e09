"""Plain-Python versions of the contracts, one result for each row given."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLACK = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
KINDS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def low(t):
    return (t or "").translate(_LOW)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def pii(docs):
    out = []
    for i, t in docs:
        spans, n = [], []
        for kind, r in KINDS:
            c = 0
            for m in r.finditer(t or ""):
                digits = re.sub("[^0-9]", "", m[0])
                ok = {"email": lambda: True, "ip": lambda m=m: all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")), "card": lambda d=digits: 13 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]()
                if ok:
                    c += 1
                    spans.append(f"{kind}:{m.start()}:{m.end()}")
            n.append(c)
        out.append((i, *n, sha(",".join(spans))))
    return out


def contamination(docs, items):
    occ = defaultdict(list)
    for i, t in items:
        w = ALNUM.findall(low(t))
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            occ[tuple(w[s : s + n])].append(str(i))
    sizes, out = {len(k) for k in occ}, []
    for i, t in docs:
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in occ:
                    hit.update(range(s, s + n))
                    found.update(occ[k])
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def measures(docs):
    out = []
    for i, t in docs:
        w, seen, dup = BLACK.findall(t or ""), set(), 0
        for line in (t or "").split("\n"):
            if BLACK.search(line):
                dup += line in seen
                seen.add(line)
        c, marked = Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for k in range(len(w) - 2):
            if c[w[k], w[k + 1], w[k + 2]] > 1:
                marked.update((k, k + 1, k + 2))
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(marked), len(w) < 50 or 100 * len(marked) > 50 * len(w)))
    return out


def token_ids(docs, path):
    import numpy as np
    from tokenizers import Tokenizer

    t, out, at = Tokenizer.from_file(path), [], 0
    enc = [(i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x in docs]
    for i, ids in sorted(enc, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(np.array(r[1], "<u2").tobytes()))):
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def repeats(docs, length=100):
    first, out = {}, []
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - length + 1 if i is not None else 0):
            g = b[k : k + length]
            first[g] = min(first.get(g, (i, k)), (i, k))
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1 if i is not None else 0):
            if first[b[k : k + length]] < (i, k):
                gone[k : k + length] = b"\1" * length
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, y in zip(b, gone, strict=True) if not y))))
    return out


def licenses(docs):
    phrases, out = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")), []
    for i, t in docs:
        w, places = ALNUM.findall(low(t)), []
        for p, label in phrases:
            p = p.split()
            places += [(s, label) for s in range(len(w) - len(p) + 1) if w[s : s + len(p)] == p]
        out.append((i, len(w), len(places), min((s for s, _ in places), default=None), max((s for s, _ in places), default=None), ",".join(sorted({x for _, x in places}))))
    return out


def shingles(t, size=4):
    w = BLACK.findall(low(t))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else (frozenset([tuple(w)]) if w else frozenset())


def jaccard(docs, size=4, percent=85):
    sets = [shingles(t, size) for _, t in docs]
    ids = [i for i, _ in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for k, s in enumerate(sets):
        for g in s:
            by[g].add(k)
    for k, s in enumerate(sets):
        near = Counter(j for g in s for j in by[g] if j < k)
        for j, n in near.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(k)] = find(j)
    low_ = {}
    for k, i in enumerate(ids):
        if i is not None:
            low_[find(k)] = min(low_.get(find(k), i), i)
    return [(i, len(sets[k]), None if i is None else low_[find(k)]) for k, i in enumerate(ids)]


def line_dedup(docs):
    def key(x):
        return low(x.strip(" \t\n\x0b\x0c\r"))

    held, out = defaultdict(set), []
    for i, t in docs:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 20:
                    held[key(x)].add(i)
    for i, t in docs:
        ls = (t or "").split("\n")
        keep = [x for x in ls if len(held.get(key(x), ())) < 3 or max(held[key(x)]) == i]
        out.append((i, len(ls), len(ls) - len(keep), sha("\n".join(keep))))
    return out


def targets(sizes):
    w, total, capped = [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        unit = (total - sum(2 * sizes[i] for i in capped)) / sum(w[i] for i in free) if free else 0
        over = {i for i in free if unit * w[i] > 2 * sizes[i]}
        if not over:
            return [2.0 * sizes[i] if i in capped else unit * w[i] for i in range(len(sizes))]
        capped |= over


def personal_spans(docs):
    """(kind, start, end, text) by document, by kind as listed, then start."""
    out = []
    for _, t in docs:
        spans = []
        for kind, r in KINDS:
            for m in r.finditer(t or ""):
                digits = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": kind == "ip" and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
                if ok:
                    spans.append((kind, m.start(), m.end(), m[0]))
        out.append(spans)
    return out


def disclosures(docs, generalise=0.80, least=2):
    """Terms that reveal an entity: counts over distinct texts, contexts of 160 characters and 8 words a side."""
    from math import log2

    texts = sorted({t or "" for _, t in docs})
    n_e, n_et, n_t = Counter(), Counter(), Counter()
    for t, spans in zip(texts, personal_spans([(None, t) for t in texts]), strict=True):
        n_t.update(set(ALNUM.findall(low(t))))
        near = defaultdict(set)
        for kind, s, e, v in spans:
            lo = max(s - 160, 0)
            before = ALNUM.findall(low(t[lo:s]))
            near[f"{kind}:{v.lower()}"].update(before[lo > 0 :][-8:] + ALNUM.findall(low(t[e : e + 160]))[:8])
        for entity, terms in near.items():
            n_e[entity] += 1
            n_et.update((entity, x) for x in terms)
    told = {}
    for (entity, term), k in n_et.items():
        if k >= least and n_e[entity] >= least and n_t[term] >= least:
            p = min(n_e[entity] / len(texts), 0.5)
            told[term] = max(told.get(term, 0), log2(min(k / n_t[term], 1) / p) / -log2(p))
    return {t: d for t, d in told.items() if d >= generalise}


def all_spans(docs):
    """(doc_id, spans) with the spans of disclosing terms last."""
    told, out = disclosures(docs), []
    for (i, t), base in zip(docs, personal_spans(docs), strict=True):
        terms = [(m.start(), m.end()) for m in ALNUM.finditer(low(t)) if m[0] in told]
        out.append((i, ",".join([f"{k}:{s}:{e}" for k, s, e, _ in base] + [f"term:{s}:{e}" for s, e in terms])))
    return out


def verdicts(docs):
    """(doc_id, kept) by all quality rules."""
    out = []
    for (i, t), m in zip(docs, measures(docs), strict=True):
        t = t or ""
        _, words, chars, symbols, dup, _, failed = m
        lines = sum(bool(BLACK.search(x)) for x in t.split("\n"))
        upper, letters = (len(re.findall(x, t)) for x in ("[A-Z]", "[A-Za-z]"))
        bad = 100 * symbols > 25 * words or 100 * t.count("!") > 50 * words or 100 * upper > 60 * letters or chars > 20 * words or 10 * chars < 15 * words or 100 * dup > 60 * lines
        out.append((i, not failed and not bad))
    return out


def expression(tokens, known, exception):
    """Labels of a license expression that all the tokens make up, None if they don't; by recursive descent."""

    def clause(k):
        if k < len(tokens) and tokens[k] == "(":
            found = either(k + 1)
            return (found[0], found[1] + 1) if found and found[1] < len(tokens) and tokens[found[1]] == ")" else None
        if k >= len(tokens) or not known(tokens[k]):
            return None
        if k + 2 < len(tokens) and tokens[k + 1] == "with" and exception(tokens[k + 2]):
            return {f"{tokens[k]} with {tokens[k + 2]}"}, k + 3
        return {tokens[k]}, k + 1

    def chain(part, word):
        def parse(k):
            found = part(k)
            while found and found[1] < len(tokens) and tokens[found[1]] == word:
                more = part(found[1] + 1)
                if not more:
                    return found
                found = found[0] | more[0], more[1]
            return found

        return parse

    either = chain(chain(clause, "and"), "or")
    found = either(0)
    return found[0] if found and found[1] == len(tokens) else None


def license_labels(docs):
    """(doc_id, labels, score) by phrases in the words and tags in the text."""
    from helixframe.llm import licenses as lic

    out = []
    for i, t in docs:
        t = t or ""
        flat, labels, missed = f" {' '.join(ALNUM.findall(low(t)))} ", set(), 1.0
        for phrase, label, sure in [(p, x, lic.BASE_SURE) for p, x in lic.BASE_PHRASES] + list(lic.NOTICES):
            n = len(re.findall(f"(?= {phrase} )", flat))
            if n:
                labels.add(label)
                missed *= (1 - sure) ** n
        for line in re.findall(r"(?i)SPDX-License-Identifier[ \t]*:[ \t]*([^\r\n]*)", t):
            m = re.match(r"(?:[ \t]*(?:\(|\)|[A-Za-z0-9.+:-]+))*", line)
            tokens = [x.lower() for x in re.findall(r"\(|\)|[A-Za-z0-9.+:-]+", m[0])]
            for n in range(len(tokens), 0, -1):
                if (found := expression(tokens[:n], lambda x: lic._KNOWN.fullmatch(x), lambda x: lic._EXCEPTION.fullmatch(x))) is not None:
                    labels |= found
                    missed = 0.0
                    break
        out.append((i, ",".join(sorted(labels)), round(1 - missed, 9)))
    return out


def machine_scores(docs, m):
    """(doc_id, score) of a factorization machine, pair by pair."""
    import numpy as np

    from helixframe.llm.toxicity import BITS, LONG, PREFIXES
    from helixframe.llm.words import hash_word, mix

    out = []
    for i, t in docs:
        slots = set()
        for w in ALNUM.findall(low(t)):
            b = w.encode()
            hs = [hash_word(b)] + [int(mix(np.array([hash_word(b[:k])], np.uint64) + np.uint64(k))[0]) for k in PREFIXES if len(b) >= max(LONG, k + 1)]
            slots |= {int(m.slot[h >> 64 - BITS]) for h in hs} - {-1}
        s = sorted(slots)
        z = m.bias + sum(m.weight[a] for a in s) + sum(float(m.factor[a] @ m.factor[b]) for k, a in enumerate(s) for b in s[:k])
        out.append((i, 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))))
    return out


def passages(docs, length=13):
    words = [BLACK.findall(t or "") for _, t in docs]
    least = {}
    for (i, _), w in zip(docs, words, strict=True):
        for k in range(len(w) - length + 1 if i is not None else 0):
            g = tuple(w[k : k + length])
            least[g] = min(i, least.get(g, i))
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = set()
        for k in range(len(w) - length + 1 if i is not None else 0):
            if least[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


FUNNELS = {
    "A": (("view", "click", "view", "purchase"), "error"),
    "B": (("signup", "view", "click", "purchase"), "error"),
    "C": (("click", "click", "purchase", "view"), "signup"),
}


def funnels(clicks):
    """Rows of (client, kind, microseconds)."""
    streams = defaultdict(lambda: defaultdict(set))
    for c, k, t in clicks:
        if None not in (c, k, t):
            streams[c][k].add(t)
    out = []
    for name, (steps, excluded) in FUNNELS.items():
        for c, kinds in streams.items():
            n, times = [0] * 4, [[], [], []]
            for at in kinds[steps[0]]:
                n[0] += 1
                for k, kind in enumerate(steps[1:]):
                    later = [t for t in kinds[kind] if t > at]
                    to = min(later, default=None)
                    if to is None or to - at > 900_000_000 or any(at < x <= to for x in kinds[excluded]):
                        break
                    n[k + 1] += 1
                    times[k].append(to - at)
                    at = to
            if n[0]:
                out.append((name, c, *n, max(k + 1 for k in range(4) if n[k]), *(sorted(x)[-(-50 * len(x) // 100) - 1] if x else None for x in times)))
    depth = Counter((r[0], r[6]) for r in out)
    return [(*r, depth[r[0], r[6]]) for r in out]


def fill(docs, rate=100, suffix_first=50):
    out = []
    for i, t in docs:
        t = t or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
        n = len(units)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
            out.append((i, n, "plain", None, None, sha(t), sha(t)))
        elif h[3] % 100 < suffix_first:
            out.append((i, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(t)))
        else:
            out.append((i, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(t)))
    return out
