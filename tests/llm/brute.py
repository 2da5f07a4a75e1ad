"""Plain versions of the operators, for small inputs."""

import math
import re
from collections import Counter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def tokens(text):
    return TOKEN.findall((text or "").translate(LOWER))


def contamination(text, items, n=13):
    """(words, hit words, sorted items)"""
    w, hit, found = words(text), set(), set()
    for item, said in items:
        b = words(said)
        size = min(n, len(b))
        if item is None or not size:
            continue
        for window in {tuple(b[i : i + size]) for i in range(len(b) - size + 1)}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) == window:
                    hit.update(range(i, i + size))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """{source: target} by resharing the excess until none is above its cap."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


class Groups:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def grams(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar(texts, threshold=0.8):
    """(links per text, groups) by comparing all pairs."""
    sets, g, links = [grams(t) for t in texts], Groups(len(texts)), [0] * len(texts)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= threshold * len(a | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                g.join(i, j)
    return links, [g.find(i) for i in range(len(texts))]


def without_later_runs(docs, least=51):
    """{(doc_id, text): text left} for distinct documents in order.

    By the definition: every run of lines of at least ``least`` words that also starts at an earlier place goes.
    """
    docs = sorted(set(docs), key=lambda d: (d[0] is not None, d[0]))
    first, out = {}, {}
    for n, doc in enumerate(docs):
        lines = (doc[1] or "").split("\n")
        full = [(k, x) for k, x in ((k, x.strip(" \t\n\v\f\r")) for k, x in enumerate(lines)) if x]
        size, gone = [len(TOKEN.findall(x)) for _, x in full], set()
        for a in range(len(full)):
            words, name, last = 0, 0, None
            for b in range(a, len(full)):
                words += size[b]
                name = hash((name, full[b][1]))
                if words >= least and first.setdefault(name, (n, a)) != (n, a):
                    last = b
            if last is not None:
                gone.update(range(full[a][0], full[last][0] + 1))
        out[doc] = None if doc[1] is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text):
    """kind:start:end of the patterns' spans."""
    out = []
    for kind, rx in PII.items():
        for m in re.finditer(rx, text or ""):
            d = [int(c) for c in m[0] if c in "0123456789"]
            good = True
            if kind == "ip":
                good = all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))
            elif kind == "card":
                good = 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0
            elif kind == "phone":
                good = 9 <= len(d) <= 15
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def unigram(train, texts):
    """(N, [(tokens, known, log10 probability)]) of the add-one model."""
    count = Counter(w for t in train for w in [*tokens(t), None])
    n, v = sum(count.values()), len(count)
    return n, [(len(w), sum(count[x] > 0 for x in w), sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) for w in ([*tokens(t), None] for t in texts)]


def canonical(kind, m):
    if kind == "email":
        return kind, m.lower()
    if kind == "ip":
        return kind, ".".join(p.lstrip("0") or "0" for p in m.split("."))
    return kind, "".join(c for c in m if c in "0123456789")


def disclosing_terms(docs, threshold=0.9, context=80):
    """{row: {(start, end)}} of terms that tell an entity near them, by corpus counts, wherever they stand in its documents."""
    term = re.compile(r"[^\W\d_]\w+")
    joint, near, n_c, holds = Counter(), {}, Counter(), {}
    for row, text in enumerate(docs):
        good = set(personal(text))
        for kind, rx in PII.items():
            found = list(re.finditer(rx, text or ""))
            edges = [0, *(e for m in found for e in m.span()), len(text or "")]
            for k, m in enumerate(found):
                if f"{kind}:{m.start()}:{m.end()}" not in good:
                    continue
                before, after = text[edges[2 * k] : m.start()], text[m.end() : edges[2 * k + 3]]
                if len(before) > context:
                    before = re.sub(r"^\w+", "", before[-context:])
                if len(after) > context:
                    after = re.sub(r"\w+$", "", after[:context])
                entity = canonical(kind, m[0])
                n_c[entity] += 1
                holds.setdefault(row, set()).add(entity)
                for said in (before, after):
                    for t in term.findall(said.lower()):
                        joint[entity, t] += 1
                        near.setdefault((entity, t), set()).add((before, after))
    n_t = Counter(w for t in docs for w in term.findall((t or "").lower()))
    n = sum(n_t.values())
    told = {(e, t) for (e, t), seen in near.items() if len(seen) > 1 and t in n_t and math.log(joint[e, t] * n / (n_c[e] * n_t[t])) >= threshold * math.log(n / n_c[e]) - 1e-12}
    out = {}
    for row, entities in holds.items():
        base = [tuple(map(int, s.split(":")[1:])) for s in personal(docs[row])]
        for m in term.finditer(docs[row]):
            if any((e, m[0].lower()) in told for e in entities) and not any(x < m.end() and m.start() < y for x, y in base):
                out.setdefault(row, set()).add(m.span())
    return out
